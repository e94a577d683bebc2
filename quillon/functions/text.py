"""Text expressions: columns in, columns out, all inside the JVM.

Regular expressions spell out Unicode classes, so that they mean the same in Spark and in other engines:
``WS`` is what Python's ``str.split`` takes for white space, ``WORD`` what ``\\w`` matches.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_QUERY = r"[^\p{L}\p{N}_\-\.\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{3000}-\x{303f}\x{3040}-\x{9fff}]"
SENTENCE_END = r"[.!?。．！？]+"
HEADING = (r"\A#{1,6}" + WS + "+", r"\A\p{Nd}+\." + WS + "+", r"\A[A-Z][^.!?]*\z")

#: Words that are no keywords.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should")

#: Markup that leaves no text, then all other tags; comments and bodies first, each for itself.
DROPPED = (r"(?is)<!--.*?-->", r"(?is)<!doctype[^>]*>", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)<template\b[^>]*>.*?</template\s*>", r"<(?:\"[^\"]*\"|'[^']*'|[^'\">])*>")
#: Entities by their text; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Any other entity but the ampersand's.
ENTITY = r"&(?!amp;)(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return replace(replace(c, r"\A" + WS + "+", ""), WS + r"+\z", "")


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def normalize_text(c: Column) -> Column:
    return strip(replace(c, WS + "+", " "))


def normalize_query(c: Column) -> Column:
    """Lower case; one space for a run of white space; without characters other than words, - and .; one
    stop for several. Spaces left where something was removed stay double."""
    spaced = replace(F.lower(strip(c)), WS + "+", " ")
    return strip(replace(replace(spaced, NOT_QUERY, ""), r"\.{2,}", "."))


def keywords(c: Column, stop_words=STOP_WORDS) -> Column:
    """Words of three characters or more that are no stop words, as they are and in order."""
    stop = F.array(*(F.lit(w) for w in stop_words))
    return F.filter(words(c), lambda w: ~F.array_contains(stop, F.lower(w)) & (F.length(w) > 2))


def adaptive_multiplier(c: Column) -> Column:
    """Candidates per result: 2 below 5 words, 3 below 10, else 4."""
    n = F.size(words(c))
    return F.when(n < 5, 2).when(n < 10, 3).otherwise(4)


def is_heading(c: Column) -> Column:
    s = strip(c)
    found = s.rlike(HEADING[0])
    for pattern in HEADING[1:]:
        found = found | s.rlike(pattern)
    return found


def overlap_tail(c: Column, overlap: int = 50) -> Column:
    """The last ``overlap`` words and a space, if there are more; else the last 2 * overlap characters."""
    w = words(c)
    return F.when(F.size(w) > overlap, F.concat(F.array_join(F.slice(w, -overlap, overlap), " "), F.lit(" "))).otherwise(F.right(c, F.lit(2 * overlap)))


def parse_expansion(c: Column, most: int = 5) -> Column:
    """Keywords of a model's answer: split at commas and line feeds, trimmed, blanks dropped, at most ``most``
    (between 1 and 10)."""
    parts = F.transform(F.split(c, r"[,，、\n]+"), strip)
    return F.slice(F.filter(parts, lambda p: p != ""), 1, max(1, min(10, most)))


def character(entity: Column) -> Column:
    """The character of an entity, named (HTML 4) or by number; what is none stays."""
    body = F.substr(entity, F.lit(2), F.length(entity) - 2)
    digits = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2))).cast("int")
    named = F.element_at(F.create_map(*(F.lit(x) for kv in name2codepoint.items() for x in kv)), body)
    code = F.coalesce(digits, named)
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def unescape(c: Column) -> Column:
    """The text with its entities as characters."""
    for entity, text in ENTITIES[:-1]:
        c = F.replace(c, F.lit(entity), F.lit(text))
    between, found = F.split(c, ENTITY), F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0))
    rest = F.zip_with(F.transform(found, character), F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))), lambda e, t: F.concat(e, t))
    entity, text = ENTITIES[-1]
    return F.replace(F.when(c.rlike(ENTITY), F.concat(between[0], F.array_join(rest, ""))).otherwise(c), F.lit(entity), F.lit(text))


def html_to_text(c: Column) -> Column:
    """Text of a page: no separator between blocks, without scripts, styles, templates and comments."""
    for pattern in DROPPED:
        c = replace(c, pattern, "")
    return unescape(c)


def parts_by_size(c: Column, most: int = 512, overlap: int = 50) -> Column:
    """Array of parts of at most ``most`` characters, each starting ``most`` - ``overlap`` after the one
    before; an empty text has none."""
    if overlap >= most:
        raise ValueError("overlap must be less than the size")
    step = most - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(c) - most) / F.lit(float(step)))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(c, i * step + 1, F.lit(most)))
    return F.when(F.length(c) > 0, parts).otherwise(F.array().cast("array<string>"))


def cache_key(query: Column, keywords_: Column, top_k: Column) -> Column:
    """A digest that ignores case, outer space and the order of keywords."""
    return F.md5(F.concat_ws("|", F.lower(strip(query)), F.array_join(F.array_sort(keywords_), ","), top_k.cast("string")))
