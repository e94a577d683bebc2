"""Chunks of documents: sections, code and table blocks, sizes, sentences, and structure.

What needs no memory of what came before is a column expression; the packing of paragraphs is a fold over each
document, which runs document by document in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Patterns of code and table blocks, in order of search. A dot matches line feeds too.
CODE_BLOCKS = (r"(?s)```.*?```", r"(?s)<code>.*?</code>", r"(?s)<pre>.*?</pre>")
TABLE_BLOCKS = (r"(?s)\|.*\|.*\n\|[-\s\|]*\|.*\n(?:\|.*\|.*\n)*", r"(?s)<table>.*?</table>")


def detect_sections(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, section_no, title, start_line, end_line, content) of each section with a body. A line that is a
    heading opens one; lines before the first are the "Introduction"."""
    lines = df.select(key, F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    s = T.strip(F.col("line"))
    mark = F.regexp_extract(s, r"\A#{1,6}" + T.WS + r"+(.+)\z", 1)
    number = F.regexp_extract(s, r"\A\p{Nd}+\." + T.WS + r"+(.+)\z", 1)
    title = F.when(mark != "", mark).when(number != "", number)
    lines = lines.withColumn("title", title)
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("section_no", F.sum(F.col("title").isNotNull().cast("int")).over(order))
    body = F.when(F.col("title").isNull(), F.struct("line_no", "line"))
    grouped = lines.groupBy(key, "section_no").agg(F.coalesce(F.max("title"), F.lit("Introduction")).alias("title"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_sort(F.collect_list(body)).alias("body"))
    joined = grouped.withColumn("content", F.array_join(F.transform("body", lambda x: x["line"]), "\n")).drop("body")
    return joined.where(T.strip(F.col("content")) != "")


def may_have(c: Column, pattern: str) -> Column:
    """A cheap test that a pattern needs to match: without a table's ruler, the search for one would try
    every pair of bars."""
    return c.rlike(r"\n\|[-\s|]*\|") if pattern == TABLE_BLOCKS[0] else F.lit(True)


def labelled(section: str, kind: str):
    return lambda b: F.struct(F.lit(section).alias("section"), F.lit(kind).alias("chunk_type"), T.strip(b).alias("block"))


def blocks(c: Column) -> Column:
    """Array of (section, chunk_type, block): code blocks by pattern, then tables."""
    found = []
    for section, kind, patterns in (("code_block", "code", CODE_BLOCKS), ("table", "table", TABLE_BLOCKS)):
        for p in patterns:
            each = F.when(may_have(c, p), F.regexp_extract_all(c, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
            found.append(F.transform(each, labelled(section, kind)))
    return F.concat(*found)


def extract_blocks(df: DataFrame, key: str = "doc_id", content: str = "content", most: int = 512, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, section, chunk_type, content) of code and table blocks, split by size."""
    parts = F.flatten(F.transform(blocks(F.col(content)), lambda b: F.transform(T.parts_by_size(b["block"], most, overlap), lambda p: F.struct(b["section"].alias("section"), b["chunk_type"].alias("chunk_type"), p.alias("content")))))
    return df.select(key, F.posexplode(parts).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")


def without_blocks(c: Column) -> Column:
    for p in (*CODE_BLOCKS, *TABLE_BLOCKS):
        c = F.when(may_have(c, p), T.replace(c, p, "")).otherwise(c) if p == TABLE_BLOCKS[0] else T.replace(c, p, "")
    return T.strip(T.replace(c, r"\n\s*\n", "\n\n"))


def split_by_size(df: DataFrame, key: str = "doc_id", content: str = "content", most: int = 512, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, content) of parts of fixed size."""
    return df.select(key, F.posexplode(T.parts_by_size(F.col(content), most, overlap)).alias("chunk_index", "content"))


def sentence_pack(c: Column, most: int = 512, overlap: int = 50) -> Column:
    """Array of packs of whole sentences of at most ``most`` characters; a longer sentence stands alone, and
    if it is the last it is split by size."""
    sentences = F.filter(F.transform(F.split(c, T.SENTENCE_END), T.strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        joint = F.when(s.rlike(T.CJK), F.lit("。")).otherwise(F.lit(". "))
        longer = F.when(acc["open"] != "", F.concat(acc["open"], joint, s)).otherwise(s)
        full = (F.length(longer) > most) & (acc["open"] != "")
        return F.struct(F.when(full, F.concat(acc["done"], F.array(T.strip(acc["open"])))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(longer).alias("open"))

    def finish(acc):
        last = F.when(F.length(acc["open"]) <= most, F.array(T.strip(acc["open"]))).otherwise(F.transform(T.parts_by_size(acc["open"], most, overlap), T.strip))
        return F.concat(acc["done"], F.filter(last, lambda p: p != ""))

    return F.aggregate(sentences, start, step, finish)


def sentence_packs(df: DataFrame, key: str = "doc_id", content: str = "content", most: int = 512, overlap: int = 50) -> DataFrame:
    """(key, pack_no, pack): ``sentence_pack`` row by row, in Arrow batches, for texts of any length: each sentence is
    looked at once."""
    packer = Packer(most, overlap, False)

    def rows(batches):
        for batch in batches:
            found = [packer.sentences(t or "") for t in batch.column("content").to_pylist()]
            n = [len(x) for x in found]
            at = pa.array(np.repeat(np.arange(len(n)), n))
            number = np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if n else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(number), pa.array([p for x in found for p in x], pa.string())], names=[key, "pack_no", "pack"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(content).alias("content")).mapInArrow(rows, f"{key} {kind}, pack_no int, pack string")


# ---------------------------------------------------------------- structure

_SPACE = re.compile("[\t-\r\x1c-\x20\x85\xa0  -     　]+")
_HEADINGS = tuple(re.compile(p) for p in (r"#{1,6}\s+", r"\d+\.\s+", r"[A-Z][^.!?]*\Z"))
_SENTENCES, _CJK = re.compile("[.!?。．！？]+"), re.compile("[　-〿぀-鿿]")


class Packer:
    """Packs the paragraphs of one document into chunks."""

    def __init__(self, most: int, overlap: int, strict: bool):
        self.most, self.overlap, self.strict = most, overlap, strict

    def sized(self, s: str) -> list[str]:
        if len(s) <= self.most:
            return [s] if s else []
        step = self.most - self.overlap
        return [s[i : i + self.most] for i in range(0, -(-(len(s) - self.most) // step) * step + 1, step)]

    def sentences(self, paragraph: str) -> list[str]:
        done, held = [], ""
        for s in filter(None, map(str.strip, _SENTENCES.split(paragraph))):
            longer = f"{held}{'。' if _CJK.search(s) else '. '}{s}" if held else s
            if held and len(longer) > self.most:
                done.append(held)
                longer = s
            held = longer
        done.append(held)
        packs = [p for d in done[:-1] for p in (self.sized(d) if self.strict else [d])] + self.sized(done[-1])
        return [p.strip() for p in packs if p.strip()]

    def tail(self, s: str) -> str:
        w = s.split()
        return " ".join(w[-self.overlap :]) + " " if len(w) > self.overlap else s[-2 * self.overlap :]

    def chunks(self, content: str) -> list[tuple[str, str]]:
        """(section, chunk) in order."""
        out: list[tuple[str, str]] = []
        section, held = "main", ""
        for p in filter(None, map(str.strip, content.split("\n\n"))):
            if any(h.match(p) for h in _HEADINGS):
                if held.strip():
                    out.append((section, held.strip()))
                section, held = p[:50], ""
            if len(held) + 2 * bool(held) + len(p) <= self.most:
                held = f"{held}\n\n{p}" if held else p
                continue
            if held.strip():
                out.append((section, held.strip()))
                held = self.tail(held) + p
                if len(held) <= self.most:
                    continue
                p = held
            packs = self.sentences(p)
            out += [(section, x) for x in packs[:-1]]
            held = packs[-1] if packs else ""
        if held.strip():
            out.append((section, held.strip()))
        return out


def chunk_documents(df: DataFrame, most: int = 512, overlap: int = 50, strict_max: bool = False) -> DataFrame:
    """Chunks of documents (doc_id, content, source_path): code and table blocks first, then what is left by
    structure; (doc_id, chunk_index, section, chunk_type, content, source_path)."""
    packer = Packer(most, overlap, strict_max)
    special = F.flatten(F.transform(blocks(F.col("content")), lambda b: F.transform(T.parts_by_size(b["block"], most, overlap), lambda p: F.struct(b["section"].alias("section"), b["chunk_type"].alias("chunk_type"), p.alias("content")))))
    prepared = df.select("doc_id", "source_path", special.alias("special"), without_blocks(F.col("content")).alias("rest"))
    kind = "array<struct<section:string,chunk_type:string,content:string>>"

    @F.pandas_udf(kind)
    def structured(rest: pd.Series) -> pd.Series:
        return rest.map(lambda t: [{"section": s, "chunk_type": "text", "content": c} for s, c in packer.chunks(t or "")])

    each = prepared.select("doc_id", "source_path", F.posexplode(F.concat(F.coalesce(F.col("special").cast(kind), F.array().cast(kind)), structured("rest"))).alias("chunk_index", "c"))
    return each.select("doc_id", "chunk_index", "c.section", "c.chunk_type", "c.content", "source_path")
