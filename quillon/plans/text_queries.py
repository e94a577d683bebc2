"""Queries on text preparation and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking
from quillon.plans.registry import WS, query, strip, table, words


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumnRenamed("text", "content")


@query(rf"SELECT doc_id, md5({strip(f"regexp_replace(text, '{WS}+', ' ', 'g')")}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_text(F.col("content"))).alias("digest"))


_NORMAL = strip(rf"regexp_replace(regexp_replace(regexp_replace(lower({strip('text')}), '{WS}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\-\.\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g'), '\.{{2,}}', '.', 'g')")


@query(f"SELECT item_id, {_NORMAL} AS normalized FROM benchmark")
def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_query(F.col("text")).alias("normalized"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"SELECT item_id, array_to_string(list_filter({words('text')}, lambda w: NOT list_contains([{_STOP}], lower(w)) AND length(w) > 2), ' ') AS keywords FROM benchmark")
def extract_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(f"SELECT conv_id, turn, CASE WHEN n < 5 THEN 2 WHEN n < 10 THEN 3 ELSE 4 END AS multiplier FROM (SELECT conv_id, turn, len({words('text')}) AS n FROM conversations)")
def adaptive_multiplier(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.adaptive_multiplier(F.col("text")).alias("multiplier"))


@query(rf"""SELECT doc_id, line_no, (regexp_matches(s, '\A#{{1,6}}{WS}+') OR regexp_matches(s, '\A\p{{Nd}}+\.{WS}+') OR regexp_matches(s, '\A[A-Z][^.!?]*\z')) AS heading
FROM (SELECT doc_id, line_no, {strip('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents))""")
def is_heading(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.is_heading(F.col("line")).alias("heading"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
h AS (SELECT doc_id, line, line_no, CASE WHEN regexp_matches({strip('line')}, '\A#{{1,6}}{WS}+.+\z') THEN regexp_extract({strip('line')}, '\A#{{1,6}}{WS}+(.+)\z', 1) WHEN regexp_matches({strip('line')}, '\A\p{{Nd}}+\.{WS}+.+\z') THEN regexp_extract({strip('line')}, '\A\p{{Nd}}+\.{WS}+(.+)\z', 1) END AS title FROM l),
s AS (SELECT *, sum(CASE WHEN title IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM h)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, coalesce(max(title), 'Introduction') AS title, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line, md5(coalesce(string_agg(CASE WHEN title IS NULL THEN line END, chr(10) ORDER BY line_no), '')) AS digest
FROM s GROUP BY doc_id, section_no HAVING {strip("coalesce(string_agg(CASE WHEN title IS NULL THEN line END, chr(10) ORDER BY line_no), '')")} <> ''""")
def detect_sections(spark, sf_dir):
    return chunking.detect_sections(docs(spark, sf_dir)).withColumn("digest", F.md5("content")).drop("content")


_FENCED = "chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'tail <pre> ' || source || ' </pre>'"


@query(rf"""WITH c AS (SELECT doc_id, {_FENCED} AS t FROM documents),
b AS (SELECT doc_id, list_concat(regexp_extract_all(t, '(?s)```.*?```'), regexp_extract_all(t, '(?s)<pre>.*?</pre>')) AS found FROM c),
u AS (SELECT doc_id, unnest(list_transform(found, lambda x: {strip('x')})) AS block, generate_subscripts(found, 1) AS no FROM b),
p AS (SELECT doc_id, no, i, substr(block, CAST(i * 462 + 1 AS BIGINT), 512) AS part FROM u, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(block) - 512) / 462.0)) AS BIGINT) + 1)) AS i))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, i) - 1 AS INTEGER) AS chunk_index, 'code_block' AS section, md5(part) AS digest FROM p""")
def extract_code_blocks(spark, sf_dir):
    fence = F.concat(F.lit("\n```\n"), F.col("content"), F.lit("\n```\ntail <pre> "), F.col("source"), F.lit(" </pre>"))
    found = chunking.extract_blocks(docs(spark, sf_dir).withColumn("content", fence))
    return found.select("doc_id", "chunk_index", "section", F.md5("content").alias("digest"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, CAST(i * 462 + 1 AS BIGINT), 512)) AS digest
FROM documents, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(text) - 512) / 462.0)) AS BIGINT) + 1)) AS i) WHERE length(text) > 0""")
def split_by_size(spark, sf_dir):
    return chunking.split_by_size(docs(spark, sf_dir)).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?。．！？]+'), lambda x: {strip('x')}), lambda x: x <> '') AS a FROM documents),
f AS (SELECT doc_id, a, 0 AS i, '' AS open, CAST(NULL AS VARCHAR) AS done, 0 AS n FROM s
UNION ALL SELECT doc_id, a, i + 1,
 CASE WHEN open = '' THEN a[i + 1] WHEN length(open) + length(a[i + 1]) + CASE WHEN regexp_matches(a[i + 1], '[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{9fff}}]') THEN 1 ELSE 2 END > 512 THEN a[i + 1] ELSE open || CASE WHEN regexp_matches(a[i + 1], '[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{9fff}}]') THEN '。' ELSE '. ' END || a[i + 1] END,
 CASE WHEN open <> '' AND length(open) + length(a[i + 1]) + CASE WHEN regexp_matches(a[i + 1], '[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{9fff}}]') THEN 1 ELSE 2 END > 512 THEN open END,
 n + CASE WHEN open <> '' AND length(open) + length(a[i + 1]) + CASE WHEN regexp_matches(a[i + 1], '[\x{{3000}}-\x{{303f}}\x{{3040}}-\x{{9fff}}]') THEN 1 ELSE 2 END > 512 THEN 1 ELSE 0 END
 FROM f WHERE i < len(a)),
last AS (SELECT doc_id, open, n FROM f WHERE i = len(a) AND open <> ''),
tail AS (SELECT doc_id, n, k, {strip('substr(open, CAST(k * 462 + 1 AS BIGINT), 512)')} AS pack FROM last, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(open) - 512) / 462.0)) AS BIGINT) + 1)) AS k)),
every AS (SELECT doc_id, n - 1 AS n, 0 AS k, done AS pack FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, n, k, pack FROM tail WHERE pack <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INTEGER) AS pack_no, md5(pack) AS digest FROM every""")
def sentence_pack(spark, sf_dir):
    return chunking.sentence_packs(docs(spark, sf_dir)).select("doc_id", "pack_no", F.md5("pack").alias("digest"))


@query(rf"""SELECT doc_id, CASE WHEN len(w) > 50 THEN array_to_string(w[len(w) - 49 : len(w)], ' ') || ' ' ELSE right(text, 100) END AS tail FROM (SELECT doc_id, text, {words('text')} AS w FROM documents)""")
def overlap_tail(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.overlap_tail(F.col("content")).alias("tail"))


@query()
def chunk_by_structure(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("content", F.regexp_replace("content", "\n", "\n\n")).withColumnRenamed("source", "source_path")
    return chunking.chunk_documents(d).select("doc_id", "chunk_index", "section", "chunk_type", F.md5("content").alias("digest"))


_PLAIN = "html"
for _p in T.DROPPED:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p.replace(chr(39), chr(39) * 2)}', '', 'g')"
for _e, _t in T.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_e}', '{_t.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, md5({_PLAIN}) AS digest, length({_PLAIN}) AS n_chars FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query(rf"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,，、\n]+'), lambda p: {strip('p')}), lambda p: p <> '')[1:5], '|') AS keywords FROM conversations""")
def parse_expansion(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.parse_expansion(F.col("text")), "|").alias("keywords"))


@query(rf"SELECT item_id, md5(lower({strip('text')}) || '|' || 'a,b' || '|' || '10') AS key FROM benchmark")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.cache_key(F.col("text"), F.array(F.lit("b"), F.lit("a")), F.lit(10)).alias("key"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.' || k) AS value, k AS name FROM events, LATERAL (SELECT unnest(json_keys(props)) AS k)")
def json_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
