"""The queries of this subpackage, by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from quillon.llm import common, decontam, jaccard, langid, licenses, packing, quality, repeats, tokenfile, unigram


def op5_compression_bands(spark, sf_dir):
    return quality.quality(common.documents(spark, sf_dir))


def op1_license_scan(spark, sf_dir):
    return licenses.licenses(common.documents(spark, sf_dir))


def op2_qgram_lemma(spark, sf_dir):
    return decontam.leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_elias_fano_tokens(spark, sf_dir):
    return tokenfile.read(tokenfile.write(common.documents(spark, sf_dir)))


def op4_byte_network(spark, sf_dir):
    return langid.identify(common.documents(spark, sf_dir))


def op6_dominance_packing(spark, sf_dir):
    return packing.pack(common.documents(spark, sf_dir))


def op7_prefix_doubling(spark, sf_dir):
    return repeats.suffix_dedup(common.documents(spark, sf_dir))


def op8_unigram_counts(spark, sf_dir):
    return unigram.count_tokens(common.documents(spark, sf_dir))


def op9_levelwise_doubling(spark, sf_dir):
    return repeats.substring_dedup(common.documents(spark, sf_dir))


def op10_token_group_matrix(spark, sf_dir):
    return jaccard.join(common.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_qgram_lemma, op3_elias_fano_tokens, op4_byte_network, op5_compression_bands, op6_dominance_packing, op7_prefix_doubling, op8_unigram_counts, op9_levelwise_doubling, op10_token_group_matrix)}

_WORDS = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"

#: Windows of 20 words by their digests, the first of equal ones apart; a word goes if one of the 20 windows that reach it
#: isn't a first one.
_REPEATS = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i : i + 19], ' '))) AS hs FROM d WHERE len(w) >= 20)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM h) WHERE nth > 1),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT p.doc_id, p.i, word, max(g.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS 19 PRECEDING) IS NOT NULL AS gone FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM r),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

#: All pairs that share a shingle, and what their links reach.
_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS g FROM d),
u AS (SELECT doc_id, n, hash(g) AS g FROM (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(g) AS n_shingles, component_id, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(g), chr(10)))) END AS class_id FROM s JOIN c USING (doc_id)"""

ORACLES: dict[str, str] = {"op9_levelwise_doubling": _REPEATS, "op10_token_group_matrix": _JACCARD}
