"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, collocations, fim, langid, licences, lzprint, packing, partenum, rollup, suffixes, topk
from .common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_bpe(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL3 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = c.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is added under two versions; the first load is committed twice, as
    after a lost acknowledgement; documents under 20 words are taken out; a third of the
    sources, by the last digit of their name, is counted anew."""
    d = table(spark, sf_dir, "documents")
    counts = Scratch(spark, "counts").keep(d.select("source", "lang", rollup.word_tokens(F.col("text")).alias("words"), rollup.letter_tokens(F.col("text")).alias("letters"), rollup.byte_tokens(F.col("text")).alias("bytes")))
    by_version = lambda rows: rows.select("source", "lang", F.explode(F.array(F.struct(F.lit("words-1").alias("version"), F.col("words").alias("tokens")), F.struct(F.lit("bytes-1").alias("version"), F.col("bytes").alias("tokens")))).alias("v")).select("source", "lang", "v.*")
    ledger = rollup.new_ledger(spark, "documents")
    for _ in range(2):
        ledger.commit("0001-load", rollup.inserts(by_version(counts)))
    ledger.commit("0002-short", rollup.deletes(by_version(counts.filter("words < 20"))))
    again = counts.filter("words >= 20 AND source RLIKE '[369]$'").select("source", "lang", F.lit("words-1").alias("version"), F.col("words").alias("old_tokens"), F.col("letters").alias("tokens"))
    ledger.commit("0003-recount", rollup.revisions(again))
    return ledger.totals()


SQL4 = r"""
WITH c AS (
  SELECT source, lang,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]')) AS letters,
    strlen(coalesce(text, '')) AS bytes
  FROM documents),
v AS (
  SELECT source, lang, 'words-1' AS version, CASE WHEN regexp_matches(source, '[369]$') THEN letters ELSE words END AS tokens FROM c WHERE words >= 20
  UNION ALL
  SELECT source, lang, 'bytes-1', bytes FROM c WHERE words >= 20)
SELECT source, lang, version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM v GROUP BY ALL
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_join(table(spark, sf_dir, "documents"))


SQL6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 75 * (x.n + y.n - same)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


SQL7 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


SQL8 = r"""
WITH large AS (SELECT conv_id, count(*) AS n, CAST(min(turn) AS DOUBLE) AS lo, CAST(max(turn) AS DOUBLE) AS hi FROM conversations GROUP BY conv_id HAVING count(*) > 8192),
m AS (
  SELECT c.conv_id, CAST(coalesce(floor((CAST(turn AS DOUBLE) - lo) / (hi - lo + 1) * (n // 512)), 0) AS BIGINT) AS segment, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations c LEFT JOIN large ON large.conv_id = c.conv_id WHERE c.conv_id IS NOT NULL),
who AS (SELECT DISTINCT conv_id, role AS assistant FROM m),
r AS (
  SELECT m.*, assistant, role = assistant AS own,
    CASE WHEN role = assistant THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
    '<|end|>' || chr(10) AS tail
  FROM m JOIN who USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + length(tail)) OVER (PARTITION BY conv_id, segment, assistant ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM r)
SELECT conv_id, segment, assistant, CAST(count(*) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_trained,
  string_agg(head || text || tail, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(text) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, segment, assistant
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(table(spark, sf_dir, "documents")).drop("spans")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return laid.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(('0x' || d[1:8]) AS BIGINT) AS h1, CAST(('0x' || d[9:16]) AS BIGINT) AS h2,
    CAST(('0x' || d[17:24]) AS BIGINT) AS h3, CAST(('0x' || d[25:32]) AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL12 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM t),
g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS a
  FROM p, unnest(range(1, 6)) AS x(m), unnest(range(1, len(w) - m + 2)) AS y(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, CAST(a AS HUGEINT) AS a, string_split(phrase, ' ') AS w FROM g WHERE a >= 100),
c AS (
  SELECT f.lang, f.phrase, f.m, f.a, k, l.a AS l, r.a AS r, n, CAST(1000 AS HUGEINT) * f.a * n // (l.a * r.a) AS score
  FROM f, unnest(range(1, m)) AS x(k) JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1 : k], ' ')
  JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1 : f.m], ' ') JOIN n ON n.lang = f.lang WHERE f.m > 1),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM f, unnest(range(2, m)) AS x(s), unnest(range(1, m - s + 2)) AS y(i) GROUP BY ALL),
o AS (
  SELECT b.*, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS BIGINT) AS rank
  FROM b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lzprint.against_neighbours(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language_id, op2_byte_bpe, op3_embedding_dedup, op4_token_counts, op5_license_scan, op6_ngram_jaccard, op7_exact_top_k, op8_chat_formatting, op9_suffix_dedup, op10_best_fit_packing, op11_fill_in_middle, op12_collocations, op13_document_fingerprints)
}
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": SQL3,
    "op4_token_counts": SQL4,
    "op6_ngram_jaccard": SQL6,
    "op7_exact_top_k": SQL7,
    "op8_chat_formatting": SQL8,
    "op11_fill_in_middle": SQL11,
    "op12_collocations": SQL12,
}
