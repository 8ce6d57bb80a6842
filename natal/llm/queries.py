"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from natal.llm import (
    bpe,
    fill_in_middle,
    hard_negatives,
    html_tree,
    kneser_ney,
    multi_index,
    packing,
    quality,
    simhash,
    sketch,
    token_rollup,
    toxicity,
    warc,
)
from natal.llm.common import table, written
from natal.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


_WORDS = r"[^\x20\x09-\x0D]+"
_PARTS = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+"
_TOKENIZERS = {"words-1": _WORDS, "parts-2": _PARTS}


_NOTICES = ("licensed under", "all rights reserved")


def _without_notices(text):
    """A text without its licence lines."""

    def plain(line):
        return ~(F.lower(line).contains(_NOTICES[0]) | F.lower(line).contains(_NOTICES[1]))

    return F.array_join(F.filter(F.split(text, "\n"), plain), "\n")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents inserted; sources renamed to capitals and licence
    lines dropped, as a revision; texts under five words deleted; the revision once more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    cleaned = docs.withColumns({"text": _without_notices("text"), "source": F.upper("source")})
    tokenizers = {version: F.regexp_count("text", F.lit(pattern)) for version, pattern in _TOKENIZERS.items()}
    first, second = token_rollup.counted(docs, tokenizers), token_rollup.counted(cleaned, tokenizers)
    short = cleaned.filter(F.regexp_count("text", F.lit(_WORDS)) < 5)
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "token-rollup"))
    revised = token_rollup.revisions(first, second)
    rollup.commit("1", token_rollup.inserts(first))
    rollup.commit("2", revised)
    rollup.commit("3", token_rollup.deletes(token_rollup.counted(short, tokenizers)))
    rollup.commit("2", revised)
    return rollup.totals()


OP4_SQL = r"""
WITH lines AS (SELECT upper(source) AS source, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
cleaned AS (
  SELECT source, lang, array_to_string(list_filter(l, lambda x: NOT (contains(lower(x), 'licensed under')
         OR contains(lower(x), 'all rights reserved'))), chr(10)) AS text
  FROM lines),
counted AS (
  SELECT source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
         len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+')) AS p
  FROM cleaned),
kept AS (SELECT * FROM counted WHERE w >= 5)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS documents, CAST(sum(w) AS BIGINT) AS tokens FROM kept GROUP BY ALL
UNION ALL
SELECT source, lang, 'parts-2', count(*), CAST(sum(p) AS BIGINT) FROM kept GROUP BY ALL
"""


BPE_VERSION = "byte_bpe_50k"


def token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of ``op4_token_counts`` on the ids of a public tokenizer; texts under five tokens are deleted.

    Each text is encoded once. A revised text is encoded only where it differs; elsewhere the revision
    carries the count over, so that its change of tokens is none.
    """
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    cleaned = _without_notices("text")
    both = docs.withColumn("revised", F.when(cleaned != F.col("text"), cleaned))
    counts = token_rollup.with_token_counts(both, {"tokens": "text", "revised_tokens": "revised"})
    counts = written(counts.withColumn("tokenizer", F.lit(BPE_VERSION)), "token-counts")
    first = counts.select("source", "lang", "tokenizer", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    second = counts.select(
        F.upper("source").alias("source"), "lang", "tokenizer", F.coalesce("revised_tokens", "tokens", F.lit(0)).alias("tokens")
    )
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "token-rollup"))
    revised = token_rollup.revisions(first, second)
    rollup.commit("1", token_rollup.inserts(first))
    rollup.commit("2", revised)
    rollup.commit("3", token_rollup.deletes(second.filter("tokens < 5")))
    rollup.commit("2", revised)
    return rollup.totals()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))


def op7_multi_index_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"), scale=sketch.SHORT_SCALE)


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


OP12_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
marked AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM payloads)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM marked
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM docs),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_best_fit_packing,
        op3_bpe_round_trip,
        op4_token_counts,
        token_counts_bpe,
        op5_quality,
        op6_kneser_ney,
        op7_multi_index_near_dedup,
        op8_simhash_near_dedup,
        op9_scaled_sketch,
        op10_html_main_text,
        op11_hard_negatives,
        op12_warc,
        op13_fill_in_middle,
    )
}
ORACLES: dict[str, str] = {"op4_token_counts": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
