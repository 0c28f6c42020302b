"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import language, licenses, mixing, packing, quality, secrets, sharding, simhash, suffixes, vectors
from tickloom.llm.common import table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identified(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (~F.coalesce(language.learns(F.col("doc_id")), F.lit(True))).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_vectors": op6_vectors,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
}

#: The targets by filling in order of size per weight; the slots that the golden-ratio points give each source; and
#: of each document the words that its source's slots read in up to three rounds, and the slot that reads it first.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM t),
w AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS bound FROM r),
f AS (SELECT *, coalesce(sum(bound) OVER (ORDER BY bound / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound_before,
    sum(weight) OVER (ORDER BY bound / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from, sum(source_size) OVER () AS total FROM w),
h AS (SELECT *, (total - bound_before) / weight_from AS share, bound <= (total - bound_before) / weight_from * weight AS held FROM f),
g AS (SELECT *, CASE WHEN held THEN bound ELSE least(bound, max(share) FILTER (NOT held) OVER () * weight) END AS target FROM h),
o AS (SELECT sid, CAST(floor(target) AS BIGINT) AS goal FROM g WHERE target >= 1),
b AS (SELECT CAST(sum(goal) AS BIGINT) AS whole, greatest(1, least(1024, CAST(sum(goal) AS BIGINT) // 65536)) AS block FROM o),
i AS (SELECT sid, CAST(sum(goal) OVER (ORDER BY sid) - goal AS DOUBLE) / whole AS since, CAST(sum(goal) OVER (ORDER BY sid) AS DOUBLE) / whole AS upto FROM o, b),
s AS (SELECT u.slot, ((u.slot + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS point FROM b, unnest(generate_series(0, (whole + block - 1) // block - 1)) AS u(slot)),
k AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM s JOIN i ON point >= since AND point < upto),
n AS (SELECT sid, count(*) * max(block) AS read FROM k, b GROUP BY sid),
p AS (SELECT d.doc_id, d.size, g.sid, g.source_size, g.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY g.sid ORDER BY md5(concat(d.doc_id, '|17|', d.key)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT p.doc_id, p.size, p.source_size, p.target, k.slot AS first_slot, CAST(coalesce(greatest(0, least(p.begin + p.size, n.read) - p.begin)
    + greatest(0, least(p.begin + p.source_size + p.size, n.read) - p.begin - p.source_size)
    + greatest(0, least(p.begin + 2 * p.source_size + p.size, n.read) - p.begin - 2 * p.source_size), 0) AS BIGINT) AS taken
FROM p CROSS JOIN b LEFT JOIN n ON n.sid = p.sid LEFT JOIN k ON k.sid = p.sid AND k.rank = p.begin // b.block AND p.size > 0
"""

ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL}
