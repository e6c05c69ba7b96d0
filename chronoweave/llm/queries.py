"""The queries of the training-data operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codec, decontam, hilbert, langid, line_dedup, lm_score, mixing, neardup, pii
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"), 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "class_id", "class_size", "stands")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.per_document(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    # beside the base spans the method's own decision: how many spans of any kind it found, secrets among them
    found, secrets = F.size("spans").cast("long"), F.size(F.filter("spans", lambda x: x["kind"] == "secret")).cast("long")
    return d.select("doc_id", *(count(k) for k in pii.KINDS[:4]), secrets.alias("n_secret"), found.alias("n_found"), (found > 0).alias("has_personal_data"), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def queries() -> dict:
    import corpus_pipeline

    ops = [op1_decontaminate, op2_lm_score, op3_token_output, op4_line_dedup, op5_shard, op6_mix, op7_language, op8_near_dedup, op9_neighbours, op10_personal_data]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL}
