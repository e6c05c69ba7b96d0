"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontam, hilbert, langid, mixing, neardup
from chronoweave.llm.common import fresh, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, as they came. Texts without a letter, null ones included, go; so do all
    where no row is labelled."""
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    names = tuple(fresh(x, docs.columns) for x in ("_lang", "_score", "_rejected"))
    return langid.predict(docs, model, keep=tuple(docs.columns), names=names).where(~F.col(names[2])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; texts without words stay, equal rows of them once."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of `benchmark` to count as contaminated; texts without words hold nothing of it."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from not at all to twice; those without words once. A null source is a source."""
    return mixing.resampled(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return hilbert.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Signatures, k-means and seeded permutations are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table `documents` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
