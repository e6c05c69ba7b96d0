"""Rows and entities for training and test."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_class_rows(obs: DataFrame) -> DataFrame:
    return obs.where("variable != -1")


def class_rows(obs: DataFrame) -> DataFrame:
    return obs.where("variable = -1").select("entity", F.col("value").cast("int").alias("class"))


def drop_null_keys(obs: DataFrame) -> DataFrame:
    return obs.dropna(subset=["entity", "variable", "value"])


def ratio_split(obs: DataFrame, ratio: float) -> DataFrame:
    """(entity, role): the first floor(n * ratio) entities by id train, a null id the last; the ratio is the decimal as it is written."""
    ids = obs.select("entity").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("entity")))
    return ids.select("entity", F.when(rank <= F.floor(n * F.lit(Decimal(str(ratio)))), "train").otherwise("test").alias("role"))


def hash_rank(c: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def forecast_manifest(obs: DataFrame, ratio: float, holdout: float, seed: int = 0) -> DataFrame:
    """(entity, role, regime, cut_time): a seeded share of entities is held out whole; the others are cut in time."""
    per = obs.groupBy("entity").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.orderBy(hash_rank(F.col("entity"), seed), "entity"))
    held = rank <= F.least(F.bround(n * F.lit(holdout)), n - 1)
    cut = F.col("t0") + F.lit(ratio) * (F.col("t1") - F.col("t0"))
    return per.select("entity", held.alias("held"), cut.alias("cut")).select(
        "entity", F.when(F.col("held"), "holdout").otherwise("train").alias("role"), F.when(F.col("held"), "new").otherwise("seen").alias("regime"), F.when(~F.col("held"), F.col("cut")).alias("cut_time")
    )


def training_rows(obs: DataFrame, manifest: DataFrame, horizon: int) -> DataFrame:
    """Rows of trained entities up to `horizon` before the cut."""
    m = manifest.where("role = 'train'").select("entity", "cut_time")
    return obs.join(m, "entity").where(F.col("time") <= F.col("cut_time") - horizon).drop("cut_time")
