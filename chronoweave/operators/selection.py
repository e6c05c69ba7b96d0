"""Scores of patterns by how their prefixes differ between two classes, and the patterns selected by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mining import name


def single_instances(sti: DataFrame) -> DataFrame:
    """Instances of one symbol, in the form of those of more."""
    return sti.select("entity", F.array("pos").alias("at"), F.array("state").alias("symbols"), F.array().cast("array<int>").alias("rels"), F.col("start").alias("start_a"), F.col("end").alias("last_end"))


def class_statistics(levels: Sequence[DataFrame], classes: DataFrame) -> DataFrame:
    """(pattern, class, vs, hs, mmd) of the instances of several sizes: share of the class's entities, mean instances of
    one, mean over them of mean duration; three digits."""
    rows = None
    for x in levels:
        one = x.groupBy(name().alias("pattern"), "entity").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("last_end") - F.col("start_a")).alias("d"))
        rows = one if rows is None else rows.unionByName(one)
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("of"))
    per = rows.join(classes, "entity").groupBy("pattern", "class").agg(F.count(F.lit(1)).alias("vs"), F.avg("n").alias("hs"), F.avg("d").alias("mmd"))
    return per.join(F.broadcast(sizes), "class").select("pattern", "class", F.round(F.col("vs") / F.col("of"), 3).alias("vs"), F.round("hs", 3).alias("hs"), F.round("mmd", 3).alias("mmd"))


def prefixes(patterns: DataFrame) -> DataFrame:
    """(pattern, size, k, prefix) of patterns (symbols, rels): their first k symbols, k = 1 .. size."""
    x = patterns.select("symbols", "rels", F.size("symbols").alias("size"), F.explode(F.sequence(F.lit(1), F.size("symbols"))).alias("k"))
    x = x.withColumn("s", F.expr("slice(symbols, 1, k)")).withColumn("r", F.expr("slice(rels, 1, cast(k * (k - 1) / 2 as int))"))
    return x.select(name().alias("pattern"), "size", "k", name("s", "r").alias("prefix"))


def prefix_scores(patterns: DataFrame, stats: DataFrame) -> DataFrame:
    """(pattern, diff_vs, diff_hs, diff_mmd, mean_squared_mmd, mean_diff_vs): class 1 less class 0 for the prefix that
    lacks the last symbol, and means over all shorter prefixes; a class without the prefix counts 0."""
    of = lambda c: stats.where(F.col("class") == c).select(F.col("pattern").alias("prefix"), *(F.col(m).alias(f"{m}{c}") for m in ("vs", "hs", "mmd")))
    x = prefixes(patterns).where("k < size").join(of(0), "prefix", "left").join(of(1), "prefix", "left").fillna(0.0)
    diff = lambda m: F.col(f"{m}1") - F.col(f"{m}0")
    last = lambda m: F.round(F.max(F.when(F.col("k") == F.col("size") - 1, diff(m))), 3).alias(f"diff_{m}")
    return x.groupBy("pattern").agg(last("vs"), last("hs"), last("mmd"), F.round(F.avg(diff("mmd") * diff("mmd")), 3).alias("mean_squared_mmd"), F.round(F.avg(diff("vs")), 3).alias("mean_diff_vs"))


def selected(scores: DataFrame, methods: Sequence[str], sizes: Sequence[int], seed: int | None = None) -> DataFrame:
    """Adds 0/1 columns `binary_<method>_<size>` for the best by each method (ties: by name), with a seed
    `binary_random_<size>` for nested draws, and `binary_all` for the union."""
    every = Window.partitionBy(F.lit(0))
    rank = {m: F.row_number().over(every.orderBy(F.desc_nulls_last(m), "pattern")) for m in methods}
    if seed is not None:
        rank["random"] = F.row_number().over(every.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "pattern")), "pattern"))
    flags = {f"binary_{m}_{n}": (r <= n).cast("int") for m, r in rank.items() for n in sizes}
    out = scores.withColumns(flags)
    return out.withColumn("binary_all", F.greatest(*flags) if len(flags) > 1 else F.col(next(iter(flags))))
