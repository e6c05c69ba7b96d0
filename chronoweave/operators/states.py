"""Cut points and symbolic states. Bins are [low, high) when states are assigned."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: value >= c)) + 1


def equal_width(obs: DataFrame, bins: int) -> DataFrame:
    """(variable, cuts)"""
    step = lambda lo, hi: F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.round(lo + i * (hi - lo) / bins, 6))
    return obs.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select("variable", step(F.col("lo"), F.col("hi")).alias("cuts"))


def equal_frequency(obs: DataFrame, bins: int) -> DataFrame:
    """(variable, cuts): exact quantiles between neighbours in proportion."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    return obs.groupBy("variable").agg(F.percentile("value", at).alias("q")).select("variable", F.transform("q", lambda x: F.round(x, 6)).alias("cuts"))


def gaussian(obs: DataFrame, bins: int) -> DataFrame:
    """(variable, cuts): quantiles of the normal distribution with the values' mean and deviation; deviation 0 counts as 1."""
    z = F.array(*(F.lit(NormalDist().inv_cdf(i / bins)) for i in range(1, bins)))
    m = obs.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return m.select("variable", F.transform(z, lambda x: F.round(F.col("mean") + x * F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")), 6)).alias("cuts"))


def with_cuts(obs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `bin`; variables without cuts have none. `cuts` has a row for each variable."""
    return obs.join(F.broadcast(cuts), "variable", "left").withColumn("bin", F.when(F.col("cuts").isNull(), -1).otherwise(assign(F.col("value"), F.col("cuts")))).drop("cuts")


def state_ids(binned: DataFrame) -> DataFrame:
    return binned.withColumn("state", F.when(F.col("bin") < 0, -1).otherwise(F.col("variable") * 10 + F.col("bin")).cast("int"))


def angles(obs: DataFrame, width: int) -> DataFrame:
    """Adds `angle`: slope of the values of (time - width, time), in degrees; null for fewer than two points."""
    w = Window.partitionBy("entity", "variable").orderBy("time").rangeBetween(-width, 0)
    slope = F.regr_slope("value", "time").over(w)
    return obs.withColumn("angle", F.when(F.count(F.lit(1)).over(w) >= 2, F.degrees(F.atan(slope))))


def gradient_cuts(angled: DataFrame, central: float = 0.3) -> DataFrame:
    """(variable, low, high): quantiles of the angles around the central share."""
    tail = (1 - central) / 2
    q = angled.groupBy("variable").agg(F.percentile("angle", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return q.select("variable", F.round(F.coalesce(F.get("q", F.lit(0)), F.lit(-45.0)), 6).alias("low"), F.round(F.coalesce(F.get("q", F.lit(1)), F.lit(45.0)), 6).alias("high"))


def gradient_bins(angled: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `bin`: 1 falling, 2 level, 3 rising, -1 without an angle or cuts."""
    a = F.round("angle", 6)
    b = F.when(a.isNull() | F.col("low").isNull(), -1).when(a <= F.col("low"), 1).when(a >= F.col("high"), 3).otherwise(2)
    return angled.join(F.broadcast(cuts), "variable", "left").withColumn("bin", b).drop("low", "high")


def knowledge(obs: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds `bin` from (variable, bin, low, high): low <= value < high, the lowest match, -1 without one.

    A variable's bins are few and travel as one array, so rows stay where they are, repeated ones too."""
    known = bins.groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("low", "high", "bin"))).alias("_bins"))
    hit = F.get(F.filter("_bins", lambda b: (F.col("value") >= b["low"]) & (F.col("value") < b["high"])), F.lit(0))["bin"]
    return obs.join(F.broadcast(known), "variable", "left").withColumn("bin", F.coalesce(hit, F.lit(-1))).drop("_bins")


def paa(obs: DataFrame, width: int) -> DataFrame:
    """Windows of `width` rows of each entity and variable: mean, least and largest value at the first time."""
    n = F.row_number().over(Window.partitionBy("entity", "variable").orderBy("time"))
    return obs.withColumn("piece", F.floor((n - 1) / width)).groupBy("entity", "variable", "piece").agg(F.min("time").alias("first_time"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def candidate_pool(obs: DataFrame, size: int) -> DataFrame:
    """(variable, value): about `size` of the distinct values of each variable, evenly spaced by rank, without the smallest."""
    d = obs.select("variable", "value").distinct()
    by = Window.partitionBy("variable")
    d = d.withColumn("i", F.row_number().over(by.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    picks = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.floor(1 + k * (F.col("n") - 2) / (size - 1)).cast("int"))
    return d.where((F.col("n") > 1) & F.array_contains(picks, F.col("i"))).select("variable", "value")


def apply_learned(train: DataFrame, other: DataFrame, learn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """States of `other` by the cuts that learn(train) gives; variables that `train` lacks have state -1."""
    return state_ids(with_cuts(other, learn(train)))


def keep_states(points: DataFrame, tests: DataFrame, threshold: float) -> DataFrame:
    """States whose p-value (state, p) is at most `threshold`; the others, and those without one, become -1."""
    p = F.broadcast(tests.select("state", F.col("p").alias("_p")))  # a row for each state
    return points.join(p, "state", "left").withColumn("state", F.when(F.col("_p") <= threshold, F.col("state")).otherwise(-1).cast("int")).drop("_p")
