"""Symbolic time intervals from symbolic points: an observation at t covers [t, t + 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(points: DataFrame, max_gap: int, keys: tuple[str, ...] = ("entity", "variable")) -> DataFrame:
    """(keys, state, start, end): runs of one state whose gaps are at most `max_gap`."""
    w = Window.partitionBy(*keys).orderBy("time")
    goes_on = (F.lag("state").over(w) == F.col("state")) & (F.col("time") - F.lag("time").over(w) - 1 <= max_gap)
    marked = points.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "state", "_run").agg(F.min("time").alias("start"), (F.max("time") + 1).alias("end")).drop("_run")


def positioned(sti: DataFrame) -> DataFrame:
    """Adds `pos`: place in the entity by start, end, state, variable."""
    return sti.withColumn("pos", F.row_number().over(Window.partitionBy("entity").orderBy("start", "end", "state", "variable")))


def symbol_support(sti: DataFrame) -> DataFrame:
    return sti.groupBy("state").agg(F.countDistinct("entity").alias("support"))


def covering(points: DataFrame, sti: DataFrame, at: str = "tau", state: str = "state") -> DataFrame:
    """Adds the state of the last interval that starts at `at` or before, if it also reaches it (ends included).

    One pass over both, ordered by time in each entity: no pair of a point and every earlier interval is made."""
    flag = F.lit(0)
    starts = sti.select("entity", F.col("start").alias("_t"), flag.alias("_k"), F.struct(F.col("start"), F.col("end"), F.col("state").alias("s")).alias("_i"))
    asked = points.select("entity", F.col(at).alias("_t"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_p"))
    w = Window.partitionBy("entity").orderBy("_t", "_k", F.col("_i.end"), F.col("_i.s"))
    seen = starts.unionByName(asked, allowMissingColumns=True).withColumn("_last", F.last("_i", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where("_k = 1").select("_p.*", F.when(F.col("_last.end") >= F.col("_t"), F.col("_last.s")).alias(state))
