"""Frequent patterns of intervals, level by level.

A pattern is (symbols, rels): rels is the half matrix in column order, so that (i, j) is at j(j-1)/2 + i. An instance
is (entity, positions) of a pattern. A level joins the instances before with the pair table once for each earlier
symbol, on entity and position; supports are counted and only frequent patterns' instances go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import compositions


def frequent_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """(sym_a, sym_b, rel, support)"""
    return pairs.groupBy("sym_a", "sym_b", "rel").agg(F.countDistinct("entity").alias("support")).where(F.col("support") >= least)


def only_frequent(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.join(frequent_pairs(pairs, least).drop("support"), ["sym_a", "sym_b", "rel"])


def first_level(pairs: DataFrame) -> DataFrame:
    return pairs.select("entity", F.array("pos_a", "pos_b").alias("at"), F.array("sym_a", "sym_b").alias("symbols"), F.array("rel").alias("rels"), "start_a", F.greatest("end_a", "end_b").alias("last_end"))


def extend(level: DataFrame, pairs: DataFrame, size: int, least: float, kinds: int | None = 7) -> DataFrame:
    """Instances of one more symbol, of frequent patterns only, from only_frequent() pairs; `kinds` None: without the
    table of compositions."""
    edge = lambda k: pairs.select("entity", F.col("pos_a").alias(f"a{k}"), F.col("pos_b").alias("new"), F.col("rel").alias(f"r{k}"), *([F.col("sym_b").alias("new_symbol"), F.col("end_b").alias("new_end")] if k == size - 1 else []))
    out = level.withColumns({f"a{k}": F.get("at", F.lit(k)) for k in range(size)}).join(edge(size - 1), ["entity", f"a{size - 1}"])
    for k in reversed(range(size - 1)):
        out = out.join(edge(k), ["entity", f"a{k}", "new"])
    out = out.where(~F.array_contains("symbols", F.col("new_symbol")))
    if kinds:
        allowed = [a * 100 + b * 10 + c for (a, b), cs in compositions(kinds).items() for c in cs]
        for k in range(size - 1):
            last = F.get("rels", F.lit((size - 1) * (size - 2) // 2 + k))
            out = out.where((last * 100 + F.col(f"r{size - 1}") * 10 + F.col(f"r{k}")).isin(allowed))
    out = out.select(
        "entity",
        F.array_append("at", F.col("new")).alias("at"),
        F.array_append("symbols", F.col("new_symbol")).alias("symbols"),
        F.concat("rels", F.array(*(f"r{k}" for k in range(size)))).alias("rels"),
        "start_a",
        F.greatest("last_end", "new_end").alias("last_end"),
    )
    often = out.groupBy("symbols", "rels").agg(F.countDistinct("entity").alias("n")).where(F.col("n") >= least).drop("n")
    return out.join(often, ["symbols", "rels"], "left_semi")


def mine(pairs: DataFrame, least: float, max_size: int, kinds: int = 7) -> list[DataFrame]:
    """Instances of the frequent patterns of 2, 3, ... symbols; each level is written to the checkpoint folder."""
    folder = pairs.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    keep = (lambda x: x.persist()) if folder.isEmpty() else (lambda x: x.checkpoint())
    pairs = keep(only_frequent(keep(pairs), least))  # once for all levels
    levels = [first_level(pairs)]
    while len(levels) + 1 < max_size and levels[-1].limit(1).count():
        levels.append(keep(extend(levels[-1], pairs, len(levels) + 1, least, kinds)))
    return levels


def name(symbols: str = "symbols", rels: str = "rels"):
    return F.concat(F.size(symbols).cast("string"), F.lit("-"), F.array_join(F.col(symbols).cast("array<string>"), "_"), F.lit("_"), F.array_join(F.col(rels).cast("array<string>"), "_"))


def statistics(instances: DataFrame) -> DataFrame:
    """(pattern, vs, hs, mmd): entities, mean instances of an entity, mean over entities of mean duration."""
    per = instances.groupBy(name().alias("pattern"), "entity").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("last_end") - F.col("start_a")).alias("d"))
    return per.groupBy("pattern").agg(F.count(F.lit(1)).alias("vs"), F.round(F.avg("n"), 6).alias("hs"), F.round(F.avg("d"), 6).alias("mmd"))


def detect(pairs: DataFrame, symbols: list[int], rels: list[int]) -> DataFrame:
    """(entity, p0, p1, ...): the instances of one pattern."""
    out = None
    for j in range(1, len(symbols)):
        for i in range(j):
            r = rels[j * (j - 1) // 2 + i]
            edge = pairs.where((F.col("sym_a") == symbols[i]) & (F.col("sym_b") == symbols[j]) & (F.col("rel") == r)).select("entity", F.col("pos_a").alias(f"p{i}"), F.col("pos_b").alias(f"p{j}"))
            out = edge if out is None else out.join(edge, [c for c in edge.columns if c in out.columns])
    return out


def ending_with(instances: DataFrame, event: int) -> DataFrame:
    """The instances of patterns of more than two symbols that end with `event`."""
    return instances.where((F.size("symbols") > 2) & (F.element_at("symbols", -1) == event))


def entity_features(instances: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, pattern, present, hs, md) for each entity and each pattern that has instances: whether and how often it
    occurs, and its mean duration; 0 where it does not. The patterns of a mining run are few and listed on the driver."""
    per = instances.groupBy("entity", name().alias("pattern")).agg(F.count(F.lit(1)).alias("hs"), F.avg(F.col("last_end") - F.col("start_a")).alias("md"))
    names = sorted(r[0] for r in instances.select(name().alias("pattern")).distinct().collect())
    grid = entities.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("pattern"))
    return grid.join(per, ["entity", "pattern"], "left").select("entity", "pattern", F.col("hs").isNotNull().cast("int").alias("present"), F.coalesce("hs", F.lit(0)).alias("hs"), F.round(F.coalesce("md", F.lit(0.0)), 6).alias("md"))
