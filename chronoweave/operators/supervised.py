"""Entropy splits, duration scores between classes, durations across variables, states from several methods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .states import assign

EPS = 1e-10


def value_counts(obs: DataFrame, classes: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(variable, value, n0, n1, ..., first, last): rows of each class; classes of the first and last row by entity and time."""
    order = F.struct("entity", "time")
    n = (F.count_if(F.col("class") == c).alias(f"n{i}") for i, c in enumerate(labels))
    return obs.join(classes, "entity").groupBy("variable", "value").agg(*n, F.min_by("class", order).alias("first"), F.max_by("class", order).alias("last"))


def _bits(parts: list[Column]) -> Column:
    total = sum(parts[1:], parts[0])
    return sum((F.when(p > 0, -p / total * F.log2(p / total)).otherwise(0.0) for p in parts[1:]), F.when(parts[0] > 0, -parts[0] / total * F.log2(parts[0] / total)).otherwise(0.0))


def best_splits(values: DataFrame, labels: int = 2) -> DataFrame:
    """(variable, segment, cut, gain): the split of each segment with the largest gain of entropy, the lowest of equal ones.

    Candidates lie midway between neighbouring values where the class changes; if it changes nowhere, between all.
    Running counts are of distinct values, so a value's rows are counted before they are ordered."""
    whole = Window.partitionBy("variable", "segment")
    w = whole.orderBy("value")
    x = values.withColumn("prev", F.lag("value").over(w)).withColumn("edge", F.coalesce(F.col("first") != F.lag("last").over(w), F.lit(False)))
    x = x.withColumn("edges", F.max("edge").over(whole))
    for i in range(labels):
        x = x.withColumn(f"a{i}", F.sum(f"n{i}").over(whole)).withColumn(f"l{i}", F.sum(f"n{i}").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.where("prev is not null and (edge or not edges)")
    every, left = [F.col(f"a{i}") for i in range(labels)], [F.col(f"l{i}") for i in range(labels)]
    right = [a - b for a, b in zip(every, left)]
    n, nl = sum(every[1:], every[0]), sum(left[1:], left[0])
    gain = _bits(every) - nl / n * _bits(left) - (n - nl) / n * _bits(right)
    best = x.groupBy("variable", "segment").agg(F.max(F.struct(F.round(gain, 9).alias("gain"), (-(F.col("value") + F.col("prev")) / 2).alias("minus"))).alias("b"))
    return best.select("variable", "segment", (-F.col("b.minus")).alias("cut"), F.col("b.gain").alias("gain"))


def entropy_cuts(obs: DataFrame, classes: DataFrame, bins: int, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(variable, cut): bins - 1 cuts of each variable, best first; when no split is left, the last cut is repeated.

    A variable of one value has that value as each of its cuts. A round returns a row for each segment to the driver."""
    spark = obs.sparkSession
    values = value_counts(obs, classes, labels).persist()
    cuts: dict[int, list[float]] = {}
    for _ in range(bins - 1):
        known = spark.createDataFrame(list(cuts.items()) or [(-1, [0.0])], "variable int, cuts array<double>")
        in_segments = values.join(F.broadcast(known), "variable", "left").withColumn("segment", assign(F.col("value"), F.coalesce("cuts", F.array().cast("array<double>"))))
        best: dict[int, tuple] = {}
        for r in best_splits(in_segments, len(labels)).collect():
            best[r["variable"]] = max(best.get(r["variable"], (-1.0, 0.0)), (r["gain"], -r["cut"]))
        for v, (_, minus) in best.items():
            cuts.setdefault(v, []).append(-minus)
    only = {r["variable"]: r["v"] for r in values.groupBy("variable").agg(F.min("value").alias("v")).collect()}
    values.unpersist()
    full = {v: (c := cuts.get(v, [])) + [c[-1] if c else x] * (bins - 1 - len(c)) for v, x in only.items()}
    return spark.createDataFrame([(v, float(c)) for v, cs in full.items() for c in sorted(cs)], "variable int, cut double")


def class_pairs(d: DataFrame) -> DataFrame:
    """(variable, state, a, b, duration, na, nb): counts of the durations of each pair of classes a < b."""
    n = d.groupBy("variable", "state", "class", "duration").count()
    of = n.select("variable", "state", "class").distinct()
    pairs = of.withColumnRenamed("class", "a").join(of.withColumnRenamed("class", "b"), ["variable", "state"]).where("a < b")
    x = n.join(pairs, ["variable", "state"]).where("class = a or class = b")
    count = lambda c: F.sum(F.when(F.col("class") == F.col(c), F.col("count")).otherwise(0)).alias(f"n{c}")
    return x.groupBy("variable", "state", "a", "b", "duration").agg(count("a"), count("b"))


KEYS = ["variable", "state", "a", "b"]


def _cumulated(pairs: DataFrame) -> DataFrame:
    every = Window.partitionBy(*KEYS)
    w = every.orderBy("duration")
    return pairs.withColumns({"ta": F.sum("na").over(every), "tb": F.sum("nb").over(every), "fa": F.sum("na").over(w), "fb": F.sum("nb").over(w), "next": F.lead("duration").over(w)})


def _summed(per: DataFrame, value: Column) -> DataFrame:
    return per.groupBy("variable").agg(F.round(F.sum(value), 6).alias("score"))


def ks_score(pairs: DataFrame) -> DataFrame:
    """(variable, score): summed largest differences of the distributions."""
    x = _cumulated(pairs).groupBy(*KEYS).agg(F.max(F.abs(F.col("fa") / F.col("ta") - F.col("fb") / F.col("tb"))).alias("d"))
    return _summed(x, F.col("d"))


def wasserstein_score(pairs: DataFrame) -> DataFrame:
    """(variable, score): summed areas between the distributions."""
    step = F.abs(F.col("fa") / F.col("ta") - F.col("fb") / F.col("tb")) * (F.coalesce("next", F.col("duration")) - F.col("duration"))
    return _summed(_cumulated(pairs).withColumn("d", step), F.col("d"))


def rank_score(pairs: DataFrame) -> DataFrame:
    """(variable, score): summed |z| of the rank-sum test, with average ranks, corrected for ties and continuity."""
    t = F.col("na") + F.col("nb")
    x = _cumulated(pairs).withColumn("r", F.col("na") * (F.col("fa") + F.col("fb") - t + (t + 1) / 2)).withColumn("ties", t * t * t - t)
    g = x.groupBy(*KEYS).agg(F.sum("r").alias("r"), F.sum("ties").alias("ties"), F.first("ta").cast("double").alias("m"), F.first("tb").cast("double").alias("k"))
    n = F.col("m") + F.col("k")
    u = F.abs(F.col("r") - F.col("m") * (F.col("m") + 1) / 2 - F.col("m") * F.col("k") / 2)
    var = F.col("m") * F.col("k") / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return _summed(g.withColumn("v", var).withColumn("u", u).where("v > 0"), F.greatest(F.col("u") - 0.5, F.lit(0.0)) / F.sqrt("v"))


def duration_kl_score(pairs: DataFrame) -> DataFrame:
    """(variable, score): summed symmetric divergences of histograms with int(sqrt(n)) bins, 2 to 10, of two durations of each class at least."""
    g = pairs.groupBy(*KEYS).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.min("duration").alias("lo"), F.max("duration").alias("hi")).where("ta >= 2 and tb >= 2 and hi > lo")
    g = g.withColumn("bins", F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.sqrt(F.col("ta") + F.col("tb"))))))
    x = pairs.join(g, KEYS).withColumn("bin", F.least(F.col("bins") - 1, F.floor((F.col("duration") - F.col("lo")) / ((F.col("hi") + EPS - F.col("lo")) / F.col("bins")))))
    h = x.groupBy(*KEYS, "bin").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    full = g.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1))).join(h, [*KEYS, "bin"], "left").fillna(0, ["na", "nb"])
    p, q = ((F.col(f"n{c}") + EPS) / (F.col(f"t{c}") + EPS * F.col("bins")) for c in "ab")
    return _summed(full, (p - q) * F.log(p / q) / 2)


def mean_difference_score(d: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(variable, score): minus the summed differences of means and 0.001 of the summed deviations; a class without durations of a state has mean 0."""
    avg = {c: F.coalesce(F.avg(F.when(F.col("class") == c, F.col("duration"))), F.lit(0.0)) for c in labels}
    sd = [F.coalesce(F.stddev_pop(F.when(F.col("class") == c, F.col("duration"))), F.lit(0.0)) for c in labels]
    diff = [F.abs(avg[a] - avg[b]) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    per = d.groupBy("variable", "state").agg((-(sum(diff[1:], diff[0]) + 0.001 * sum(sd[1:], sd[0]))).alias("d"))
    return _summed(per, F.col("d"))


def self_transition_score(binned: DataFrame, classes: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(variable, score): over states and pairs of classes, the differences of the share of rows that the same state follows."""
    w = Window.partitionBy("entity", "variable").orderBy("time")
    x = binned.withColumn("next", F.lead("bin").over(w)).where("next is not null").join(classes, "entity")
    share = {c: F.coalesce(F.avg(F.when(F.col("class") == c, (F.col("next") == F.col("bin")).cast("double"))), F.lit(0.0)) for c in labels}
    diff = [F.abs(share[a] - share[b]) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    return _summed(x.groupBy("variable", "bin").agg(sum(diff[1:], diff[0]).alias("d")), F.col("d"))


def mean_gaps(d: DataFrame) -> DataFrame:
    """(variable, state, gap): how far the mean duration of a state is from the next state's, classes pooled."""
    m = d.groupBy("variable", "state").agg(F.avg("duration").alias("m"))
    w = Window.partitionBy("variable").orderBy("state")
    return m.select("variable", "state", F.round(F.abs(F.lead("m").over(w) - F.col("m")), 6).alias("gap")).where("gap is not null")


def cross_durations(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sym_a, sym_b, rel, class, duration) of pairs of related intervals: from the first start to the last end."""
    span = F.greatest("end_a", "end_b") - F.least("start_a", "start_b")
    return pairs.join(classes, "entity").select("sym_a", "sym_b", "rel", "class", span.alias("duration"))


def top_keys_score(d: DataFrame, k: int = 100, fixed: bool = True) -> DataFrame:
    """(score): the k largest |t| of (sym_a, sym_b, rel) between classes 0 and 1, summed and divided by k, or by their number."""
    key = ["sym_a", "sym_b", "rel"]
    of = lambda c: F.when(F.col("class") == c, F.col("duration"))
    s = d.groupBy(*key).agg(*(f(of(c)).alias(f"{n}{c}") for c in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))).where("n0 >= 2 and n1 >= 2 and v0 + v1 > 0")
    t = F.abs(F.col("m1") - F.col("m0")) / F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    top = s.select(t.alias("t")).orderBy(F.desc("t")).limit(k)
    return top.agg(F.round(F.coalesce(F.sum("t"), F.lit(0.0)) / (F.lit(k) if fixed else F.greatest(F.count("t"), F.lit(1))), 6).alias("score"))


def with_total(scores: DataFrame) -> DataFrame:
    """(variable, score) and a row without variable that has the sum."""
    return scores.rollup("variable").agg(F.round(F.sum("score"), 6).alias("score"))


def entity_equal_frequency(obs: DataFrame, bins: int) -> DataFrame:
    """Adds `bin`, by exact quantiles of the entity's own values of the variable."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    cuts = obs.groupBy("entity", "variable").agg(F.transform(F.percentile("value", at), lambda x: F.round(x, 6)).alias("cuts"))
    return obs.join(cuts, ["entity", "variable"]).withColumn("bin", assign(F.col("value"), F.col("cuts"))).drop("cuts")


def composite(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(entity, variable, method, time, state): binned rows of several methods; states are numbered over (variable, method, bin), bins below 0 are -1.

    Intervals are then merged with keys (entity, variable, method), so that methods do not cut one another's runs."""
    rows = None
    for name, x in parts.items():
        one = x.select("entity", "variable", F.lit(name).alias("method"), "time", F.col("bin").cast("int").alias("bin"))
        rows = one if rows is None else rows.unionByName(one)
    key = ["variable", "method", "bin"]
    ids = rows.where("bin >= 0").select(*key).distinct().withColumn("state", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*key)))
    return rows.join(ids, key, "left").select("entity", "variable", "method", "time", F.coalesce("state", F.lit(-1)).alias("state"))


def cut_stability(cuts: DataFrame, tolerance: float) -> DataFrame:
    """(variable, i, cv, agreement) of cuts (fold, variable, i, cut): deviation by mean, and the share of folds within `tolerance` of the median, relative to it."""
    mid = cuts.groupBy("variable", "i").agg(F.median("cut").alias("mid"), F.try_divide(F.stddev_samp("cut"), F.abs(F.avg("cut"))).alias("cv"))
    near = (F.abs(F.col("cut") - F.col("mid")) <= tolerance * F.abs("mid")).cast("double")
    return cuts.join(mid, ["variable", "i"]).groupBy("variable", "i").agg(F.round(F.first("cv"), 6).alias("cv"), F.round(F.avg(near), 6).alias("agreement"))
