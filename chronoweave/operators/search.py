"""Scores of cut points, and the greedy search over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge
from .states import candidate_pool

EPS = 1e-10


def class_counts(binned: DataFrame, classes: DataFrame) -> DataFrame:
    """(variable, class, bin, p): share of each bin among a class's rows, smoothed, bins that occur in either class."""
    n = binned.join(classes, "entity").groupBy("variable", "class", "bin").count()
    grid = n.select("variable", "bin").distinct().join(n.select("variable", "class").distinct(), "variable")
    full = grid.join(n, ["variable", "class", "bin"], "left").withColumn("c", F.coalesce("count", F.lit(0)) + EPS)
    return full.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("variable", "class"))).select("variable", "class", "bin", "p")


def histogram_score(binned: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """(variable, score): summed over pairs of classes, how far their histograms are apart."""
    h = class_counts(binned, classes)
    if kind == "entropy":
        per = h.groupBy("variable", "class").agg((-F.sum(F.col("p") * F.log2("p"))).alias("e"))
        x = per.join(per.select("variable", F.col("class").alias("k"), F.col("e").alias("g")), "variable").where("class < k")
        return x.groupBy("variable").agg(F.round(F.sum(F.abs(F.col("e") - F.col("g"))), 6).alias("score"))
    pair = h.join(h.select("variable", "bin", F.col("class").alias("k"), F.col("p").alias("q")), ["variable", "bin"]).where("class < k")
    if kind == "kl":
        one = F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))) / 2
    else:
        one = 1 - F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))
    return pair.groupBy("variable", "class", "k").agg(one.alias("d")).groupBy("variable").agg(F.round(F.sum("d"), 6).alias("score"))


def persist_score(binned: DataFrame) -> DataFrame:
    """(variable, score): mean over states of how much likelier than its share a state follows itself.

    Rows of a variable follow one another by entity and time."""
    w = Window.partitionBy("variable").orderBy("entity", "time")
    t = binned.withColumn("next", F.lead("bin").over(w))
    per = t.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"), F.count("next").alias("m"), F.sum(F.when(F.col("next") == F.col("bin"), 1).otherwise(0)).alias("same"))
    per = per.withColumn("n_all", F.sum("n").over(Window.partitionBy("variable")))
    e = F.lit(1.0) / F.greatest(F.lit(2), F.col("n_all"))
    clamp = lambda c: F.least(F.greatest(c, e), 1 - e)
    a, s = clamp(F.coalesce(F.try_divide("same", "m"), F.lit(0.0))), clamp(F.col("n") / F.col("n_all"))
    kl = ((a - s) * F.log(a / s) + (s - a) * F.log((1 - a) / (1 - s))) / 2
    return per.withColumn("d", F.signum(a - s) * kl).groupBy("variable").agg(F.round(F.avg("d"), 6).alias("score"))


def durations(points: DataFrame, classes: DataFrame, max_gap: int, least: int = 2) -> DataFrame:
    """(variable, class, state, duration, censored) of the intervals of at least `least`; ended by another state: not censored."""
    sti = merge(points, max_gap).where("state is not null")
    w = Window.partitionBy("entity", "variable").orderBy("start")
    ended = (F.lead("start").over(w) == F.col("end")) & (F.lead("state").over(w) != F.col("state"))
    d = sti.withColumn("duration", F.col("end") - F.col("start")).withColumn("censored", ~F.coalesce(ended, F.lit(False)))
    return d.where(F.col("duration") >= least).join(classes, "entity").select("variable", "class", "state", "duration", "censored")


def welch_score(d: DataFrame, direction: int = 0) -> DataFrame:
    """(variable, score): over states and pairs of classes, the sum of |t|; of one direction only, if asked."""
    s = d.groupBy("variable", "state", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("m"), F.var_samp("duration").alias("v"))
    x = s.join(s.select("variable", "state", *(F.col(c).alias(f"{c}2") for c in ("class", "n", "m", "v"))), ["variable", "state"]).where("class < class2 and n >= 2 and n2 >= 2 and v + v2 > 0")
    t = (F.col("m2") - F.col("m")) / F.sqrt(F.col("v") / F.col("n") + F.col("v2") / F.col("n2"))
    x = x.withColumn("t", t)
    if direction:
        x = x.where(F.col("t") * direction > 0)
    return x.groupBy("variable").agg(F.round(F.sum(F.abs("t")), 6).alias("score"))


def logrank_score(d: DataFrame) -> DataFrame:
    """(variable, score): over states, the sum of |z| of the log-rank test of classes 0 and 1."""
    at = d.groupBy("variable", "state", "duration").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("class") == 1, 1).otherwise(0)).alias("n1"), F.sum((~F.col("censored")).cast("int")).alias("e"), F.sum(F.when((F.col("class") == 1) & ~F.col("censored"), 1).otherwise(0)).alias("e1"))
    later = Window.partitionBy("variable", "state").orderBy(F.desc("duration"))
    at = at.withColumn("r", F.sum("n").over(later)).withColumn("r1", F.sum("n1").over(later))
    mean = F.col("e") * F.col("r1") / F.col("r")
    var = F.when(F.col("r") > 1, F.col("e") * (F.col("r1") / F.col("r")) * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("e")) / (F.col("r") - 1)).otherwise(F.lit(0.0))
    z = at.groupBy("variable", "state").agg(F.sum(F.col("e1") - mean).alias("o"), F.sum(var).alias("v"))
    return z.where("v > 0").groupBy("variable").agg(F.round(F.sum(F.abs(F.col("o") / F.sqrt("v"))), 6).alias("score"))


def upper_bins(obs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `state` with bins (low, high]: how many of `cuts` (variable, cuts) lie under the value."""
    return obs.join(F.broadcast(cuts), "variable").withColumn("state", F.size(F.filter("cuts", lambda c: c < F.col("value"))))


def _moments(x: pa.Table, pool: int) -> pa.RecordBatch:
    """(variable, class, k, state, n, m, m2) of whole runs; `new` is true in the first row."""
    new, lo, hi, time, under, base, of = (x.column(c).to_numpy() for c in ("new", "lo", "hi", "time", "under", "base", "of"))
    kinds = [x.column(c).combine_chunks().dictionary_encode() for c in ("variable", "class")]
    codes, states = [c.indices.to_numpy() for c in kinds], int(base.max()) + 2
    group = codes[0].astype(np.int64) * len(kinds[1].dictionary) + codes[1]
    found = []
    for k in range(min(pool, int(of.max()))):
        at = np.flatnonzero(new | ((lo <= k) & (hi > k)))
        d = time[np.append(at[1:], len(time)) - 1] + 1 - time[at]
        kept = (d >= 2) & (of[at] > k)
        at, d = at[kept], d[kept]
        key, i = np.unique(group[at] * states + base[at] + (under[at] > k), return_inverse=True)
        n = np.bincount(i, minlength=len(key))
        m = np.bincount(i, d, len(key)) / n
        found.append((key, np.full(len(key), k), n, m, np.bincount(i, (d - m[i]) ** 2, len(key))))
    key, k, n, m, m2 = (np.concatenate(c) for c in zip(*found))
    each = [c.dictionary.take(pa.array(i)) for c, i in zip(kinds, np.divmod(key // states, len(kinds[1].dictionary)))]
    return pa.RecordBatch.from_arrays([*each, *map(pa.array, (k, key % states, n)), pa.array(m, pa.float64()), pa.array(m2.astype(float))], ["variable", "class", "k", "state", "n", "m", "m2"])


def tried_runs(obs: DataFrame, classes: DataFrame, tries: DataFrame, pool: int, max_gap: int, rows: int = 1 << 20) -> DataFrame:
    """(variable, class, k, state, n, m, v): for each candidate of `tries` (variable, candidates, chosen), k its place, number,
    mean and variance of the runs of at least 2 that the cuts `chosen` and that candidate give.

    A row is moved and sorted once, for all candidates: how many of them lie under its value and under the one before
    says whose runs end there. Runs are counted where they lie, about `rows` rows at a time."""
    under = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("value")))
    x = obs.where("time is not null").join(F.broadcast(tries), "variable").join(classes.where("class is not null"), "entity")
    x = x.select("entity", "class", "variable", "time", under("candidates").alias("under"), under("chosen").alias("base"), F.size("candidates").alias("of"))
    w = Window.partitionBy("entity", "class", "variable").orderBy("time")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before("base") == F.col("base")) & (F.col("time") - before("time") - 1 <= max_gap)
    last = F.coalesce(before("under"), F.col("under"))
    x = x.select("variable", "class", "time", "under", "base", "of", (~F.coalesce(goes_on, F.lit(False))).alias("new"), F.least("under", last).alias("lo"), F.greatest("under", last).alias("hi"))

    def count(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            starts = np.flatnonzero(batch.column("new").to_numpy(zero_copy_only=False)) if n >= rows else ()
            if len(starts) and starts[-1] + n > batch.num_rows:  # a run may go on in the next batch
                held[-1] = batch.slice(0, starts[-1])
                yield _moments(pa.Table.from_batches(held), pool)
                held = [batch.slice(starts[-1])]
                n = held[0].num_rows
        if n:
            yield _moments(pa.Table.from_batches(held), pool)

    kinds = dict(x.dtypes)
    part = x.mapInArrow(count, f"variable {kinds['variable']}, class {kinds['class']}, k long, state long, n long, m double, m2 double")
    each = Window.partitionBy("variable", "class", "k", "state")
    part = part.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(each) / F.sum("n").over(each))
    return part.groupBy("variable", "class", "k", "state", "mean").agg(F.sum("n").alias("n"), F.sum(F.col("m2") + F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("m2")).select("variable", "class", "k", "state", "n", F.col("mean").alias("m"), F.try_divide("m2", F.col("n") - 1).alias("v"))


def greedy_cuts(obs: DataFrame, classes: DataFrame, bins: int, pool: int, max_gap: int) -> DataFrame:
    """(variable, cut): cut points of each variable, one a round, that raise the duration score most; a score of 0 ends it.

    A round scores all candidates of all variables in one job; candidates and chosen cuts are few and go to every task."""
    spark = obs.sparkSession
    found = candidate_pool(obs, pool).groupBy("variable").agg(F.sort_array(F.collect_list("value")).alias("values")).collect()  # a row for each variable
    candidates = {r["variable"]: r["values"] for r in found if r["variable"] is not None}
    chosen: dict[int, list[float]] = {}
    done: set[int] = set()
    for _ in range(bins - 1):
        tries = spark.createDataFrame([(v, c, chosen.get(v, [])) for v, c in candidates.items()], "variable int, candidates array<double>, chosen array<double>")
        s = tried_runs(obs, classes, tries, pool, max_gap)
        x = s.join(s.select("variable", "k", "state", *(F.col(c).alias(f"{c}2") for c in ("class", "n", "m", "v"))), ["variable", "k", "state"]).where("class < class2 and n >= 2 and n2 >= 2 and v + v2 > 0")
        score = x.groupBy("variable", "k").agg(F.sum(F.abs((F.col("m2") - F.col("m")) / F.sqrt(F.col("v") / F.col("n") + F.col("v2") / F.col("n2")))).alias("score"))
        best = score.groupBy("variable").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("k")).alias("k"))).alias("b")).collect()  # a row for each variable
        for r in best:
            cut = candidates[r["variable"]][-r["b"]["k"]]
            if r["variable"] not in done and r["b"]["s"] > 0 and cut not in chosen.get(r["variable"], []):
                chosen.setdefault(r["variable"], []).append(cut)
            else:
                done.add(r["variable"])
    return spark.createDataFrame([(v, c) for v, cs in sorted(chosen.items()) for c in sorted(cs)], "variable int, cut double")


def greedy(obs: DataFrame, candidates: DataFrame, score: Callable[[DataFrame], DataFrame], bins: int, least_share: float = 0.0) -> DataFrame:
    """(variable, cut): the cut of each variable, one a round, whose bins (low, high] have the best score by `score`, which
    maps rows (entity, variable, time, value, bin) to (variable, score); of equal ones the smallest. A cut that leaves a
    bin with less than `least_share` of the rows is not tried; a variable of one value has that value as each cut.

    A round scores all candidates of all variables in one job: each candidate is a variable of its own for `score`."""
    spark = obs.sparkSession
    ends = {r["variable"]: (r["lo"], r["hi"]) for r in obs.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    pool = [(r["variable"], r["value"]) for r in candidates.select("variable", "value").collect()]  # as many as were asked for
    chosen: dict[int, list[float]] = {v: [lo] * (bins - 1) for v, (lo, hi) in ends.items() if lo == hi}
    for done in range(bins - 1):
        tries = [(i, v, c, [*chosen.get(v, []), c]) for i, (v, c) in enumerate(pool) if len(chosen.get(v, [])) == done and c not in chosen.get(v, [])]
        if not tries:
            break
        t = spark.createDataFrame(tries, "id int, variable int, cut double, cuts array<double>")
        rows = obs.join(F.broadcast(t), "variable").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("variable", "cut", "cuts").withColumnRenamed("id", "variable")
        found = score(rows)
        if least_share:
            n = rows.groupBy("variable", "bin").count().groupBy("variable").agg(F.min("count").alias("least"), F.sum("count").alias("of"), F.count(F.lit(1)).alias("bins"))
            found = found.join(n.where((F.col("least") >= F.lit(least_share) * F.col("of")) & (F.col("bins") == done + 2)).select("variable"), "variable")
        best: dict[int, tuple] = {}
        names = {i: (v, c) for i, v, c, _ in tries}
        for r in found.where("score is not null").collect():  # a row for each candidate
            v, c = names[r["variable"]]
            best[v] = max(best.get(v, (float("-inf"), 0.0)), (r["score"], -c))
        for v, (_, minus) in best.items():
            chosen.setdefault(v, []).append(-minus)
    return spark.createDataFrame([(v, float(c)) for v, cs in sorted(chosen.items()) for c in sorted(cs)], "variable int, cut double")


def length_of_stay(obs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, los): mean over its entities of the time from the first to the last row."""
    per = obs.groupBy("entity").agg((F.max("time") - F.min("time")).alias("stay"))
    return per.join(classes, "entity").groupBy("class").agg(F.round(F.avg("stay"), 6).alias("los"))
