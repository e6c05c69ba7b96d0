"""From pattern instances to feature rows, labels, joint forecasts and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def endpoint_durations(instances: DataFrame, max_gap: int) -> DataFrame:
    """(entity, first, durs) of two-symbol instances (entity, start_a, end_a, start_b, end_b): differences of
    consecutive ordered endpoints, at most int(1.2 * max_gap)."""
    t = F.array_sort(F.array("start_a", "end_a", "start_b", "end_b"))
    d = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.least(F.get("t", i) - F.get("t", i - 1), F.lit(int(1.2 * max_gap))))
    return instances.withColumn("t", t).select("entity", "start_a", "pos_a", "pos_b", F.get("t", F.lit(0)).alias("first"), d.alias("durs"))


def expand(durations: DataFrame) -> DataFrame:
    """A row for each t = 0 .. sum of durs: for each duration, whether it has begun and how far it has come."""
    span = F.aggregate("durs", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    begin = F.transform(F.sequence(F.lit(0), F.size("durs") - 1), lambda i: F.aggregate(F.slice("durs", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    d = durations.withColumn("begin", begin).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), span)))
    f = F.zip_with("begin", "durs", lambda b, x: F.struct((F.col("t") >= b).cast("int").alias("on"), F.when(F.col("t") >= b, F.least(F.col("t") - b, F.coalesce(x, F.col("t") - b))).otherwise(0).alias("done")))
    return d.withColumn("features", f).drop("begin")


def merge_prefixes(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of later tables first; of the next table those that no kept row equals on the common columns, nulls alike.

    The first of several tables is left out; one alone is returned as it is."""
    if len(tables) == 1:
        return tables[0]
    out = tables[1]
    for t in tables[2:]:
        common = [c for c in t.columns if c in out.columns]
        seen = out.select(*(F.col(c).alias(f"_{c}") for c in common)).distinct()
        same = F.lit(True)
        for c in common:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.unionByName(t.join(seen, same, "left_anti"), allowMissingColumns=True)
    return out


def aggregate(forecasts: DataFrame, how: str = "average") -> DataFrame:
    """(entity, time, symbol, p, n_active) from (pattern, entity, time, symbol, p): a pattern's own rows are averaged;
    then mean or maximum over patterns, symbols that a pattern lacks counting 0, scaled to sum 1."""
    one = forecasts.groupBy("pattern", "entity", "time", "symbol").agg(F.avg("p").alias("p"))
    active = one.groupBy("entity", "time").agg(F.countDistinct("pattern").alias("n_active"))
    value = F.sum("p") if how == "average" else F.max("p")
    x = one.groupBy("entity", "time", "symbol").agg(value.alias("p")).join(active, ["entity", "time"])
    if how == "average":
        x = x.withColumn("p", F.col("p") / F.col("n_active"))
    return x.withColumn("p", F.coalesce(F.try_divide("p", F.sum("p").over(Window.partitionBy("entity", "time"))), F.lit(0.0)))


def winners(joint: DataFrame) -> DataFrame:
    """(entity, time, n_active, pred): the likeliest symbol, the lowest of equal ones."""
    best = F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("symbol")).alias("s")))
    return joint.groupBy("entity", "time", "n_active").agg(best.alias("b")).select("entity", "time", "n_active", (-F.col("b.s")).cast("int").alias("pred"))


def latest_within(grid: DataFrame, forecasts: DataFrame, context: int) -> DataFrame:
    """For each (entity, time) and pattern, the pattern's last forecast of the `context` time units up to then.

    Forecasts: (pattern, entity, time, value). Grid rows are made once for each pattern of their entity."""
    of = forecasts.select("entity", "pattern").distinct()
    asked = grid.join(of, "entity").select("entity", "pattern", "time", F.lit(None).cast("struct<time:bigint,value:double>").alias("f"), F.lit(1).alias("asked"))
    known = forecasts.select("entity", "pattern", "time", F.struct("time", "value").alias("f"), F.lit(0).alias("asked"))
    w = Window.partitionBy("entity", "pattern").orderBy("time").rangeBetween(-context, 0)
    x = known.unionByName(asked).withColumn("last", F.last("f", ignorenulls=True).over(w))
    return x.where("asked = 1 and last is not null").select("entity", "pattern", "time", F.col("last.time").alias("from_time"), F.col("last.value").alias("value"))


def scored(rows: DataFrame, manifest: DataFrame, warmup: int) -> DataFrame:
    """Adds regime and scored: entities known by then count after their cut, held-out ones after a warm-up."""
    first = F.min("time").over(Window.partitionBy("entity"))
    ok = F.when(F.col("regime") == "seen", F.col("time") > F.col("cut_time")).when(F.col("regime") == "new", F.col("time") >= first + warmup).otherwise(F.lit(False))
    return rows.join(manifest.select("entity", "regime", "cut_time"), "entity", "left").withColumn("scored", F.coalesce(ok, F.lit(False)) & F.col("covered")).drop("cut_time")


def measures(rows: DataFrame, symbols: int) -> DataFrame:
    """(scope, n, accuracy, macro_f1, weighted_f1, baseline) of rows (regime, y, pred): overall and by regime. The mean of
    F1 is over all `symbols` that can be forecast; one that neither occurs nor is forecast counts 0."""
    n = rows.select(F.explode(F.array(F.lit("overall"), F.col("regime"))).alias("scope"), "y", "pred").groupBy("scope", "y", "pred").count()
    total = n.groupBy("scope").agg(F.sum("count").alias("n"), (F.sum(F.when(F.col("y") == F.col("pred"), F.col("count")).otherwise(0)) / F.sum("count")).alias("accuracy"))
    side = n.select("scope", F.col("y").alias("c"), F.col("count").alias("t"), F.lit(0).alias("q"), F.when(F.col("y") == F.col("pred"), F.col("count")).otherwise(0).alias("tp"))
    side = side.unionByName(n.select("scope", F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("count").alias("q"), F.lit(0).cast("long").alias("tp")))
    per = side.groupBy("scope", "c").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("tp").alias("tp")).withColumn("f1", 2 * F.col("tp") / (F.col("t") + F.col("q")))
    f = per.groupBy("scope").agg((F.sum("f1") / symbols).alias("macro_f1"), (F.sum(F.col("f1") * F.col("t")) / F.sum("t")).alias("weighted_f1"), (F.max("t") / F.sum("t")).alias("baseline"))
    r = lambda c: F.round(c, 6).alias(c)
    return total.join(f, "scope").select("scope", "n", r("accuracy"), r("macro_f1"), r("weighted_f1"), r("baseline"))


def early_warning(rows: DataFrame, threshold: float, run: int) -> DataFrame:
    """(entity, decided): time of row number `run` (1 at least) of the first run of at least run + 1 rows with
    p >= threshold; entities without one are left out."""
    w = Window.partitionBy("entity").orderBy("time")
    x = rows.withColumn("hot", F.col("p") >= threshold).withColumn("n", F.row_number().over(w))
    x = x.where("hot").withColumn("run", F.col("n") - F.row_number().over(w))
    inside = Window.partitionBy("entity", "run")
    x = x.withColumn("size", F.count(F.lit(1)).over(inside)).withColumn("k", F.row_number().over(inside.orderBy("time")))
    return x.where((F.col("size") >= max(1, run + 1)) & (F.col("k") == max(1, run))).groupBy("entity").agg(F.min("time").alias("decided"))


def confusion(rows: DataFrame, steps: int = 100) -> DataFrame:
    """(k, tp, fp, fn, tn) of rows (p, y) at thresholds k / steps: counts by the last threshold a row passes, summed up."""
    bin_ = F.floor(F.col("p") * steps + 1e-9).cast("int")
    per = rows.groupBy(F.least(F.lit(steps), bin_).alias("k")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    spark = rows.sparkSession
    full = spark.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(F.broadcast(per), "k", "left").fillna(0)
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    every = Window.partitionBy(F.lit(0))
    x = full.withColumn("tp", F.sum("pos").over(up)).withColumn("fp", F.sum("neg").over(up)).withColumn("p_all", F.sum("pos").over(every)).withColumn("n_all", F.sum("neg").over(every))
    return x.select("k", "tp", "fp", (F.col("p_all") - F.col("tp")).alias("fn"), (F.col("n_all") - F.col("fp")).alias("tn"))


def area(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """(area): trapezoids between the observed points in order of x, then y."""
    w = Window.partitionBy(F.lit(0)).orderBy("x", "y")
    p = points.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    return p.withColumn("d", (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2).agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 6).alias("area"))


def legacy_aggregate(rows: DataFrame, how: str, share: float = 0.5) -> DataFrame:
    """(entity, time, p) from (entity, time, pattern, p, weight): avg, max, min, top (mean of the best share), weighted."""
    by = ["entity", "time"]
    if how == "top":
        w = Window.partitionBy(*by)
        x = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("p"), "pattern"))).withColumn("n", F.count(F.lit(1)).over(w))
        return x.where(F.col("k") <= F.ceil(F.col("n") * F.lit(share))).groupBy(*by).agg(F.avg("p").alias("p"))
    if how == "weighted":
        return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("weight")), F.when(F.sum("weight") > 0, F.sum("weight"))), F.avg("p")).alias("p"))
    return rows.groupBy(*by).agg({"avg": F.avg, "max": F.max, "min": F.min}[how]("p").alias("p"))


def endpoint_order(starts: Column, ends: Column) -> Column:
    """Names of an instance's endpoints in time, "0+ 1+ 0- 1-" for two symbols that overlap: number of the symbol, + start
    or - end; at the same time by number, then starts first."""
    side = lambda x, sign: F.transform(x, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.lit(sign).alias("s")))
    return F.array_join(F.transform(F.array_sort(F.concat(side(starts, "+"), side(ends, "-"))), lambda p: F.concat(p["i"].cast("string"), p["s"])), " ")


def time_to_end(expanded: DataFrame) -> DataFrame:
    """Adds `tte` to rows of expand(): time units left until the instance is over, counted from 1."""
    total = F.aggregate("durs", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return expanded.withColumn("tte", total - F.col("t") + 1)


def event_times(sti: DataFrame, event: int) -> DataFrame:
    """(entity, event_time): start of the entity's last interval of the symbol `event`; `sti` has `pos`."""
    return sti.where(F.col("state") == event).groupBy("entity").agg(F.max_by("start", "pos").alias("event_time"))


def time_to_event(rows: DataFrame, events: DataFrame, at: str) -> DataFrame:
    """Adds `tte` from `at` to the entity's event; null without one, below 0 after it."""
    return rows.join(events, "entity", "left").withColumn("tte", F.col("event_time") - F.col(at)).drop("event_time")


def baselines(rows: DataFrame) -> DataFrame:
    """(scope, majority, baseline, accuracy, beats_baseline) of rows (regime, y, pred): the most frequent truth, the
    smallest of several, how often it is right, and whether the forecasts are right more often."""
    n = rows.select(F.explode(F.array(F.lit("overall"), F.col("regime"))).alias("scope"), "y", "pred").groupBy("scope", "y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("right"))
    x = n.groupBy("scope").agg(F.max(F.struct("n", (-F.col("y")).alias("m"))).alias("top"), F.sum("n").alias("of"), F.sum("right").alias("right"))
    base, hit = F.col("top.n") / F.col("of"), F.col("right") / F.col("of")
    return x.select("scope", (-F.col("top.m")).cast("int").alias("majority"), F.round(base, 6).alias("baseline"), F.round(hit, 6).alias("accuracy"), (hit > base).alias("beats_baseline"))


def log_loss(truth: DataFrame, joint: DataFrame, clip: float = 1e-15) -> DataFrame:
    """(scope, n, log_loss) of truths (entity, time, regime, y) whose symbol has a probability in (entity, time, symbol, p)."""
    x = truth.join(joint.select("entity", "time", F.col("symbol").alias("y"), "p"), ["entity", "time", "y"])
    x = x.select(F.explode(F.array(F.lit("overall"), F.col("regime"))).alias("scope"), F.least(F.greatest("p", F.lit(clip)), F.lit(1 - clip)).alias("p"))
    return x.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.log("p")), 6).alias("log_loss"))


def extreme_row(rows: DataFrame, largest: bool = True) -> DataFrame:
    """For each (entity, time) the whole row with the largest (smallest) p, that of the smallest pattern of several."""
    rest = [c for c in rows.columns if c not in ("entity", "time")]
    key = F.struct(F.col("p") if largest else -F.col("p"), -F.col("pattern"))
    return rows.groupBy("entity", "time").agg(F.max_by(F.struct(*rest), key).alias("x")).select("entity", "time", "x.*")


def warning_classes(rows: DataFrame, threshold: float, run: int, window: float) -> DataFrame:
    """(entity, decided, label) of rows (entity, time, p, tte_pred, tte_true, outcome): tp if the entity has the event and
    the forecast time to it at the decision, 0 at least, is within half a window of the true one; any other decision is fp;
    without a decision fn or tn."""
    decided = early_warning(rows, threshold, run)
    at = rows.join(decided.select("entity", F.col("decided").alias("time")), ["entity", "time"]).select("entity", F.col("time").alias("decided"), (F.abs(F.greatest(F.lit(0), "tte_pred") - F.col("tte_true")) <= window / 2).alias("near"))
    every = rows.groupBy("entity").agg(F.max("outcome").alias("outcome"))
    event = F.col("outcome") == 1
    label = F.when(F.col("decided").isNotNull(), F.when(event & F.col("near"), "tp").otherwise("fp")).otherwise(F.when(event, "fn").otherwise("tn"))
    return every.join(at, "entity", "left").select("entity", "decided", label.alias("label"))
