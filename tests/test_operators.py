"""Hand-sized cases, and properties that hold for any input."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import forecast, intervals, mining, relations, split, states
from chronoweave.sources import tables


def points(spark, *rows):
    return spark.createDataFrame([(1, 1, t, s) for t, s in rows], "entity long, variable int, time long, state int")


def test_interruption_splits_runs(spark):
    got = intervals.merge(points(spark, (1, 1), (2, 1), (3, 1), (4, 2), (5, 1)), 1).orderBy("start").collect()
    assert [(r["state"], r["end"] - r["start"]) for r in got] == [(1, 3), (2, 1), (1, 1)]


def test_gap_at_the_limit(spark):
    assert intervals.merge(points(spark, (0, 1), (2, 1)), 1).count() == 1
    assert intervals.merge(points(spark, (0, 1), (3, 1)), 1).count() == 2


def test_relation_at_the_gap_limit():
    assert relations.relation_of((0, 2), (5, 6), 3) is None
    assert relations.relation_of((0, 2), (4, 6), 3) == relations.SEVEN.index("before")


def test_relation_column_is_relation_of(spark):
    spans = [(a, b) for a, b in product(range(5), repeat=2) if a < b]
    for eps, kinds in product((0, 1), (3, 7)):
        df = spark.createDataFrame([(*a, *b) for a, b in product(spans, repeat=2)], "a long, b long, c long, d long")
        df = df.withColumn("r", relations.relation(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 2, eps, kinds))
        assert all(r["r"] == relations.relation_of((r["a"], r["b"]), (r["c"], r["d"]), 2, eps, kinds) for r in df.collect())


def test_every_ordered_pair_has_a_relation():
    spans = [(a, b) for a, b in product(range(8), repeat=2) if a < b]
    assert all(relations.relation_of(a, b, 99) is not None for a, b in product(spans, repeat=2) if a <= b)


def test_bin_edges(spark):
    df = spark.createDataFrame([(9.9,), (10.0,), (20.0,)], "value double")
    assert [r[0] for r in df.select(states.assign(F.col("value"), F.array(F.lit(10.0), F.lit(20.0)))).collect()] == [1, 2, 3]


@pytest.mark.parametrize("rows, decided", [((3, 4, 5), 4), ((3, 4), None)])
def test_early_warning(spark, rows, decided):
    df = spark.createDataFrame([(1, t, 0.9 if t in rows else 0.1) for t in range(1, 8)], "entity long, time long, p double")
    got = forecast.early_warning(df, 0.5, 2).collect()
    assert [r["decided"] for r in got] == ([decided] if decided else [])


def test_mined_patterns_are_detected(spark):
    obs = tables.observations(spark, "/root/testdata/sf0.001")
    sti = intervals.merge(states.state_ids(states.with_cuts(obs, states.equal_frequency(obs, 2))), 3)
    pairs = relations.pairs(intervals.positioned(sti), 8)
    level = mining.mine(pairs, 6, 3)[-1].groupBy("symbols", "rels").agg(F.count(F.lit(1)).alias("n")).orderBy("symbols", "rels").limit(3).collect()
    assert level
    for r in level:
        assert mining.detect(pairs, r["symbols"], r["rels"]).count() == r["n"]


def test_prefix_merge_prefers_earlier_tables(spark):
    a, b = spark.createDataFrame([(1, 2)], "e int, x int"), spark.createDataFrame([(1, 2, 3), (2, None, 4)], "e int, x int, y int")
    c = spark.createDataFrame([(2, None), (3, 5)], "e int, x int")
    assert sorted(map(tuple, forecast.merge_prefixes([a, b, c], ["e"]).collect())) == [(1, 2, 3), (2, None, 4), (3, 5, None)]


def test_joint_forecasts_sum_to_one(spark):
    from chronoweave.catalogue import _forecasts

    for how in ("average", "max"):
        s = forecast.aggregate(_forecasts(spark, "/root/testdata/sf0.001"), how).groupBy("entity", "time").agg(F.sum("p").alias("s"))
        assert s.where("abs(s - 1) > 1e-9").count() == 0


def test_class_rows(spark):
    df = spark.createDataFrame([(1, -1, 0, 1.0), (1, 2, 0, 3.0), (1, None, 0, 3.0)], tables.OBSERVATION)
    assert split.class_rows(df).collect()[0]["class"] == 1
    assert split.drop_null_keys(split.without_class_rows(df)).count() == 1


def test_interval_file_round_trip(spark, tmp_path):
    sti = spark.createDataFrame([(1, 1, 11, 0, 2), (1, 2, 21, 1, 4), (2, 1, 12, 3, 5), (2, 1, -1, 5, 6)], "entity long, variable int, state int, start long, end long")
    tables.write_interval_file(sti, str(tmp_path / "kl"))
    back = tables.read_interval_file(spark, str(tmp_path / "kl"), keep_undefined=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sti.collect()))


def test_time_series_file(spark, tmp_path):
    (tmp_path / "x.ts").write_text("@problemName x\n@data\n1,2,?:4,5,6:a\n7,8:9,10:b\n")
    got = tables.read_ts(spark, str(tmp_path / "x.ts"))
    assert got.count() == 10 and got.where("value is null").count() == 1


def test_stream_gives_the_batch_intervals(spark, tmp_path):
    from chronoweave.streaming.intervals import stream

    rows = [(t, s) for t, s in zip(range(20), [1, 1, 2, 2, 1, 1, 1, 3, 3, 3, 3, 1, 2, 2, 2, 1, 1, 1, 1, 9])]
    points(spark, *rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("entity long, variable int, time long, state int").parquet(str(tmp_path / "in"))
    q = stream(src, 1).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r["state"], r["start"], r["end"]) for r in intervals.merge(points(spark, *rows), 1).collect()}
    got = {(r["state"], r["start"], r["end"]) for r in spark.sql("select * from closed").collect()}
    assert got == {x for x in batch if x[0] != 9}


def test_cut_points_try_the_reference_number_of_candidates(monkeypatch):
    """The reference's nb_candidates is 100."""
    from chronoweave import catalogue

    tried = []
    monkeypatch.setattr(catalogue, "_obs", lambda s, d: None)
    monkeypatch.setattr(catalogue.tables, "classes", lambda obs: None)
    monkeypatch.setattr(catalogue.search, "greedy_cuts", lambda obs, classes, bins, pool, max_gap: tried.append(pool))
    catalogue.Q["tid3_cutpoints"](None, None)
    assert tried == [100]


@pytest.mark.parametrize("n", [90, 170, 180, 90_000])
def test_ratio_split_takes_the_ratio_as_written(spark, n):
    """0.7 as a double gives 62999.99999999999 of 90000."""
    got = split.ratio_split(spark.range(n).toDF("entity"), 0.7)
    assert got.where("role = 'train'").count() == n * 7 // 10
    assert got.where("role = 'train'").agg(F.max("entity")).first()[0] == n * 7 // 10 - 1


def test_ratio_split_puts_a_null_entity_last(spark):
    got = split.ratio_split(spark.createDataFrame([(None,), *((i,) for i in range(9))], "entity long"), 0.7)
    assert {r["entity"] for r in got.where("role = 'test'").collect()} == {7, 8, None}


@pytest.mark.parametrize("rows", [1, 7, 1 << 20])
def test_runs_of_all_candidates_are_those_of_each(spark, rows):
    """No row for each row and candidate is made: what tried_runs gives is counted where a row lies."""
    from chronoweave.operators import search

    obs = spark.createDataFrame([(e, v, t * (1 + (t * e) % 3), float((e * 7 + t * t * 5 + v) % 23)) for e in range(12) for v in (1, 2) for t in range(14)], tables.OBSERVATION).distinct()
    obs = obs.unionByName(spark.createDataFrame([(1, 1, None, 3.0), (None, 1, 4, 3.0), (2, 2, 900, None), (2, 2, 901, float("nan"))], tables.OBSERVATION))
    obs = obs.dropDuplicates(["entity", "variable", "time"])
    classes = tables.classes(obs)
    cuts = {1: ([2.0, 5.0, 11.0, 17.0], []), 2: ([3.0, 9.0, 20.0], [9.0, 12.0])}
    tries = spark.createDataFrame([(v, c, o) for v, (c, o) in cuts.items()], "variable int, candidates array<double>, chosen array<double>")
    got = {tuple(r[:4]): tuple(r[4:]) for r in search.tried_runs(obs, classes, tries, 4, 3, rows).select("variable", "class", "k", "state", "n", "m", "v").collect()}
    want = {}
    for v, (candidates, chosen) in cuts.items():
        for k, c in enumerate(candidates):
            points = search.upper_bins(obs, spark.createDataFrame([(v, [*chosen, c])], "variable int, cuts array<double>"))
            d = intervals.merge(points, 3).withColumn("d", F.col("end") - F.col("start")).where("d >= 2").join(classes, "entity").groupBy("class", "state")
            want |= {(v, r[0], k, r[1]): tuple(r[2:]) for r in d.agg(F.count("d"), F.avg("d"), F.var_samp("d")).collect()}
    assert set(got) == set(want) and len(want) > 20
    for key, (n, m, v) in want.items():
        assert got[key][:2] == (n, pytest.approx(m)) and got[key][2] == (None if v is None else pytest.approx(v))
