"""Every query of the library over the driver's tables, with SQL that gives the same rows.

Common settings: two equal-frequency bins for each variable, runs with gaps of up to 3 days, pairs up to 8 days apart,
patterns that a fifth of the entities support.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import forecast, intervals, mining, relations, search, selection, split, states, supervised
from .sources import tables

GAP, NEAR, SUPPORT = 3, 8, 0.2


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return tables.observations(spark, d)


def _binned(obs: DataFrame, bins: int = 2) -> DataFrame:
    return states.state_ids(states.with_cuts(obs, states.equal_frequency(obs, bins)))


def _sti(obs: DataFrame) -> DataFrame:
    return intervals.merge(_binned(obs), GAP)


def _pairs(spark: SparkSession, d: str, **how) -> DataFrame:
    return relations.pairs(intervals.positioned(_sti(_obs(spark, d))), NEAR, **how)


def _least(spark: SparkSession, d: str, share: float = SUPPORT) -> float:
    return share * _obs(spark, d).select("entity").distinct().count()


def _r(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


OBS = """obs AS (SELECT user_id AS entity, CAST(list_position(['click','error','purchase','signup','view'], event_type) AS INTEGER) AS variable,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS time, max(value) AS value FROM events GROUP BY ALL),
cls AS (SELECT DISTINCT entity, CAST(entity % 2 AS INTEGER) AS class FROM obs)"""
BINS = OBS + """,
cuts AS (SELECT variable, round(quantile_cont(value, 0.5), 6) AS q FROM obs GROUP BY variable),
pts AS (SELECT entity, obs.variable, time, value, CASE WHEN value >= q THEN 2 ELSE 1 END AS bin, CAST(obs.variable * 10 + CASE WHEN value >= q THEN 2 ELSE 1 END AS INTEGER) AS state FROM obs JOIN cuts USING (variable))"""


def _islands(src: str, gap: int, name: str = "sti") -> str:
    return f"""{name} AS (SELECT entity, variable, state, min(time) AS start, max(time) + 1 AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY entity, variable ORDER BY time) AS run FROM (
  SELECT *, CASE WHEN lag(state) OVER w = state AND time - lag(time) OVER w - 1 <= {gap} THEN 0 ELSE 1 END AS n FROM {src} WINDOW w AS (PARTITION BY entity, variable ORDER BY time))) GROUP BY entity, variable, state, run)"""


STI = BINS + ",\n" + _islands("pts", GAP)
POS = STI + """,
ps AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start, "end", state, variable) AS pos FROM sti)"""


def _relation_sql(kinds: int, eps: int) -> str:
    n = lambda x: relations.number(x, kinds)
    return f"""CASE WHEN sb - ea > {NEAR} OR sa > sb THEN NULL WHEN sb - ea > {eps} AND sb - ea < {NEAR} THEN {n('before')}
 WHEN sb - sa > {eps} AND abs(ea - sb) <= {eps} AND ea - eb < {eps} THEN {n('meet')} WHEN sb - sa > {eps} AND ea - sb > {eps} AND ea - eb < {eps} THEN {n('overlap')}
 WHEN abs(sb - sa) <= {eps} AND abs(ea - eb) <= {eps} THEN {n('equal')} WHEN sb - sa > {eps} AND ea - eb > {eps} THEN {n('contain')}
 WHEN abs(sb - sa) <= {eps} AND eb - ea > {eps} THEN {n('starts')} WHEN sb - sa > {eps} AND abs(ea - eb) <= {eps} THEN {n('finishby')} END"""


def _pairs_sql(kinds: int = 7, eps: int = 0, followers: bool = True, same_variable: bool = False) -> str:
    more = (" AND NOT (a.variable = b.variable AND abs(a.state - b.state) = 1)" if followers else "") + (" AND a.variable <> b.variable" if same_variable else "")
    return POS + f""",
pr AS (SELECT * FROM (SELECT *, CAST({_relation_sql(kinds, eps)} AS INTEGER) AS rel FROM (SELECT a.entity, a.pos AS pos_a, b.pos AS pos_b, a.state AS sym_a, b.state AS sym_b,
  a.start AS sa, a."end" AS ea, b.start AS sb, b."end" AS eb FROM ps a JOIN ps b ON a.entity = b.entity AND a.pos < b.pos AND b.start - a."end" <= {NEAR} AND a.state <> b.state{more})) WHERE rel IS NOT NULL)"""


PAIR_COLUMNS = ["entity", "pos_a", "pos_b", "sym_a", "sym_b", "rel"]
PAIRS = _pairs_sql()
FREQUENT = PAIRS + f""",
fp AS (SELECT sym_a, sym_b, rel, count(DISTINCT entity) AS support FROM pr GROUP BY ALL HAVING count(DISTINCT entity) >= {SUPPORT} * (SELECT count(DISTINCT entity) FROM obs)),
fr AS (SELECT pr.* FROM pr JOIN fp USING (sym_a, sym_b, rel))"""
ALLOWED = ",".join(str(a * 100 + b * 10 + c) for (a, b), cs in relations.compositions().items() for c in cs)
TRIPLES = FREQUENT + f""",
t3 AS (SELECT x.entity, x.sym_a AS s0, x.sym_b AS s1, y.sym_b AS s2, x.rel AS r01, z.rel AS r02, y.rel AS r12, x.sa AS st, greatest(x.ea, x.eb, y.eb) AS en
  FROM fr x JOIN fr y ON x.entity = y.entity AND x.pos_b = y.pos_a JOIN fr z ON z.entity = x.entity AND z.pos_a = x.pos_a AND z.pos_b = y.pos_b WHERE y.sym_b <> x.sym_a AND x.rel * 100 + y.rel * 10 + z.rel IN ({ALLOWED})),
f3 AS (SELECT '3-' || s0 || '_' || s1 || '_' || s2 || '_' || r01 || '_' || r02 || '_' || r12 AS pattern, entity, st, en FROM t3)"""
LEAST = f"{SUPPORT} * (SELECT count(DISTINCT entity) FROM obs)"
SYNTHETIC = OBS + """,
fc AS (SELECT CAST(event_id % 3 AS INTEGER) AS pattern, user_id AS entity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS time, CAST(s AS INTEGER) AS symbol,
  CAST(1 + (event_id * (s + 3)) % 7 AS DOUBLE) / 64 AS p FROM events, (SELECT unnest([1, 2, 3]) AS s))"""
EVENTS = """pe AS (SELECT user_id AS entity, event_id AS time, CAST(event_id % 101 AS DOUBLE) / 100 AS p, CAST(event_id % 3 = 0 AS INTEGER) AS y, CAST(event_id % 4 AS INTEGER) AS pattern, CAST(event_id % 5 AS DOUBLE) AS weight FROM events)"""


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events").withColumn("s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return e.select((F.col("event_id") % 3).cast("int").alias("pattern"), F.col("user_id").alias("entity"), day.alias("time"), F.col("s").cast("int").alias("symbol"), ((1 + (F.col("event_id") * (F.col("s") + 3)) % 7).cast("double") / 64).alias("p"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = tables.read(spark, d, "events")
    i = F.col("event_id")
    return e.select(F.col("user_id").alias("entity"), i.alias("time"), ((i % 101).cast("double") / 100).alias("p"), (i % 3 == 0).cast("int").alias("y"), (i % 4).cast("int").alias("pattern"), (i % 5).cast("double").alias("weight"))


Q: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    Q[name] = build
    if sql:
        SQL[name] = sql


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _list(cuts: DataFrame) -> DataFrame:
    return cuts.select("variable", F.posexplode("cuts").alias("i", "cut")).select("variable", F.col("i").cast("int").alias("i"), "cut")


_add("obs_long", _obs, _with(OBS, "SELECT * FROM obs"))
_add("null_drop", lambda s, d: split.drop_null_keys(_obs(s, d)), _with(OBS, "SELECT * FROM obs WHERE entity IS NOT NULL AND variable IS NOT NULL AND value IS NOT NULL"))
_add("class_rows_split", lambda s, d: tables.classes(_obs(s, d)), _with(OBS, "SELECT * FROM cls"))
_add("skip_vars_union", lambda s, d: _obs(s, d).where(~F.col("variable").isin(1, 2)).unionByName(_obs(s, d).where("variable = 1")), _with(OBS, "SELECT * FROM obs WHERE variable NOT IN (1, 2) UNION ALL SELECT * FROM obs WHERE variable = 1"))
_add("entity_ratio_split", lambda s, d: split.ratio_split(_obs(s, d), 0.7), _with(OBS, "SELECT entity, CASE WHEN row_number() OVER (ORDER BY entity) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'test' END AS role FROM (SELECT DISTINCT entity FROM obs)"))
MANIFEST = OBS + """,
mf AS (SELECT entity, CASE WHEN h THEN 'holdout' ELSE 'train' END AS role, CASE WHEN h THEN 'new' ELSE 'seen' END AS regime, CASE WHEN NOT h THEN t0 + CAST(0.7 AS DOUBLE) * (t1 - t0) END AS cut_time
  FROM (SELECT entity, t0, t1, row_number() OVER (ORDER BY md5('0:' || entity), entity) <= least(round_even(count(*) OVER () * CAST(0.2 AS DOUBLE), 0), count(*) OVER () - 1) AS h FROM (SELECT entity, min(time) AS t0, max(time) AS t1 FROM obs GROUP BY entity)))"""
_add("chrono_split_manifest", lambda s, d: split.forecast_manifest(_obs(s, d), 0.7, 0.2), _with(MANIFEST, "SELECT * FROM mf"))
_add("chrono_train_embargo", lambda s, d: split.training_rows(_obs(s, d), split.forecast_manifest(_obs(s, d), 0.7, 0.2), 2), _with(MANIFEST, "SELECT obs.* FROM obs JOIN mf USING (entity) WHERE role = 'train' AND time <= cut_time - 2"))

WIDTH = "SELECT variable, CAST(i - 1 AS INTEGER) AS i, round(lo + i * (hi - lo) / 3, 6) AS cut FROM (SELECT variable, min(value) AS lo, max(value) AS hi FROM obs GROUP BY variable), (SELECT unnest([1, 2]) AS i)"
QUART = "SELECT variable, CAST(i - 1 AS INTEGER) AS i, round(CASE i WHEN 1 THEN q[1] ELSE q[2] END, 6) AS cut FROM (SELECT variable, quantile_cont(value, [1/3, 2/3]) AS q FROM obs GROUP BY variable), (SELECT unnest([1, 2]) AS i)"
Z = [NormalDist().inv_cdf(i / 3) for i in (1, 2)]
SAX = f"SELECT variable, CAST(i - 1 AS INTEGER) AS i, round(m + CASE i WHEN 1 THEN {Z[0]!r}::DOUBLE ELSE {Z[1]!r}::DOUBLE END * CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS cut FROM (SELECT variable, avg(value) AS m, stddev_samp(value) AS sd FROM obs GROUP BY variable), (SELECT unnest([1, 2]) AS i)"
for _n, _f, _s in (("equal_width", states.equal_width, WIDTH), ("equal_freq", states.equal_frequency, QUART), ("sax", states.gaussian, SAX)):
    _add(f"{_n}_cutpoints", lambda s, d, f=_f: _list(f(_obs(s, d), 3)), _with(OBS, _s))
    _add(f"{_n}_states", lambda s, d, f=_f: states.state_ids(states.with_cuts(_obs(s, d), f(_obs(s, d), 3))).select("entity", "variable", "time", "state"), _with(OBS + f", c AS ({_s})", "SELECT entity, obs.variable, time, CAST(obs.variable * 10 + 1 + count(*) FILTER (value >= cut) AS INTEGER) AS state FROM obs JOIN c USING (variable) GROUP BY entity, obs.variable, time, value"))
ANGLES = OBS + """,
an AS (SELECT entity, variable, time, CASE WHEN count(*) OVER w >= 2 THEN degrees(atan(regr_slope(value, time) OVER w)) END AS angle FROM obs WINDOW w AS (PARTITION BY entity, variable ORDER BY time RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))"""
_add("gradient_angles", lambda s, d: states.angles(_obs(s, d), 5).select("entity", "variable", "time", F.round("angle", 6).alias("angle")), _with(ANGLES, "SELECT entity, variable, time, round(angle, 6) AS angle FROM an"))
GRADIENT = "SELECT entity, variable, time, CASE WHEN angle IS NULL OR low IS NULL THEN -1 WHEN round(angle, 6) <= low THEN 1 WHEN round(angle, 6) >= high THEN 3 ELSE 2 END AS bin FROM an LEFT JOIN gc USING (variable)"
_add("gradient_states", lambda s, d: (lambda a: states.gradient_bins(a, states.gradient_cuts(a)).select("entity", "variable", "time", "bin"))(states.angles(_obs(s, d), 5)), _with(ANGLES + ", gc AS (SELECT variable, round(quantile_cont(angle, 0.35), 6) AS low, round(quantile_cont(angle, 0.65), 6) AS high FROM an GROUP BY variable)", GRADIENT))
JSON = '{"cutoffs": {"1": [-30, 30], "2": [-50, 50], "3": [-10, 10]}, "default": [-45, 45]}'
_add("kb_gradient_states", lambda s, d: states.gradient_bins(states.angles(_obs(s, d), 5), tables.cutoffs_from_json(s, JSON)).select("entity", "variable", "time", "bin"), _with(ANGLES + ", gc(variable, low, high) AS (VALUES (1, -30, 30), (2, -50, 50), (3, -10, 10))", GRADIENT))


def _known(spark: SparkSession) -> DataFrame:
    inf = float("inf")
    rows = [(v, b, lo, hi) for v in (1, 2, 3, 4) for b, (lo, hi) in enumerate([(-inf, 15.0), (15.0, 35.0), (35.0, 70.0), (70.0, inf)], 1)]
    return spark.createDataFrame(rows, "variable int, bin int, low double, high double")


_add("knowledge_states", lambda s, d: states.knowledge(_obs(s, d), _known(s)).select("entity", "variable", "time", "bin"), _with(OBS, "SELECT entity, variable, time, CASE WHEN variable = 5 THEN -1 WHEN value < 15 THEN 1 WHEN value < 35 THEN 2 WHEN value < 70 THEN 3 ELSE 4 END AS bin FROM obs"))
for _n, _a in (("mean", "avg"), ("least", "min"), ("most", "max")):
    _add({"mean": "paa_mean", "least": "paa_min", "most": "paa_max"}[_n], lambda s, d, n=_n: states.paa(_obs(s, d), 4).select("entity", "variable", "first_time", F.round(n, 6).alias("value")), _with(OBS, f"SELECT entity, variable, min(time) AS first_time, round({_a}(value), 6) AS value FROM (SELECT *, (row_number() OVER (PARTITION BY entity, variable ORDER BY time) - 1) // 4 AS piece FROM obs) GROUP BY entity, variable, piece"))
_add("candidate_pool", lambda s, d: states.candidate_pool(_obs(s, d), 100), _with(OBS, "SELECT DISTINCT variable, value FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY variable) AS n FROM (SELECT DISTINCT variable, value FROM obs)), (SELECT unnest(range(100)) AS k) WHERE n > 1 AND i = CAST(floor(1 + k * (n - 2) / 99) AS INTEGER)"))
HIST = BINS + """,
hn AS (SELECT variable, class, bin, count(*) AS n FROM pts JOIN cls USING (entity) GROUP BY ALL),
hg AS (SELECT variable, class, bin, coalesce(n, 0) + 1e-10 AS c FROM (SELECT DISTINCT variable, bin FROM hn) JOIN (SELECT DISTINCT variable, class FROM hn) USING (variable) LEFT JOIN hn USING (variable, class, bin)),
h AS (SELECT variable, class, bin, c / sum(c) OVER (PARTITION BY variable, class) AS p FROM hg),
hp AS (SELECT a.variable, a.p, b.p AS q FROM h a JOIN h b ON a.variable = b.variable AND a.bin = b.bin AND a.class = 0 AND b.class = 1)"""
_add("td4c_kl_score", lambda s, d: search.histogram_score(_binned(_obs(s, d)), tables.classes(_obs(s, d)), "kl"), _with(HIST, "SELECT variable, round(sum((p - q) * ln(p / q)) / 2, 6) AS score FROM hp GROUP BY variable"))
_add("td4c_cosine_score", lambda s, d: search.histogram_score(_binned(_obs(s, d)), tables.classes(_obs(s, d)), "cosine"), _with(HIST, "SELECT variable, round(1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 6) AS score FROM hp GROUP BY variable"))
_add("td4c_entropy_score", lambda s, d: search.histogram_score(_binned(_obs(s, d)), tables.classes(_obs(s, d)), "entropy"), _with(HIST, "SELECT variable, round(abs(sum(CASE WHEN class = 0 THEN -p * log2(p) ELSE p * log2(p) END)), 6) AS score FROM h GROUP BY variable"))
_add("persist_score", lambda s, d: search.persist_score(_binned(_obs(s, d))), _with(BINS + """,
nx AS (SELECT variable, bin, lead(bin) OVER (PARTITION BY variable ORDER BY entity, time) AS nb FROM pts),
pc AS (SELECT variable, bin, count(*) AS n, count(nb) AS m, sum(CASE WHEN nb = bin THEN 1 ELSE 0 END) AS same FROM nx GROUP BY ALL),
pa AS (SELECT variable, n, same / m AS a, sum(n) OVER (PARTITION BY variable) AS t FROM pc),
pb AS (SELECT variable, least(greatest(a, 1.0::DOUBLE / greatest(2, t)), 1 - 1.0::DOUBLE / greatest(2, t)) AS a, n / t AS s FROM pa)""", "SELECT variable, round(avg(sign(a - s) * ((a - s) * ln(a / s) + (s - a) * ln((1 - a) / (1 - s))) / 2), 6) AS score FROM pb GROUP BY variable"))
DUR = STI + """,
du AS (SELECT variable, class, state, d AS duration, censored FROM (SELECT entity, variable, state, "end" - start AS d, NOT coalesce(lead(start) OVER w = "end" AND lead(state) OVER w <> state, false) AS censored FROM sti WINDOW w AS (PARTITION BY entity, variable ORDER BY start)) JOIN cls USING (entity) WHERE d >= 2)"""


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return search.durations(_binned(_obs(spark, d)), tables.classes(_obs(spark, d)), GAP)


WELCH = DUR + """,
sc AS (SELECT variable, state, class, count(*) AS n, avg(duration) AS m, var_samp(duration) AS v FROM du GROUP BY ALL),
tt AS (SELECT a.variable, (b.m - a.m) / sqrt(a.v / a.n + b.v / b.n) AS t FROM sc a JOIN sc b ON a.variable = b.variable AND a.state = b.state AND a.class < b.class WHERE a.n >= 2 AND b.n >= 2 AND a.v + b.v > 0)"""
_add("tid3_durations", lambda s, d: _durations(s, d).groupBy("variable", "class", "state", "duration", "censored").agg(F.count(F.lit(1)).alias("n")), _with(DUR, "SELECT variable, class, state, duration, censored, count(*) AS n FROM du GROUP BY ALL"))
_add("tid3_welch_score", lambda s, d: search.welch_score(_durations(s, d)), _with(WELCH, "SELECT variable, round(sum(abs(t)), 6) AS score FROM tt GROUP BY variable"))
_add("tid3_directional_score", lambda s, d: search.welch_score(_durations(s, d), 1), _with(WELCH, "SELECT variable, round(sum(abs(t)), 6) AS score FROM tt WHERE t > 0 GROUP BY variable"))
_add("tid3_logrank_score", lambda s, d: search.logrank_score(_durations(s, d)), _with(DUR + """,
la AS (SELECT variable, state, duration, count(*) AS n, sum(class) AS n1, sum(CASE WHEN censored THEN 0 ELSE 1 END) AS e, sum(CASE WHEN class = 1 AND NOT censored THEN 1 ELSE 0 END) AS e1 FROM du GROUP BY ALL),
lr AS (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM la WINDOW w AS (PARTITION BY variable, state ORDER BY duration DESC)),
lz AS (SELECT variable, state, sum(e1 - e * r1 / r) AS o, sum(CASE WHEN r > 1 THEN e * (r1 / r) * (1 - r1 / r) * (r - e) / (r - 1) ELSE 0 END) AS v FROM lr GROUP BY ALL)""", "SELECT variable, round(sum(abs(o / sqrt(v))), 6) AS score FROM lz WHERE v > 0 GROUP BY variable"))
_add("tid3_cutpoints", lambda s, d: search.greedy_cuts(_obs(s, d), tables.classes(_obs(s, d)), 3, 100, GAP))
_add("sti_intervals", lambda s, d: _sti(_obs(s, d)), _with(STI, "SELECT * FROM sti"))
_add("symbol_support", lambda s, d: intervals.symbol_support(_sti(_obs(s, d))), _with(STI, "SELECT state, count(DISTINCT entity) AS support FROM sti GROUP BY state"))
_add("sti_kl_text", lambda s, d: tables.interval_lines(_sti(_obs(s, d))), _with(STI, """SELECT entity, string_agg(start || ',' || "end" || ',' || state || ',' || variable, ';' ORDER BY start, "end", state, variable) || ';' AS line FROM sti GROUP BY entity"""))
_add("sti_from_kl_text", lambda s, d: tables.parse_interval_lines(tables.interval_lines(_sti(_obs(s, d)))), _with(STI, "SELECT * FROM sti"))
for _n, _how, _sql in (
    ("pair_allen7", {}, {}),
    ("pair_rel3", {"kinds": 3}, {"kinds": 3}),
    ("pair_epsilon", {"eps": 1}, {"eps": 1}),
    ("pair_skip_followers", {"skip_followers": False}, {"followers": False}),
    ("pair_skip_same_var", {"skip_same_variable": True}, {"same_variable": True}),
):
    _add(_n, lambda s, d, how=_how: _pairs(s, d, **how).select(*PAIR_COLUMNS), _with(_pairs_sql(**_sql), f"SELECT {', '.join(PAIR_COLUMNS)} FROM pr"))
_add("relation_descriptions", lambda s, d: s.createDataFrame([(i, n, c) for i, (n, c) in enumerate(zip(relations.SEVEN, relations.SEVEN_SIGNS))], "rel int, name string, sign string"), "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(zip(relations.SEVEN, relations.SEVEN_SIGNS))) + ") t(rel, name, sign)")
_add("frequent_pairs", lambda s, d: mining.frequent_pairs(_pairs(s, d), _least(s, d)), _with(FREQUENT, "SELECT * FROM fp"))
_add("support_range_filter", lambda s, d: mining.frequent_pairs(_pairs(s, d), _least(s, d)).where(F.col("support") <= _least(s, d, 0.5)), _with(FREQUENT, "SELECT * FROM fp WHERE support <= 0.5 * (SELECT count(DISTINCT entity) FROM obs)"))
_add("frequent_size3", lambda s, d: mining.mine(_pairs(s, d), _least(s, d), 3)[-1].groupBy(mining.name().alias("pattern")).agg(F.countDistinct("entity").alias("support")), _with(TRIPLES, f"SELECT pattern, count(DISTINCT entity) AS support FROM f3 GROUP BY pattern HAVING count(DISTINCT entity) >= {LEAST}"))
_add("pattern_statistics", lambda s, d: mining.statistics(mining.mine(_pairs(s, d), _least(s, d), 3)[-1]), _with(TRIPLES, f"SELECT pattern, count(*) AS vs, round(avg(n), 6) AS hs, round(avg(dd), 6) AS mmd FROM (SELECT pattern, entity, count(*) AS n, avg(en - st) AS dd FROM f3 GROUP BY ALL) GROUP BY pattern HAVING count(*) >= {LEAST}"))
_add("detect_fixed_pattern", lambda s, d: mining.detect(_pairs(s, d), [11, 31, 51], [0, 0, 0]), _with(PAIRS, "SELECT x.entity, x.pos_a AS p0, x.pos_b AS p1, y.pos_b AS p2 FROM pr x JOIN pr y ON x.entity = y.entity AND x.pos_b = y.pos_a JOIN pr z ON z.entity = x.entity AND z.pos_a = x.pos_a AND z.pos_b = y.pos_b WHERE x.sym_a = 11 AND x.sym_b = 31 AND y.sym_b = 51 AND x.rel = 0 AND y.rel = 0 AND z.rel = 0"))
EXPANDED = PAIRS + """,
ds AS (SELECT entity, pos_a, pos_b, t[1] AS first, least(t[2] - t[1], 9) AS d1, least(t[3] - t[2], 9) AS d2, least(t[4] - t[3], 9) AS d3 FROM (SELECT *, list_sort([sa, ea, sb, eb]) AS t FROM pr WHERE sym_a = 11 AND sym_b = 31))"""


def _durs(spark: SparkSession, d: str) -> DataFrame:
    return forecast.endpoint_durations(_pairs(spark, d).where("sym_a = 11 and sym_b = 31"), NEAR)


_add("tiep_durations", lambda s, d: _durs(s, d).select("entity", "pos_a", "pos_b", "first", *(F.get("durs", F.lit(i)).alias(f"d{i + 1}") for i in range(3))), _with(EXPANDED, "SELECT * FROM ds"))
_add("feature_expand", lambda s, d: forecast.expand(_durs(s, d)).select("entity", "pos_a", "pos_b", "t", *(F.get("features", F.lit(i))["on"].alias(f"on{i + 1}") for i in range(3)), *(F.get("features", F.lit(i))["done"].alias(f"done{i + 1}") for i in range(3))), _with(EXPANDED, "SELECT entity, pos_a, pos_b, t, 1 AS on1, CAST(t >= d1 AS INTEGER) AS on2, CAST(t >= d1 + d2 AS INTEGER) AS on3, least(t, d1) AS done1, CASE WHEN t >= d1 THEN least(t - d1, d2) ELSE 0 END AS done2, CASE WHEN t >= d1 + d2 THEN least(t - d1 - d2, d3) ELSE 0 END AS done3 FROM (SELECT *, unnest(range(d1 + d2 + d3 + 1)) AS t FROM ds)"))
LABELS = EXPANDED + """,
tx AS (SELECT entity, pos_a, pos_b, t, first + t + 2 AS tau FROM (SELECT *, unnest(range(d1 + d2 + d3 + 1)) AS t FROM ds)),
ty AS (SELECT tx.entity, pos_a, pos_b, t, max(struct_pack(s := start, e := "end", st := state)) AS m, any_value(tau) AS tau FROM tx LEFT JOIN (SELECT * FROM sti WHERE variable = 5) k ON k.entity = tx.entity AND k.start <= tau GROUP BY tx.entity, pos_a, pos_b, t)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    x = forecast.expand(_durs(spark, d)).select("entity", "pos_a", "pos_b", "t", (F.col("first") + F.col("t") + 2).alias("tau"))
    return intervals.covering(x, _sti(_obs(spark, d)).where("variable = 5"), "tau", "label")


_add("forecast_labels_infer", lambda s, d: _labelled(s, d).select("entity", "pos_a", "pos_b", "t", "label"), _with(LABELS, "SELECT entity, pos_a, pos_b, t, CASE WHEN m.e >= tau THEN m.st END AS label FROM ty"))
_add("forecast_labels_train", lambda s, d: _labelled(s, d).where("label is not null").select("entity", "pos_a", "pos_b", "t", "label"), _with(LABELS, "SELECT entity, pos_a, pos_b, t, m.st AS label FROM ty WHERE m.e >= tau"))
AGG = SYNTHETIC + """,
f1 AS (SELECT pattern, entity, time, symbol, avg(p) AS p FROM fc GROUP BY ALL),
fn AS (SELECT entity, time, count(DISTINCT pattern) AS n_active FROM f1 GROUP BY ALL)"""
for _n, _how, _sql in (("agg_average", "average", "sum(p) / any_value(n_active)"), ("agg_max", "max", "max(p)")):
    _joint = AGG + f", fj AS (SELECT entity, time, symbol, any_value(n_active) AS n_active, {_sql} AS p FROM f1 JOIN fn USING (entity, time) GROUP BY entity, time, symbol), fk AS (SELECT *, p / sum(p) OVER (PARTITION BY entity, time) AS pp FROM fj)"
    _add(_n, lambda s, d, how=_how: forecast.aggregate(_forecasts(s, d), how).select("entity", "time", "symbol", F.round("p", 6).alias("p"), "n_active"), _with(_joint, "SELECT entity, time, symbol, round(pp, 6) AS p, n_active FROM fk"))
    _add(f"{_n}_winner", lambda s, d, how=_how: forecast.winners(forecast.aggregate(_forecasts(s, d), how)), _with(_joint, "SELECT entity, time, n_active, symbol AS pred FROM (SELECT *, row_number() OVER (PARTITION BY entity, time ORDER BY round(pp, 9) DESC, symbol) AS k FROM fk) WHERE k = 1"))
WIN = AGG + ", fj AS (SELECT entity, time, symbol, sum(p) / any_value(n_active) AS p FROM f1 JOIN fn USING (entity, time) GROUP BY entity, time, symbol), fk AS (SELECT *, p / sum(p) OVER (PARTITION BY entity, time) AS pp FROM fj), fw AS (SELECT entity, time, symbol AS pred FROM (SELECT *, row_number() OVER (PARTITION BY entity, time ORDER BY round(pp, 9) DESC, symbol) AS k FROM fk) WHERE k = 1)" + MANIFEST[len(OBS):] + ", rg AS (SELECT fw.entity, fw.time, pred, regime, CAST(1 + (fw.entity * 7 + fw.time) % 3 AS INTEGER) AS y, CASE WHEN regime = 'seen' THEN fw.time > cut_time ELSE fw.time >= min(fw.time) OVER (PARTITION BY fw.entity) + 3 END AS scored FROM fw LEFT JOIN mf USING (entity))"


def _regime(spark: SparkSession, d: str) -> DataFrame:
    w = forecast.winners(forecast.aggregate(_forecasts(spark, d)))
    w = w.withColumn("covered", F.lit(True)).withColumn("y", (1 + (F.col("entity") * 7 + F.col("time")) % 3).cast("int"))
    return forecast.scored(w, split.forecast_manifest(_obs(spark, d), 0.7, 0.2), 3)


_add("regime_scored", lambda s, d: _regime(s, d).select("entity", "time", "regime", "scored"), _with(WIN, "SELECT entity, time, regime, scored FROM rg"))
_add("forecast_metrics", lambda s, d: forecast.measures(_regime(s, d).where("scored"), 3), _with(WIN + """,
mr AS (SELECT unnest(['overall', regime]) AS scope, y, pred FROM rg WHERE scored),
mc AS (SELECT scope, c, sum(t) AS t, sum(q) AS q, sum(tp) AS tp FROM (SELECT scope, y AS c, 1 AS t, 0 AS q, CAST(y = pred AS INTEGER) AS tp FROM mr UNION ALL SELECT scope, pred, 0, 1, 0 FROM mr) GROUP BY ALL)""", "SELECT scope, CAST(sum(t) AS BIGINT) AS n, round(sum(tp) / sum(t), 6) AS accuracy, round(sum(2 * tp / (t + q)) / 3, 6) AS macro_f1, round(sum(2 * tp / (t + q) * t) / sum(t), 6) AS weighted_f1, round(max(t) / sum(t), 6) AS baseline FROM mc GROUP BY scope"))
_add("agg_context_window", lambda s, d: (lambda f: forecast.latest_within(_obs(s, d).select("entity", "time").distinct(), f, 3))(_forecasts(s, d).where("symbol = 1").groupBy("pattern", "entity", "time").agg(F.max("p").alias("value"))), _with(SYNTHETIC + ", g AS (SELECT pattern, entity, time, max(p) AS value FROM fc WHERE symbol = 1 GROUP BY ALL)", "SELECT o.entity, g.pattern, o.time, max(g.time) AS from_time, arg_max(g.value, g.time) AS value FROM (SELECT DISTINCT entity, time FROM obs) o JOIN g ON g.entity = o.entity AND g.time BETWEEN o.time - 3 AND o.time GROUP BY ALL"))
_add("early_warning_decisions", lambda s, d: forecast.early_warning(_events(s, d), 0.5, 2), _with(EVENTS, "SELECT entity, min(time) AS decided FROM (SELECT *, count(*) OVER (PARTITION BY entity, run) AS size, row_number() OVER (PARTITION BY entity, run ORDER BY time) AS k FROM (SELECT *, n - row_number() OVER (PARTITION BY entity ORDER BY time) AS run FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY time) AS n FROM pe) WHERE p >= 0.5)) WHERE size >= 3 AND k = 2 GROUP BY entity"))
CONF = EVENTS + ", cf AS (SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN i >= k THEN y ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN i >= k THEN 1 - y ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN i < k THEN y ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN i < k THEN 1 - y ELSE 0 END) AS BIGINT) AS tn FROM (SELECT y, floor(p * 100 + 1e-9) AS i FROM pe), (SELECT unnest(range(101)) AS k) GROUP BY k)"
_add("threshold_confusion", lambda s, d: forecast.confusion(_events(s, d)), _with(CONF, "SELECT * FROM cf"))
_rate = lambda a, b: F.col(a) / (F.col(a) + F.col(b))
_add("roc_auc", lambda s, d: forecast.area(forecast.confusion(_events(s, d)), _rate("fp", "tn"), _rate("tp", "fn")), _with(CONF, "SELECT round(sum((x - px) * (y + py) / 2), 6) AS area FROM (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT fp / (fp + tn) AS x, tp / (tp + fn) AS y FROM cf) WINDOW w AS (ORDER BY x, y))"))
_add("pr_auc", lambda s, d: forecast.area(forecast.confusion(_events(s, d)), _rate("tp", "fn"), F.try_divide("tp", F.col("tp") + F.col("fp"))), _with(CONF, "SELECT round(sum((x - px) * (y + py) / 2), 6) AS area FROM (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT tp / (tp + fn) AS x, tp / (tp + fp) AS y FROM cf WHERE tp + fp > 0) WINDOW w AS (ORDER BY x, y))"))


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("time", F.floor(F.col("time") / 2000).cast("long"))


LEG = EVENTS + ", lg AS (SELECT * REPLACE (time // 2000 AS time) FROM pe)"
for _n, _how, _sql in (("legacy_agg_avg", "avg", "avg(p)"), ("legacy_agg_max", "max", "max(p)"), ("legacy_agg_min", "min", "min(p)"), ("legacy_agg_weighted", "weighted", "CASE WHEN sum(weight) > 0 THEN sum(p * weight) / sum(weight) ELSE avg(p) END")):
    _add(_n, lambda s, d, how=_how: forecast.legacy_aggregate(_legacy(s, d), how).select("entity", "time", *_r("p")), _with(LEG, f"SELECT entity, time, round({_sql}, 6) AS p FROM lg GROUP BY entity, time"))
_add("legacy_agg_top_pct", lambda s, d: forecast.legacy_aggregate(_legacy(s, d), "top").select("entity", "time", *_r("p")), _with(LEG, "SELECT entity, time, round(avg(p), 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY entity, time ORDER BY p DESC, pattern) AS k, count(*) OVER (PARTITION BY entity, time) AS n FROM lg) WHERE k <= ceil(n * 0.5) GROUP BY entity, time"))
_add("patterns_used", lambda s, d: _legacy(s, d).groupBy("entity", "time").agg(F.array_join(F.array_sort(F.collect_set("pattern")).cast("array<string>"), ",").alias("patterns")), _with(LEG, "SELECT entity, time, string_agg(CAST(pattern AS VARCHAR), ',' ORDER BY pattern) AS patterns FROM (SELECT DISTINCT entity, time, pattern FROM lg) GROUP BY entity, time"))
_add("config_summary", lambda s, d: _events(s, d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("sd")), _with(EVENTS, "SELECT pattern, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd FROM pe GROUP BY pattern"))


def _mdlp(src: str, out: str) -> str:
    h = lambda a, b: f"(CASE WHEN {a} > 0 THEN -{a} / ({a} + {b}) * log2({a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN -{b} / ({a} + {b}) * log2({b} / ({a} + {b})) ELSE 0 END)"
    return f"""{out}_w AS (SELECT *, lag(value) OVER w AS prev, coalesce(first <> lag(last) OVER w, false) AS edge, sum(n0) OVER e AS a0, sum(n1) OVER e AS a1, sum(n0) OVER w - n0 AS l0, sum(n1) OVER w - n1 AS l1
  FROM {src} WINDOW w AS (PARTITION BY variable, segment ORDER BY value), e AS (PARTITION BY variable, segment)),
{out}_g AS (SELECT variable, segment, (value + prev) / 2 AS cut, round({h('a0', 'a1')} - (l0 + l1) / (a0 + a1) * {h('l0', 'l1')} - (a0 + a1 - l0 - l1) / (a0 + a1) * {h('(a0 - l0)', '(a1 - l1)')}, 9) AS gain
  FROM (SELECT *, max(edge) OVER (PARTITION BY variable, segment) AS edges FROM {out}_w) WHERE prev IS NOT NULL AND (edge OR NOT edges)),
{out} AS (SELECT * FROM {out}_g QUALIFY row_number() OVER (PARTITION BY variable, segment ORDER BY gain DESC, cut) = 1)"""


MDLP = OBS + """,
vc AS (SELECT variable, value, count(*) FILTER (class = 0) AS n0, count(*) FILTER (class = 1) AS n1, arg_min(class, (entity, time)) AS first, arg_max(class, (entity, time)) AS last, 1 AS segment FROM obs JOIN cls USING (entity) GROUP BY variable, value),
""" + _mdlp("vc", "s1") + """,
v2 AS (SELECT vc.* REPLACE (CASE WHEN value >= cut THEN 2 ELSE 1 END AS segment) FROM vc JOIN s1 USING (variable)),
""" + _mdlp("v2", "s2")
_values = lambda s, d: supervised.value_counts(_obs(s, d), tables.classes(_obs(s, d)))
_add("mdlp_first_split", lambda s, d: supervised.best_splits(_values(s, d).withColumn("segment", F.lit(1))).select("variable", "cut", F.round("gain", 6).alias("gain")), _with(MDLP, "SELECT variable, cut, round(gain, 6) AS gain FROM s1"))
_add("mdlp_cutpoints", lambda s, d: supervised.entropy_cuts(_obs(s, d), tables.classes(_obs(s, d)), 3), _with(MDLP, "SELECT variable, cut FROM s1 UNION ALL SELECT variable, cut FROM (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY variable ORDER BY gain DESC, cut) = 1)"))
DP = DUR + """,
dp AS (SELECT * FROM (SELECT variable, state, duration, count(*) FILTER (class = 0) AS na, count(*) FILTER (class = 1) AS nb FROM du GROUP BY variable, state, duration) QUALIFY max(na) OVER (PARTITION BY variable, state) > 0 AND max(nb) OVER (PARTITION BY variable, state) > 0),
dc AS (SELECT *, sum(na) OVER e AS ta, sum(nb) OVER e AS tb, sum(na) OVER w AS fa, sum(nb) OVER w AS fb, lead(duration) OVER w AS nx, na + nb AS t FROM dp WINDOW e AS (PARTITION BY variable, state), w AS (PARTITION BY variable, state ORDER BY duration))"""
_dp = lambda s, d: supervised.class_pairs(_durations(s, d))
_add("duration_ks_score", lambda s, d: supervised.ks_score(_dp(s, d)), _with(DP, "SELECT variable, round(sum(x), 6) AS score FROM (SELECT variable, state, max(abs(fa / ta - fb / tb)) AS x FROM dc GROUP BY ALL) GROUP BY variable"))
_add("duration_wasserstein_score", lambda s, d: supervised.wasserstein_score(_dp(s, d)), _with(DP, "SELECT variable, round(sum(abs(fa / ta - fb / tb) * coalesce(nx - duration, 0)), 6) AS score FROM dc GROUP BY variable"))
_add("duration_rank_score", lambda s, d: supervised.rank_score(_dp(s, d)), _with(DP + ", rk AS (SELECT variable, state, sum(na * (fa + fb - t + (t + 1) / 2)) AS r, sum(t * t * t - t) AS ties, CAST(any_value(ta) AS DOUBLE) AS m, CAST(any_value(tb) AS DOUBLE) AS k FROM dc GROUP BY ALL), rv AS (SELECT *, m * k / 12 * (m + k + 1 - ties / ((m + k) * (m + k - 1))) AS v FROM rk)", "SELECT variable, round(sum(greatest(abs(r - m * (m + 1) / 2 - m * k / 2) - 0.5, 0) / sqrt(v)), 6) AS score FROM rv WHERE v > 0 GROUP BY variable"))
_add("duration_kl_score", lambda s, d: supervised.duration_kl_score(_dp(s, d)), _with(DP + """,
kg AS (SELECT variable, state, sum(na) AS ta, sum(nb) AS tb, min(duration) AS lo, max(duration) AS hi, CAST(least(10, greatest(2, floor(sqrt(sum(na) + sum(nb))))) AS BIGINT) AS bins FROM dp GROUP BY ALL HAVING sum(na) >= 2 AND sum(nb) >= 2 AND max(duration) > min(duration)),
kh AS (SELECT variable, state, CAST(least(bins - 1, floor((duration - lo) / ((hi + 1e-10::DOUBLE - lo) / bins))) AS BIGINT) AS bin, sum(na) AS na, sum(nb) AS nb FROM dp JOIN kg USING (variable, state) GROUP BY ALL),
kf AS (SELECT g.variable, (coalesce(na, 0) + 1e-10::DOUBLE) / (ta + 1e-10::DOUBLE * bins) AS p, (coalesce(nb, 0) + 1e-10::DOUBLE) / (tb + 1e-10::DOUBLE * bins) AS q FROM (SELECT *, unnest(range(bins)) AS bin FROM kg) g LEFT JOIN kh USING (variable, state, bin))""", "SELECT variable, round(sum((p - q) * ln(p / q) / 2), 6) AS score FROM kf GROUP BY variable"))
_add("duration_mean_difference_score", lambda s, d: supervised.mean_difference_score(_durations(s, d)), _with(DUR, "SELECT variable, round(sum(-(abs(m0 - m1) + 0.001 * (d0 + d1))), 6) AS score FROM (SELECT variable, state, coalesce(avg(duration) FILTER (class = 0), 0) AS m0, coalesce(avg(duration) FILTER (class = 1), 0) AS m1, coalesce(stddev_pop(duration) FILTER (class = 0), 0) AS d0, coalesce(stddev_pop(duration) FILTER (class = 1), 0) AS d1 FROM du GROUP BY ALL) GROUP BY variable"))
_add("self_transition_score", lambda s, d: supervised.self_transition_score(_binned(_obs(s, d)), tables.classes(_obs(s, d))), _with(BINS, "SELECT variable, round(sum(abs(s0 - s1)), 6) AS score FROM (SELECT variable, bin, coalesce(avg(CAST(bin = nb AS INTEGER)) FILTER (class = 0), 0) AS s0, coalesce(avg(CAST(bin = nb AS INTEGER)) FILTER (class = 1), 0) AS s1 FROM (SELECT *, lead(bin) OVER (PARTITION BY entity, variable ORDER BY time) AS nb FROM pts) JOIN cls USING (entity) WHERE nb IS NOT NULL GROUP BY ALL) GROUP BY variable"))
_add("tid3_mean_gaps", lambda s, d: supervised.mean_gaps(_durations(s, d)), _with(DUR, "SELECT variable, state, gap FROM (SELECT variable, state, round(abs(lead(m) OVER (PARTITION BY variable ORDER BY state) - m), 6) AS gap FROM (SELECT variable, state, avg(duration) AS m FROM du GROUP BY ALL)) WHERE gap IS NOT NULL"))
_add("score_summary_total", lambda s, d: supervised.with_total(search.welch_score(_durations(s, d))), _with(WELCH, "SELECT variable, round(sum(score), 6) AS score FROM (SELECT variable, round(sum(abs(t)), 6) AS score FROM tt GROUP BY variable) GROUP BY ROLLUP (variable)"))
CROSS = _pairs_sql(same_variable=True) + ", xd AS (SELECT sym_a, sym_b, rel, class, greatest(ea, eb) - least(sa, sb) AS duration FROM pr JOIN cls USING (entity))"
_cross = lambda s, d: supervised.cross_durations(_pairs(s, d, skip_same_variable=True), tables.classes(_obs(s, d)))
_add("cross_durations", lambda s, d: _cross(s, d).groupBy("sym_a", "sym_b", "rel", "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 6).alias("mean")), _with(CROSS, "SELECT sym_a, sym_b, rel, class, count(*) AS n, round(avg(duration), 6) AS mean FROM xd GROUP BY ALL"))
_add("cross_top_keys_score", lambda s, d: supervised.top_keys_score(_cross(s, d), 100), _with(CROSS + ", xs AS (SELECT sym_a, sym_b, rel, count(*) FILTER (class = 0) AS n0, count(*) FILTER (class = 1) AS n1, avg(duration) FILTER (class = 0) AS m0, avg(duration) FILTER (class = 1) AS m1, var_samp(duration) FILTER (class = 0) AS v0, var_samp(duration) FILTER (class = 1) AS v1 FROM xd GROUP BY ALL)", "SELECT round(coalesce(sum(t), 0) / 100, 6) AS score FROM (SELECT abs(m1 - m0) / sqrt(v0 / n0 + v1 / n1) AS t FROM xs WHERE n0 >= 2 AND n1 >= 2 AND v0 + v1 > 0 ORDER BY t DESC LIMIT 100)"))
_add("entity_states", lambda s, d: supervised.entity_equal_frequency(_obs(s, d), 2).select("entity", "variable", "time", "bin"), _with(OBS, "SELECT entity, variable, time, CASE WHEN value >= round(quantile_cont(value, 0.5) OVER (PARTITION BY entity, variable), 6) THEN 2 ELSE 1 END AS bin FROM obs"))


def _composite(spark: SparkSession, d: str) -> DataFrame:
    obs = _obs(spark, d)
    return supervised.composite({"knowledge": states.knowledge(obs, _known(spark)), "quantile": _binned(obs)})


COMPOSITE = BINS + """,
cr AS (SELECT entity, variable, 'knowledge' AS method, time, CASE WHEN variable = 5 THEN -1 WHEN value < 15 THEN 1 WHEN value < 35 THEN 2 WHEN value < 70 THEN 3 ELSE 4 END AS bin FROM obs UNION ALL SELECT entity, variable, 'quantile', time, bin FROM pts),
ci AS (SELECT *, row_number() OVER (ORDER BY variable, method, bin) AS id FROM (SELECT DISTINCT variable, method, bin FROM cr WHERE bin >= 0)),
cp AS (SELECT entity, variable, method, time, CAST(coalesce(id, -1) AS INTEGER) AS state FROM cr LEFT JOIN ci USING (variable, method, bin))"""
_add("composite_states", _composite, _with(COMPOSITE, "SELECT * FROM cp"))
_add("composite_intervals", lambda s, d: intervals.merge(_composite(s, d), GAP, ("entity", "variable", "method")), _with(COMPOSITE + ",\n" + _islands("cp", GAP, "ct").replace("entity, variable", "entity, variable, method"), "SELECT * FROM ct"))


def _prefix_scores(spark: SparkSession, d: str) -> DataFrame:
    obs = _obs(spark, d)
    levels = mining.mine(_pairs(spark, d), _least(spark, d), 3)
    stats = selection.class_statistics([selection.single_instances(intervals.positioned(_sti(obs))), levels[0]], tables.classes(obs))
    return selection.prefix_scores(levels[-1].select("symbols", "rels").distinct(), stats)


SELECT = TRIPLES + """,
f3k AS (SELECT pattern FROM f3 GROUP BY pattern HAVING count(DISTINCT entity) >= """ + LEAST + """),
p3 AS (SELECT DISTINCT '3-' || s0 || '_' || s1 || '_' || s2 || '_' || r01 || '_' || r02 || '_' || r12 AS pattern, '1-' || s0 || '_' AS q1, '2-' || s0 || '_' || s1 || '_' || r01 AS q2 FROM t3),
pi AS (SELECT '1-' || state || '_' AS q, entity, "end" - start AS x FROM sti UNION ALL SELECT '2-' || sym_a || '_' || sym_b || '_' || rel, entity, greatest(ea, eb) - sa FROM fr),
pt AS (SELECT q, class, round(count(*) / any_value(n_of), 3) AS vs, round(avg(n), 3) AS hs, round(avg(x), 3) AS mmd FROM (SELECT q, entity, count(*) AS n, avg(x) AS x FROM pi GROUP BY ALL) JOIN cls USING (entity) JOIN (SELECT class, count(*) AS n_of FROM cls GROUP BY class) USING (class) GROUP BY q, class),
pd AS (SELECT pattern, k, coalesce(b.vs, 0) - coalesce(a.vs, 0) AS vs, coalesce(b.hs, 0) - coalesce(a.hs, 0) AS hs, coalesce(b.mmd, 0) - coalesce(a.mmd, 0) AS mmd FROM (SELECT pattern, unnest([1, 2]) AS k, unnest([q1, q2]) AS q FROM p3 JOIN f3k USING (pattern)) z LEFT JOIN pt a ON a.q = z.q AND a.class = 0 LEFT JOIN pt b ON b.q = z.q AND b.class = 1),
px AS (SELECT pattern, round(max(vs) FILTER (k = 2), 3) AS diff_vs, round(max(hs) FILTER (k = 2), 3) AS diff_hs, round(max(mmd) FILTER (k = 2), 3) AS diff_mmd, round(avg(mmd * mmd), 3) AS mean_squared_mmd, round(avg(vs), 3) AS mean_diff_vs FROM pd GROUP BY pattern)"""
_add("pattern_prefix_scores", _prefix_scores, _with(SELECT, "SELECT * FROM px"))
_add("pattern_selection_flags", lambda s, d: selection.selected(_prefix_scores(s, d).select("pattern", "diff_vs", "diff_mmd"), ["diff_vs", "diff_mmd"], [5, 20], seed=0), _with(SELECT, """SELECT *, greatest(binary_diff_vs_20, binary_diff_mmd_20, binary_random_20) AS binary_all FROM (SELECT pattern, diff_vs, diff_mmd, """ + ", ".join(f"CAST(row_number() OVER (ORDER BY {o}) <= {n} AS INTEGER) AS binary_{m}_{n}" for m, o in (("diff_vs", "diff_vs DESC, pattern"), ("diff_mmd", "diff_mmd DESC, pattern"), ("random", "md5('0:' || pattern), pattern")) for n in (5, 20)) + " FROM px)"))
_add("cutpoint_stability", lambda s, d: supervised.cut_stability(_obs(s, d).groupBy((F.col("entity") % 5).alias("fold"), "variable").agg(F.median("value").alias("cut")).withColumn("i", F.lit(0)), 0.05), _with(OBS, "SELECT variable, i, round(stddev_samp(cut) / abs(avg(cut)), 6) AS cv, round(avg(CAST(abs(cut - mid) <= 0.05::DOUBLE * abs(mid) AS INTEGER)), 6) AS agreement FROM (SELECT *, median(cut) OVER (PARTITION BY variable) AS mid FROM (SELECT entity % 5 AS fold, variable, median(value) AS cut, 0 AS i FROM obs GROUP BY ALL)) GROUP BY variable, i"))


def queries() -> dict:
    from . import catalogue_more

    return Q | catalogue_more.Q


def oracle_sql() -> dict[str, str]:
    from . import catalogue_more

    return SQL | catalogue_more.SQL
