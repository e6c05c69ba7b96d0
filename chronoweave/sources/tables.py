"""Observations, classes and the text format of interval files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ["click", "error", "purchase", "signup", "view"]
OBSERVATION = "entity long, variable int, time long, value double"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations (entity, variable, time, value) from `events`: the largest value of a user, type and day; a type
    that VARIABLES lacks has no number."""
    e = read(spark, sf_dir, "events")
    number = F.nullif(F.array_position(F.array(*map(F.lit, VARIABLES)), F.col("event_type")), F.lit(0)).cast("int")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return e.groupBy(F.col("user_id").alias("entity"), number.alias("variable"), day.alias("time")).agg(F.max("value").alias("value"))


def classes(obs: DataFrame) -> DataFrame:
    return obs.select("entity").distinct().select("entity", (F.col("entity") % 2).cast("int").alias("class"))


def read_csv(spark: SparkSession, path: str, schema: str = OBSERVATION) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def unpivot(wide: DataFrame, entity: str, time: str, variables: list[str]) -> DataFrame:
    """Wide rows (entity, time, one column for each variable) to long observations; null cells are left out."""
    long = wide.unpivot([entity, time], variables, "name", "value")
    number = F.array_position(F.array(*map(F.lit, variables)), F.col("name")).cast("int")
    return long.where("value is not null").select(F.col(entity).alias("entity"), number.alias("variable"), F.col(time).alias("time"), F.col("value").cast("double").alias("value"))


def panel(rows: DataFrame, instance: str, channels: Column) -> DataFrame:
    """array<array<double>> of channels and time points to long observations; variables and times from 1."""
    by_channel = rows.select(F.col(instance).alias("entity"), F.posexplode(channels).alias("variable", "points"))
    return by_channel.select("entity", (F.col("variable") + 1).alias("variable"), F.posexplode("points").alias("time", "value")).select("entity", "variable", (F.col("time") + 1).cast("long").alias("time"), F.col("value").cast("double").alias("value")).where("value is not null")


def read_ts(spark: SparkSession, path: str) -> DataFrame:
    """(instance, channel, time, value, label) of a time-series text file: after @data a line for each instance,
    channels between colons, values between commas, `?` for none, the label last."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    start = F.min(F.when(F.lower(F.trim("value")) == "@data", F.col("line")))
    lines = lines.join(F.broadcast(lines.agg(start.alias("start")))).where("line > start and trim(value) != ''")
    fields = F.split("value", ":")
    rows = lines.select("line", F.trim(F.element_at(fields, -1)).alias("label"), F.posexplode(F.slice(fields, 1, F.size(fields) - 1)).alias("channel", "points"))
    points = rows.select("line", "label", "channel", F.posexplode(F.split("points", ",")).alias("time", "v"))
    return points.select(F.col("line").alias("instance"), (F.col("channel") + 1).alias("channel"), (F.col("time") + 1).alias("time"), F.expr("try_cast(trim(v) AS double)").alias("value"), "label")


def cutoffs_from_json(spark: SparkSession, text: str) -> DataFrame:
    """(variable, low, high) from {"cutoffs": {"1": [low, high], ...}}."""
    parsed = spark.range(1).select(F.from_json(F.lit(text), "cutoffs map<string,array<double>>").alias("j"))
    return parsed.select(F.explode("j.cutoffs").alias("variable", "c")).select(F.col("variable").cast("int").alias("variable"), F.get("c", F.lit(0)).alias("low"), F.get("c", F.lit(1)).alias("high"))


def interval_lines(sti: DataFrame) -> DataFrame:
    """(entity, line): `start,end,state,variable;` for each interval, in order."""
    one = F.struct("start", "end", "state", "variable")
    text = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("start", "end", "state", "variable"))))
    return sti.groupBy("entity").agg(F.concat(F.array_join(text, ";"), F.lit(";")).alias("line"))


def parse_interval_lines(lines: DataFrame, keep_undefined: bool = False) -> DataFrame:
    """The inverse; state -1 is dropped unless kept."""
    parts = lines.select("entity", F.explode(F.array_remove(F.split("line", ";"), "")).alias("x")).select("entity", F.split("x", ",").alias("x"))
    out = parts.select("entity", F.get("x", F.lit(3)).cast("int").alias("variable"), F.get("x", F.lit(2)).cast("int").alias("state"), F.get("x", F.lit(0)).cast("long").alias("start"), F.get("x", F.lit(1)).cast("long").alias("end"))
    return out if keep_undefined else out.where("state != -1")


def write_interval_file(sti: DataFrame, path: str) -> None:
    """Two header lines, then two lines for each entity, in one text file."""
    n = sti.select("entity").distinct().count()
    head = sti.sparkSession.createDataFrame([(-1, f"startToncepts\nnumberOfEntities,{n}")], "entity long, value string")
    body = interval_lines(sti).select("entity", F.concat(F.col("entity").cast("string"), F.lit(";\n"), F.col("line")).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("entity").select("value").write.text(path)


def read_interval_file(spark: SparkSession, path: str, keep_undefined: bool = False) -> DataFrame:
    """An interval file; an entity's records stand in the line after its own."""
    whole = spark.read.text(path, wholetext=True)
    entity = F.split("value", r"\n(?=[^\n,;]*;\n)")
    blocks = whole.select(F.posexplode(entity).alias("i", "b")).where("i > 0").select(F.split("b", "\n").alias("b"))
    lines = blocks.select(F.regexp_replace(F.get("b", F.lit(0)), ";", "").cast("long").alias("entity"), F.get("b", F.lit(1)).alias("line"))
    return parse_interval_lines(lines, keep_undefined)
