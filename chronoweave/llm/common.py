"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAYBE_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset, as in local tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="chronoweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """Rows fixed by a reliable checkpoint: a lost executor cannot change what partition ids were read from."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches of texts that JVM and Python workers hold at once, for this session from now on."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like `name` that is none of `taken`, in any case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """Words of a text, as they are written; null: none."""
    return F.coalesce(F.array_remove(F.split(c, WORD_BREAK, -1), ""), F.array().cast("array<string>"))


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_key(*cols: str) -> Column:
    """The same for rows with the same values, nulls included; distinct ones differ."""
    return F.md5(F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols)))


def maybe_among(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str | None = None) -> DataFrame:
    """Rows whose `key` may be one of `wanted`: all that are, and a few others with the same hash; a join that follows moves less.

    Every executor knows which of MAYBE_BITS hash values occur, in words of 64 of them, however many rows there are."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(MAYBE_BITS))
    word = lambda c: F.shiftright(at(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.expr("1L"), F.pmod(at(c), F.lit(64)).cast("int"))
    k = F.col(wanted_key or key)
    bits = wanted.select(word(k).alias("_word"), bit(k).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return df.join(F.broadcast(bits), (word(F.col(key)) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit(F.col(key))) != 0), "left_semi")


def ordered_totals(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds `_rank` (rows before, within the group) and `_before` (sum of `value` before), however large a group is.

    Rows are range-partitioned by (group, order); each partition's totals give its offset, so no group meets in one
    task. `group` must not be null.
    """
    spark = df.sparkSession
    parts = stable(df.repartitionByRange(2 * shuffle_partitions(spark), group, *order).withColumn("_pid", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_pid", group)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
        .select("_pid", group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v0"))
    )
    here = Window.partitionBy("_pid", group).orderBy(*order)
    return (
        parts.withColumn("_r", F.row_number().over(here))
        .withColumn("_s", F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, ["_pid", group])
        .withColumn("_rank", F.col("_n0") + F.col("_r") - 1)
        .withColumn("_before", F.col("_v0") + F.col("_s") - F.col(value))
        .drop("_pid", "_r", "_s", "_n0", "_v0")
    )
