"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised to 2**bits levels, strings by where their rows lie when all rows are sorted by them; rows are
sorted by the index of their cell on the curve, then by a hash of the text and id; the sorted run is cut where its bytes
reach a shard's part. A shard then spans a short piece of the curve, so min/max statistics prune it on every dimension.
Equal texts of a cell are neighbours; those of several cells, or more than a shard holds, are in several shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ordered_totals, row_key

#: Up to so many different strings a dimension's levels are broadcast; more are joined.
FEW = 10_000


def _steps(dims: int) -> list[tuple[int, int]]:
    """For each state (entry corner, main axis) and each corner of the cube: (place on the curve, next state).

    The states are those of the compact form of the curve: Gray-code corners seen from the entry, rotated to the axis.
    """
    size, mask = 1 << dims, (1 << dims) - 1
    rot = lambda x, r: ((x >> r % dims) | (x << (dims - r % dims))) & mask
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(size)}
    ones = lambda i: ((i ^ (i + 1)).bit_length() - 1) % dims
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    axis = lambda i: 0 if i == 0 else ones(i - 1) if i % 2 == 0 else ones(i)
    out = []
    for e in range(size):
        for d in range(dims):
            for corner in range(size):
                i = place[rot(corner ^ e, d + 1)]
                out.append((i, (e ^ rot(entry(i), -(d + 1))) * dims + (d + axis(i) + 1) % dims))
    return out


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Place on the curve of the cell with these levels, each 0 .. 2**bits - 1."""
    dims = len(levels)
    steps = _steps(dims)
    at, to = F.array(*(F.lit(i) for i, _ in steps)), F.array(*(F.lit(s) for _, s in steps))
    levels = [x.cast("int") for x in levels]

    def corner(level: Column) -> Column:
        out = F.lit(0)
        for j, x in enumerate(levels):
            out = out + F.expr("int(1)") * (F.floor(x / F.pow(F.lit(2.0), level)).cast("int") % 2) * (1 << j)
        return out

    def step(acc: Column, level: Column) -> Column:
        i = acc["s"] * (1 << dims) + corner(level)
        return F.struct((acc["h"] * (1 << dims) + F.get(at, i)).cast("long").alias("h"), F.get(to, i).cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def _string_levels(df: DataFrame, c: str, bits: int) -> DataFrame:
    """(value, level) of each string: where the middle of its rows lies among all rows in the order of the strings."""
    n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    run = ordered_totals(n, "_all", ["value"], "n")
    total = n.agg(F.sum("n")).first()[0] or 1
    levels = run.select("value", F.floor((F.col("_before") + F.col("n") / 2) * F.lit(float(1 << bits)) / F.lit(total)).cast("int").alias("level"))
    return F.broadcast(levels) if levels.limit(FEW + 1).count() <= FEW else levels


def quantise(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Adds `_q0`, `_q1`, ...: numbers by their logarithm between the smallest and the largest, strings by their rows' places. Null: level 0."""
    kinds = dict(df.dtypes)
    numbers = {i: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for i, c in enumerate(dims) if kinds[c] != "string"}
    ends = df.agg(F.lit(0), *(f(x).alias(f"{n}{i}") for i, x in numbers.items() for n, f in (("lo", F.min), ("hi", F.max)))).first()
    top = (1 << bits) - 1
    for i, c in enumerate(dims):
        if i in numbers:
            lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
            level = F.lit(0) if lo is None or not hi > lo else F.coalesce(F.least(F.lit(top), F.floor((numbers[i] - lo) / (hi - lo) * (top + 1)).cast("int")), F.lit(0))
            df = df.withColumn(f"_q{i}", level)
        else:
            levels = _string_levels(df, c, bits).select(F.col("value").alias(f"_v{i}"), F.col("level").alias(f"_l{i}"))
            df = df.join(levels, F.col(c) == F.col(f"_v{i}"), "left").withColumn(f"_q{i}", F.coalesce(f"_l{i}", F.lit(0))).drop(f"_v{i}", f"_l{i}")
    return df


def shard(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key, size, text_crc32, curve, law, shard, slot, grown_shard.

    `size` is the text's UTF-8 bytes (null: none) plus 16. Law `bytes`: cuts lie where the sorted run's bytes pass a
    multiple of an equal part, so a shard's bytes differ from it by less than a row at either end. Empty tables give
    no rows; null ids, sources and languages sort first; repeated rows take slots of their own; columns other than
    the dimensions are not read. Fewer rows than shards leave some shards empty.
    """
    run = _placed(docs, shards, dims, bits, doc_id, text, carry=False)
    return run.select("doc_id", "row_key", "size", "text_crc32", "curve", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _placed(docs: DataFrame, shards: int, dims: tuple[str, ...], bits: int, doc_id: str, text: str, carry: bool) -> DataFrame:
    """The columns of shard(), and with `carry` the row itself as `_doc`."""
    named = {"size", "text_crc32"}
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        row_key(doc_id, text).alias("row_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("_h"),
        *(F.col(c).alias(f"_d{i}") for i, c in enumerate(dims) if c not in named),
        *([F.struct(*docs.columns).alias("_doc")] if carry else []),
    )
    base = quantise(base, [c if c in named else f"_d{i}" for i, c in enumerate(dims)], bits)
    keyed = base.withColumn("curve", hilbert_index([F.col(f"_q{i}") for i in range(len(dims))], bits)).withColumn("_all", F.lit(0))
    kept = ["doc_id", "row_key", "size", "text_crc32", "curve", *(["_doc"] if carry else [])]
    keyed = keyed.select(*kept, "_h", "_all").withColumn("_tie", F.monotonically_increasing_id())
    run = ordered_totals(keyed, "_all", ["curve", "_h", "doc_id", "_tie"], "size")
    total = docs.agg(F.sum((F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long"))).first()[0] or 1
    # the shard that holds a row's middle byte
    run = run.withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("_before") + F.col("size") / 2) * F.lit(shards) / F.lit(total))).cast("int")).select(*kept, "shard", "_rank")
    first = run.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return run.join(F.broadcast(first), "shard").select(*kept, "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot"))  # at most `shards` rows


def write_shards(docs: DataFrame, path: str, shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = 5, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents, with their columns as they came, to `path`: one folder for each shard (a partition column
    `shard`, or `_shard` where that name is taken), rows in slot order. Each of several equal rows goes to its own slot."""
    run = _placed(docs, shards, dims, bits, doc_id, text, carry=True)
    name = fresh("shard", docs.columns)
    run = run.repartitionByRange(2 * shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    run.select("_doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
