"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents one after another in a pseudorandom order, are packed into blocks of fixed
length. The mix has as many slots as the sources' targets need; a seeded permutation of all slots deals them to output
shards, so a shard's counts by source are a multinomial draw under the condition that the totals meet the targets
(free draws would break the limit of passes). A source's slots walk through a permutation of its block indices, once
for each pass, and the blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, ordered_totals, row_key, shuffle_partitions

TOKEN = r"[^\x20\x09-\x0D]+"
ROUNDS = 24


def permuted(x: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Image of x under a seeded permutation of 0 .. n - 1, for any n: swap-or-not rounds, each its own inverse."""

    def swap(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(seed, r), n) - acc + n, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(acc, mirror)), F.lit(2)) == 1, mirror).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row for each source.

    Sources in code-point order, null last, take the weights in turn and share `share` of all sizes; a target stops
    at `passes` times the source's size and what is left over goes to the others by weight: the level that this
    settles on is found in one pass over the sources ordered by the level at which each is full.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source, not for each document
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("most", (passes * F.col("source_size")).cast("double")).withColumn("full_at", F.col("most") / F.col("weight"))
    filled = Window.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    w = (
        w.withColumn("goal", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        # the first source that the level does not fill sets it for all later ones
        .withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(everything)["level"])
    )
    return w.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, block: int = 64, out_shards: int = 64, seed: int = 17, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, targets).

    documents: doc_id, row_key, source, size, source_size, target: one row for each row of `docs`, with `_row`.
    pieces: what the mix takes: out_shard, out_slot, source, block, `_row`, from_word, to_word (end exclusive), once
    for each time a block is taken. targets: source_targets().
    Null texts have no words; a null source is a source; repeated rows count each; empty tables give empty results;
    a source without words is never taken; other columns are not read.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long").alias("size")
    ).withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    # the order within a source is the same in every run; _row tells rows apart that are the same throughout
    d = d.withColumn("_order", F.xxhash64(F.lit(seed), "row_key")).withColumn("_tie", F.monotonically_increasing_id())
    run = ordered_totals(d, "_g", ["_order", "row_key", "_tie"], "size").withColumnRenamed("_rank", "_row")
    targets = source_targets(run)
    t = targets.withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))).drop("source")
    documents = run.join(t, "_g").select("doc_id", "row_key", "_g", "source", "size", "source_size", "target", "_row", "_before")

    blocks = F.ceil(F.col("source_size") / block).cast("long")
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    rest = F.round((F.col("target") - whole * F.col("source_size")) / block).cast("long")
    need = (
        t.where("source_size > 0")
        .withColumn("blocks", blocks)
        .withColumn("slots", F.least(passes * F.col("blocks"), whole * F.col("blocks") + F.least(rest, F.col("blocks"))))
        .withColumn("slots0", F.coalesce(F.sum("slots").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))
    )
    runs = 4096  # slots that one row of the first explode stands for
    slots = (
        need.where("slots > 0")
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(runs).cast("long"))))
        .repartition(shuffle_partitions(docs.sparkSession), "_g", "first")
        .withColumn("j", F.explode(F.sequence("first", F.least(F.col("first") + runs, F.col("slots")) - 1)))
        .select(
            "_g",
            permuted(F.pmod("j", "blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "_g", F.lit("blocks"))).alias("block"),
            permuted(F.col("slots0") + F.col("j"), F.col("all_slots"), F.lit(seed).cast("long")).alias("deal"),
        )
        .select("_g", "block", F.pmod("deal", F.lit(out_shards)).cast("int").alias("out_shard"), F.floor(F.col("deal") / out_shards).cast("long").alias("out_slot"))
    )
    cut = (
        run.where("size > 0")
        .select("_g", "source", "_row", "_before", "size", F.explode(F.sequence(F.floor(F.col("_before") / block).cast("long"), F.floor((F.col("_before") + F.col("size") - 1) / block).cast("long"))).alias("block"))
        .select("_g", "source", "_row", "block", F.greatest(F.lit(0), F.col("block") * block - F.col("_before")).alias("from_word"), F.least("size", (F.col("block") + 1) * block - F.col("_before")).alias("to_word"))
    )
    pieces = slots.hint("merge").join(cut, ["_g", "block"])  # its few rows become many: not for a broadcast
    pieces = pieces.select("out_shard", "out_slot", "_g", "source", "block", "_row", "from_word", "to_word")
    return documents, pieces, targets


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, row_key, source, size, source_size, target, taken (words in the mix, repeats counted)."""
    documents, pieces, _ = mix(docs, **how)
    per = pieces.groupBy("_g", "_row").agg(F.sum(F.col("to_word") - F.col("from_word")).cast("long").alias("taken"))
    return documents.join(per, ["_g", "_row"], "left").select("doc_id", "row_key", "_row", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The mix itself: (out_shard, out_slot, words): the words of each slot's block in the order of its pieces."""
    documents, pieces, _ = mix(docs, doc_id=doc_id, text=text, **how)
    words = docs.select(row_key(doc_id, text).alias("row_key"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)).alias("w")).dropDuplicates(["row_key"])
    cut = pieces.join(documents.select("_g", "_row", "row_key", "_before"), ["_g", "_row"]).join(words, "row_key")
    cut = cut.select("out_shard", "out_slot", F.struct((F.col("_before") + F.col("from_word")).alias("at"), F.slice("w", F.col("from_word").cast("int") + 1, (F.col("to_word") - F.col("from_word")).cast("int")).alias("w")).alias("p"))
    return cut.groupBy("out_shard", "out_slot").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["w"])).alias("words"))


def resampled(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The documents as often as the mix takes them, with their columns as they came.

    A document's words taken over its size, rounded down or up by a hash of its row so that sums hold on average:
    0 to `passes` copies. Documents without words are kept once.
    """
    key, copies_of, copy = (fresh(x, docs.columns) for x in ("_mix_key", "_times", "_copy"))
    t = taken(docs, seed=seed, **how)
    part = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(1 << 20)) / float(1 << 20)
    times = t.select(F.col("row_key").alias(key), F.when(F.col("size") == 0, 1).otherwise(F.floor(part + draw)).cast("int").alias(copies_of))
    times = times.groupBy(key).agg(F.max(copies_of).alias(copies_of))
    copies = docs.withColumn(key, row_key(how.get("doc_id", "doc_id"), how.get("text", "text"))).join(times, key).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies_of))))
    return copies.select(*docs.columns)
