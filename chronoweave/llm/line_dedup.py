"""Removal of repeated runs of lines.

Lines are hashed; a hash over each `window` lines in a row decides whether a chunk ends there, so chunk boundaries
depend on content alone and come back together after an insertion. Beside chunks of two lines or more there are runs:
from each line the fewest lines on, and up to each line the fewest lines back, that hold more than `least` words. The
runs inside a passage of whole lines with more than `least` words cover it, and depend on nothing outside it, so they
find it wherever it occurs. A chunk or run that occurs again anywhere is removed but for its first occurrence, after
its bytes have been compared; lines that a repeat shares with its own first occurrence stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import _powers, in_slices, mix64, span_hashes, text_bytes, word_starts
from .common import fresh, row_key, small_batches, stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _chunks(hashes: np.ndarray, window: int, divisor: int) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk of one text: two lines or more, but for the last."""
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for j in range(1, window):
            rolled[j:] += hashes[: len(hashes) - j] * (GOLDEN ** np.uint64(j))
    out, last = [], 0
    for end in (np.flatnonzero(mix64(rolled) % np.uint64(divisor) == 0) + 1).tolist():
        if end - last >= 2:
            out.append((last, end - last))
            last = end
    return out + [(last, len(hashes) - last)] * (last < len(hashes))


def _runs(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first line, number of lines) of the shortest runs of more than `least` words from each line on and up to each
    line, by the lines' counts of words."""
    sums = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(words))
    end = np.searchsorted(sums, sums[:-1] + least, side="right")
    start = np.searchsorted(sums, sums[1:] - least, side="left") - 1
    on = [(a, e - a) for a, e in zip(at.tolist(), end.tolist()) if e <= len(words)]
    back = [(b, a + 1 - b) for a, b in zip(at.tolist(), start.tolist()) if b >= 0]
    return on + back


def chunks(docs: DataFrame, window: int, divisor: int, least: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row_key, at, n, hash): the chunks of two lines or more and the runs; null texts have none."""

    def run(batches):
        for batch in in_slices(batches, "t"):
            data, offsets = text_bytes(batch.column("t"))
            rows, at, n, hashes = [], [], [], []
            breaks = np.flatnonzero(data == 10)
            starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
            first = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)  # each text's first line
            # a line is hashed with the break before it, so no span is empty
            framed = np.insert(data, offsets[:-1], 10)
            own = np.flatnonzero(framed == 10)
            lines = span_hashes(framed, own, np.concatenate((own[1:], [len(framed)])))
            words = np.add.reduceat(word_starts(framed), own) if len(own) else own
            last = np.concatenate((first[1:], [len(starts)]))
            for i, (a, b) in enumerate(zip(first, last)):
                spans = {(s, k) for s, k in _chunks(lines[a:b], window, divisor) if k > 1}
                spans = np.array(sorted(spans | set(_runs(words[a:b], least))), np.int64).reshape(-1, 2)
                if not len(spans):
                    continue
                # a span's hash is that of its lines as they follow, whatever stands before it
                sums, powers = _prefix(lines[a:b])
                with np.errstate(over="ignore"):
                    h = mix64((sums[spans[:, 0] + spans[:, 1]] - sums[spans[:, 0]]) * powers[spans[:, 0]] + spans[:, 1].astype(np.uint64))
                rows.append(np.full(len(spans), i)), at.append(spans[:, 0]), n.append(spans[:, 1]), hashes.append(h.view(np.int64))
            take, at, n, hashes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, at, n, hashes))
            take = pa.array(take)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row_key").take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hashes)], ["doc_id", "row_key", "at", "n", "hash"])

    d = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("t")).where("t is not null")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, row_key string, at int, n int, hash long")


def _prefix(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of line hashes times powers, and the inverse powers."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(lines) + 1, np.uint64)
        np.cumsum(mix64(lines) * _powers(len(lines), int(GOLDEN) | 1), out=sums[1:])
        return sums, _powers(len(lines) + 1, pow(int(GOLDEN) | 1, -1, 1 << 64))


def joined_spans(spans: DataFrame, keys: list[str], at: str, n: str) -> DataFrame:
    """(keys, at, n): spans of the same keys that overlap or touch, as one."""
    w = Window.partitionBy(*keys).orderBy(at, n)
    ends = F.max(F.col(at) + F.col(n)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("_new", F.coalesce(ends < F.col(at), F.lit(True)).cast("int"))
    d = d.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy(*keys, "_part").agg(F.min(at).alias("_at"), F.max(F.col(at) + F.col(n)).alias("_end"))
    return d.select(*keys, F.col("_at").alias(at), (F.col("_end") - F.col("_at")).alias(n))


def removals(docs: DataFrame, window: int = 2, divisor: int = 2, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, cuts): for each row with something to remove, array of (at, n) in lines, which do not touch.

    The first occurrence is that of the smallest doc_id (null last), then row_key, then line."""
    small_batches(docs.sparkSession)
    c = stored(chunks(docs, window, divisor, least, doc_id, text), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "at")
    # rows that repeat have the same places
    again = c.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    again = again.select("hash", F.col("first.row_key").alias("of"), F.col("first.at").alias("of_at"))
    found = c.join(again, "hash").where("row_key != of or at != of_at").select("row_key", "of", "at", "n", (F.col("at") - F.col("of_at")).alias("shift"))
    # what a row shares with the same earlier row at the same distance is compared as a whole
    same = F.col("row_key") == F.col("of")
    found = stored(found.distinct(), "found")
    match = stored(joined_spans(found, ["row_key", "of", "shift"], "at", "n").withColumn("of_at", F.col("at") - F.col("shift")), "matches")
    ours = match.select("row_key", "at", "n", "of", "of_at")
    firsts = match.select(F.col("of").alias("row_key"), F.col("of_at").alias("at"), "n", "of", "of_at")
    wanted = ours.unionByName(firsts).distinct().groupBy("row_key").agg(F.collect_list(F.struct("at", "n", "of", "of_at")).alias("spans"))
    texts = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).alias("t"))
    seen = texts.join(wanted, "row_key").select(F.split("t", "\n", -1).alias("lines"), F.explode("spans").alias("x"))
    seen = seen.select("x.of", "x.of_at", "x.n", F.array_join(F.slice("lines", F.col("x.at") + 1, F.col("x.n")), "\n").alias("bytes"))
    # the bytes of a first occurrence and of all that matched it; a match whose bytes differ anywhere is not used
    differ = seen.groupBy("of", "of_at", "n").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a != b").select("of", "of_at", "n")
    differ = stored(differ, "differ")
    match = match.join(F.broadcast(differ), ["of", "of_at", "n"], "left_anti")
    # found again, span by span: a repeat that overlaps its own first occurrence loses the lines past that only
    from_ = F.when(same, F.greatest("at", F.col("at") - F.col("shift") + F.col("n"))).otherwise(F.col("at"))
    whole = match.select("row_key", "of", "shift", F.col("at").alias("m_at"), (F.col("at") + F.col("n")).alias("m_end"))
    cut = found.join(whole, ["row_key", "of", "shift"]).where("at >= m_at and at + n <= m_end")
    cut = cut.select("row_key", from_.cast("int").alias("at"), (F.col("at") + F.col("n") - from_).cast("int").alias("n")).where("n > 0").distinct()
    return joined_spans(cut, ["row_key"], "at", "n").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("cuts"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents as they came, without repeated chunks in `text`, and with `_lines`, `_removed`, `_cuts`: counts of
    lines, removed lines and removed stretches of lines.

    Null texts stay null (no lines); rows with the same id and text are one document and lose the same lines; a text
    may become empty, one of a single line too if that has more than `least` words.
    """
    key, cuts, lines = (fresh(x, docs.columns) for x in ("_line_key", "_line_cuts", "_line_split"))
    gone = removals(docs, doc_id=doc_id, text=text, **how).select(F.col("row_key").alias(key), F.col("cuts").alias(cuts))
    d = docs.withColumn(key, row_key(doc_id, text)).join(gone, key, "left").withColumn(lines, F.split(text, "\n", -1))
    left = F.filter(F.col(lines), lambda x, i: ~F.exists(cuts, lambda c: (i >= c["at"]) & (i < c["at"] + c["n"])))
    out = d.withColumn(text, F.when(F.col(cuts).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    removed = F.aggregate(F.coalesce(cuts, F.array().cast("array<struct<at:int,n:int>>")), F.lit(0), lambda acc, c: acc + c["n"])
    return out.select(*docs.columns, F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_lines"), removed.cast("long").alias("_removed"), F.coalesce(F.size(cuts), F.lit(0)).cast("long").alias("_cuts"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks (removed stretches), kept_sha256 (of what is left; null text: of nothing)."""
    d = deduplicate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **how)
    return d.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_cuts").alias("n_chunks"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
