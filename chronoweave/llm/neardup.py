"""Near-duplicate detection by weighted minwise signatures.

A document is the multiset of its five-word shingles. Weight is discretised to whole numbers and cut into the dyadic
ranges (0,1], (1,2], (2,4], ...; each shingle has an independent Poisson process on each range, whose rate is the
range's width and whose points carry a time, a weight level inside the range and a signature component. A document
sees the points at levels up to its weight; a component is the earliest point seen. Two documents agree in a
component with a probability of exactly their weighted Jaccard similarity.

Documents with the same words are one node. Bands of the signature make buckets. A node is the more central the larger
its buckets are: copies close to what a group was copied from share their values with most of the group. In each bucket
all nodes are compared with the most central one, which is much the same node in all buckets of a group; in buckets that
then hold several classes, with the most central node of another class. Whatever pairs of different classes are left
in a bucket are compared too, so no bucket is capped: they have to pass longer signatures (FINE components, two bits of
each), made for these nodes alone, and count in the first bucket that they share. A pair whose signatures differ too much for the threshold (one bit of each component, six
deviations) is not looked up; every other pair is verified on the multisets of 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import in_slices, mix64, word_hashes
from .common import fresh, maybe_among, row_key, small_batches, stable, stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Components of the longer signatures.
FINE = 2048


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 64-bit numbers."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int, m: int, cells: int = 1 << 15) -> np.ndarray:
    """n x m earliest times; elements[i] has weight weights[i] >= 1 in the multiset of row rows[i]; no row may be empty.

    About `cells` points are drawn at a time, one of each element at least; the result does not depend on it."""
    out = np.full((n, m), np.inf)
    total = np.bincount(rows, weights, n)
    limit = m * (np.log(m) + 3) / np.maximum(total, 1)
    todo = np.ones(n, bool)
    while todo.any():
        at = np.flatnonzero(todo[rows])
        level, e, r, w = 0, elements[at], rows[at], weights[at]
        while len(e):
            floor = 0 if level == 0 else 1 << (level - 1)
            width = 1 if level == 0 else floor
            with np.errstate(over="ignore"):
                ee, rr, ww, t = mix64(e + GOLDEN * np.uint64(level + 1)), r, w, np.zeros(len(e))
                k = 0
                while len(ee):
                    # several points of each process at once, about as many as are still to come
                    step = max(1, min(64, cells // len(ee), 1 + int(((limit[rr] - t) * width).mean())))
                    odd = np.arange(k + 1, k + step + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                    k += step
                    draw = mix64(ee[:, None] + GOLDEN * odd)
                    times = -(np.log(_uniform(draw)) / width)
                    times[:, 0] += t
                    times = np.cumsum(times, axis=1)
                    go = times <= limit[rr][:, None]
                    i, _ = np.nonzero(go)
                    pick = mix64(draw[go] ^ GOLDEN)
                    seen = floor + 1 + (pick >> np.uint64(32)).astype(np.int64) % width <= ww[i]
                    np.minimum.at(out.reshape(-1), rr[i[seen]] * m + (pick[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, times[go][seen])
                    on = go[:, -1]
                    ee, rr, ww, t = ee[on], rr[on], ww[on], times[on, -1]
            level += 1
            more = w > (1 << (level - 1))
            e, r, w = e[more], r[more], w[more]
        todo = ~np.isfinite(out).all(1)
        limit = np.where(todo, limit * 2, limit)
    return out


def shingle_multisets(texts: pa.Array, width: int) -> tuple[list, np.ndarray, np.ndarray]:
    """For each text: (shingle hashes sorted, counts), or None without words; a text of fewer words than `width` is one
    shingle. Also two 64-bit hashes of each text's word sequence."""
    words, offsets = word_hashes(texts)
    with np.errstate(over="ignore"):
        combined = np.zeros(len(words), np.uint64)
        for j in range(width):
            n = max(0, len(words) - j)
            combined[:n] = mix64(combined[:n] + words[j:] + GOLDEN) if j else mix64(words + GOLDEN)
    sets, one, two = [], np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(words), dtype=np.uint64) if len(words) else np.zeros(0, np.uint64)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            if a == b:
                sets.append(None)
                continue
            own = place[: b - a]
            one[i], two[i] = mix64(words[a:b] + own * GOLDEN).sum(), mix64((words[a:b] ^ np.uint64(0x5851F42D4C957F2D)) + own * np.uint64(0xD1342543DE82EF95)).sum()
            if b - a < width:
                sets.append((np.array([one[i]], np.uint64), np.array([1])))
            else:
                sets.append(np.unique(combined[a : b - width + 1], return_counts=True))
    return sets, one, two


def sketches(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row_key, node, weight, bands, low, high, row) for each row; node and what follows are null without words.

    low, high: one bit of each of the first 128 components. node: 16 bytes that tell word sequences apart."""
    m = bands * rows

    def run(batches):
        for batch in in_slices(batches, "t", 1 << 20):
            sets, one, two = shingle_multisets(batch.column("t"), width)
            full = [i for i, x in enumerate(sets) if x is not None]
            nodes, weight, bandings, low, high = ([None] * len(sets) for _ in range(5))
            if full:
                elements, weights = (np.concatenate([sets[i][j] for i in full]) for j in (0, 1))
                owner = np.repeat(np.arange(len(full)), [len(sets[i][0]) for i in full])
                sig = signatures(elements, weights, owner, len(full), m).view(np.uint64).reshape(len(full), bands, rows)
                bits = np.packbits((mix64(sig.reshape(len(full), m)) & np.uint64(1)).astype(bool), axis=1)
                bits = np.pad(bits, ((0, 0), (0, max(0, 16 - bits.shape[1]))))[:, :16].copy().view(np.int64)
                with np.errstate(over="ignore"):
                    band = np.full((len(full), bands), GOLDEN) * (np.arange(bands, dtype=np.uint64) + np.uint64(1))
                    for j in range(rows):
                        band = mix64(band + sig[:, :, j])
            for k, i in enumerate(full):
                nodes[i] = one[i].tobytes() + two[i].tobytes()
                weight[i] = int(sets[i][1].sum())
                bandings[i] = band[k].view(np.int64)
                low[i], high[i] = int(bits[k, 0]), int(bits[k, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(nodes, pa.binary()), pa.array(weight, pa.int64()), pa.array(bandings, pa.list_(pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["doc_id", "row_key", "node", "weight", "bands", "low", "high"],
            )

    d = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("t"))
    out = d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, row_key string, node binary, weight long, bands array<long>, low long, high long")
    return out.withColumn("row", F.monotonically_increasing_id())


def multisets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles, counts) of rows (node, t) with words: 64-bit hashes in ascending order, and how often each occurs."""

    def run(batches):
        for batch in in_slices(batches, "t", 4 << 20):
            sets, _, _ = shingle_multisets(batch.column("t"), width)
            shingles = pa.array([None if x is None else x[0].tobytes() for x in sets], pa.binary())
            counts = pa.array([None if x is None else x[1].astype(np.uint32).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), shingles, counts], ["node", "shingles", "counts"])

    return texts.select("node", "t").mapInArrow(run, "node long, shingles binary, counts binary")


def agreeing_bits(components_: int, threshold: float) -> int:
    """How many of 128 bits two documents at the threshold share at least: six deviations under what is expected (one
    pair in 10**9 shares fewer). Components that are missing share their bits."""
    n = min(128, components_)
    p = threshold + (1 - threshold) / 2
    return int(np.floor(128 - n + n * p - 6 * np.sqrt(n * p * (1 - p))))


def fine_least(threshold: float) -> int:
    """How many of FINE two-bit components two documents at the threshold share at least, but for one pair in 10**6."""
    p = threshold + (1 - threshold) / 4
    return int(np.floor(FINE * p - 5 * np.sqrt(FINE * p * (1 - p))))


def fine_bits(sets: DataFrame) -> DataFrame:
    """(node, fine): two bits of each of FINE components as a struct of longs, first bits p0, p1, ..., then second bits q0, q1, ...

    A few multisets are signed at a time, so memory does not grow with the table."""
    longs = FINE // 64
    names = [f"p{i}" for i in range(longs)] + [f"q{i}" for i in range(longs)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                held = [[np.frombuffer(x.as_buffer(), kind) for x in part.column(c)] for c, kind in (("shingles", np.uint64), ("counts", np.uint32))]
                owner = np.repeat(np.arange(part.num_rows), [len(x) for x in held[0]])
                with np.errstate(over="ignore"):
                    elements = mix64(np.concatenate(held[0]) + GOLDEN)
                sig = mix64(signatures(elements, np.concatenate(held[1]).astype(np.int64), owner, part.num_rows, FINE).view(np.uint64))
                planes = [np.packbits((sig >> np.uint64(k) & np.uint64(1)).astype(bool), axis=1).view(np.int64) for k in (0, 1)]
                columns = [pa.array(np.ascontiguousarray(x[:, i])) for x in planes for i in range(longs)]
                yield pa.RecordBatch.from_arrays([part.column("node"), *columns], ["node", *names])

    out = sets.mapInArrow(run, "node long, " + ", ".join(f"{n} long" for n in names))
    return out.select("node", F.struct(*names).alias("fine"))


def fine_agreement(a: str, b: str) -> str:
    """SQL for the number of components whose two bits agree."""
    return f"{FINE} - (" + " + ".join(f"bit_count(({a}.p{i} ^ {b}.p{i}) | ({a}.q{i} ^ {b}.q{i}))" for i in range(FINE // 64)) + ")"


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by the threshold at least, with their similarity."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    side = lambda x: maybe_among(sets, "node", pairs, x).select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}"))

    def run(batches):
        for batch in batches:
            col = [batch.column(c) for c in ("sa", "ca", "sb", "cb")]
            sims = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                sa, ca, sb, cb = (np.frombuffer(c[i].as_buffer(), np.uint32 if k % 2 else np.uint64) for k, c in enumerate(col))
                _, x, y = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
                both = int(np.minimum(ca[x], cb[y]).sum())
                sims[i] = both / (int(ca.sum()) + int(cb.sum()) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], ["a", "b", "similarity"]).filter(pa.array(sims >= threshold - 1e-12))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node that a chain of links reaches.

    Smallest labels spread along links and are shortened by jumping to the label's own label; each round is a checkpoint."""
    both = stable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = labels.join(near, "node").join(far, "root").select("node", F.least("root", "near", "far").alias("new"), (F.least("near", "far") < F.col("root")).alias("moved"))
        new = stable(new)
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not moved:
            return labels


def joined_classes(roots: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links that gave `roots` and of more `links`: only those between classes are followed."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(between.where("a != b"))
    # a node that `roots` lacks has stood for itself
    old = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stable(old.unionByName(tops.join(roots, "node", "left_anti")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 32, rows: int = 4, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: a row for each row of `docs`: doc_id, row_key, class_id (smallest doc_id of its class), class_size,
    stands (true for one row of each class, one with that id). links: (a, b, similarity) between
    representative rows of different texts, by row number.
    Texts without words, null ones included, are classes of their own; rows that repeat are in one class; null ids
    come last; other columns are not read; an empty table gives empty results.
    """
    small_batches(docs.sparkSession)
    s = stored(sketches(docs, doc_id, text, width, bands, rows), "sketches")
    nodes = stable(s.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"), F.count(F.lit(1)).alias("_n")))
    # of the rows of a node, which have the same sketch, one; from here on its number names the node
    reps = s.join(nodes.select(F.col("head.row").alias("row")), "row", "left_semi").drop("node").withColumnRenamed("row", "node")
    entries = reps.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(entries.join(shared, "bucket"), "met")
    # nodes that share a bucket, how central they are, and their multisets, from one of the rows with the node's key
    wanted = stored(met.groupBy("node").agg(F.sum("size").alias("central")).join(reps.select("node", "row_key", "weight", "low", "high"), "node"), "wanted")
    texts = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).alias("t"))
    texts = maybe_among(texts, "row_key", wanted).join(wanted.select("row_key", "node"), "row_key")
    sets = stored(multisets(texts.dropDuplicates(["row_key"]), width), "sets")
    least = agreeing_bits(bands * rows, threshold)
    one = lambda: F.struct("central", "node", "weight", "low", "high")
    buckets = stored(met.drop("size").join(wanted.drop("row_key"), "node").select("bucket", one().alias("p")), "buckets")

    def compared(pairs: DataFrame) -> DataFrame:
        """Verified links of nodes p with leaders `lead` that may reach the threshold, by total weight and by one bit of
        each component."""
        near = F.least("p.weight", "lead.weight") >= F.lit(threshold) * F.greatest("p.weight", "lead.weight")
        same = 128 - F.bit_count(F.col("p.low").bitwiseXOR(F.col("lead.low"))) - F.bit_count(F.col("p.high").bitwiseXOR(F.col("lead.high")))
        close = pairs.where(near & (same >= least)).select(F.col("lead.node").alias("a"), F.col("p.node").alias("b")).distinct()
        return stored(verified(close, sets, threshold), "links")

    leads = buckets.groupBy("bucket").agg(F.max("p").alias("lead"))
    links = compared(buckets.join(leads, "bucket").where("p.node != lead.node"))
    roots = components(links)

    # what is left of buckets that hold several classes; the second leader is of another class than the first
    c = buckets.join(roots.select(F.col("node").alias("_node"), "root"), F.col("p.node") == F.col("_node"), "left").select("bucket", "p", F.coalesce("root", "p.node").alias("root"))
    several = c.groupBy("bucket").agg(F.max(F.struct("p", "root")).alias("x"), F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket", F.col("x.p").alias("lead"), F.col("x.root").alias("lead_root"))
    mixed = c.join(several, "bucket")
    other = mixed.where("root != lead_root").groupBy("bucket").agg(F.max(F.struct("p", "root")).alias("second"))
    mixed = stored(mixed.join(other, "bucket").select("bucket", "p", "root", F.col("lead.node").alias("first"), F.col("second.p").alias("lead"), F.col("second.root").alias("second_root")), "mixed")
    again = compared(mixed.where("root != second_root and p.node != first"))
    if again.limit(1).count():
        links = stored(links.unionByName(again).distinct(), "links")
        roots = joined_classes(roots, again)
    # pairs in a bucket that no leader has covered and whose classes, by all links so far, still differ
    now = mixed.where("p.node != first and p.node != lead.node").select("bucket", "p.*").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = now.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one != other").select("bucket")
    left = stored(now.join(apart, "bucket").select("bucket", "root", *(F.col(n) for n in ("node", "weight", "low", "high"))), "left")
    some = left.select("node").distinct()
    fine = fine_bits(maybe_among(sets, "node", some).join(some, "node", "left_semi")).join(reps.select("node", "bands"), "node")
    rest = left.join(stored(fine, "fine"), "node").select("bucket", "root", F.struct("node", "weight", "low", "high", "fine", "bands").alias("p"))
    # the same rows on both sides, so that they are moved once
    near = F.expr("least(x.p.weight, y.p.weight) >= " + repr(float(threshold)) + " * greatest(x.p.weight, y.p.weight)")
    alike = F.expr(f"128 - bit_count(x.p.low ^ y.p.low) - bit_count(x.p.high ^ y.p.high) >= {least}")
    finely = F.expr(f"{fine_agreement('x.p.fine', 'y.p.fine')} >= {fine_least(threshold)}")
    here = F.expr("x.bucket = get(filter(x.p.bands, (v, i) -> v = y.p.bands[i]), 0)")
    crossed = rest.alias("x").join(rest.alias("y"), F.expr("x.bucket = y.bucket and x.p.node < y.p.node and x.root != y.root") & near & alike & finely & here)
    last = stored(verified(crossed.select(F.col("x.p.node").alias("a"), F.col("y.p.node").alias("b")).repartition("a"), sets, threshold), "links")
    if last.limit(1).count():
        links = stored(links.unionByName(last).distinct(), "links")
        roots = joined_classes(roots, last)

    named = nodes.withColumn("rep", F.col("head.row")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = named.groupBy("root").agg(F.min("head").alias("top"), F.sum("_n").alias("class_size"))
    of = named.join(classes, "root").select("node", F.col("top.doc_id").alias("class_id"), F.col("top.row").alias("top_row"), "class_size")
    members = s.select("doc_id", "row_key", "row", "node").join(of, "node", "left")
    alone = F.col("node").isNull()
    return members.select(
        "doc_id",
        "row_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | (F.col("row") == F.col("top_row"))).alias("stands"),
    ), links


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class, with its columns as they came; rows that repeat without words are kept once."""
    members, _ = near_duplicates(docs, doc_id=doc_id, text=text, **how)
    key = fresh("_neardup_key", docs.columns)
    stands = members.where("stands").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key(doc_id, text)).join(stands, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
