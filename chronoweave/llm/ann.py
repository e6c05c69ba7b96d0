"""Approximate nearest neighbours by learned partitions.

On a bounded sample (`fit_rows`) a neighbour graph is built and cut into partitions of equal size with few edges
between them; a small network learns to tell from a vector in which partitions its neighbours lie. Every row of the
table is put into its most probable partition; a query goes to its most probable ones, as many as it takes for their
probabilities to sum up to `reach`, and all rows there are ranked by exact cosine in double precision. So a query among
clusters visits one or two partitions and one among noise many. Partitions are stored and searched in blocks of bounded
size. A query that finds fewer than k rows, its partitions being thin, is asked again of all partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _vectors(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths and values of the vectors; null ones have none."""
    flat, lengths = vectors.flatten(), np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    return lengths, np.split(values, ends[:-1]) if len(lengths) else []


def _usable(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors that take part: of that length, finite and not zero."""
    lengths, parts = _vectors(vectors)
    rows = [i for i, p in enumerate(parts) if dim and lengths[i] == dim and np.isfinite(p).all() and p.any()]
    return np.array(rows, np.int64), np.stack([parts[i] for i in rows]) if rows else np.zeros((0, dim))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each unit vector, in blocks."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A partition number for each row: halves are halved again; each cut starts at the median of the widest direction
    and swaps rows between the halves while that leaves fewer edges between them."""
    label = np.zeros(len(x), np.int64)
    while label.max() + 1 < parts:
        new = label * 2
        for part in range(label.max() + 1):
            rows = np.flatnonzero(label == part)
            if len(rows) < 2:
                continue
            y = x[rows] - x[rows].mean(0)
            way = np.linalg.eigh(y.T @ y)[1][:, -1]
            side = np.zeros(len(rows), bool)
            side[np.argsort(y @ way, kind="stable")[len(rows) // 2 :]] = True
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            near = place[graph[rows]]
            inside = near >= 0
            for _ in range(12):
                other = (side[near] != side[:, None]) & inside
                gain = 2.0 * other.sum(1) - inside.sum(1)
                a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
                n = min(len(a), len(b)) // 2
                if not n:
                    break
                side[a[np.argsort(-gain[a], kind="stable")[:n]]] = True
                side[b[np.argsort(-gain[b], kind="stable")[:n]]] = False
            new[rows[side]] += 1
        label = new
    return label


def train_router(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 5) -> list[np.ndarray]:
    """Weights of a network with one hidden layer for the shares `goal` of each row, by Adam."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, goal.shape[1])), np.zeros(goal.shape[1])]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            i = order[a : a + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            e = (softmax(h @ w[2] + w[3]) - goal[i]) / len(i)
            back = (e @ w[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[i].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                w[j] -= 3e-3 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-9)
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def route(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities of the partitions for unit vectors."""
    return softmax(np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3])


def fit(sample: np.ndarray, parts: int = 16, k: int = 10) -> list[np.ndarray]:
    x = np.unique(unit(sample), axis=0)
    if parts < 2 or len(x) <= max(k, parts):
        return [np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]  # too few rows to part
    graph = neighbour_graph(x, k)
    label = balanced_cut(x, graph, parts)
    # a row's own partition counts as much as all of its neighbours': rows are placed by it
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), label[graph].reshape(-1)), 0.5 / k)
    goal[np.arange(len(x)), label] += 0.5
    return train_router(x, goal)


def _best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> list[tuple]:
    """(query, row, cosine) of the k best rows of a block for each query, ties to smaller ids."""
    norms, out = np.sqrt(np.einsum("ij,ij->i", x, x)), []
    rough = unit(q) @ unit(x).T
    for i in range(len(q)):
        s = np.where(x_id == q_id[i], -np.inf, rough[i])
        at = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9) if len(s) > k else np.arange(len(s))
        at = at[np.isfinite(s[at])]
        # the same operations in the same order for every pair: equal vectors tie exactly
        exact = np.einsum("ij,ij->i", x[at], np.broadcast_to(q[i], (len(at), q.shape[1]))) / (norms[at] * np.sqrt(np.einsum("i,i", q[i], q[i])))
        for j in np.lexsort((x_id[at], -exact))[:k]:
            out.append((int(q_id[i]), int(x_id[at[j]]), float(exact[j])))
    return out


def partitions_for(n: int, fit_rows: int) -> int:
    """A power of two: about one partition for each 512 rows of the table, and 32 rows of the sample for each at least."""
    return 1 << max(0, min(n // 512, fit_rows // 32).bit_length() - 1)


def search(rows: DataFrame, is_query: Column, k: int = 5, parts: int | None = None, reach: float = 0.98, fit_rows: int = 8192, block: int = 8192, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `is_query` holds for.

    `parts`: partitions_for() by default. Rows without an id, and vectors that are null, zero, of another length than
    most of the sample or hold null or non-finite components take no part. Rows with the query's id are its own.
    Repeated rows are candidates each; of equal scores the smaller id comes first. With fewer candidates than k, all are
    found; an empty table gives no rows.
    """
    spark = rows.sparkSession
    r = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = r.count()
    share = min(1.0, fit_rows / max(n, 1))
    sample = r.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("vec_id", "v").toArrow().sort_by("vec_id").column("v").combine_chunks()
    parts = parts or partitions_for(n, fit_rows)
    lengths, _ = _vectors(sample)
    dim = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    vectors = _usable(sample, dim)[1]
    w = fit(vectors[: 2 * fit_rows], parts) if len(vectors) else fit(np.zeros((0, max(dim, 1))), 1)
    sent = spark.sparkContext.broadcast(w)

    def place(batches):
        for batch in batches:
            at, x = _usable(batch.column("v"), dim)
            p = route(sent.value, unit(x)) if len(at) else np.zeros((0, 1))
            by = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
            take, asks = pa.array(at), batch.column("q").take(pa.array(at))
            probes = np.where(np.array(asks.to_pylist(), bool), (np.cumsum(np.take_along_axis(p, by, 1), 1) < reach).sum(1) + 1, 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), asks, pa.array([a.tobytes() for a in x], pa.binary()), pa.array([a[:m] for a, m in zip(by, probes)], pa.list_(pa.int32()))], ["vec_id", "q", "v", "by"])

    placed = stored(r.mapInArrow(place, "vec_id long, q boolean, v binary, by array<int>"), "placed")
    placed = placed.withColumn("part", F.get("by", F.lit(0)))
    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(q):
            mx, mq = (np.stack([np.frombuffer(v) for v in t["v"]]) for t in (x, q))
            for a in range(0, len(q), 256):
                found += _best(mq[a : a + 256], q["vec_id"].to_numpy()[a : a + 256], mx, x["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    # one row for each partition
    split = lambda counts: F.coalesce(F.element_at(F.create_map(*(F.lit(a) for p, c in (counts or {0: 1}).items() for a in (p, max(1, -(-c // block))))), F.col("part")), F.lit(1))
    sizes = lambda table: split({x["part"]: x["n"] for x in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()})
    each = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    row_blocks = sizes(placed)

    def asked(queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the k best of each block of rows for the rows `queries`, one for each partition asked."""
        query_blocks = sizes(queries)
        spread = F.xxhash64("vec_id", F.monotonically_increasing_id())
        left = placed.withColumn("a", F.pmod(spread, row_blocks).cast("int")).withColumn("b", each(query_blocks)).select("part", "a", "b", "vec_id", "v")
        right = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), query_blocks).cast("int")).withColumn("a", each(row_blocks)).select("part", "a", "b", "vec_id", "v")
        return left.groupBy("part", "a", "b").cogroup(right.groupBy("part", "a", "b")).applyInPandas(compare, "query_id long, vec_id long, score double")

    queries = placed.where("q")
    found = stored(asked(queries.select("vec_id", "v", F.explode("by").alias("part"))), "found")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("_id"))
    few = stored(queries.join(enough, F.col("vec_id") == F.col("_id"), "left_anti").select("vec_id", "v"), "few")
    if parts > 1 and few.limit(1).count():
        again = asked(few.select("vec_id", "v", F.explode(F.array(*map(F.lit, range(parts)))).alias("part")))
        found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
