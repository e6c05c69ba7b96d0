"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Features are hashed three-byte grams of the text with A-Z lower-cased and other ASCII than letters as spaces.
Document frequencies, centroids and thresholds come from all labelled rows that may be learned from. Centroids are those
of spherical k-means, several for each language, each round of which is a pass over the rows. A text gets the language of
the centroid with the largest cosine; it is rejected if that cosine lies under what training texts of its length reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import in_slices, text_bytes
from .common import fresh

DIMS = 8192
#: A weight of 1 in sums of whole numbers: 2**27 rows fit.
UNIT = float(1 << 36)
_RNG = np.random.default_rng(7)
_TABLES = _RNG.integers(0, DIMS, (3, 256)).astype(np.uint16)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Feature numbers of each text, one for each of its grams."""
    data, offsets = text_bytes(texts)
    data = np.concatenate((np.full(2, 32, np.uint8), _FOLD[data], np.full(2, 32, np.uint8)))
    grams = _TABLES[0][data[:-2]] ^ _TABLES[1][data[1:-1]] ^ _TABLES[2][data[2:]]
    spaces = (data[:-2] == 32) & (data[1:-1] == 32) | (data[1:-1] == 32) & (data[2:] == 32)  # runs of spaces say nothing
    for a, b in zip(offsets[:-1], offsets[1:]):
        g = grams[a + 1 : b + 1] if b > a else grams[:0]  # grams centred inside the text: the middle byte is its own
        yield g[~spaces[a + 1 : b + 1]] if b > a else g


def _has_letter(data: np.ndarray, text) -> bool:
    return bool(((_FOLD[data] != 32) & (data < 128)).any()) or any(map(str.isalpha, text.as_py() or ""))


def _vector(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(np.bincount(grams, minlength=DIMS)) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    def count(batches):
        total, df = 0, np.zeros(DIMS, np.int64)
        for batch in in_slices(batches, "t"):
            for g in _rows(batch.column("t")):
                df[np.unique(g)] += 1
                total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at)), pa.int32()), pa.array(np.concatenate(([total], df[at])), pa.int64())], ["f", "n"])

    # at most DIMS + 1 rows
    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n")).collect()
    df = np.zeros(DIMS)
    for f, n in rows:
        if f >= 0:
            df[f] = n
    return next((n for f, n in rows if f < 0), 0), df


def _sparse(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their weights in its unit vector."""
    n = np.bincount(grams, minlength=DIMS)
    f = np.flatnonzero(n)
    x = np.log1p(n[f]) * idf[f]
    return f, x / np.sqrt(x @ x) if len(f) else x


def _unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=-1, keepdims=True), 1e-12)


def _summed(rows: DataFrame, langs: list, idf: np.ndarray, k: int, axes: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, n) of the unit vectors of rows (t, l) by language and which of its k `axes` is the largest after `shift`.

    Sums are of whole numbers, so they do not depend on the order of the rows."""
    sent = rows.sparkSession.sparkContext.broadcast((idf, axes, shift))

    def run(batches):
        idf, axes, shift = sent.value
        sums, n = np.zeros((len(langs) * k, DIMS), np.int64), np.zeros(len(langs) * k, np.int64)
        for batch in in_slices(batches, "t"):
            for g, own in zip(_rows(batch.column("t")), batch.column("l").to_pylist()):
                f, x = _sparse(g, idf)
                if len(f):
                    i = langs.index(own)
                    j = i * k + int(np.argmax(axes[i][:, f] @ x - shift[i]))
                    sums[j, f] += np.rint(x * UNIT).astype(np.int64)
                    n[j] += 1
        j, f = np.nonzero(sums)
        keys, values = np.concatenate((j * DIMS + f, -1 - np.arange(len(n)))), np.concatenate((sums[j, f], n))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["key", "n"])

    # at most k (DIMS + 1) rows for each language
    out = rows.select("t", "l").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, value = (out.column(c).to_numpy() for c in ("key", "n"))
    sums, n = np.zeros(len(langs) * k * DIMS), np.zeros(len(langs) * k)
    sums[key[key >= 0]], n[-1 - key[key < 0]] = value[key >= 0], value[key < 0]
    return sums.reshape(len(langs), k, DIMS), n.reshape(len(langs), k)


def _kmeans(rows: DataFrame, langs: list, idf: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, n): k unit centroids of each language by cosine, over all rows; n: how many rows each has, 0 if it is none.

    Rows are dealt first by which of k fixed random directions they lean to from their language's mean."""
    mean, _ = _summed(rows, langs, idf, 1, np.zeros((len(langs), 1, DIMS)), np.zeros((len(langs), 1)))
    axes = np.broadcast_to(np.random.default_rng(11).choice([-1.0, 1.0], (k, DIMS)), (len(langs), k, DIMS))
    sums, n = _summed(rows, langs, idf, k, axes, np.einsum("ikf,if->ik", axes, _unit(mean[:, 0])))
    for _ in range(rounds):
        c = _unit(sums)
        new, m = _summed(rows, langs, idf, k, c, np.where(n > 0, 0.0, np.inf))
        if (new == sums).all():
            break
        sums, n = np.where((m > 0)[:, :, None], new, sums), np.where(n > 0, np.maximum(m, 1), 0)
    return _unit(sums), n


def _floors(rows: DataFrame, langs: list, model: dict) -> np.ndarray:
    """Least cosine of a row (t, l) with the nearest centroid of its own language, by bits of its number of grams; nan: no rows."""
    sent = rows.sparkSession.sparkContext.broadcast((model["idf"], [model["centroids"][model["owner"] == i] for i in range(len(langs))]))

    def run(batches):
        idf, own = sent.value
        low = np.full(64, np.inf)
        for batch in in_slices(batches, "t"):
            for g, x in zip(_rows(batch.column("t")), batch.column("l").to_pylist()):
                f, v = _sparse(g, idf)
                c = own[langs.index(x)]
                b = int(np.log2(len(g) + 1))
                low[b] = min(low[b], float((c[:, f] @ v).max()) if len(c) else 0.0)
        at = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(low[at])], ["b", "low"])

    low = np.full(64, np.nan)
    for b, x in rows.select("t", "l").mapInArrow(run, "b long, low double").groupBy("b").agg(F.min("low")).collect():  # 64 rows at most
        low[b] = x
    return low


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", centroids: int = 4, rounds: int = 6, slack: float = 0.5) -> dict:
    """Model from labelled rows: {"langs", "owner", "centroids", "idf", "floor"}; None values for lang and text are left out.

    Every row counts in every part of it. Without labelled rows the model has no languages."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}  # one row for each language
    langs = sorted(counts)
    total, df = document_frequencies(rows, "t")
    idf = np.log((1 + total) / (1 + df)) + 1.0
    model = {"langs": langs, "owner": np.zeros(0, int), "centroids": np.zeros((0, DIMS)), "idf": idf, "floor": np.zeros(64), "slack": slack, "main": max(langs, key=lambda x: (counts[x], x), default=None)}
    if not langs:
        return model
    c, n = _kmeans(rows, langs, idf, centroids, rounds)
    model["owner"], model["centroids"] = np.nonzero(n)[0], c[n > 0]
    low = _floors(rows, langs, model)
    seen = np.flatnonzero(np.isfinite(low))
    # a shorter text may be as far as any longer one; unseen lengths take the next shorter one's floor, or none
    for b in range(64):
        low[b] = np.nanmin(low[b:]) if np.isfinite(low[b:]).any() else (low[b - 1] if b else 0)
    low[: seen[0]] = 0.0
    model["floor"] = slack * low
    return model


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns `keep`, then `names`: the language, its score (0 to 1) and whether it is rejected. No name may be in `keep`.

    Null texts and texts without a letter: `und`, score 0, rejected. Every other text gets a learned language (`und`
    if none was learned); a text without grams gets the most frequent one, score 0. Repeated rows get a row each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x centroids x languages
    column = fresh("_text", keep)

    def run(batches):
        m = sent.value
        owners = np.asarray(m["owner"])
        for batch in in_slices(batches, column):
            texts = batch.column(column)
            data, offsets = text_bytes(texts)
            found, scores, out = [], [], []
            for i, g in enumerate(_rows(texts)):
                if not _has_letter(data[offsets[i] : offsets[i + 1]], texts[i]) or not m["langs"]:
                    found.append("und"), scores.append(0.0), out.append(True)
                    continue
                cos = m["centroids"] @ _vector(g, m["idf"])
                j = int(np.argmax(cos)) if len(cos) else -1
                score = float(min(1.0, max(0.0, cos[j]))) if j >= 0 else 0.0
                found.append(m["langs"][owners[j]] if score > 0 else m["main"])
                scores.append(score)
                out.append(bool(score < m["floor"][int(np.log2(len(g) + 1))]))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*keep, *names])

    d = docs.select(*keep, F.col(text).alias(column))
    kinds = [*d.dtypes[:-1], *zip(names, ("string", "double", "boolean"))]
    return d.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kinds))


def held_out(doc_id: str = "doc_id"):
    """True for rows that nothing is learned from: crc32 of the id as text is a multiple of 5; null ids: false, and not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, with a model learned from rows that are not held out."""
    model = fit(docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)), text, lang, **how)
    return predict(docs, model, text, (doc_id,)).select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")
