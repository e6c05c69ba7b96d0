"""Cross-entropy difference of two language models, by document.

A target model (documents labelled as good) and a background model (all documents) are bigram models over one
vocabulary, smoothed in the same way. A document's score is its loss per token under the target model minus that
under the background model: the lower, the closer to the target.

Every word has statistics of its own, however rare and however large the corpus. Words that make up at least one in
`VOCABULARY` of all tokens have an id, which every executor knows (there can be no more than `VOCABULARY` of them). The
code of another word is its hash with the sign bit set; each of its occurrences is moved once, with the words before and
after it, to where all its occurrences meet (fewer than one in `VOCABULARY` of all tokens), and its counts, those of the
bigrams with it, and its share of each document's score come from there. Bigrams of words with ids are counted and
joined; those that make up at least one in `FREQUENT` of all are sent to every executor and scored where the document is
read. A bigram's loss is a term of the bigram and its second word plus a term of its first word alone, so the two can be
found in different places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import in_slices, word_hashes
from .common import shuffle_partitions, small_batches, stored

VOCABULARY = 1 << 20
FREQUENT = 1 << 21
SIGN = np.uint64(1 << 63)
SIDES = ("context_b", "context_t", "word_b", "word_t")


def _arrays(df: DataFrame, *cols: str) -> list[np.ndarray]:
    t = df.select(*cols).toArrow()
    return [t.column(c).to_numpy() for c in cols]


def _slices(batches, most: int = 2 << 20):
    """The batches of coded texts, cut so that each has about `most` tokens at most; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_tokens").to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def vocabulary(docs: DataFrame, text: str, size: int = VOCABULARY) -> tuple[np.ndarray, int, int]:
    """Hashes of the words that make up at least one in `size` of all tokens, ascending (`size` at most); how many tokens
    there are, and how many different words."""

    def run(batches):
        for batch in in_slices(batches, "t"):
            h, n = np.unique(word_hashes(batch.column("t"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = stored(docs.select(F.col(text).alias("t")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    types, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    (h,) = _arrays(counts.where(F.col("n") * size >= total), "h")
    return np.sort(h.astype(np.int64).view(np.uint64)), total, types


def score(docs: DataFrame, labels: DataFrame, strength: float = 100.0, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", good: str = "quality") -> DataFrame:
    """doc_id, n_tokens, score for every row.

    Target: documents with a label row whose `good` is 1. Null texts and texts without words: no tokens, score null.
    Repeated rows get a row each and count each; null ids are never in the target; without labels the target model is
    its smoothing alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    vocab, total, types = vocabulary(d, "t")
    words = spark.sparkContext.broadcast(vocab)  # VOCABULARY at most
    v = len(vocab) + 1  # 0 ..: the vocabulary; v - 1: start of a document; v: its end

    def to_ids(batches):
        known = words.value
        for batch in in_slices(batches, "t"):
            h, offsets = word_hashes(batch.column("t"))
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            ids = np.where(known[at] == h, at, -1).astype(np.int32) if len(known) else np.full(len(h), -1, np.int32)
            cuts = list(zip(offsets[:-1], offsets[1:]))
            rare = [(h[a:b][ids[a:b] < 0] | SIGN).tobytes() for a, b in cuts]
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array(rare, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "rare"])

    target = labels.where((F.col(good) == 1) & F.col(label_id).isNotNull()).select(F.col(label_id).alias("doc_id")).distinct()
    coded = d.mapInArrow(to_ids, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids binary, rare binary")
    coded = stored(coded.select("*", F.monotonically_increasing_id().alias("row")), "coded")
    texts = coded.select("n_tokens", "ids", "rare", "row")
    # which rows are in the target, a bit for each in words of 64 rows: the coded texts stay where they are
    bit = F.call_function("shiftleft", F.expr("1L"), F.col("row").bitwiseAND(F.lit(63)).cast("int"))
    flags = coded.select("doc_id", "row").join(target, "doc_id", "left_semi").groupBy(F.shiftright("row", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    word, bits = _arrays(flags, "word", "bits")
    order = np.argsort(word)
    in_target = spark.sparkContext.broadcast((word[order].astype(np.int64), bits[order].astype(np.int64)))

    def are_good(rows: np.ndarray) -> np.ndarray:
        word, bits = in_target.value
        if not len(word):
            return np.zeros(len(rows), bool)
        at = np.minimum(np.searchsorted(word, rows >> 6), len(word) - 1)
        return (word[at] == rows >> 6) & (bits[at] >> (rows & 63) & 1).astype(bool)

    def tokens(batch, codes: bool = False) -> tuple[np.ndarray, ...]:
        """(w, c, q, owner, good): each token's id (rare: -1, or its code), the one before and the one after it, which
        row of the batch it is in, and whether that is in the target."""
        n = batch.column("n_tokens").to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        w = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("ids")]).astype(np.int64)
        if codes:
            w[w < 0] = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("rare")])
        first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(w) else np.zeros(0, bool)
        c, q = np.roll(w, 1), np.roll(w, -1)
        c[first], q[np.roll(first, -1)] = v - 1, v
        return w, c, q, owner, are_good(batch.column("row").to_numpy())[owner]

    def margins(batches):
        """Counts of the words with ids as contexts and as words, in all and in the target; at -1 those of all tokens."""
        sums, all_b, all_t = np.zeros((4, v), np.int64), 0, 0
        for batch in _slices(batches):
            w, c, _, _, is_good = tokens(batch)
            for k, x in enumerate((c, c[is_good], w, w[is_good])):
                sums[k] += np.bincount(x[x >= 0], minlength=v)
            all_b, all_t = all_b + len(w), all_t + int(is_good.sum())
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at))), *(pa.array(np.concatenate(([x], s[at]))) for x, s in zip((0, 0, all_b, all_t), sums))], ["code", *SIDES])

    ends = texts.mapInArrow(margins, "code long, " + ", ".join(f"{x} long" for x in SIDES)).groupBy("code").agg(*(F.sum(x).alias(x) for x in SIDES))
    code, *held = _arrays(ends, "code", *SIDES)  # v + 1 rows at most
    total_t = int(held[3][code == -1].sum())
    marginal = {x: np.zeros(v) for x in SIDES}
    for x, n in zip(SIDES, held):
        marginal[x][code[code >= 0]] = n[code >= 0]
    # of each word with an id: smoothing added to its bigrams' counts, and its term as a context
    base_b, base_t = (strength * (marginal[f"word_{s}"] + 1.0) / max(n + types, 1) for s, n in (("b", total), ("t", total_t)))
    sent = spark.sparkContext.broadcast((base_b, base_t, np.log((marginal["context_t"] + strength) / (marginal["context_b"] + strength))))

    def count(batches):
        for batch in _slices(batches):
            w, c, _, _, is_good = tokens(batch)
            both = (w >= 0) & (c >= 0)
            key, back, n = np.unique(c[both] * v + w[both], return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(np.bincount(back, is_good[both], len(key)).astype(np.int64))], ["key", "b", "t"])

    grams = stored(texts.mapInArrow(count, "key long, b long, t long").groupBy("key").agg(F.sum("b").alias("b"), F.sum("t").alias("t")), "grams")

    def term(key: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        base_b, base_t, _ = sent.value
        return np.log((b + base_b[key % v]) / (t + base_t[key % v])).astype(np.float32)

    def weigh(batches):
        for batch in batches:
            key, b, t = (batch.column(x).to_numpy() for x in ("key", "b", "t"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(term(key, b, t))], ["key", "term"])

    frequent = F.col("b") * FREQUENT >= max(total, 1)
    hot_key, hot_b, hot_t = _arrays(grams.where(frequent), "key", "b", "t")  # FREQUENT at most
    order = np.argsort(hot_key)
    hot = spark.sparkContext.broadcast((hot_key[order], term(hot_key, hot_b, hot_t)[order]))

    def local(batches):
        """For each text a row, under a key that no bigram has, with what is known here; one for each other bigram of ids."""
        hot_key, hot_term = hot.value
        context = sent.value[2]
        for batch in _slices(batches):
            w, c, _, owner, _ = tokens(batch)
            rows = batch.column("row").to_numpy()
            part = np.bincount(owner[c >= 0], context[c[c >= 0]], len(rows))
            both = (w >= 0) & (c >= 0)
            key, of = c[both] * v + w[both], owner[both]
            at = np.minimum(np.searchsorted(hot_key, key), max(len(hot_key) - 1, 0))
            known = hot_key[at] == key if len(hot_key) else np.zeros(len(key), bool)
            part += np.bincount(of[known], hot_term[at[known]], len(rows))
            columns = (np.concatenate((-1 - rows, key[~known])), np.concatenate((rows, rows[of[~known]])), np.concatenate((part, np.ones((~known).sum()))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "row", "x"])

    terms = grams.where(~frequent).mapInArrow(weigh, "key long, term float")
    parts = texts.mapInArrow(local, "key long, row long, x float").join(terms, "key", "left")
    sums = parts.select("row", (F.col("x").cast("double") * F.coalesce("term", F.lit(1.0))).alias("x"))

    def occurrences(batches):
        """(x, p, q, row, good, base_b, base_t): each rare word with its neighbours; smoothing of a next word with an id."""
        base_b, base_t, _ = sent.value
        for batch in _slices(batches):
            w, c, q, owner, is_good = tokens(batch, codes=True)
            at = np.flatnonzero(w < 0)
            after = q[at]
            ends = (after < 0) | (after >= v)
            bases = [np.where(ends, 0, x[np.where(ends, 0, after)]).astype(np.float32) for x in (base_b, base_t)]
            columns = (w[at], c[at], after, batch.column("row").to_numpy()[owner[at]], is_good[at].astype(np.int32), *bases)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["x", "p", "q", "row", "good", "base_b", "base_t"])

    rare = texts.mapInArrow(occurrences, "x long, p long, q long, row long, good int, base_b float, base_t float").repartition(2 * shuffle_partitions(spark), "x")
    by = {"": Window.partitionBy("x"), "p": Window.partitionBy("x", "p"), "q": Window.partitionBy("x", "q")}
    goes_on = F.col("q") != v
    of = {f"{n}_b": F.count(F.lit(1)).over(w) for n, w in by.items()} | {f"{n}_t": F.sum("good").over(w) for n, w in by.items()}
    of |= {"context_b": F.sum(goes_on.cast("int")).over(by[""]), "context_t": F.sum(F.when(goes_on, F.col("good")).otherwise(0)).over(by[""])}
    # its bigram with the word before it, itself as a context, and its bigram with a next word that has an id
    own_b, own_t = (strength * (F.col(f"_{s}") + 1.0) / (n + types) for s, n in (("b", total), ("t", total_t)))
    own = F.log((F.col("p_b") + own_b) / (F.col("p_t") + own_t))
    context = F.when(goes_on, F.log((F.col("context_t") + strength) / (F.col("context_b") + strength))).otherwise(0.0)
    after = F.when((F.col("q") >= 0) & goes_on, F.log((F.col("q_b") + F.col("base_b").cast("double")) / (F.col("q_t") + F.col("base_t").cast("double")))).otherwise(0.0)
    sums = sums.unionByName(rare.withColumns(of).select("row", (own + context + after).alias("x"))).groupBy("row").agg(F.sum("x").alias("diff"))
    return coded.select("doc_id", "row", "n_tokens").join(sums, "row").select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("diff") / F.col("n_tokens")).alias("score"))
