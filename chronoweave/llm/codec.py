"""Token ids in files of canonical, length-limited Huffman codes.

Documents become ids (one end id after each), in ascending order of their id. Code lengths come from the counts of all
ids by package-merge with a limit; codes are canonical, so the lengths alone are the codebook. Ids are coded in blocks
that can be decoded alone; a block keeps the bit offset of every `STRIDE`-th id, and decoding runs from all of them at
once with one table look-up an id.

A file set is two Parquet tables under one path: `codebook` (id, bits) and `blocks` (part, ids_before, doc_ids, lens,
n_ids, checkpoints, payload): Parquet gives atomic writes and any store that Spark reaches; the payload is the format's.
"""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import in_slices
from .common import shared_dir, shuffle_partitions, small_batches, stored

STRIDE = 256
LIMIT = 18
BLOCK_IDS = 1 << 16
#: ASCII marks but the apostrophe, which may begin a token with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _worker_cache(path: str, dtype: str) -> PieceCache:
    """The cache of this Python worker, which serves one task after another, for a tokenizer."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_piece_caches", {})
    if (path, dtype) not in held:
        held.clear()  # one at a time, so memory is bounded
        held[path, dtype] = PieceCache(path, dtype)
    return held[path, dtype]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 characters for themselves, the
    others by U+0100 and on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


class PieceCache(dict):
    """Ids of pieces of text between blanks, as bytes. The tokenizer drops white space and never joins across it, but for
    its added tokens (<|endoftext|> and the like, in any case): a text that may hold one is encoded whole.

    Holds `most` pieces at most; longer pieces are not kept."""

    def __init__(self, path: str, dtype: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.most = Tokenizer.from_file(path), dtype, most
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        kinds = [type(x).__name__ for x in (self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        # the short way holds for a lower-casing byte-level tokenizer, which these words show it to be
        self.simple = kinds == ["BPE", "Sequence", "Sequence"] and all(self.whole(x) == self.whole(y) for x, y in (("Word", "word"), ("\u00c9t\u00e9", "\u00e9t\u00e9"))) and "ByteLevel" in str(self.tokenizer.pre_tokenizer)
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha() and not piece.islower():
            out = self[piece.lower()]
        elif len(head := piece.rstrip(MARKS)) < len(piece) and head.isalpha() and unicodedata.normalize("NFC", head).lower().isalpha():
            # letters that stay letters, and marks: never one token
            out = self[head] + self[piece[len(head) :]]
        elif self.simple and len(low := piece.lower()) == len(piece) and low.isalpha() and max(low) < "\u0250" and unicodedata.is_normalized("NFC", piece):
            # one word of the pre-tokenizer: to the model at once, each byte as the letter that stands for it
            word = low if low.isascii() else "".join(map(BYTE_LETTERS.__getitem__, low.encode()))
            out = np.array([x.id for x in self.tokenizer.model.tokenize(word)], self.dtype).tobytes()
        else:
            out = self.whole(piece)
        if len(self) >= self.most:
            self.clear()
            self[""] = b""
        if len(piece) <= 64:
            self[piece] = out
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_ids(docs: DataFrame, path: str | None = None, end: int = 2, doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2") -> DataFrame:
    """(doc_id, ids): ids as bytes of `dtype`, the end id last; a null text is empty."""

    def run(batches):
        cache, last = _worker_cache(path or _default_path(), dtype), np.array([end], dtype).tobytes()
        for batch in in_slices(batches, "t"):
            ids = [cache.encode(t or "") + last for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return d.mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, dtype: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and their counts; at most the vocabulary comes to the driver."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                c = np.bincount(np.frombuffer(x.as_buffer(), dtype))
                if len(c) > len(counts):
                    counts = np.concatenate((counts, np.zeros(len(c) - len(counts), np.int64)))
                counts[: len(c)] += c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["id", "n"])

    rows = sorted(tuple(r) for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for these counts (all positive), by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    items, packages, leaves = counts[order].astype(np.float64), np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate((items, packages))
        by = np.argsort(both, kind="stable")
        leaves.append(np.concatenate(([0], np.cumsum(by < n))))
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(leaves):
        used = int(level[take])
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((ids, lengths))
    codes, code, before = np.zeros(len(ids), np.uint64), 0, 0
    for i in order:
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def pack(codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, offsets): the codes one after another, most significant bit first, and the bit offset of every STRIDE-th."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    cell, off = starts >> 5, (starts & 31).astype(np.uint64)
    wide = codes << (np.uint64(64) - off - lengths.astype(np.uint64))
    n = int(ends[-1] >> 5) + 2 if len(ends) else 2
    # bits of different codes don't meet: sums are unions, and exact below 2**53
    cells = np.bincount(cell, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(cell + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return cells.astype(np.uint32).astype(">u4").tobytes(), starts[::STRIDE].astype(np.int64)


def decode_table(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) for every value of the next `width` bits, width being the longest code's."""
    width = int(lengths.max())
    codes = canonical(ids, lengths)
    symbol, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = np.argsort(codes << (np.uint64(width) - lengths.astype(np.uint64)))
    reach = (1 << (width - lengths[order])).astype(np.int64)
    filled = int(reach.sum())
    symbol[:filled], bits[:filled] = np.repeat(ids[order], reach), np.repeat(lengths[order], reach)
    return symbol, bits


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, symbol: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The n ids of a block."""
    width = len(symbol).bit_length() - 1
    b = np.frombuffer(payload, np.uint8).astype(np.uint32)
    b = np.concatenate((b, np.zeros(8, np.uint32)))
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at, out = checkpoints.copy(), np.zeros((STRIDE, len(checkpoints)), np.uint32)
    top = 8 * (len(window) - 1)
    for k in range(min(STRIDE, n)):
        value = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[k] = symbol[value]
        at = np.minimum(at + bits[value], top)  # lanes past the last id run on harmlessly
    return out.T.reshape(-1)[:n]


def write(docs: DataFrame, to: str, dtype: str = "<u2", limit: int = LIMIT, block_ids: int = BLOCK_IDS, **how) -> None:
    """Writes the documents' ids to the path `to`. A document stays in one block; rows whose id is null come first, rows
    with the same id follow one another in the order of a hash of their ids, then of the ids."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = stored(token_ids(docs, dtype=dtype, **how), "ids")
    symbols, counts = id_counts(ids, dtype)
    lengths = code_lengths(counts, limit)
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist())), "id long, bits int").coalesce(1).write.parquet(f"{to}/codebook")
    sent = spark.sparkContext.broadcast((symbols, lengths))  # at most the vocabulary

    def run(batches):
        symbols, lengths = sent.value
        codes, bits = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint64), np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
        codes[symbols], bits[symbols] = canonical(symbols, lengths), lengths
        before, part, names, lens, held, n = 0, 0, [], [], [], 0

        def block():
            nonlocal before, names, lens, held, n
            x = np.concatenate(held).astype(np.int64)
            payload, offsets = pack(codes[x], bits[x])
            row = [[part], [before], [names], [lens], [len(x)], [offsets], [payload]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            before, names, lens, held, n = before + len(x), [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "ids_before", "doc_ids", "lens", "n_ids", "checkpoints", "payload"])

        for batch in batches:
            for p, name, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                part = p
                x = np.frombuffer(x.as_buffer(), dtype)
                names.append(name), lens.append(len(x)), held.append(x)
                n += len(x)
                if n >= block_ids:
                    yield block()
        if held:
            yield block()

    keyed = ids.withColumn("_h", F.xxhash64("ids"))  # many rows of one id are more than one task's
    placed = keyed.repartitionByRange(2 * shuffle_partitions(spark), "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "ids").drop("_h").withColumn("part", F.spark_partition_id())
    placed.mapInArrow(run, "part int, ids_before long, doc_ids array<long>, lens array<long>, n_ids long, checkpoints array<long>, payload binary").write.parquet(f"{to}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a file set: `start` counts the ids of all documents before; ids as little-endian uint32."""
    book = sorted(tuple(r) for r in spark.read.parquet(f"{path}/codebook").collect())  # at most the vocabulary
    sent = spark.sparkContext.broadcast((np.array([r[0] for r in book], np.int64), np.array([r[1] for r in book], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row for each part that was written
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        symbol, bits = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if symbol is None:
                    symbol, bits = decode_table(*sent.value)
                ids = unpack(r["payload"], np.array(r["checkpoints"], np.int64), r["n_ids"], symbol, bits)
                ends = np.cumsum(r["lens"])
                starts = ends - r["lens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["at"]), pa.array(r["lens"], pa.int64()), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    at = blocks.join(F.broadcast(parts), "part").withColumn("at", F.col("first") + F.col("ids_before")).select("doc_ids", "lens", "n_ids", "checkpoints", "payload", "at")
    return at.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files written to the shared folder and read back.

    Empty and null texts have the end id alone; repeated rows follow one another; an empty table gives no rows."""
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, to, **how)
    return read(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
