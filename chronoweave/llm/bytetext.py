"""Words and hashes of whole Arrow batches of texts, by array arithmetic on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, a-z, A-Z and all of characters past ASCII.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i+1]]; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], from prefix sums of byte values times powers; spans must not be empty."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(len(data), _BASE), out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _powers(len(data) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))


def word_starts(data: np.ndarray) -> np.ndarray:
    """1 at the first byte of each word, 0 elsewhere."""
    inside = _IS_WORD[data]
    out = inside.astype(np.int64)
    out[1:] &= ~inside[:-1]
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): hashes of the lower-cased words; those of text i are hashes[offsets[i]:offsets[i+1]]."""
    data, offsets = text_bytes(texts)
    inside = _IS_WORD[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def in_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
