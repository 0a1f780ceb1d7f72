"""Vectorised word helpers for Arrow batches (used inside ``mapInArrow`` tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the 64-bit finaliser.
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes, in order."""
    h = np.full_like(parts[0], _STEP)
    for p in parts:
        h = mix(h * _STEP + p)
    return h


def hash_vocabulary(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()),
                       dtype=np.uint64, count=len(words))


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space (x20, x09-x0D): words per text, a code per word, the distinct words.

    ``lower`` folds A-Z only. NULL and blank texts have no words.
    """
    t = texts.fill_null("")
    t = pc.ascii_trim_whitespace(pc.ascii_lower(t) if lower else t)
    t = t.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(t)
    counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    blank = pc.binary_length(t).to_numpy(zero_copy_only=False) == 0
    if blank.any():  # splitting an empty text gives one empty word
        counts[blank] = 0
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    if len(flat) == 0:
        return counts, np.empty(0, np.int64), pa.array([], pa.large_string())
    d = flat.dictionary_encode()
    return counts, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``chars`` bytes of text, so that a task's arrays stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.binary_length(b.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // chars
        starts = np.flatnonzero(np.diff(cut, prepend=-1))
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            yield b.slice(int(s), int(e - s))
