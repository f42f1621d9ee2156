"""Words of whole Arrow batches as flat arrays, and hashes of words and word runs.

A word is a run of characters other than the six ASCII white-space ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column; null counts as empty.

    Of a slice the values are copied, as lower-casing misreads large strings that start inside a buffer.
    """
    column = batch.column(name)
    if column.offset:
        column = pa.concat_arrays([column, column.slice(0, 0)])
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or of one longer text, to bound a task's memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the batch in order, and for text i the range offsets[i]:offsets[i+1] of its words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, bounds = lists.values, np.asarray(lists.offsets).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(filled), kept[bounds]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as indexes into the batch's distinct words."""
    if not len(words):
        return np.zeros(0, np.int64), words
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def hash_each(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def word_hashes(texts: pa.Array, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the batch, and the offsets of the texts."""
    words, offsets = split_words(texts, lower)
    codes, distinct = coded(words)
    hashes = hash_each(distinct, seed)
    return (hashes[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of the run of ``length`` values that starts at each position."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * base + hashes[k : k + n]
    return mixed(out)
