"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its distinct words, hashed into buckets (each weighing 1/sqrt of their number),
statistics of its structure, cut into ranges and hashed as well, and its size as metadata.
The score is the logistic of w0 + Σ wᵢxᵢ + ½ Σ_f ((Σ v_if xᵢ)² − Σ v_if² xᵢ²), so pairwise interactions
cost no more than the features themselves.

Training takes the ``train_rows`` labelled texts with the smallest hash of their id, a bounded sample; their features are
made in Spark and only those come to the driver, where the machine is fitted by AdaGrad.
Labels, language, source and id are never features.

Defined results: null counts as an empty text, whose features are its structure alone. Labels that are null or
belong to no document are not used; documents labelled twice count twice. With no
label, or only one kind, every score is the smoothed share of label 1. Rows that repeat get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.llm.words import coded, hash_each, mixed, split_words, text_column

TRAIN_ROWS = 8_000
BUCKETS = 1 << 15
FACTORS = 6
EPOCHS = 12
RATE = 0.15
DECAY = 1e-5
SEED = 11

# upper ends of the ranges that shares are cut into
_SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_SIZES = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, 2048, 8192, 32768])


def _ranges(doc: np.ndarray, n: int, flags: np.ndarray) -> np.ndarray:
    return np.bincount(doc[flags], minlength=n)


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets per text, bucket ids and values."""
    n = len(texts)
    words, offsets = split_words(texts, lower=False)
    codes, distinct = coded(words)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(n), counts)

    # structure, from bytes of the whole text
    at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    kinds = np.zeros((n, 8))
    for i in range(n):
        kinds[i] = _byte_kinds(texts[i].as_py())
    size = np.maximum(np.diff(at), 1)
    total = np.maximum(counts, 1)
    pairs = doc * np.int64(max(len(distinct), 1)) + codes
    unique, seen = np.unique(pairs, return_counts=True)
    owner = unique // max(len(distinct), 1)
    n_distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, seen)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
    ends = _word_ends(distinct)[codes] if len(codes) else np.zeros((0, 2), bool)
    shares = [
        *(kinds[:, :6] / size[:, None]).T,
        n_distinct / total,
        top / total,
        _ranges(doc, n, same) / total,
        _ranges(doc, n, lengths > 14) / total,
        _ranges(doc, n, lengths < 3) / total,
        _ranges(doc, n, ends[:, 0] if len(codes) else same) / total,
        _ranges(doc, n, ends[:, 1] if len(codes) else same) / total,
    ]
    sizes = [counts, kinds[:, 6], kinds[:, 7], counts / np.maximum(kinds[:, 6] + 1, 1), np.diff(at)]
    cut = [np.searchsorted(_SHARES, s) for s in shares] + [np.searchsorted(_SIZES, s) for s in sizes]
    dense = np.stack([mixed(np.uint64(977 * (k + 1)) + c.astype(np.uint64)) for k, c in enumerate(cut)], axis=1)

    word_bucket = hash_each(distinct)[unique % max(len(distinct), 1)] if len(unique) else np.zeros(0, np.uint64)
    ids = np.concatenate([(word_bucket % np.uint64(buckets - buckets // 8)).astype(np.int64), (buckets - buckets // 8 + dense.ravel() % np.uint64(buckets // 8)).astype(np.int64)])
    values = np.concatenate([1 / np.sqrt(np.maximum(n_distinct, 1))[owner], np.full(dense.size, 1 / np.sqrt(dense.shape[1]))])
    rows = np.concatenate([owner, np.repeat(np.arange(n), dense.shape[1])])
    order = np.argsort(rows, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)
    return bounds, ids[order], values[order]


def _byte_kinds(text: str) -> np.ndarray:
    """Upper case, digits, closing marks, other marks, bars, beyond ASCII; lines, repeated lines."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = text.split("\n")
    return np.array(
        [
            counts[65:91].sum(),
            counts[48:58].sum(),
            counts[[33, 44, 46, 63]].sum(),
            counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:128].sum() - counts[[33, 44, 46, 63]].sum(),
            counts[124],
            counts[128:].sum(),
            len(lines) - 1,
            len(lines) - len(set(lines)),
        ],
        float,
    )


def _word_ends(distinct: pa.Array) -> np.ndarray:
    """Of each distinct word: ends in three equal marks or two exclamation marks; all in capitals."""
    out = np.zeros((len(distinct), 2), bool)
    for i, word in enumerate(distinct.to_pylist()):
        last = word[-1]
        out[i] = (len(word) > 2 and not last.isalnum() and word[-2] == last, len(word) > 1 and word.isupper())
    return out


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        row = np.repeat(np.arange(n), np.diff(bounds))
        out = self.bias + np.bincount(row, self.linear[ids] * values, n)
        for f in range(self.factors.shape[1]):
            part = self.factors[ids, f] * values
            out += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part**2, n))
        return out

    def scores(self, *matrix: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*matrix), -30, 30)))


def fit(
    bounds: np.ndarray,
    ids: np.ndarray,
    values: np.ndarray,
    labels: np.ndarray,
    buckets: int = BUCKETS,
    n_factors: int = FACTORS,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> Machine:
    """Logistic loss, AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    linear, factors = np.zeros(buckets), rng.normal(0, 0.02, (buckets, n_factors))
    if len(np.unique(labels)) < 2:
        return Machine(bias, linear, np.zeros((buckets, n_factors)))
    seen_linear, seen_factors = np.full(buckets, 1e-4), np.full((buckets, n_factors), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(order) // 32)):
            counts = bounds[rows + 1] - bounds[rows]
            pick = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            i, x, row = ids[pick], values[pick], np.repeat(np.arange(len(rows)), counts)
            v = factors[i] * x[:, None]
            sums = np.stack([np.bincount(row, v[:, f], len(rows)) for f in range(n_factors)], axis=1)
            squares = np.stack([np.bincount(row, v[:, f] ** 2, len(rows)) for f in range(n_factors)], axis=1)
            margin = bias + np.bincount(row, linear[i] * x, len(rows)) + 0.5 * (sums**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            bias -= 0.5 * error.sum()
            touched, place = np.unique(i, return_inverse=True)
            push = error[row] * x
            g = np.bincount(place, push, len(touched)) + DECAY * linear[touched]
            seen_linear[touched] += g**2
            linear[touched] -= RATE * g / np.sqrt(seen_linear[touched])
            for f in range(n_factors):
                g = np.bincount(place, push * (sums[row, f] - v[:, f]), len(touched)) + DECAY * factors[touched, f]
                seen_factors[touched, f] += g**2
                factors[touched, f] -= 0.5 * RATE * g / np.sqrt(seen_factors[touched, f])
    return Machine(bias, linear, factors)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    train_rows: int = TRAIN_ROWS,
    buckets: int = BUCKETS,
) -> Machine:
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    sample = usable.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    joined = rows.join(F.broadcast(sample), "id").select("id", "y", "text")  # train_rows pairs of numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, ids, values = features(text_column(batch, "text"), buckets)
            lists = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("y"),
                    pa.ListArray.from_arrays(lists, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(lists, pa.array(values, pa.float32())),
                ],
                ["id", "y", "ids", "values"],
            )

    kind = joined.schema["id"].dataType.simpleString()
    got = joined.mapInArrow(run, f"id {kind}, y double, ids array<int>, values array<float>").toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
    if not len(got):
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), buckets)
    sizes = pc.list_value_length(got["ids"]).to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = pc.list_flatten(got["ids"]).to_numpy().astype(np.int64)
    return fit(bounds, ids, pc.list_flatten(got["values"]).to_numpy().astype(float), got["y"].to_numpy(), buckets)


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``score`` of every row."""
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(
        (machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))
    )
    buckets = len(machine.linear)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Machine(*model.value)
        for batch in batches:
            found = scorer.scores(*features(text_column(batch, "text"), buckets))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key)
