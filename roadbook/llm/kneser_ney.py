"""Language-model scores from an interpolated modified Kneser-Ney bigram model.

Counting is a Spark job of two rounds, words and then pairs of word numbers. A task counts its documents some megabytes at a
time, and what a stretch counted goes out as one block per part: words by the top bits of their hash, pairs by their context, and
a context that stands before a large share of all tokens by the following word as well. The number of parts of pairs follows the
number of tokens, so a part holds about ``PART_TOKENS`` of them at any size of the corpus. The model is stored as sorted
arrays in the shared folder: per shard words (hash, count), per part its contexts and its pairs (place of the context and
number of the word in one key, count), and by word number the weight of the lower order and the continuation probability.
Workers memory-map them, so all tasks of a machine share one copy in its page cache and touch only the pages they look up.

Every word and every pair of the training texts is kept, also those seen once. Words that training never saw share one
place in the lower order.

The shared folder must be one that all machines mount (local disk in tests, a network or mounted object store on a
cluster), as only such files can be memory-mapped.

Defined results: null counts as an empty text, which has one token, its end. Without training texts each token has
base probability 1 and model probability 1. Rows that repeat count as documents of their own. Other
columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadbook.llm.folders import new_folder
from roadbook.llm.words import coded, hash_each, mixed, pieces, split_words, text_column

COUNT_BYTES = 8 << 20  # of text that a task counts at once; more would combine more, but take more memory
SCORE_BYTES = 6 << 20
PART_TOKENS = 2_500_000  # of training text that a part's pairs come from
END_HASH = np.uint64(0x5851F42D4C957F2D)  # of the end token, which is no word
_HOT_SHARE = 4  # a context that stands before more than this part of a part's tokens is dealt by the next word as well
_WORD_BITS = np.uint64(34)  # of a pair's key: the number of its word; a part has far fewer than 2^30 contexts


def mounted(folder: str) -> str:
    match = re.fullmatch(r"(?:file:(?://)?)?(/.*)", folder)
    if not match:
        raise ValueError(f"{folder} can't be memory-mapped: spark.checkpoint.dir must be a mounted folder")
    return match[1]


def _save(folder: str, name: str, shard: int, values: np.ndarray) -> None:
    """Whole or not at all, so a repeated or lost task does no harm."""
    part = f"{folder}/.{name}-{shard}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, values)
    os.replace(part, f"{folder}/{name}-{shard:06d}.npy")


def _load(folder: str, name: str, shard: int, kind: str) -> np.ndarray:
    path = f"{folder}/{name}-{shard:06d}.npy"
    return np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, kind)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - shards.bit_length())).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)


@dataclass
class Model:
    """What workers need to open the stored arrays."""

    folder: str
    shards: int
    offsets: np.ndarray  # number of the first word of each shard
    tokens: int
    types: int
    documents: int
    parts: int = 1
    lower_floor: float = 0.0  # lower-order probability of a word without any predecessor
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _open: dict = field(default_factory=dict, repr=False)

    unseen = property(lambda self: self.types)  # the number of all words that training did not see
    begin = property(lambda self: self.types + 1)

    def array(self, name: str, shard: int, kind: str) -> np.ndarray:
        if (name, shard) not in self._open:
            self._open[name, shard] = _load(self.folder, name, shard, kind)
        return self._open[name, shard]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word."""
        numbers, counts = np.full(len(hashes), self.unseen, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes, kind="stable")
        shard = _shard_of(hashes[order], self.shards)
        for rows in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
            s = int(_shard_of(hashes[rows[:1]], self.shards)[0])
            keys = self.array("word", s, "u8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[rows]), len(keys) - 1)
                found = keys[at] == hashes[rows]
                counts[rows[found]] = self.array("count", s, "i8")[at[found]]
                numbers[rows[found]] = self.offsets[s] + at[found]
        return numbers, counts

    @cached_property
    def block(self) -> int:
        return -(-(self.types + 2) // self.shards)

    def by_number(self, name: str, numbers: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(numbers), missing)
        order = np.argsort(numbers, kind="stable")
        part = numbers[order] // self.block
        for rows in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                values = self.array(name, int(numbers[rows[0]] // self.block), "f8")
                if len(values):
                    out[rows] = values[numbers[rows] % self.block]
        return out

    def context_counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often each word stands before a token."""
        out = np.zeros(len(numbers), np.int64)
        out[numbers == self.begin] = self.documents
        plain = np.flatnonzero(numbers < self.types)
        shard = np.searchsorted(self.offsets, numbers[plain], side="right") - 1
        for s in np.unique(shard):
            rows = plain[shard == s]
            out[rows] = self.array("count", int(s), "i8")[numbers[rows] - self.offsets[s]]
        return out

    def part_of(self, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The part that keeps a pair; ``counts`` are those of the contexts."""
        spread = mixed(before.astype(np.uint64) + np.uint64(1))
        hot = counts > self.tokens // (_HOT_SHARE * self.parts)
        spread[hot] = mixed(spread[hot] + after[hot].astype(np.uint64))
        return (spread % np.uint64(self.parts)).astype(np.int64)

    def high(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Discounted probability of each pair, 0 for pairs that training did not see."""
        out = np.zeros(len(before))
        contexts, place = np.unique(before, return_inverse=True)
        counts = self.context_counts(contexts)[place]
        part = self.part_of(before, after, counts)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            p = int(part[rows[0]])
            known, keys = self.array("context", p, "i8"), self.array("pair", p, "u8")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(known, before[rows]), len(known) - 1)
            wanted = _pair_key(at, after[rows])
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = (known[at] == before[rows]) & (keys[spot] == wanted)
            n = self.array("times", p, "u4")[spot[found]].astype(np.int64)
            rows = rows[found]
            out[rows] = (n - np.array([0.0, *self.discounts])[np.minimum(n, 3)]) / counts[rows]
        return out


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << _WORD_BITS) | word.astype(np.uint64)


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens, texts one after another with their end; hash of each code (the last is the
    end's); first token of each text."""
    words, offsets = split_words(texts, lower=True)
    codes, distinct = coded(words)
    hashes = np.append(hash_each(distinct), END_HASH)
    n = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n)
    tokens = np.full(len(codes) + n, len(distinct), np.int64)
    mask = np.ones(len(tokens), bool)
    mask[offsets[1:] + np.arange(n)] = False
    tokens[mask] = codes
    return tokens, hashes, starts


def _before(tokens: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[starts] = begin
    return out


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, "text", most)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(docs[text].cast("string").alias("text"))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    size = next(b for b in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * b))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"<u{body[0]}", offset=1)


_BLOCK = "part int, a binary, b binary, n binary, texts bigint"


def _blocks(part: np.ndarray, columns: list[np.ndarray], texts: int, most: int = 16) -> Iterator[pa.RecordBatch]:
    """Columns that lie in order of ``part``, packed into one row per part; ``texts`` goes with the first.

    The first column rises within a part, so its steps are kept.
    """
    first, *others = columns
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    spans = list(zip(cuts, cuts[1:]))
    for at in range(0, len(spans), most):
        some = spans[at : at + most]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[x]) for x, _ in some], pa.int32()),
                pa.array([_packed(np.diff(first[x:y], prepend=first.dtype.type(0))) for x, y in some], pa.binary()),
                *(pa.array([_packed(c[x:y]) for x, y in some], pa.binary()) for c in others),
                pa.array([texts if at + i == 0 else 0 for i in range(len(some))], pa.int64()),
            ],
            ["part", "a", "b", "n", "texts"],
        )


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], int]]:
    """The columns of each part, put together again, from rows in which a part's follow one another."""

    def whole(held: list[tuple]) -> tuple[int, list[np.ndarray], int]:
        first = np.concatenate([np.cumsum(_unpacked(row[1]), dtype=np.uint64) for row in held])
        others = [np.concatenate([_unpacked(row[i]) for row in held]).astype(np.int64) for i in (2, 3)]
        return held[0][0], [first, *others], sum(row[4] for row in held)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield whole(held)
                held = []
            held.append(row)
    if held:
        yield whole(held)


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """One part per task."""
    return blocks.repartitionById(parts, "part")


def _count_words(docs: DataFrame, text: str, folder: str, shards: int) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, COUNT_BYTES):
            tokens, hashes, starts = _sequences(text_column(batch, "text"))
            counts = np.bincount(tokens, minlength=len(hashes))
            order = np.argsort(hashes)
            order = order[counts[order] > 0]
            hashes, counts = hashes[order], counts[order]
            yield from _blocks(_shard_of(hashes, shards), [hashes, np.zeros(len(hashes), np.int64), counts], len(starts))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (words, _, counts), texts in _by_part(batches):
            distinct, place = np.unique(words, return_inverse=True)
            total = np.bincount(place, counts).astype(np.int64)
            _save(folder, "word", shard, distinct)
            _save(folder, "count", shard, total)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "types": len(total), "tokens": int(total.sum()), "texts": texts}])

    rows = _dealt(_texts(docs, text).mapInArrow(count, _BLOCK), shards)
    sums = rows.mapInArrow(store, "shard bigint, types bigint, tokens bigint, texts bigint").collect()  # a row per shard
    types = np.zeros(shards, np.int64)
    for row in sums:
        types[row.shard] = row.types
    tokens = sum(r.tokens for r in sums)
    parts = max(shards, -(-tokens // PART_TOKENS))
    return Model(folder, shards, np.cumsum(types) - types, tokens, int(types.sum()), sum(r.texts for r in sums), parts)


def _distinct(v: np.ndarray, w: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of v and w, the order and first places that make them, and the place of each given pair among them."""
    if numbers < 1 << 31:  # a pair fits one number, which sorts faster
        order = np.argsort(v * np.int64(numbers) + w)
    else:
        order = np.lexsort((w, v))
    first = np.append(True, (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)) if len(v) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(first) - 1
    return v[order[heads]], w[order[heads]], (order, heads), place


def _summed(v: np.ndarray, w: np.ndarray, n: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of v and w, with the sums of their counts."""
    if not len(v):
        return v, w, n
    v, w, (order, heads), _ = _distinct(v, w, numbers)
    return v, w, np.add.reduceat(n[order], heads)


_FACTS = "kind int, a bigint, n bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"


def _facts(kind: int, a, n, parts=None) -> pa.RecordBatch:
    size = len(a)
    parts = parts if parts is not None else [np.zeros(size, np.int64)] * 4
    columns = [np.full(size, kind, np.int32), a, n, *parts]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "n", "n1", "n2", "n3", "n4"])


def _count_pairs(docs: DataFrame, text: str, model: Model, path: str) -> None:
    """Store all pairs and write facts about them, by kind: 1 a context (its distinct pairs by count), 2 a word (its
    distinct predecessors), 3 the number of pairs by count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, COUNT_BYTES):
            tokens, hashes, starts = _sequences(text_column(batch, "text"))
            after = model.words(hashes)[0][tokens]
            before = _before(after, starts, model.begin)
            before, after, n = _summed(before, after, np.ones(len(after), np.int64), model.types + 2)
            heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
            lengths = np.diff(np.append(heads, len(before)))
            part = model.part_of(before, after, np.repeat(model.context_counts(before[heads]), lengths))
            order = np.argsort(part, kind="stable")
            yield from _blocks(part[order], [before[order], after[order], n[order]], 0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (v, w, n), _ in _by_part(batches):
            v, w, n = _summed(v.view(np.int64), w, n, model.types + 2)
            heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            local = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(v))))
            _save(model.folder, "context", part, v[heads])
            _save(model.folder, "pair", part, _pair_key(local, w))
            _save(model.folder, "times", part, n.astype("u4") if n.max() < 1 << 32 else n)
            by_count = [np.add.reduceat(x.astype(np.int64), heads) for x in (n == 1, n == 2, n > 2)]
            yield _facts(1, v[heads], model.context_counts(v[heads]), [*by_count, np.zeros(len(heads), np.int64)])
            words, found = np.unique(w, return_counts=True)
            yield _facts(2, words, found.astype(np.int64))
            yield _facts(3, np.zeros(1, np.int64), np.array([len(n)]), [np.array([(n == k).sum()]) for k in (1, 2, 3, 4)])

    rows = _dealt(_texts(docs, text).mapInArrow(count, _BLOCK), model.parts)
    rows.mapInArrow(merge, _FACTS).write.partitionBy("kind").parquet(path)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts 1, 2 and more; half the count where the corpus is too small to tell."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    given = (
        1 - 2 * y * n2 / n1 if n1 else 0.5,
        2 - 3 * y * n3 / n2 if n2 else 1.0,
        3 - 4 * y * n4 / n3 if n3 else 1.5,
    )
    return tuple(min(max(d, 0.0), k - 0.1) if n1 and n2 else k / 2 for k, d in enumerate(given, 1))


def _store_by_number(values: DataFrame, name: str, model: Model, missing: float) -> None:
    """(a, p) as arrays by number."""
    block = model.block

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        numbers, p = table["a"].to_numpy(), table["p"].to_numpy()
        part = numbers // block
        for s in np.unique(part):
            out = np.full(block, missing)
            own = part == s
            out[numbers[own] % block] = p[own]
            _save(model.folder, name, int(s), out)
            yield pa.RecordBatch.from_pydict({"shard": [int(s)]})

    placed = values.withColumn("part", F.floor(F.col("a") / F.lit(block)).cast("bigint"))
    placed.repartition(model.shards, "part").select("a", "p").mapInArrow(store, "shard bigint").count()


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    spark: SparkSession = docs.sparkSession
    wanted = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(0, wanted - 1).bit_length()
    place = new_folder(spark, "kneser-ney")
    folder = mounted(place)
    os.makedirs(f"{folder}/arrays", exist_ok=True)
    model = _count_words(docs, text, f"{folder}/arrays", shards)
    if not model.tokens:
        return model
    _count_pairs(docs, text, model, f"{place}/facts")
    facts = spark.read.schema(_FACTS).parquet(f"{place}/facts")

    counted = facts.where("kind = 3").agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    model.discounts = discounts(*counted)

    # what each context leaves to the lower order: the sum of its discounts
    contexts = facts.where("kind = 1").groupBy("a").agg(F.max("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in (1, 2, 3)])
    weight = sum((F.col(f"n{k}") * F.lit(d) for k, d in zip((1, 2, 3), model.discounts)), F.lit(0.0)) / F.col("n")
    _store_by_number(contexts.select("a", weight.alias("p")), "left", model, 1.0)

    words = facts.where("kind = 2").groupBy("a").agg(F.sum("n").alias("n"))
    many = words.agg(
        F.sum("n").alias("total"), *[F.sum((F.col("n") == k).cast("bigint")) for k in (1, 2, 3, 4)], F.sum((F.col("n") > 2).cast("bigint"))
    ).first()
    total, n1, n2, n3, n4, more = many
    e1, e2, e3 = discounts(n1, n2, n3, n4)
    model.lower_floor = (e1 * n1 + e2 * n2 + e3 * more) / total / (model.types + 1)
    lower = (F.col("n") - F.when(F.col("n") == 1, e1).when(F.col("n") == 2, e2).otherwise(e3)) / F.lit(float(total)) + F.lit(model.lower_floor)
    _store_by_number(words.select("a", lower.alias("p")), "lower", model, model.lower_floor)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``n_known``, ``base_score`` (add-one words), ``score`` (the model's log10 probability) and ``perplexity``."""
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    names = ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, SCORE_BYTES):
            tokens, hashes, starts = _sequences(text_column(batch, "text"))
            numbers, counts = model.words(hashes)
            sizes = np.diff(np.append(starts, len(tokens)))
            base = np.log10((counts + 1) / (model.tokens + model.types + 1))[tokens]
            logs = np.zeros(len(tokens))
            if model.tokens:
                after = numbers[tokens]
                before = _before(after, starts, model.begin)
                v, w, _, place = _distinct(before, after, model.types + 2)
                left, spot = np.unique(before, return_inverse=True)
                lower = model.by_number("lower", numbers, model.lower_floor)
                logs = np.log10(model.high(v, w)[place] + model.by_number("left", left, 1.0)[spot] * lower[tokens])
            total = np.add.reduceat(logs, starts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(total),
                    pa.array(10 ** np.minimum(-total / sizes, 300.0)),
                ],
                names,
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", key)
