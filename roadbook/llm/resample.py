"""Importance resampling towards a target distribution of hashed word n-grams.

Words are found on the UTF-8 bytes of a text: one table of 256 bytes lower-cases A-Z and blanks
every ASCII byte that is no letter or digit, ``bytes.split`` gives the words, and the CRC-32 of a
word, fed on as the seed of the next, gives the buckets of longer runs. A first pass counts
features per bucket over all documents and all target texts, summed per batch before they leave a
task; the gains per bucket are a table of fixed size that the second pass adds up per document.
Gumbel noise from a hash of seed and id makes the draw of the highest scores a sample without
replacement. Ranks need one order over all candidates: they are dealt into ranges of (score, id,
row), each range is sorted where it lies, and one count per range carries the numbers.

Defined results: a null text has no words. A document without features has weight 0. A null id is
hashed as an empty one and comes last among equal scores. Rows that repeat are documents of their
own: equal score, ranks in no stated order between them. Of an empty table nothing is drawn.
Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadbook.llm.folders import stored
from roadbook.llm.words import pieces

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
DRAW_PERCENT = 10
PIECE_BYTES = 8 << 20
MEMO_BYTES = 32 << 20  # of words whose bucket or gain a worker keeps

# letters and digits stay, A-Z become a-z, other ASCII becomes a blank, bytes of longer characters stay
TABLE = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)


def word_lists(text: bytes, most: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words in order, in lists of some ``most`` bytes, so that no text is held as one list."""
    blanked = text.translate(TABLE)
    start = 0
    while start < len(blanked):
        end = blanked.find(b" ", start + most)
        end = len(blanked) if end < 0 else end
        yield blanked[start:end].split()
        start = end


class Kept(dict):
    """What a function gives per key; emptied when its keys' bytes reach the bound."""

    def __init__(self, function, most: int = MEMO_BYTES):
        super().__init__()
        self.function, self.most, self.held = function, most, 0

    def __missing__(self, key):
        value = self.function(key)
        if self.held > self.most:
            self.clear()
            self.held = 0
        self.held += len(key) + 100
        self[key] = value
        return value


def longer_runs(words: list[bytes], before: list[bytes], max_n: int) -> Counter:
    """Counts of the CRC-32 of every run of 2 to ``max_n`` words that ends in ``words``; ``before``: up to ``max_n`` - 1 words ahead of them."""
    found: Counter = Counter()
    words = before + words
    codes = [zlib.crc32(w) for w in words]
    for n in range(2, max_n + 1):
        # the run that starts at i so far, extended by a blank and its next word
        codes = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(codes, words[n - 1 :])]
        found.update(codes[max(0, len(before) - n + 1) :])
    return found


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(``bucket``, ``n``): features of all rows; buckets without features are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                texts = texts_of(piece)
                for words in word_lists(b" ".join(texts)):
                    for word, n in Counter(words).items():
                        sums[zlib.crc32(word) % buckets] += n
                for body in texts if max_n > 1 else ():
                    before: list[bytes] = []
                    for words in word_lists(body):
                        for code, n in longer_runs(words, before, max_n).items():
                            sums[code % buckets] += n
                        before = (before + words)[1 - max_n :]
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(sums[filled], pa.int64())], ["bucket", "n"])

    rows = docs.select(docs[text].cast("string").alias("text"))
    return rows.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Per bucket the log ratio of the target's smoothed share to that of the documents, in thousandths."""

    def gathered(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for row in bucket_counts(df, text, max_n, buckets).collect():  # one row per bucket
            out[row["bucket"]] = row["n"]
        return out

    have, want = gathered(docs), gathered(target)
    all_have, all_want = float(sum(have) + buckets), float(sum(want) + buckets)
    return [math.floor(1000 * math.log((t + 1) * all_have / ((s + 1) * all_want))) for s, t in zip(have, want)]


def noise(seed: int, key: int | None) -> int:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, table: list[int], seed: int = SEED, key: str = "doc_id", text: str = "text", max_n: int = 1
) -> DataFrame:
    """id, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row."""
    rows = docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(table)
        gain = Kept(lambda word: table[zlib.crc32(word) % buckets])
        for batch in batches:
            ids = batch.column("id").to_pylist()
            words, features, weights = [], [], []
            for body in texts_of(batch):
                n = longer = weight = 0
                before: list[bytes] = []
                for found in word_lists(body):
                    n += len(found)
                    weight += sum(map(gain.__getitem__, found))
                    if max_n > 1:
                        for code, times in longer_runs(found, before, max_n).items():
                            weight += times * table[code % buckets]
                            longer += times
                        before = (before + found)[1 - max_n :]
                words.append(n)
                features.append(n + longer)
                weights.append(weight)
            scores = [w + noise(seed, i) for w, i in zip(weights, ids)]
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in (words, features, weights, scores))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank`` from 1 in the given order, without sorting all rows in one task."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id's upper bits name the range, its lower 33 bits count the rows within
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("place", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return ranked.withColumn("rank", F.col("start") + inside + 1).drop("part", "start", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: int = SEED,
    draw_percent: int = DRAW_PERCENT,
    min_words: int = MIN_WORDS,
    max_n: int = 1,
    buckets: int = BUCKETS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row's id, ``n_features``, ``weight``, ``score`` and ``rank``, which is null where the row is not drawn."""
    table = gains(docs, target, text, max_n, buckets)
    scored = stored(weigh(docs, table, seed, key, text, max_n), "scores")
    long_enough = F.col("n_words") >= min_words
    n = scored.where(long_enough).count()
    out = [F.col("id").alias(key), "n_features", "weight", "score"]
    candidates = scored.where(long_enough).withColumn("row", F.monotonically_increasing_id())
    ranked = numbered(candidates, F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    drawn = F.when(F.col("rank") <= draw_percent * n // 100, F.col("rank")).cast("bigint").alias("rank")
    rest = scored.where(~long_enough).select(*out, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*out, drawn).unionByName(rest)
