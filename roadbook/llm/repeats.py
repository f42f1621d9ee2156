"""Repeated passages, found by recompression.

Rounds rename the words of every document to symbols: a run of one symbol becomes one symbol, then neighbouring
symbols become one where the left one's name has its round's bit clear and the right one's has it set. A name
is a 64-bit hash of what it stands for, so all tasks give equal parts equal names without a
dictionary. Whether two symbols join depends on them alone, so two equal stretches of words get equal symbols inside;
only at their ends can outer words change them, by at most as many words as a symbol may span.

With runs up to 2 and 3 words and pairs up to 3 and 6 words that is 2 + 2 + 3 + 3 = 10 words at either end. A
window of 35 words has 15 words within, and 15 ≥ 2·6 − 1 words always hold a whole symbol. Each window takes its longest
symbol there, with the smallest name, as its anchor. Equal windows have equal anchors at equal distance.

Every window with an anchor also holds the ten words on either side of it, so the anchor's key is made of its symbol and of
these words. Consecutive windows with one anchor are a block. A first pass counts the blocks of each key, combined before the
shuffle; a key that occurs once has no repeated window. A second pass sends the blocks of the other keys, found by a filter
of fixed size that lets some more through, with a 64-bit hash of each window's words; windows with equal key,
distance and hash are one passage, so two 64-bit hashes of different words must agree for a mistake. Keys that hold a large share of all blocks, like a long line in a third
of all documents, are dealt out by the windows' hashes as well. Blocks that are equal within a batch of documents
travel as one row with the places where they start, so a passage in a third of all documents sends one row per
batch. Repeated windows go back to their documents, where the words they cover are removed.

Defined results: null texts have no words; texts shorter than a window keep all. Windows are judged on the input. A row that repeats
counts as another document, whatever its id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.llm import bitmap
from roadbook.llm.folders import stored
from roadbook.llm.words import BASE, coded, hash_each, mixed, pieces, split_words, text_column

WINDOW = 35
RUN_WORDS = (2, 3)  # longest run of a round
PAIR_WORDS = (3, 6)  # longest pair of a round
_LONGEST = PAIR_WORDS[-1]
CUT_BYTES = 8 << 20  # of text that a task cuts into windows at once
HOT_LEAST = 1000  # blocks of a key that are never too many for one task
_HOT_SHARE = 4  # a key with more than this part of a task's share of blocks is dealt out by window


def _edge() -> int:
    """Words at either end of a stretch whose symbols outer words can change."""
    lost, longest = 0, 1
    for run, pair in zip(RUN_WORDS, PAIR_WORDS):
        lost += run
        longest = max(longest, run)
        lost += longest
        longest = max(longest, pair)
    return lost


def recompress(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first word and number of words of each symbol after all rounds."""
    start, size = np.arange(len(names)), np.ones(len(names), np.int64)
    for k, (run_cap, pair_cap) in enumerate(zip(RUN_WORDS, PAIR_WORDS)):
        if len(names) < 2:
            break
        # runs
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        copies = np.diff(np.append(heads, len(names)))
        joined = (copies > 1) & (copies * size[heads] <= run_cap)
        if joined.any():
            inside = np.repeat(joined, copies) & ~new
            at = heads[joined]
            names, size = names.copy(), size.copy()
            names[at] = mixed(names[at] * BASE + copies[joined].astype(np.uint64) + np.uint64(1 << 40))
            size[at] *= copies[joined]
            names, start, size, doc = (x[~inside] for x in (names, start, size, doc))
        # pairs
        bit = (mixed(names + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        left = np.zeros(len(names), bool)
        left[:-1] = ~bit[:-1] & bit[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= pair_cap)
        at = np.flatnonzero(left)
        names, size = names.copy(), size.copy()
        names[at] = mixed((names[at] * BASE) ^ (names[at + 1] + np.uint64(k + 7)))
        size[at] += size[at + 1]
        stay = np.ones(len(names), bool)
        stay[at + 1] = False
        names, start, size, doc = (x[stay] for x in (names, start, size, doc))
    return names, start, size


def _anchors(names: np.ndarray, start: np.ndarray, size: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """For the window that starts at each word, the word at which its anchor starts."""
    edge = _edge()
    inner = window - 2 * edge
    rank = np.zeros(n_words + window, np.uint64)  # longer symbols rank higher, then smaller names
    rank[start] = (size.astype(np.uint64) << np.uint64(61)) | (~names >> np.uint64(3))
    best = np.zeros(n_words, np.uint64)
    place = np.zeros(n_words, np.int64)
    for k in range(inner):
        here = rank[edge + k : edge + k + n_words]
        room = inner - k
        better = here > best
        if room < _LONGEST:
            better &= here < np.uint64((room + 1) << 61)
        best[better] = here[better]
        place[better] = k
    return np.arange(n_words) + edge + place


def _window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """Of the window that starts at each word; wraps are meant."""
    power = np.full(len(hashes) + 1, BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(hashes) + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    return mixed((sums[window:] - sums[:-window]) * back[: len(hashes) - window + 1])


_BLOCKS = "name bigint, first int, windows binary, places binary"
_PLACE = np.dtype([("row", "<i8"), ("check", "<i4"), ("start", "<i4")])


@dataclass
class _Cut:
    """The windows of a batch of texts: first word, anchor word and hash of each; where blocks begin and what key they have."""

    doc: np.ndarray
    offsets: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    prints: np.ndarray
    heads: np.ndarray
    counts: np.ndarray
    keys: np.ndarray


def _cut(texts: pa.Array, window: int) -> _Cut | None:
    words, offsets = split_words(texts, lower=False)
    if len(words) < window:
        return None
    codes, distinct = coded(words)
    hashes = hash_each(distinct)[codes]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n = len(hashes)
    names, start, size = recompress(hashes, doc)
    anchor = _anchors(names, start, size, n, window)[: n - window + 1]
    whole = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return None
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    heads = np.flatnonzero(new)
    name_at = np.zeros(n, np.uint64)
    name_at[start] = names
    edge = _edge()
    around = _window_hashes(hashes, 2 * edge + 1)
    keys = mixed(name_at[anchor[heads]] * BASE + around[anchor[heads] - edge])
    return _Cut(doc, offsets, at, anchor, _window_hashes(hashes, window)[at], heads, np.diff(np.append(heads, len(at))), keys)


def _key_counts(texts: pa.Array, window: int) -> pa.RecordBatch | None:
    cut = _cut(texts, window)
    if cut is None:
        return None
    keys, counts = np.unique(cut.keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, … for counts[i] numbers each, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _blocks(
    rows: np.ndarray, checks: np.ndarray, texts: pa.Array, window: int, wanted: np.ndarray | None = None, hot: np.ndarray | None = None
) -> pa.RecordBatch | None:
    """Blocks of the wanted keys; equal blocks of the batch as one row. Blocks of hot keys are cut into single windows."""
    cut = _cut(texts, window)
    if cut is None:
        return None
    chosen = np.flatnonzero(bitmap.passes(wanted, cut.keys)) if wanted is not None else np.arange(len(cut.heads))
    heads, counts, keys = cut.heads[chosen], cut.counts[chosen], cut.keys[chosen]
    if hot is not None and len(hot):
        single = np.isin(keys, hot)
        alone = _ranges(heads[single], counts[single])
        own = mixed(mixed(np.repeat(keys[single], counts[single]) + cut.prints[alone]) + (cut.anchor - cut.at)[alone].astype(np.uint64))
        heads, counts = np.concatenate([heads[~single], alone]), np.concatenate([counts[~single], np.ones(len(alone), np.int64)])
        keys = np.concatenate([keys[~single], own])
    if not len(heads):
        return None
    begin, first = cut.at[heads], (cut.anchor - cut.at)[heads]
    # equal blocks
    inside = _ranges(np.zeros(len(heads), np.int64), counts)
    prints = cut.prints[_ranges(heads, counts)]
    sums = np.add.reduceat(mixed(prints + (inside.astype(np.uint64) << np.uint64(48))), np.cumsum(counts) - counts)
    block = mixed(sums + keys * BASE + (first * 64 + counts).astype(np.uint64))
    _, sample, group = np.unique(block, return_index=True, return_inverse=True)
    places = np.zeros(len(heads), _PLACE)
    document = cut.doc[begin]
    places["row"], places["check"], places["start"] = rows[document], checks[document], begin - cut.offsets[document]
    places = places[np.argsort(group, kind="stable")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[sample].view(np.int64)),
            pa.array(first[sample].astype(np.int32)),
            _binary(cut.prints[_ranges(heads[sample], counts[sample])].astype("<u8").tobytes(), counts[sample] * 8),
            _binary(places.tobytes(), np.bincount(group) * _PLACE.itemsize),
        ],
        ["name", "first", "windows", "places"],
    )


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one array, and the number of bytes of each value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    wide = column.cast(pa.large_binary())
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(wide.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds)


def _repeated(blocks: pa.Table) -> pa.RecordBatch:
    """Row key, first window and windows (as bits) of each stretch of windows that occurs elsewhere too."""
    raw, sizes = _bytes_of(blocks["windows"])
    counts = sizes // 8
    prints = np.frombuffer(raw.tobytes(), "<u8").astype(np.uint64)
    spread, place_sizes = _bytes_of(blocks["places"])
    places = np.frombuffer(spread.tobytes(), _PLACE)
    n_places = place_sizes // _PLACE.itemsize
    heads = np.cumsum(counts) - counts
    inside = np.arange(len(prints)) - np.repeat(heads, counts)
    distance = np.repeat(blocks["first"].to_numpy().astype(np.int64), counts) - inside
    name = np.repeat(blocks["name"].to_numpy().view(np.uint64), counts)
    anchor = mixed(name + distance.astype(np.uint64))
    order = np.lexsort((prints, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (prints[order[1:]] != prints[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
    group = np.zeros(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    seen = np.bincount(group, np.repeat(n_places, counts))[group] > 1
    bits = np.add.reduceat(seen.astype(np.int64) << inside, heads) if len(heads) else np.zeros(0, np.int64)
    spread_bits = np.repeat(bits, n_places)
    hit = spread_bits > 0
    return pa.RecordBatch.from_arrays(
        [*(pa.array(places[name][hit]) for name in ("row", "check", "start")), pa.array(spread_bits[hit])],
        ["row", "check", "start", "bits"],
    )


def _removal(starts: list[int], bits: list[int], n_words: int, window: int) -> np.ndarray:
    """Which words are covered."""
    step = np.zeros(n_words + 1, np.int64)
    at, flags = np.asarray(starts, np.int64), np.asarray(bits, np.int64)
    for k in range(int(flags.max()).bit_length()):
        first = at[(flags >> k) & 1 == 1] + k
        first = first[first + window <= n_words]
        np.add.at(step, first, 1)
        np.add.at(step, first + window, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``row`` and ``check`` (hashes of id and text), ``start`` and ``bits``: the windows that occur elsewhere too."""
    if window - 2 * _edge() < 2 * _LONGEST - 1:
        raise ValueError(f"windows need at least {2 * _edge() + 2 * _LONGEST - 1} words")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    texts = docs.select("row", "check", docs[text].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", CUT_BYTES):
                if (out := _key_counts(text_column(piece, "text"), window)) is not None:
                    for i in range(0, out.num_rows, 100_000):
                        yield out.slice(i, 100_000)

    counted = texts.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = stored(counted, "repeated-keys")
    wanted = bitmap.filter_of(repeated, "key")
    hot = _hot_keys(repeated, tasks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", CUT_BYTES):
                rows, checks = (piece.column(c).to_numpy() for c in ("row", "check"))
                if (out := _blocks(rows, checks, text_column(piece, "text"), window, wanted.value, hot)) is not None:
                    for i in range(0, out.num_rows, 100_000):
                        yield out.slice(i, 100_000)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield _repeated(pa.Table.from_batches(held))

    dealt = texts.mapInArrow(cut, _BLOCKS).repartition(tasks, "name")
    return dealt.mapInArrow(meet, "row bigint, check int, start int, bits bigint")


def _hot_keys(repeated: DataFrame, tasks: int) -> np.ndarray:
    """Keys that hold more than a quarter of a task's share of the repeated blocks; fewer than four per task."""
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = repeated.where(F.col("n") > max(HOT_LEAST, total // (_HOT_SHARE * tasks))).select("key").collect()
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_sha256``, and the ``kept`` text if asked for."""
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text")).withColumns({"row": F.xxhash64("id", "text"), "check": F.hash("id", "text")})
    # rows equal in id and text have equal marks, which count once
    marks = repeated_windows(rows, "text", window).groupBy("row", "check").agg(F.collect_set(F.struct("start", "bits")).alias("marks"))
    marked = rows.join(marks, ["row", "check"], "left").select("id", "text", "marks")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, kept_texts = [], [], [], []
            words, offsets = split_words(text_column(batch, "text"), lower=False)
            for i, marks in enumerate(batch.column("marks")):
                own = words[offsets[i] : offsets[i + 1]]
                gone = 0
                if marks.is_valid:
                    places = marks.values.flatten()
                    cover = _removal(places[0].to_numpy(), places[1].to_numpy(), len(own), window)
                    gone = int(cover.sum())
                    own = own.filter(pa.array(~cover))
                kept = " ".join(own.to_pylist())
                total.append(int(offsets[i + 1] - offsets[i]))
                removed.append(gone)
                digests.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
                kept_texts.append(kept)
            columns = [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(run, schema).withColumnRenamed("id", key)
