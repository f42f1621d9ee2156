"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased in A-Z and cut into words of ASCII letters, digits and all characters
beyond ASCII. A pattern is a run of ``window`` consecutive words of an item; an item with
fewer words, but not none, is one pattern as a whole. The automaton over all patterns reads each text
once; every hit is mapped back to the words it covers and to their offsets in the original.

The benchmark is a stated set, not a corpus: its words come to the driver in blocks of at most
``block_chars`` characters, and each block is one automaton, so a worker's memory is bounded
for any benchmark (about 500 bytes per character of a block). The usual benchmark is one block.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no
pattern. A null item id counts as an empty one; repeated items count once. An empty benchmark hits
nothing. Rows that repeat get equal results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.llm.folders import stored

WINDOW = 10
BLOCK_CHARS = 400_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before A-Z are lowered
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in blocks. Items are read one partition at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    block, chars = [], 0
    for row in rows.where(F.col("t").isNotNull()).toLocalIterator():
        words = words_of(row.t)
        if not words:
            continue
        if block and chars + len(row.t) > block_chars:
            yield block
            block, chars = [], 0
        block.append((row.i, words))
        chars += len(row.t)
    if block:
        yield block


def automaton(items: list[tuple[str, list[bytes]]], window: int) -> ahocorasick.Automaton:
    owners: dict[str, tuple[int, set[str]]] = {}
    for item, words in items:
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            pattern = b" ".join([b"", *words[i : i + size], b""]).decode("utf-8", "surrogatepass")
            owners.setdefault(pattern, (size, set()))[1].add(item)
    machine = ahocorasick.Automaton()
    for pattern, owner in owners.items():
        machine.add_word(pattern, owner)
    if owners:
        machine.make_automaton()
    return machine


def hits(machine: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges of hit words (from, to) in order of their ends, and the items they belong to."""
    ranges, items, starts = [], set(), None
    joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    for end, (size, owners) in machine.iter(joined):
        if starts is None:  # of each word, the place of the blank that ends it
            starts = {int(p): i for i, p in enumerate(np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)[1:])}
        last = starts[end]
        ranges.append((last - size + 1, last + 1))
        items |= owners
    return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SCHEMA = "id {}, text string, n_words bigint, ranges array<array<int>>, items array<string>"


def _scan(rows: DataFrame, items: list[tuple[str, list[bytes]]], window: int, kind: str) -> DataFrame:
    """Add one block's hits to those found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, window)
        for batch in batches:
            counts, ranges, owners = [], [], []
            texts = batch.column("text")
            for i, text in enumerate(texts):
                words = words_of(text.as_py())
                got, ids = hits(machine, words) if len(machine) and words else ([], set())
                if got or batch.column("ranges")[i].is_valid:
                    got = merged(got + [tuple(r) for r in batch.column("ranges")[i].as_py() or ()])
                    ids = sorted(ids | set(batch.column("items")[i].as_py() or ()))
                counts.append(len(words))
                ranges.append([list(r) for r in got] or None)
                owners.append(list(ids) or None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    texts,
                    pa.array(counts, pa.int64()),
                    pa.array(ranges, pa.list_(pa.list_(pa.int32()))),
                    pa.array(owners, pa.list_(pa.string())),
                ],
                ["id", "text", "n_words", "ranges", "items"],
            )

    return rows.mapInArrow(run, _SCHEMA.format(kind))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` words, ``items`` (sorted ids of the items hit)
    and ``spans``, the (start, end) offsets in the original text of each hit stretch."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        docs[key].alias("id"),
        docs[text].cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<array<int>>").alias("ranges"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    done = 0
    for block in blocks(benchmark, item_id, item_text, block_chars):
        if done:
            rows = stored(rows, "scanned")  # one automaton at a time
        rows, done = _scan(rows, block, window, kind), done + 1
    if not done:
        rows = _scan(rows, [], window, kind)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, found = [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                stretches = ranges.as_py() or []
                places = [m.span() for m in _WORD.finditer(text.as_py())] if stretches else []
                found.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in stretches])
                hit.append(sum(b - a for a, b in stretches))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("n_words"),
                    pa.array(hit, pa.int64()),
                    batch.column("items"),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["id", "n_words", "n_hit", "items", "spans"],
            )

    schema = f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    out = rows.mapInArrow(spans, schema)
    return out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumnRenamed("id", key)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows in which no pattern occurs, with all their columns."""
    done = 0
    for block in blocks(benchmark, item_id, item_text, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            machine = automaton(block, window)
            for batch in batches:
                clean = []
                for value in batch.column(batch.schema.get_field_index(text)):
                    words = words_of(value.as_py())
                    joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
                    clean.append(next(machine.iter(joined), None) is None)
                yield batch.filter(pa.array(clean, pa.bool_()))

        if done:
            docs = stored(docs, "scanned")
        docs, done = docs.mapInArrow(run, docs.schema), done + 1
    return docs
