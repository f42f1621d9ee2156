"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's set holds its distinct runs of five lower-cased words. One hash deals the set's members
into bins; a bin keeps its smallest member, and an empty bin borrows from the first
filled one in its own fixed random order of bins. Bands of bins give bucket keys.

Equal sets are one node from the start, so copies are never paired. In each bucket, members are first joined to
the bucket's leaders only (star-shaped candidates): the smallest id, the largest, and the smallest in an
order of the bucket's own. Candidates of the first kind are confirmed on the full sets; of the others only those
whose ends are not connected yet. Where other members of a bucket are in several components after that, all their
sets are compared, tile by tile of the bucket's square. So any two documents that share a bucket are compared or
connected otherwise, and a bucket is only worked off in full if it does not hang together.

With 32 bands of 4 bins a pair of similarity 0.75 meets in some bucket with probability 0.99999.

Defined results: null and wordless texts have an empty set and no link. Texts of fewer than five words are one
run as a whole. A null id has no link, component null, and stays. Rows that share an id are one node: they count
as linked. Ties of size or similarity do not matter, as components go by the smallest id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.llm.components import components
from roadbook.llm.folders import stored
from roadbook.llm.words import BASE, mixed, run_hashes, text_column, word_hashes

WORDS = 5
BINS = 128
BAND_ROWS = 4
PERCENT = 75
_SEED = 2026
_TILE_ROWS = 256  # of a bucket's members on either side of a tile
_TILE_BYTES = 16 << 20  # of sets, likewise


def sets_of(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's set as sorted distinct 64-bit hashes."""
    hashes, offsets = word_hashes(texts, lower=True)
    runs = run_hashes(hashes, words)
    for start, end in zip(offsets[:-1], offsets[1:]):
        if end - start >= words:
            yield np.unique(runs[start : end - words + 1])
        elif end > start:
            yield run_hashes(hashes[start:end], int(end - start), BASE + np.uint64(2 * (end - start)))
        else:
            yield np.zeros(0, np.uint64)


def probe_orders(bins: int) -> np.ndarray:
    """For every bin the order in which it looks for a filled one."""
    rng = np.random.default_rng(_SEED)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(members: np.ndarray, orders: np.ndarray) -> np.ndarray:
    bins = len(orders)
    place = (members >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(place, return_index=True)  # members are sorted
    out, has = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[filled], has[filled] = members[first], True
    empty = np.flatnonzero(~has)
    if len(empty):
        tries = orders[empty]
        out[empty] = out[tries[np.arange(len(empty)), has[tries].argmax(axis=1)]]
    return out


def band_keys(sign: np.ndarray, rows: int) -> np.ndarray:
    parts = sign.reshape(-1, rows)
    keys = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for k in range(rows):
        keys = mixed(keys * BASE + parts[:, k])
    return keys.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, words: int, bins: int, rows: int) -> DataFrame:
    """id, ``n_shingles``, ``set_key`` (128-bit hash of the set) and ``bands``."""
    source = docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = probe_orders(bins)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for members in sets_of(text_column(batch, "text"), words):
                sizes.append(len(members))
                keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                bands.append(band_keys(signature(members, orders), rows) if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "n_shingles", "set_key", "bands"],
            )

    return source.mapInArrow(run, "id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def bucketed(nodes: DataFrame) -> DataFrame:
    """(band, id, n_shingles) with the bucket's size ``n`` and leaders, for buckets of several members."""
    bands = nodes.select("id", "n_shingles", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.col("id").bitwiseXOR(F.col("band"))).alias("own"), F.count("id").alias("n")
    )
    buckets = buckets.where("low < high").withColumn("own", F.col("own").bitwiseXOR(F.col("band")))
    return bands.join(buckets, "band")


def candidates(members: DataFrame) -> DataFrame:
    """(a, b, first): members and leaders of each bucket; ``first`` where the leader is the smallest id."""
    leaders = F.explode(F.array_distinct(F.array("low", "high", "own")))
    met = members.select("id", "low", leaders.alias("leader")).where("id <> leader")
    pairs = met.select(
        F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b"), (F.col("leader") == F.col("low")).alias("first")
    )
    return pairs.groupBy("a", "b").agg(F.max("first").alias("first"))


def similar(common, x, y, percent: int):
    """Whether sets of sizes x and y reach the similarity with so many common members; of numbers or arrays."""
    return (common > 0) & (100 * common >= percent * (x + y - common))


def tile_links(
    band: int, bands: np.ndarray, chunk: np.ndarray, label: np.ndarray, sets: list[np.ndarray], within: bool, percent: int
) -> list[tuple[int, int]]:
    """Similar pairs that connect what has different labels, of one chunk (``within``) or across two.

    A pair is left to the first band in which it meets.
    """
    at = np.flatnonzero(bands[0] == band)[0]
    links, label = [], label.copy()
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum([len(x) for x in sets])[:-1])
    marked = np.zeros(max(c.max() for c in codes) + 1, bool)
    for i, own in enumerate(codes):
        wanted = label != label[i]
        wanted[:i] = False
        if not within:
            wanted &= chunk != chunk[i]
        wanted[wanted] = ~(bands[wanted, :at] == bands[i, :at]).any(axis=1)
        marked[own] = True
        for j in np.flatnonzero(wanted):
            if label[j] != label[i] and similar(np.count_nonzero(marked[codes[j]]), len(own), len(codes[j]), percent):
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
        marked[own] = False
    return links


def remaining(
    crowded: DataFrame, joined: DataFrame, docs: DataFrame, key: str, text: str, words: int, bins: int, rows: int, percent: int
) -> DataFrame:
    """Similar pairs of members that are no leaders of their bucket and in different components (a bucket's tiles bound a task)."""
    of = joined.select(F.col("id").alias("joined"), "component")
    placed = crowded.join(of, F.col("id") == F.col("joined"), "left").select(
        "band", "id", "n_shingles", F.coalesce("component", "id").alias("component")
    )
    buckets = placed.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("id").alias("n"), F.sum("n_shingles").alias("total")
    )
    sides = F.greatest(F.ceil(F.col("n") / _TILE_ROWS), F.ceil(F.col("total") * 8 / _TILE_BYTES)).cast("bigint")
    open_buckets = buckets.where("low < high").select("band", sides.alias("sides"))
    members = stored(placed.join(open_buckets, "band"), "open-members")
    ids = members.select(F.col("id").alias("wanted")).distinct()
    texts = docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("string").alias("text")).join(ids, F.col("id") == F.col("wanted"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = probe_orders(bins)
        for batch in batches:
            sets = list(sets_of(text_column(batch, "text"), words))
            bands = [band_keys(signature(x, orders), rows).tobytes() if len(x) else None for x in sets]
            columns = [batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["of", "members", "bands"])

    sets = texts.select("id", "text").mapInArrow(make, "of bigint, members binary, bands binary").where("bands IS NOT NULL").distinct()
    chunk = F.pmod(F.xxhash64("id"), "sides")
    dealt = members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1)))
    dealt = dealt.select("band", "id", "component", "chunk", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))

    def meet(tile: pa.Table) -> pa.Table:
        ids, chunk, label = (tile[c].to_numpy() for c in ("id", "chunk", "component"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in tile["members"]]
        bands = np.stack([np.frombuffer(x.as_py(), np.int64) for x in tile["bands"]])
        links = tile_links(tile["band"][0].as_py(), bands, chunk, label, sets, tile["x"][0] == tile["y"][0], percent)
        at = np.array(links, np.int64).reshape(-1, 2)
        ends = ids[at[:, 0]], ids[at[:, 1]]
        return pa.table({"a": np.maximum(*ends), "b": np.minimum(*ends)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    full = dealt.join(sets, F.col("id") == F.col("of")).select("band", "x", "y", "id", "chunk", "component", "members", "bands")
    return full.groupBy("band", "x", "y").applyInArrow(meet, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    texts = docs.select(docs[key].cast("bigint").alias("id"), docs[text].cast("string").alias("text"))
    left = pairs.select("a", "b").join(texts.alias("l"), F.col("a") == F.col("l.id")).select("a", "b", F.col("l.text").alias("left"))
    both = left.join(texts.alias("r"), F.col("b") == F.col("r.id")).select("a", "b", "left", F.col("r.text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(sets_of(text_column(batch, "left"), words), sets_of(text_column(batch, "right"), words)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(similar(common, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    bins: int = BINS,
    band_rows: int = BAND_ROWS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``."""
    found = stored(sketches(docs, key, text, words, bins, band_rows), "sketches")
    usable = found.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = usable.groupBy("set_key").agg(F.min("id").alias("node"))
    nodes = usable.select("id", "n_shingles", "set_key", "bands").join(classes.withColumnRenamed("set_key", "of"), (F.col("id") == F.col("node")) & (F.col("set_key") == F.col("of")))
    members = bucketed(nodes)
    pairs = stored(candidates(members), "pairs")
    links = stored(confirmed(pairs.where("first"), docs, key, text, words, percent), "links")
    joined = stored(components(links), "components")
    names = [joined.select(F.col("id").alias(f"{e}_id"), F.col("component").alias(f"{e}_of")) for e in "ab"]
    open_pairs = (
        pairs.where("NOT first")
        .join(names[0], F.col("a") == F.col("a_id"), "left")
        .join(names[1], F.col("b") == F.col("b_id"), "left")
        .where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b"))
        .select("a", "b")
    )
    more = stored(confirmed(stored(open_pairs, "open-pairs"), docs, key, text, words, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = stored(components(links), "components")
    crowded = stored(members.where("n > 3 AND id <> low AND id <> high AND id <> own").select("band", "id", "n_shingles"), "crowded")
    rest = stored(remaining(crowded, joined, docs, key, text, words, bins, band_rows, percent), "links")
    if not rest.isEmpty():
        joined = stored(components(links.unionByName(rest)), "components")
    # a row's class, then its class's component
    # keys are spelled out, so that both sides are dealt anew and Spark can split a heavy class
    of_class = classes.select(F.hex("set_key").alias("class"), "node")
    classed = found.select("id", "n_shingles", F.hex("set_key").alias("own")).join(of_class, F.col("own") == F.col("class"), "left")
    out = classed.join(joined.withColumnRenamed("id", "joined"), F.col("node") == F.col("joined"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """The rows that stay, with all their columns."""
    gone = near_duplicates(docs, key, text, **settings).where("NOT kept").select(F.col(key).alias("gone"))
    return docs.join(gone, docs[key].cast("bigint") == F.col("gone"), "left_anti")
