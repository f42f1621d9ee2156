"""A filter of fixed size for keys, built by Spark and sent to all tasks.

Each key sets one bit of a bitmap. A key that was put in always passes; others pass by chance, the more the
fuller the bitmap. So a filter only saves work: what passes must be checked by other means.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27  # 2^27 bits are 16 MB
_BLOCK_BITS = 16


def filter_of(keys: DataFrame, key: str, bits: int = BITS) -> Broadcast:
    """The bitmap of a column of 64-bit keys; null keys are left out. At most 2^``bits`` bits come to the driver."""
    spark = keys.sparkSession
    block_bits = min(_BLOCK_BITS, bits)
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    places = keys.where(F.col(key).isNotNull()).select(F.shiftright(place, block_bits).alias("block"), place.alias("place"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            block, at = (batch.column(c).to_numpy() for c in ("block", "place"))
            order = np.argsort(block, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(rows):
                    own = blocks.setdefault(int(block[rows[0]]), np.zeros(1 << block_bits, bool))
                    own[at[rows] & ((1 << block_bits) - 1)] = True
        for block, own in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = places.repartition(tasks, "block").mapInArrow(fill, "block bigint, bits binary")
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    size = max(1, (1 << block_bits) >> 3)
    for row in filled.toLocalIterator():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key may have been put in."""
    at = keys.astype(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
