"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the mix. A source whose share exceeds its cap
(maximum epochs times its words) is clamped there and its excess goes to the others in
proportion to their weights, until no source is above its cap. Each round of that needs two
sums over the free and the clamped sources, which Spark takes; only those sums come to the driver.

A source's rate is its target over its words. Every document is taken whole as often as the whole part of
the rate says. The words still missing come from a sample of whole documents: the source's documents in the order of
a hash of seed and id, until the target is met; only the document at the boundary gives a part of itself, from its text's
start. So a source comes within a word of its target, and reruns agree. No task orders a source: its words are summed per range
of the hash, the range that holds the boundary is found by a running sum over the ranges, and only documents in that range are ordered.

Defined results: null text has no words. A null source is a source of its own and comes last.
A null id is hashed as an empty one and comes last among equal hashes. Rows of a source that repeat id and size share one place
in the order; at the boundary each of them gives an equal part, rounded down. A source
without words has target 0, and so has every source of an empty corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadbook.llm.folders import stored

RANGE_BITS = 12  # of the hash; a source's words are summed per range
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last.

    Sources are dealt into ordered ranges; a running sum over one row per range carries the
    numbers, so no task orders more than its own range.
    """
    ordered = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "sources-by-range")
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ordered.join(starts, "part").select(
        "source", "source_size", (F.col("start") + F.row_number().over(inside) - 1).alias("number")
    )


def water_fill(sizes: DataFrame, weights: Sequence[int], share_percent: int, max_epochs: int) -> DataFrame:
    """Add ``target`` to (source, source_size): whole-number weights by source order, repeating.

    A free source gets (share · all words − clamped caps) · weight / free weights; numerator and
    denominator are whole numbers, so the one division is all that is rounded.
    """
    ranked = ranked_sources(sizes)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = stored(
        ranked.select(
            "source",
            "source_size",
            weight.alias("weight"),
            (F.col("source_size") * max_epochs).alias("cap"),
        ),
        "sources",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    wanted = share_percent * total  # in hundredths of a word
    # sources above this level, in hundredths of a word per unit of weight, are free; none is clamped at first
    rest, free = None, None
    clamped = F.lit(False)
    while True:
        sums = table.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("caps"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if (rest, free) == (wanted - 100 * sums["caps"], sums["free"]):
            break
        rest, free = wanted - 100 * sums["caps"], sums["free"]
        if free == 0:
            break
        # clamped when its share of what is left reaches its cap; the level only rises, so none is freed again
        wide = "decimal(38,0)"
        clamped = F.lit(rest).cast(wide) * F.col("weight").cast("decimal(18,0)") >= F.col("cap").cast("decimal(18,0)") * F.lit(
            100 * free
        ).cast(wide)
    share = F.lit(rest).cast("double") * F.col("weight").cast("double") / F.lit(100 * max(free, 1)).cast("double")
    return table.select(
        "source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def seeded(key: Column, seed: int) -> Column:
    """A whole number below 2^32 from id and seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def _sampled(measured: DataFrame, filled: DataFrame) -> DataFrame:
    """Per source its ``target``, ``whole`` repetitions and the range of hashes in which its sample ends, with the ``room`` left
    for documents of that range; every range below is taken, none above."""
    size, target = F.col("source_size").cast("double"), F.col("target")
    whole = F.when(F.col("source_size") > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("bigint")
    quotas = filled.withColumn("whole", whole).withColumn(
        "quota", F.floor(target - F.col("whole").cast("double") * size + F.lit(0.5)).cast("bigint")
    )
    ranges = measured.groupBy("source", F.shiftright("hash", 32 - RANGE_BITS).alias("range")).agg(F.sum("size").alias("words"))
    # at most 2^RANGE_BITS rows per source
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranges.withColumn("until", F.sum("words").over(so_far)).withColumnRenamed("source", "of")
    held = summed.join(quotas, F.col("of").eqNullSafe(F.col("source"))).where(F.col("until") <= F.col("quota"))
    below = held.groupBy(F.col("source").alias("of")).agg(F.max("range").alias("last"), F.max("until").alias("taken"))
    joined = quotas.join(below, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return joined.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        "whole",
        F.coalesce("last", F.lit(-1)).alias("last"),
        (F.col("quota") - F.coalesce("taken", F.lit(0))).alias("room"),
    )


def _boundary(measured: DataFrame, sampled: DataFrame) -> DataFrame:
    """What each document of a boundary range gives, once per place in the order."""
    inside = measured.join(sampled, F.col("source").eqNullSafe(F.col("of")))
    following = inside.where((F.col("range") > F.col("last")) & (F.col("room") > 0) & (F.col("size") > 0))
    first = following.groupBy("of").agg(F.min("range").alias("range"))
    near = following.drop("of").join(first.withColumnRenamed("range", "at"), F.col("source").eqNullSafe(F.col("of")))
    groups = near.where("range = at").groupBy("source", "hash", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("room").alias("room"))
    order = Window.partitionBy("source").orderBy("hash", F.col("id").asc_nulls_last(), "size")
    before = F.coalesce(F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.col("room") - before, F.lit(0))
    part = F.least(F.col("size"), F.floor(left / F.col("n")).cast("bigint"))
    return groups.select(
        F.col("source").alias("b_source"), F.col("hash").alias("b_hash"), F.col("id").alias("b_id"), F.col("size").alias("b_size"), part.alias("part")
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int],
    share_percent: int,
    max_epochs: int,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    whole_rows: bool = False,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken`` words, ``copies``
    whole repetitions and ``part_words``, the words of the partial one from the text's start.

    With ``whole_rows`` the document's own columns come first, followed by the others.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole_rows else []
    words = word_count(docs[text].cast("string"))
    facts = [docs[key].alias("id"), docs[source].cast("string").alias("source"), seeded(docs[key], seed).alias("hash"), words.alias("size")]
    measured = docs.select(*row, *facts)
    small = stored(docs.select(*facts).withColumn("range", F.shiftright("hash", 32 - RANGE_BITS)), "sizes")
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = water_fill(sizes, weights, share_percent, max_epochs)
    sampled = stored(_sampled(small, filled), "samples")
    boundary = stored(_boundary(small, sampled), "boundaries")
    planned = measured.withColumn("range", F.shiftright("hash", 32 - RANGE_BITS)).join(sampled, F.col("source").eqNullSafe(F.col("of")))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("source", "b_source"), ("hash", "b_hash"), ("id", "b_id"), ("size", "b_size"))]
    planned = planned.join(boundary, reduce(and_, same), "left")
    sampled_words = F.when(F.col("range") <= F.col("last"), F.col("size")).otherwise(F.coalesce("part", F.lit(0)))
    planned = planned.withColumn("taken", F.col("whole") * F.col("size") + sampled_words)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("bigint")
    own = [F.col("row")[c].alias(c) for c in docs.columns] if whole_rows else [F.col("id").alias(key)]
    out = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "taken": F.col("taken"),
        "copies": copies,
        "part_words": F.col("taken") - copies * F.col("size"),
    }
    taken_names = set(docs.columns) if whole_rows else {key}
    return planned.select(*own, *[c.alias(n if n not in taken_names else f"mix_{n}") for n, c in out.items()])


def mix(
    docs: DataFrame,
    weights: Sequence[int],
    share_percent: int,
    max_epochs: int,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mixed corpus: the documents' columns, one row per repetition and ``repetition`` from 1; documents that are not taken go.

    The partial repetition, which comes last, holds the first words of its text, joined by one space. Should the documents have a column
    of that name, the number is called ``mix_repetition``.
    """
    plan = mix_plan(docs, weights, share_percent, max_epochs, seed, key, text, source, whole_rows=True)
    name = {n: n if n not in docs.columns else f"mix_{n}" for n in ("copies", "part_words", "repetition")}
    copies, part = F.col(name["copies"]), F.col(name["part_words"])
    times = copies + (part > 0).cast("bigint")
    rows = plan.where(times > 0).withColumn(name["repetition"], F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})")), F.lit(1), part.cast("int")), " ")
    cut = F.when(F.col(name["repetition"]) > copies, first_words).otherwise(F.col(text)).alias(text)
    return rows.select(*[cut if c == text else F.col(c) for c in docs.columns], name["repetition"])
