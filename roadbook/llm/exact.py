"""Exact duplicates, with DataFrame functions only.

Two texts are equal when they are identical after deleting every ASCII white-space character.
Texts are grouped by a 128-bit hash together with the normalised text itself: the hash deals
rows out and finds groups, and the grouping compares the bytes, so texts whose hashes collide
stay apart. Each task first folds its own copies into one row, so a group that holds a third
of all rows sends one row per task. Rows then learn their group by hash and SHA-256, a short
stand-in for the text; two different texts under one stand-in would stop the job.

Defined results: a null text counts as empty, and all empty texts are one group. The row with
the most code points in the original text stays, then the smallest id; a null id comes after
all others. Of rows that repeat both id and text exactly one stays. An empty table gives an
empty result. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the white space that is ignored, space and U+0009 to U+000D
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_ID_SPAN = "20000000000000000000"
_MAX_ID = "9223372036854775807"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _rank(text: Column, key: Column) -> Column:
    """One number that is larger for longer texts, then for smaller ids; exact for every 64-bit id."""
    points = F.length(F.coalesce(text, F.lit(""))).cast("decimal(12,0)")
    after = F.coalesce(F.lit(_MAX_ID).cast("decimal(20,0)") - key.cast("decimal(20,0)") + 1, F.lit(0)).cast("decimal(20,0)")
    return (points * F.lit(_ID_SPAN).cast("decimal(20,0)") + after).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    after = rank % F.lit(_ID_SPAN).cast("decimal(38,0)")
    return F.when(after > 0, (F.lit(_MAX_ID).cast("decimal(38,0)") - after + 1).cast("bigint"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    hashed = rows.select("id", "text", normalised(F.col("text")).alias("norm"))
    groups = (
        hashed.select(F.unhex(F.md5("norm")).alias("h"), "norm", _rank(F.col("text"), F.col("id")).alias("rank"))
        .groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("rank"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", _id_of(F.col("rank")).alias("keep_id"))
    )
    # a stand-in must mean one text
    single = groups.groupBy("h", "sha").agg(
        F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("texts")
    )
    # joined by the two hashes as one value, so that both sides are dealt anew and Spark can split a heavy group
    stand_in = F.concat("h", "sha")
    single = single.select(
        stand_in.alias("text_key"),
        F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("bigint"))
        .alias("group_size"),
        "keep_id",
    )
    members = hashed.select("id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    joined = members.select("id", stand_in.alias("text_key"), "sha").join(single, "text_key")
    same_row = Window.partitionBy("id", "sha").orderBy("group_size")
    first = F.row_number().over(same_row) == 1
    return joined.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""

    def row_key(identity: Column, digest: Column) -> Column:
        return F.concat(F.coalesce(identity.cast("bigint").cast("string"), F.lit("")), F.lit(":"), digest).alias("row_key")

    kept = exact_groups(docs, key, text).where("kept").select(row_key(F.col(key), F.col("text_sha256")))
    tagged = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        row_key(docs[key], F.sha2(normalised(docs[text].cast("string")), 256)),
        F.length(F.coalesce(docs[text], F.lit(""))).alias("points"),
    )
    # of rows that repeat id and text the longest original stays; the window finds the rows dealt by the join
    best = Window.partitionBy("row_key").orderBy(F.desc("points"))
    here = tagged.join(kept, "row_key", "left_semi")
    return here.withColumn("n", F.row_number().over(best)).where("n = 1").select("row.*")
