"""A corpus pipeline: language, exact copies, near copies, benchmark passages, mix.

Each stage reads what its predecessor kept, from Parquet in the folder the cluster shares. An empty table gives an
empty result at every stage; texts of any length are handled whole; columns beyond those of documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadbook.llm import decontaminate, exact, langid, minhash, mixing
from roadbook.llm.folders import stored
from roadbook.llm.queries import MAX_EPOCHS, MIX_SEED, SHARE_PERCENT, WEIGHTS, language_dictionaries, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, empty and letterless texts go. Rows that repeat stay."""
    return langid.keep_identified(docs, language_dictionaries(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest original, then the smallest id; null counts as empty. Of rows
    that repeat id and text one stays."""
    return exact.drop_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, the smallest id; texts without words are similar to none."""
    return minhash.drop_near(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none. Rows that repeat stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per repetition of a document, the last one of a source cut to what its target leaves; documents
    that the sample leaves out go. Rows that repeat are documents of their own."""
    return mixing.mix(docs, WEIGHTS, SHARE_PERCENT, MAX_EPOCHS, MIX_SEED)


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
