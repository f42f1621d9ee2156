from __future__ import annotations

import random

import brute
import pytest
from conftest import tuples
from pyspark.sql import functions as F

from roadbook.llm import decontaminate, queries


def found(df, items, **settings):
    hits = decontaminate.find_hits(df, items, **settings)
    return tuples(
        hits.select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items"),
            F.sha2(F.array_join("items", ","), 256),
            F.col("n_hit") > 0,
        ),
        "*",
    )


def test_given_tables(given, spark):
    (df, docs), (items, rows) = given("documents"), given("benchmark")
    want = sorted(brute.contamination(docs, rows), key=repr)
    assert found(df, items) == want
    assert found(df, items, block_chars=1500) == want  # several automata, one after the other
    assert tuples(queries.op6_decontaminate(spark, "/root/testdata/sf0.001"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = {r[0] for r in want if not r[-1]}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, items).collect()} == clean
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, items, block_chars=1500).collect()} == clean


ITEMS = "item_id bigint, text string"


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, make_docs, extra):
    rng = random.Random(2)
    words = [rng.choice(["ab", "c", "É7", "x", "Ye"]) for _ in range(400)]
    items = [(1, "one"), (2, "C, x"), (3, None), (4, " !? "), (None, "ab ab ab"), (5, " ".join(words[50:75])), (5, "É7-x"), (6, "One")]
    texts = [None, "", "?!", " ".join(words), "oNE", "bone ones", "one" * 50_000, "A B-C:x;É7x", " one ", "ab, AB ab", "ab, AB ab"]
    df = make_docs(*texts, extra=extra)
    bench = spark.createDataFrame(items, ITEMS)
    want = brute.contamination([{"doc_id": i, "text": t} for i, t in enumerate(texts)], [{"item_id": i, "text": t} for i, t in items])
    assert found(df, bench) == sorted(want, key=repr)
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[-1])


def test_spans_point_into_the_original(spark, make_docs):
    bench = spark.createDataFrame([(1, "red fox jumps")], ITEMS)
    text = "  The RED x; Red -- fox...Jumps high. red fox jumps"
    row = decontaminate.find_hits(make_docs(text), bench).first()
    assert [text[s.start : s.end] for s in row.spans] == ["Red -- fox...Jumps", "red fox jumps"]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    assert [tuple(r)[:3] for r in decontaminate.find_hits(make_docs("a b"), none).collect()] == [(0, 2, 0)]
    assert decontaminate.drop_contaminated(make_docs("a b"), none).count() == 1
    assert decontaminate.find_hits(make_docs("a").where("false"), none).count() == 0
