from __future__ import annotations

import brute
import pytest
from conftest import tuples

from roadbook.llm import exact

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def same(df, docs):
    return tuples(exact.exact_groups(df), *COLUMNS) == sorted(brute.exact(docs), key=repr)


def test_given_table(given):
    assert same(*given("documents"))


@pytest.mark.parametrize("extra", [False, True])
def test_nulls_blanks_ties_and_long_texts(make_docs, extra):
    texts = ["a b", "ab", "a  b\t", None, "", " \n\x0b\x0c\r", "x" * 300_000, "x" * 300_000 + " ", "é é", "éé", "a b", None]
    df = make_docs(*texts, extra=extra)
    assert same(df, [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    left = exact.drop_exact(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 5, 7, 8, 10]


def test_null_and_extreme_ids(make_docs):
    rows = [(None, "a"), (7, "a"), (-(2**63), "b"), (2**63 - 1, "b"), (None, "c"), (0, "d"), (-1, "d")]
    assert same(make_docs(*rows), [{"doc_id": i, "text": t} for i, t in rows])
    assert exact.drop_exact(make_docs(*rows)).count() == 4


def test_one_of_repeated_rows_stays(make_docs):
    df = make_docs((1, "a b"), (1, "a b"), (1, "ab"), (1, "c"))
    found = exact.exact_groups(df).collect()
    assert sorted((r.group_size, r.kept) for r in found) == [(1, True), (3, False), (3, False), (3, True)]
    assert sorted(r.text for r in exact.drop_exact(df).collect()) == ["a b", "c"]


def test_empty(make_docs):
    df = make_docs((1, "a")).where("false")
    assert exact.exact_groups(df).count() == 0
    assert exact.drop_exact(df).count() == 0


def test_one_group_holds_a_third(make_docs):
    texts = [f"t {i}" for i in range(200)] + ["same text"] * 100
    assert same(make_docs(*texts), [{"doc_id": i, "text": t} for i, t in enumerate(texts)])


def test_no_python_in_the_plan(make_docs):
    plan = exact.exact_groups(make_docs("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
