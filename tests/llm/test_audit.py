from __future__ import annotations

import re
from itertools import permutations

import pytest

from roadbook.llm import audit


def brute(docs, labels):
    """Every order applied document by document."""
    first, out = {}, {}
    for d in docs:
        text, i = d["text"] or "", d["doc_id"]
        if i is not None:
            first[text] = min(first.get(text, i), i)
    rows = []
    for d in docs:
        text, i = d["text"] or "", d["doc_id"]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": text in first and (i is None or i > first[text]),
        }
        mine = [x for x in labels if x["doc_id"] == i and i is not None]
        rows.append((d["source"] or "", fails, any(x["quality"] == 1 for x in mine), any(x["toxic"] == 1 for x in mine)))
    for part in {r[0] for r in rows}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                here = [r for r in left if r[1][letter]]
                gone = sum(r[1][letter] for r in rows if r[0] == part) - len(here)
                alone = sum(r[1][letter] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                left = [r for r in left if not r[1][letter]]
                total[letter] += len(here)
                out[part, order, step] = [len(left), len(here), gone, alone, sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    assert df.columns[:3] == ["part", "filter_order", "step"]
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_given_tables(given):
    docs, doc_rows = given("documents")
    labels, label_rows = given("labels")
    assert found(audit.audit(docs, labels)) == brute(doc_rows, label_rows)


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows(spark, make_docs, extra):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, "en", None),
        (2, "", "en", ""),
        (3, long, "en", "a"),
        (3, long, "en", "b"),
        (None, long, "en", "a"),
        (None, "only # here", "en", "a"),
        (4, long, "en", "a"),
        (5, "same " * 70, "en", "b"),
        (6, "ABC def", "en", "b"),
        (7, long + " &", "en", "é"),
        (8, "x y " * 60_000, "en", "é"),
        (8, "x y " * 60_000, "en", "é"),
        (9, "a b", "en", "b"),
    ]
    docs = make_docs(*rows, extra=extra)
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (6, None, 1), (99, 1, 1), (9, 1, 0), (9, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if extra:
        frame = frame.selectExpr("*", "'x' AS part", "'x' AS mask", "'x' AS good", "'x' AS n", "'x' AS id")
    want = brute(
        [{"doc_id": i, "text": t, "source": s} for i, t, _, s in rows],
        [{"doc_id": i, "quality": q, "toxic": x} for i, q, x in labels],
    )
    assert found(audit.audit(docs, frame)) == want


def test_no_documents_and_no_labels(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(make_docs("a").where("false"), labels).count() == 0
    rows = audit.audit(make_docs("a"), labels).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def test_many_parts_pass_the_recursion_limit(spark):
    spark.conf.set(audit._ROW_LIMIT, "500")
    try:
        cells = spark.range(40).selectExpr("cast(id AS string) AS part", "1 AS mask", "id AS n", "0L AS good", "0L AS toxic")
        steps = audit.prefix_steps(cells)
        assert steps.count() == 40 * 325
        assert spark.conf.get(audit._ROW_LIMIT) == "500"
    finally:
        spark.conf.unset(audit._ROW_LIMIT)


def test_one_text_in_most_rows_meets_by_id(spark, make_docs):
    docs = make_docs(*[(i, "the same text", "en", "s") for i in range(3000)], (3000, "another", "en", "s"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: r["n"] for r in audit.mask_cells(docs, labels).collect()}
    assert cells == {1: 2, 17: 2999}
