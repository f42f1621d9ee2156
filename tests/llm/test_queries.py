from __future__ import annotations

import pytest

from roadbook.llm import queries

ENGLISH, GERMAN = "the and of to in is that for with was", "der die und das von mit den ist ein zu"


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    """Small tables with odd rows, as a folder of given tables."""
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, f"{ENGLISH if i % 2 else GERMAN} word{i} " * (1 + i % 9), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    rows += [(None, ENGLISH, "en", None), (None, None, None, "s1"), (41, "", "en", "s1"), (3, rows[3][1], "en", "s0")]
    make_docs(*rows, extra=True).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b1", ENGLISH + " word1"), (None, None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None, "<p>a</p>"), (None, "u", None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_every_query_takes_odd_tables(spark, folder, name):
    out = queries.queries()[name](spark, folder)
    rows = out.collect()
    assert rows
    if name not in ("op5_extract", "op11_audit", "op12_packing"):
        assert len(rows) == 44
    if "held_out" in out.columns:
        assert all(r.held_out is False for r in rows if r.doc_id is None) and all(r.held_out is not None for r in rows)
        assert any(r.held_out for r in rows)
