from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (id, text) or (id, text, lang, source)."""

    def make(*rows, extra=False):
        full = []
        for i, row in enumerate(rows):
            key, text, lang, source = (*row, *(None, None, None))[:4] if isinstance(row, tuple) else (i, row, "en", "s")
            full.append((key, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use for themselves
            for name in ("id", "row", "norm", "kept", "keep_id", "score", "h", "sha", "size", "taken", "bands", "component", "n"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def given(spark):
    """A given table as a frame and as a list of dicts."""

    def read(name, sf="/root/testdata/sf0.001"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        return df, [r.asDict() for r in df.collect()]

    return read


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
