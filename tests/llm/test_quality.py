from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from roadbook.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = queries.table(spark, SF, "labels")
    scored = queries.op1_quality(spark, SF)
    assert scored.count() == queries.table(spark, SF, "documents").count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_linear_time_form_equals_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x = rng.permutation(50)[:9], rng.normal(size=9)
    pairs = sum(
        machine.factors[ids[i]] @ machine.factors[ids[j]] * x[i] * x[j] for i in range(9) for j in range(i + 1, 9)
    )
    want = 0.3 + machine.linear[ids] @ x + pairs
    assert machine.margins(np.array([0, 9]), ids, x)[0] == pytest.approx(want)


def test_an_interaction_is_learned():
    """Label 1 where exactly one of two features is set, which no linear score can tell."""
    rng = np.random.default_rng(4)
    bounds, ids, labels = [0], [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        own = [0 + a, 2 + b]
        ids += own
        bounds.append(len(ids))
        labels.append(float(a != b))
    bounds, ids, labels = np.array(bounds), np.array(ids), np.array(labels)
    machine = quality.fit(bounds, ids, np.ones(len(ids)), labels, buckets=4, epochs=30)
    assert np.mean((machine.scores(bounds, ids, np.ones(len(ids))) > 0.5) == labels) > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = pa.array(["a b", "", "Und Und Und", "x " * 40_000, "é!!! $$$ | |"], pa.large_string())
    bounds, ids, values = quality.features(texts, 1 << 12)
    for i in range(len(texts)):
        b, one, x = quality.features(texts.slice(i, 1), 1 << 12)
        assert sorted(zip(one, x.round(9))) == sorted(zip(ids[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]].round(9)))


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, make_docs, extra):
    df = make_docs((1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "x"), (4, "BAD!! " * 60_000), extra=extra)
    labels = "doc_id bigint, quality int, toxic int"
    for rows in ([], [(3, 1, 0)], [(None, 1, 0), (9, 0, 0), (3, None, 0)], [(3, 1, 0), (4, 0, 0), (4, 0, 0)]):
        machine = quality.train(df, spark.createDataFrame(rows, labels))
        found = quality.score(df, machine).collect()
        assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id == 3}) == 1
    assert quality.score(df.where("false"), machine).count() == 0
    one_kind = quality.train(df, spark.createDataFrame([(3, 1, 0)], labels))
    assert len({round(r.score, 12) for r in quality.score(df, one_kind).collect()}) == 1
