from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from test_mixing import brute_plan

from roadbook.llm import langid
from roadbook.llm.folders import stored
from roadbook.llm.queries import language_dictionaries

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark, given):
    docs, rows = given("documents", SF)
    _, items = given("benchmark", SF)
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        before, rows = rows, [r.asDict() for r in docs.collect()]
        kept[name] = (before, rows)
        if name != "mix":
            assert docs.columns == COLUMNS
    assert list(stages) == ["language", "exact copies", "near copies", "benchmark", "mix"]

    encoders = langid.Encoders(language_dictionaries(given("documents", SF)[0]))
    ids = {n: ({r["doc_id"] for r in a}, {r["doc_id"] for r in b}) for n, (a, b) in kept.items()}
    want = set()
    for r in kept["language"][0]:
        code, _, margin = encoders.classify(r["text"])
        if code != "und" and margin >= langid.MIN_MARGIN:
            want.add(r["doc_id"])
    assert ids["language"][1] == want and len(want) > 0.99 * len(ids["language"][0])
    assert ids["exact copies"][1] == {d[0] for d in brute.exact(kept["exact copies"][0]) if d[3]}
    assert ids["near copies"][1] == {d[0] for d in brute.near(kept["near copies"][0]) if d[3]}
    assert ids["benchmark"][1] == {d[0] for d in brute.contamination(kept["benchmark"][0], items) if not d[5]}
    before, after = kept["mix"]
    taken = {}
    for r in after:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    assert taken == {key: n for key, _, n in brute_plan(before) if n}
    total = sum(len((r["text"] or "").split()) for r in before)
    assert abs(sum(taken.values()) - 1.5 * total) < 0.01 * total and len(taken) < len(before)
    key = lambda r: (r["doc_id"], r["repetition"], r["text"])
    assert sorted(map(key, after)) == sorted(key(r.asDict()) for r in corpus_pipeline.run(spark, SF).collect())


@pytest.mark.parametrize("extra", [False, True])
def test_stages_keep_columns_and_stand_odd_rows(spark, make_docs, extra):
    english, german = "the and of to in is that for with was", "der die und das von mit den ist ein zu"
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "the and of " * 40_000, "en", "a"), (None, german, "de", "b")]
    rows += [(4, english, "en", "a")] * 2 + [(5, english + " more", "en", "c"), (6, "Der " + german, "de", None), (7, "!!!", None, "a")]
    docs = make_docs(*rows, extra=extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.schema.fields[0].dataType == docs.schema.fields[0].dataType
        assert stage(spark, docs.where("false"), SF).count() == 0
        docs = stored(out, "stage")
        assert docs.count() >= 1
