from __future__ import annotations

import pathlib

import brute
import numpy as np
import pytest

from roadbook.llm import kneser_ney, queries


def test_against_the_plain_model(spark, given):
    df, docs = given("documents")
    trained = lambda d: brute.fold(d["doc_id"], 7) != 2
    base = brute.base_scores(docs, trained)
    plain = brute.kneser_ney([d["text"] for d in docs if trained(d)])
    text = {d["doc_id"]: d["text"] for d in docs}
    found = queries.op7_kneser_ney(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        n, known, total, score = base[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score == pytest.approx(plain(text[r.doc_id]), rel=1e-6)
        assert r.held_out == (not trained({"doc_id": r.doc_id}))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_plain_model_sums_to_one():
    plain = brute.kneser_ney(["a b a c", "a b b d", "c c a", "e"])
    for before in ("<begin>", "a", "b", "c", "e", "<unseen>"):
        assert sum(plain.p(before, w) for w in plain.words) == pytest.approx(1.0)


@pytest.mark.parametrize("extra", [False, True])
def test_edges(make_docs, extra):
    texts = ["a b a c", "A B\tb d", None, "", "c c a", "c c a", "long " * 100_000, "é"]
    df = make_docs(*texts, extra=extra)
    plain = brute.kneser_ney(texts)
    model = kneser_ney.train(df)
    new = make_docs(*texts, "never seen words", "a", extra=extra)
    for r in kneser_ney.score(new, model).collect():
        text = [*texts, "never seen words", "a"][r.doc_id]
        if text and "never" in text:
            assert r.n_known == 1
        assert r.n_tokens == len((text or "").split()) + 1
        assert r.score == pytest.approx(plain(text), rel=1e-6)


def test_without_training_texts_and_empty(make_docs):
    none = make_docs("a").where("false")
    model = kneser_ney.train(none)
    row = kneser_ney.score(make_docs("a b"), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)
    assert kneser_ney.score(none, kneser_ney.train(make_docs("a b"))).count() == 0


def test_a_pair_seen_once_counts(make_docs):
    texts = ["a b", "a c", "a c", "b c", "b c", "d e", "d e"]
    model = kneser_ney.train(make_docs(*texts))
    seen, new = kneser_ney.score(make_docs("a b", "d b"), model).orderBy("doc_id").collect()
    plain = brute.kneser_ney(texts)
    assert seen.score == pytest.approx(plain("a b")) and new.score == pytest.approx(plain("d b"))
    assert model.discounts[0] < 1 and plain.p("a", "b") > plain.p("d", "b")


def test_a_context_before_most_tokens_is_dealt_by_its_next_word(make_docs, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PART_TOKENS", 100)
    texts = [" ".join(f"the w{(7 * i + j) % 90}" for j in range(40)) for i in range(30)]
    df = make_docs(*texts)
    model = kneser_ney.train(df, shards=2)
    assert model.parts >= 20
    folder = pathlib.Path(model.folder)
    assert max(len(np.load(f)) for f in folder.glob("pair-*.npy")) < 60  # of 180 pairs, 90 after "the"
    plain = brute.kneser_ney(texts)
    for r in kneser_ney.score(df, model).collect():
        assert r.score == pytest.approx(plain(texts[r.doc_id]), rel=1e-6)


def test_blocks_come_back_whole():
    rng = np.random.default_rng(1)
    part = np.sort(rng.integers(0, 150, 4000))
    first = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    columns = [first[np.lexsort((first, part))], rng.integers(0, 300, 4000), rng.integers(0, 1 << 40, 4000)]
    found = list(kneser_ney._by_part(kneser_ney._blocks(part, columns, 5)))
    assert [f[0] for f in found] == np.unique(part).tolist() and sum(f[2] for f in found) == 5
    for i in range(3):
        assert np.concatenate([f[1][i] for f in found]).tolist() == columns[i].tolist()
    assert list(kneser_ney._by_part(iter(()))) == []


def test_shards_do_not_matter(make_docs):
    df = make_docs(*[f"w{i % 7} w{i % 3} w{i % 5} the end" for i in range(60)])
    found = [
        sorted((r.doc_id, round(r.score, 9)) for r in kneser_ney.score(df, kneser_ney.train(df, shards=n)).collect()) for n in (1, 2, 16)
    ]
    assert found[0] == found[1] == found[2]


def test_pairs_are_summed_alike_for_any_number_of_words():
    rng = np.random.default_rng(3)
    v, w, n = rng.integers(0, 9, (3, 500))
    small, large = (kneser_ney._summed(v, w, n, k) for k in (9, 1 << 40))
    assert all((a == b).all() for a, b in zip(small, large))
    assert small[2].sum() == n.sum() and len(small[0]) == len({*zip(v.tolist(), w.tolist())})


def test_folder_must_be_mounted():
    assert kneser_ney.mounted("file:///a/b") == kneser_ney.mounted("file:/a/b") == kneser_ney.mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        kneser_ney.mounted("hdfs://host/a")
