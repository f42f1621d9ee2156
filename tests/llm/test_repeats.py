from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import tuples

from roadbook.llm import bitmap, repeats

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def same(df, docs):
    return tuples(repeats.remove_repeats(df), *COLUMNS) == sorted(brute.repeats(docs), key=repr)


def test_given_table(given):
    assert same(*given("documents"))


@pytest.mark.parametrize("words", [2, 3, 12, 400])
def test_random_texts_with_shared_passages_and_runs(make_docs, words):
    """Small vocabularies make runs and periods, where symbols are hardest to keep alike."""
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(words)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(rng.choice([34, 35, 36, 60])) for _ in range(6)] + [["a"] * 50, ["a", "b"] * 30, ["a", "a", "b"] * 20]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += draw(rng.randrange(0, 40))
            if rng.random() < 0.5:
                parts += rng.choice(passages)
        texts.append(" ".join(parts))
    assert same(make_docs(*texts), [{"doc_id": i, "text": t} for i, t in enumerate(texts)])


@pytest.mark.parametrize("extra", [False, True])
def test_nulls_short_long_and_repeated_rows(make_docs, extra):
    base = " ".join(f"w{i}" for i in range(35))
    rows = [(1, base), (1, base), (2, None), (3, ""), (4, " \t "), (None, "x\n" + base), (5, "a b c"), (6, "z " * 50_000)]
    df = make_docs(*rows, extra=extra)
    assert same(df, [{"doc_id": i, "text": t} for i, t in rows])
    kept = repeats.remove_repeats(df, with_text=True)
    assert [r.kept for r in kept.where("doc_id IS NULL").collect()] == ["x"]


def test_empty(make_docs):
    assert repeats.remove_repeats(make_docs("a").where("false")).count() == 0


def test_too_short_windows_are_refused(make_docs):
    with pytest.raises(ValueError):
        repeats.remove_repeats(make_docs("a"), window=20)


def test_equal_stretches_get_equal_symbols_inside():
    rng = np.random.default_rng(5)
    edge = repeats._edge()
    for _ in range(200):
        inner = rng.integers(0, 4, 35).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sides = [rng.integers(0, 4, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (20, 20, 20, 20)]
        found = []
        for left, right in (sides[:2], sides[2:]):
            names, start, size = repeats.recompress(np.concatenate([left, inner, right]), np.zeros(75, np.int64))
            low, high = 20 + edge, 55 - edge
            inside = (start >= low) & (start + size <= high)
            found.append([(int(n), int(a), int(s)) for n, a, s in zip(names[inside], start[inside], size[inside])])
        assert found[0] == found[1] and found[0]


def blocks_of(texts):
    return [repeats._blocks(np.array([i]), np.array([i], np.int32), pa.array([t], pa.large_string()), 35) for i, t in enumerate(texts)]


def test_windows_that_share_part_of_their_hash_stay_apart(monkeypatch):
    real = repeats._window_hashes
    monkeypatch.setattr(repeats, "_window_hashes", lambda hashes, window: real(hashes, window) & np.uint64(0xFFFFFF))
    inner = [f"i{k}" for k in range(35)]
    texts = [" ".join([f"l{d}-{k}" for k in range(10)] + inner[:34] + [f"r{d}-{k}" for k in range(10)]) for d in range(2)]
    found = [repeats._repeated(pa.Table.from_batches(blocks_of(pair))).num_rows for pair in (texts, texts[:1] * 2)]
    assert found[0] == 0 and found[1] > 0


def test_a_key_needs_the_words_around_its_anchor():
    inner = [f"i{k}" for k in range(15)]
    texts = [" ".join([f"l{d}-{k}" for k in range(10)] + inner + [f"r{d}-{k}" for k in range(10)]) for d in range(2)]
    names = [set(b.column("name").to_pylist()) for b in blocks_of(texts)]
    assert not names[0] & names[1]


@pytest.mark.parametrize("least", [5, 1000])
def test_a_line_of_34_words_in_most_texts_is_dealt_out(make_docs, monkeypatch, least):
    monkeypatch.setattr(repeats, "HOT_LEAST", least)
    line = " ".join(f"s{k}" for k in range(34))
    texts = [f"{' '.join(f'a{i}-{k}' for k in range(12))} {line} {' '.join(f'b{i}-{k}' for k in range(12))}" for i in range(300)]
    texts += [texts[0], f"x {line} same", f"y {line} same"]
    assert same(make_docs(*texts), [{"doc_id": i, "text": t} for i, t in enumerate(texts)])


def test_hot_keys_spread_over_the_windows_hashes():
    line = " ".join(f"s{k}" for k in range(34))
    texts = pa.array([f"{' '.join(f'a{i}-{k}' for k in range(12))} {line} b{i}" for i in range(50)], pa.large_string())
    rows, checks = np.arange(50), np.arange(50, dtype=np.int32)
    plain = repeats._blocks(rows, checks, texts, 35)
    keys, counts = np.unique(plain.column("name").to_numpy().view(np.uint64), return_counts=True)
    hot = keys[counts > 40]
    assert len(hot)
    split = repeats._blocks(rows, checks, texts, 35, hot=hot)
    assert np.unique(split.column("name").to_numpy(), return_counts=True)[1].max() == 1
    assert sum(len(w.as_py()) for w in split.column("windows")) == sum(len(w.as_py()) for w in plain.column("windows"))


def test_filter_lets_all_its_keys_through(spark):
    keys = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    frame = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "key bigint")
    wide, narrow = (bitmap.filter_of(frame, "key", bits).value for bits in (20, 10))
    assert bitmap.passes(wide, keys).all() and bitmap.passes(narrow, keys).all()
    others = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000)
    assert bitmap.passes(wide, others).mean() < 0.02
    assert not bitmap.passes(bitmap.filter_of(frame.where("false"), "key", 12).value, keys).any()
