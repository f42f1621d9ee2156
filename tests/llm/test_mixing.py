from __future__ import annotations

import hashlib
import math
from collections import Counter
from fractions import Fraction

import pytest

from roadbook.llm import mixing, queries


def brute_targets(sizes, weights=(5, 2, 1), share=150, epochs=2):
    """Clamp and share again until none is above its cap, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(share * sum(sizes.values()), 100)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= epochs * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            free.remove(s)
        left = Fraction(share * sum(sizes.values()), 100) - sum(target.values())
    return target


def check(plan, docs, share=150):
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len((d["text"] or "").split())
    want = brute_targets(sizes, share=share)
    rows = plan.collect()
    assert len(rows) == len(docs)
    taken, count = {}, {}
    source = {d["doc_id"]: d["source"] for d in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size + r.part_words and 0 <= r.part_words < max(r.size, 1)
        taken[s], count[s] = taken.get(s, 0) + r.taken, count.get(s, 0) + 1
    alike = Counter((source[d["doc_id"]], d["doc_id"], len((d["text"] or "").split())) for d in docs)
    cut = Counter((source[r.doc_id], r.doc_id, r.size) for r in rows if r.part_words)
    for s in sizes:
        repeats = max([n for (of, _, _), n in alike.items() if of == s])
        assert abs(taken[s] - want[s]) <= 0.5 + repeats
        # one place in the order at most gives a part, all others are whole
        assert len([k for k in cut if k[0] == s]) <= 1
    return rows


def brute_plan(docs, share=150, seed=7):
    """Documents in seeded order until the target is met, source by source."""
    size = {i: len((d["text"] or "").split()) for i, d in enumerate(docs)}
    sizes = {}
    for i, d in enumerate(docs):
        sizes[d["source"]] = sizes.get(d["source"], 0) + size[i]
    want, out = brute_targets(sizes, share=share), []
    for s, target in want.items():
        own = [i for i, d in enumerate(docs) if d["source"] == s]
        whole = target // sizes[s] if sizes[s] else 0
        room = math.floor(float(target) - float(whole * sizes[s]) + 0.5)
        places = {}
        for i in own:
            key = docs[i]["doc_id"]
            digest = hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
            places.setdefault((int(digest[:8], 16), key is None, key or 0, size[i]), []).append(i)
        for place in sorted(places):
            members = places[place]
            part = min(place[-1], room // len(members))
            room -= min(room, place[-1] * len(members))
            out += [(docs[i]["doc_id"], size[i], int(whole) * size[i] + part) for i in members]
    return sorted(out, key=repr)


def test_given_table(given):
    df, docs = given("documents")
    plan = lambda seed=7: mixing.mix_plan(df, (5, 2, 1), 150, 2, seed)
    rows = check(plan(), docs)
    key = lambda found: sorted((r.doc_id, r.taken) for r in found)
    assert sorted(((r.doc_id, r.size, r.taken) for r in rows), key=repr) == brute_plan(docs)
    assert key(rows) == key(plan().collect())
    assert key(rows) != key(plan(8).collect())


@pytest.mark.parametrize("share", [10, 100, 150, 199])
def test_clamping_in_rounds(make_docs, share):
    docs = [{"doc_id": i, "text": "w " * n, "source": s} for i, (n, s) in enumerate([(3, "a"), (40, "b"), (400, "c"), (9, "d"), (4000, "é"), (70, "z"), (800, None)])]
    df = make_docs(*[(d["doc_id"], d["text"], "en", d["source"]) for d in docs])
    check(mixing.mix_plan(df, (5, 2, 1), share, 2), docs, share)


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_the_sample_does_not_depend_on_the_ranges(make_docs, monkeypatch, bits):
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    docs = [{"doc_id": i // 2 if i < 20 else i, "text": "w " * (i % 9), "source": "abc"[i % 3 % 2]} for i in range(90)]
    docs += [{"doc_id": None, "text": "n n n", "source": "a"}] * 30
    rows = mixing.mix_plan(make_docs(*[(d["doc_id"], d["text"], "en", d["source"]) for d in docs]), (5, 2, 1), 70, 2).collect()
    assert sorted(((r.doc_id, r.size, r.taken) for r in rows), key=repr) == brute_plan(docs, 70)


@pytest.mark.parametrize("extra", [False, True])
def test_the_mix_holds_what_the_plan_says(make_docs, extra):
    texts = [f"d{i}\t" + " ".join(f"w{k}" for k in range(i % 11)) for i in range(60)] + [None, ""]
    df = make_docs(*[(i, t, "en", "ab"[i % 5 == 0]) for i, t in enumerate(texts)], extra=extra)
    if extra:
        df = df.selectExpr("*", "7 AS repetition", "'x' AS copies", "'x' AS taken_words")
    plan = {r.doc_id: r for r in mixing.mix_plan(df, (5, 2, 1), 60, 2).collect()}
    mixed = mixing.mix(df, (5, 2, 1), 60, 2)
    assert mixed.columns == [*df.columns, "mix_repetition" if extra else "repetition"]
    got = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append((r[-1], r.text))
    for key, row in plan.items():
        want = [(n + 1, texts[key]) for n in range(row["copies"])] if not extra else None
        if want is not None:
            if row.part_words:
                want.append((row["copies"] + 1, " ".join(texts[key].split()[: row.part_words])))
            assert sorted(got.get(key, [])) == want
        assert sum(len((t or "").split()) for _, t in got.get(key, [])) == row.taken
    assert any(r.taken == 0 for r in plan.values())


@pytest.mark.parametrize("extra", [False, True])
def test_edges(make_docs, extra):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (None, "z", "en", "b"), (4, "q " * 100_000, "en", "c")]
    df = make_docs(*rows, extra=extra)
    docs = [{"doc_id": k, "text": t, "source": s} for k, t, _, s in rows]
    check(mixing.mix_plan(df, (5, 2, 1), 150, 2), docs)
    whole = mixing.mix_plan(df, (5, 2, 1), 150, 2, whole_rows=True)
    assert whole.columns[: len(df.columns)] == df.columns and whole.count() == 6
    assert len(set(whole.columns)) == len(whole.columns)


def test_empty_and_wordless(make_docs):
    none = make_docs("a").where("false")
    assert mixing.mix_plan(none, (5, 2, 1), 150, 2).count() == 0
    rows = mixing.mix_plan(make_docs(None, "", " "), (5, 2, 1), 150, 2).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 3


def test_words_are_counted_by_the_six_blanks(make_docs):
    df = make_docs("a\x0bb\x0cc\rd\te\nf g", "a b\x1cc", "  ")
    assert [r.n for r in df.select(mixing.word_count(df.text).alias("n")).collect()] == [7, 1, 0]


def test_sql_counterpart(spark):
    assert set(queries.oracle_sql()) <= set(queries.queries())
