from __future__ import annotations

import random

import public_tokenizers
import pytest

from roadbook.llm import queries, tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    def count(name, text):
        if name not in loaded:
            loaded[name] = Tokenizer.from_file(public_tokenizers.path(name))
        return len(loaded[name].encode(text, add_special_tokens=False).ids)

    loaded = {}
    return count


def test_given_table(spark, given, plain):
    _, docs = given("documents")
    want = {d["doc_id"]: plain(FILES[0], d["text"]) for d in docs}
    for r in queries.op9_tokens(spark, "/root/testdata/sf0.001").collect():
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 2048)


def samples():
    rng = random.Random(8)
    kinds = [
        lambda: "".join(rng.choice("abcé ßÀ́\n\t  .,'0123s<|>") for _ in range(3000)),
        lambda: " ".join(rng.choice(["don't", "<|endoftext|>", "x" * rng.randrange(1, 40), "ΣΑΣ", "é", "́", "12345", "!!!", "日本語"]) for _ in range(500)),
        lambda: "a" * 3000,  # no place to cut
        lambda: "z" * 900 + " end " * 300,
        lambda: "   \n\n  " * 500,
        lambda: "word next " * 300,
    ]
    return [k() for k in kinds for _ in range(3)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk, overlap", [(200, 20), (64, 8), (997, 100)])
def test_spliced_counts_equal_whole_ones(plain, name, chunk, overlap):
    counter = tokens.Counter(name, chunk, overlap)
    for text in samples():
        assert counter.counts([text]) == [plain(name, text)]


def test_huge_documents_are_cut(plain, monkeypatch):
    counter, seen = tokens.Counter(FILES[0]), []
    encoded = counter.encoded
    monkeypatch.setattr(counter, "encoded", lambda text, a, b: seen.append(b - a) or encoded(text, a, b))
    text = "the quick brown fox. " * 20_000
    assert counter.counts([text]) == [plain(FILES[0], text)]
    assert len(seen) > 5 and max(seen) <= tokens.CHUNK_CHARS


def test_sentencepiece_models():
    import sentencepiece

    name = "piece_bpe_32k.model"
    whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    texts = ["", "hello world", "x y " * 50_000]
    assert tokens.Counter(name).counts(texts) == [len(whole.encode(t)) for t in texts]


@pytest.mark.parametrize("extra", [False, True])
def test_edges(make_docs, plain, extra):
    rows = [(1, None), (2, ""), (3, " "), (4, "é"), (4, "é"), (None, "a b")]
    df = make_docs(*rows, extra=extra)
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, FILES[0]).collect()), key=repr)
    assert found == sorted([(k, len((t or "").encode()), plain(FILES[0], t or "")) for k, t in rows], key=repr)
    assert tokens.count_tokens(df.where("false"), FILES[0]).count() == 0
