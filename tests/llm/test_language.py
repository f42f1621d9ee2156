from __future__ import annotations

import pytest
import zstandard

from roadbook.llm import langid, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def dictionaries(spark):
    return queries.language_dictionaries(queries.table(spark, SF, "documents"))


def test_held_out_accuracy(spark, dictionaries):
    docs = queries.table(spark, SF, "documents").where(queries.fold("doc_id", 4) == 2)
    found = langid.classify(docs, dictionaries).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 100
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97
    assert sum(r.rejected for r in found) / len(found) < 0.01


@pytest.mark.parametrize("extra", [False, True])
def test_edges(make_docs, dictionaries, extra):
    df = make_docs((1, None), (2, ""), (3, "123 !!! 456"), (4, "the and of " * 30_000), (4, "the and of " * 30_000), (None, "der die und das"), extra=extra)
    found = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in langid.classify(df, dictionaries).collect()), key=repr)
    assert found == sorted(
        [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (None, "de", False)], key=repr
    )
    assert all(0 <= r.score <= 1 for r in langid.classify(df, dictionaries).collect())
    kept = langid.keep_identified(df, dictionaries)
    assert kept.columns == df.columns and kept.count() == 3


def plain(text, dictionaries):
    """The code whose dictionary makes the text smallest, straight from the definition, and the margin."""
    cleaned = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()

    def size(body, content):
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = dict(write_checksum=False, write_content_size=False, write_dict_id=False)
        if len(cleaned) >= 32:
            return len(zstandard.ZstdCompressor(level=6, dict_data=raw, **options).compress(body))
        close = zstandard.ZstdCompressionParameters.from_level(19, dict_size=len(content), source_size=512, min_match=3, **options)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=close).compress(body))

    sizes = {}
    for code, content in dictionaries.items():
        if len(cleaned) < 160:
            lead = content[-256:] + b" "
            sizes[code] = max(1, size(lead + cleaned, content) - size(lead, content))
        else:
            sizes[code] = sum(size(cleaned[i : i + 8192], content) for i in range(0, len(cleaned), 8192))
    low, next_low = sorted(sizes.values())[:2]
    return min(sizes, key=lambda c: (sizes[c], c)), (next_low - low) / next_low


def test_against_plain_sizes(spark, dictionaries):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    found = langid.classify(docs, dictionaries).join(docs.select("doc_id", "text"), "doc_id").where("lang_pred <> 'und'").collect()
    assert len(found) > 150
    for r in found:
        code, margin = plain(r.text, dictionaries)
        assert (r.lang_pred, round(r.margin, 9), r.rejected) == (code, round(margin, 9), margin < langid.MIN_MARGIN)


def test_passages_come_from_anywhere_in_a_text(make_docs):
    body = " ".join(f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx")
    texts = [f"{'x' * (i + 1)} {body}" for i in range(20)]
    found = langid.train(make_docs(*[(i, t, "en", "s") for i, t in enumerate(texts)]), dictionary_bytes=2048)["en"]
    assert len({p for p in found.decode().split() if p[0] in "efgh"}) > 20


def test_training_edges(make_docs):
    df = make_docs((1, "alpha beta"), (2, None, "en", "s"), (3, "words", None, "s"), (4, "7 7", "de", "s"))
    assert langid.train(df) == {}  # a text without language, a language without text or letters
    one = langid.train(make_docs((1, "alpha beta", "en", "s"), (2, "alpha beta", "en", "s")))
    assert list(one) == ["en"]
    assert langid.classify(make_docs("gamma", None), one).where("lang_pred = 'en'").count() == 1
    assert langid.classify(make_docs("gamma"), {}).first().lang_pred == "und"
    assert langid.classify(make_docs("a").where("false"), one).count() == 0


def test_many_languages_share_the_bound(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "ALL_BYTES", 8 * 1024)
    df = make_docs(*[(i, f"word{chr(97 + i)} " * 2000 + "tail " * i, f"l{i}", "s") for i in range(16)])
    found = langid.train(df)
    assert len(found) == 16 and all(len(d) <= 1024 for d in found.values())
