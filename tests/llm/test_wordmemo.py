from __future__ import annotations

import json
import random

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from roadbook.llm import wordmemo

ODD = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", " ", "　", "﻿"]
BITS = ["word", "Word", "it's", "'ll", "'", "a", "É", "é", "́", "Σ", "σΣ", "ΑΣ", "İ", "9", "12", "½", ".", "...", "!?", "日本", "ß", "ﬁ", "ẛ̣",
        "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "🙂", "👩‍👩‍👧", "क्ष", "̣̇", "_", "|", "K", "Å", "a.", "é,", "×.", "ǀ!", "x:", "ſ;", "ŉ?", "<", "a<b"]


def odd_text(rng):
    return "".join(rng.choice(ODD if rng.random() < 0.45 else BITS) if rng.random() < 0.8 else " " for _ in range(rng.randrange(0, 40)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole(name):
    coder = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(11)
    for _ in range(6000):
        text = odd_text(rng)
        want = coder.encode(text, add_special_tokens=False).ids
        pieces = wordmemo.word_pieces(text)
        assert "".join(pieces) == text
        got = [i for p in pieces for i in coder.encode(p, add_special_tokens=False).ids]
        assert got == want, repr(text)


def test_which_tokenizers_cut_so():
    for name, want in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", True)):
        parts = json.loads(Tokenizer.from_file(public_tokenizers.path(name)).to_str())
        assert wordmemo.cuts_at_blanks(parts) == want
        assert not wordmemo.cuts_at_blanks(parts | {"pre_tokenizer": {"type": "Whitespace"}})
        assert not wordmemo.cuts_at_blanks(parts | {"normalizer": {"type": "Strip"}})
        assert not wordmemo.cuts_at_blanks(parts | {"added_tokens": [{"content": "a. b"}]})


def test_slices_put_together_are_the_text():
    rng = random.Random(3)
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(300):
        text = "".join(odd_text(rng) for _ in range(5))
        parts = list(wordmemo.slices(text, 20))
        assert "".join(parts) == text
        got = [i for part in parts for i in coder.encode(part, add_special_tokens=False).ids]
        assert got == coder.encode(text, add_special_tokens=False).ids
    assert list(wordmemo.slices("")) == [""]


def test_memo_encodes_each_piece_once_within_its_bound():
    seen = []

    def encode(pieces):
        seen.extend(pieces)
        return [len(p) for p in pieces]

    memo = wordmemo.Memo(lambda value: 8, most=2000)
    assert memo.values([["a", "bb", "a"], [], ["ccc", "a"]], encode) == [[1, 2, 1], [], [3, 1]]
    assert memo.values([["bb", "ccc"]], encode) == [[2, 3]]
    assert sorted(seen) == ["a", "bb", "ccc"]
    for i in range(100):
        assert memo.values([[f"x{i}", "a"]], encode) == [[len(f"x{i}"), 1]]
    assert len(memo) < 15
    wide = [f"y{i}" for i in range(300)]
    assert memo.values([wide, wide], encode) == [[len(p) for p in wide]] * 2
