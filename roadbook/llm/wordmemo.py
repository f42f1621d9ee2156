"""Texts encoded word by word with a bounded memo, for tokenizers that cut at white space first.

A text is cut before a blank, tab or line break that follows a character which is white space by
no definition, and between a letter of an alphabet based on Latin and a mark of punctuation. Tokenizers whose pre-tokenizer starts a new piece there, and whose normaliser and
special strings do not reach across, give each cut piece the tokens it has inside the whole text;
pieces come back often, so a piece is encoded once and then looked up. The memo only saves time:
it is emptied when it reaches a bound in bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from roadbook.llm.words import coded

PLAIN = " \t\n\r"
# white space for some engine and perhaps not for another: no cut next to these
DOUBTFUL = (
    "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
)

_BEFORE_BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PLAIN + DOUBTFUL) + "] "
_DOUBT = re.compile(f"[{DOUBTFUL}]")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = ".,;:!?"

_PIECES = re.compile(f"[{PLAIN}]*[{LETTERS}]++(?![^{PLAIN}{MARKS}])|[{PLAIN}]*[^{PLAIN}]+|[{PLAIN}]+")
_CUT = re.compile(f"(?<=[^{PLAIN}{DOUBTFUL}])(?=[{PLAIN}])")

SLICE_CHARS = 1 << 20
MEMO_BYTES = 96 << 20


def slices(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at safe places; longer where there is none."""
    start = 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def word_pieces(text: str) -> list[str]:
    """The text cut at all safe places; the pieces put together are the text."""
    if _DOUBT.search(text):
        return [p for p in _CUT.split(text) if p]
    return _PIECES.findall(text)


def cuts_at_blanks(parts: dict) -> bool:
    """Whether a tokenizer, by its description, starts a new piece at every place where ``word_pieces`` cuts.

    So do byte-level ones with the usual pattern and no normaliser, and those that split words by a pattern which leaves white
    space out and normalise by steps that neither join nor reorder across a blank.
    """
    cutter = parts.get("pre_tokenizer") or {}
    for token in parts.get("added_tokens", []):
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word") or set(token["content"]) & set(PLAIN + DOUBTFUL + MARKS):
            return False
    if cutter.get("type") == "ByteLevel":
        return cutter["use_regex"] and not cutter["add_prefix_space"] and parts.get("normalizer") is None
    steps = cutter.get("pretokenizers", [])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return False
    leaves_out = steps[0]["invert"] and steps[0]["behavior"] == "Removed" and steps[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    normaliser = parts.get("normalizer") or {"normalizers": []}
    harmless = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
        for n in normaliser.get("normalizers", [normaliser])
    )
    return leaves_out and harmless


def blank_runs(texts: pa.Array) -> np.ndarray:
    """Which texts have a blank after other white space; all others can be cut at each blank."""
    return pc.match_substring_regex(texts, _BEFORE_BLANK).to_numpy(zero_copy_only=False)


def words_at_blanks(texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
    """Texts without ``blank_runs`` cut at each blank: the batch's distinct words, the first word of each text, for each
    word in order which of all these it is, and the words' offsets by text.

    A word stands for itself with the blank before it, but the first of a text has none.
    """
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    codes, distinct = coded(lists.values)
    first = np.flatnonzero(np.diff(offsets))
    heads = lists.values.take(pa.array(offsets[first])).to_pylist()
    codes = codes.copy()
    codes[offsets[first]] = len(distinct) + np.arange(len(first))
    return distinct, heads, codes, offsets


def at_blanks(texts: pa.Array, known: Memo, encode: Callable[[list[str]], Iterable]) -> tuple[list, np.ndarray, np.ndarray]:
    """As ``words_at_blanks``, with the values of the words instead of the words."""
    distinct, heads, codes, offsets = words_at_blanks(texts)
    return known.values([[f" {w}" for w in distinct.to_pylist()] + heads], encode)[0], codes, offsets


class Memo(dict):
    """What an encoder gives for pieces of text; emptied when it reaches a bound in bytes."""

    def __init__(self, cost: Callable[[object], int], most: int = MEMO_BYTES):
        super().__init__()
        self.cost, self.most, self.held = cost, most, 0

    def keep(self, piece: str, value: object) -> None:
        if self.held > self.most:
            self.clear()
            self.held = 0
        self.held += 4 * len(piece) + self.cost(value) + 160
        self[piece] = value

    def values(self, texts: list[list[str]], encode: Callable[[list[str]], Iterable]) -> list[list]:
        """The values of each text's pieces in order; new pieces of all texts are given to ``encode`` together."""
        found = [list(map(self.get, pieces)) for pieces in texts]
        new = {p for pieces, values in zip(texts, found) if None in values for p, v in zip(pieces, values) if v is None}
        if not new:
            return found
        new = list(new)
        fresh = dict(zip(new, encode(new)))
        for pieces, values in zip(texts, found):
            if None in values:
                values[:] = [fresh[p] if v is None else v for p, v in zip(pieces, values)]
        for piece, value in fresh.items():
            self.keep(piece, value)
        return found
