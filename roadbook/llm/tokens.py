"""Token counts as a public tokenizer gives them, for documents of any length.

Ordinary documents are cut into words with the blanks before them, where the tokenizer is known to cut at
white space itself, and a bounded memo of words saves encoding them again (``llm/wordmemo.py``); with
any other tokenizer they are encoded whole. A huge document is encoded in overlapping chunks with offsets.
Where two chunks overlap they are spliced at a stable common boundary: a place next to white space
at which both encodings begin a token and around which their tokens agree. These tokenizers
cut at white space before they merge, and neither their normalisation nor a special string reaches
across it, so what stands left of such a place has no influence on what stands right of it. If an
overlap holds no such place, it is widened, at worst to the rest of the document.

Special strings inside a text are handled as the library does by default; none is added.

Defined results: null counts as an empty text, which has no tokens. Rows that repeat get equal
results, an empty table an empty one, other columns are not read. sentencepiece models add a blank
at the start of what they encode, so their documents are encoded whole at any length.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from roadbook.llm.wordmemo import Memo, at_blanks, blank_runs, cuts_at_blanks, word_pieces

CHUNK_CHARS = 60_000
OVERLAP_CHARS = 600
AGREE = 4  # tokens on either side that must be equal


class Counter:
    """Counts of one tokenizer file, found by name among the installed public ones or by path."""

    def __init__(self, name: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import public_tokenizers

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.pieces = self.coder = self.memo = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.coder = Tokenizer.from_file(path)
            self.coder.no_truncation()
            self.coder.no_padding()
            probe = self.coder.encode("a b", add_special_tokens=False).offsets
            self.blank_leads = any(start == 1 for start, _ in probe)
            if cuts_at_blanks(json.loads(self.coder.to_str())):
                self.memo, self.words = Memo(lambda count: 0), Memo(lambda count: 0)

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        short = [i for i, t in enumerate(texts) if len(t) <= 2 * self.chunk]
        out = [0] * len(texts)
        if self.memo is not None:
            for i, count in zip(short, self.memo_counts([texts[i] for i in short])):
                out[i] = count
        else:
            for i, count in zip(short, self.encoded_lengths([texts[i] for i in short])):
                out[i] = count
        for i, text in enumerate(texts):
            if len(text) > 2 * self.chunk:
                out[i] = self.spliced(text)
        return out

    def memo_counts(self, texts: list[str]) -> list[int]:
        array = pa.array(texts, pa.large_string())
        careful = blank_runs(array)
        values, codes, offsets = at_blanks(array.filter(pa.array(~careful)), self.words, self.word_counts)
        until = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[codes])])
        plain = iter((until[offsets[1:]] - until[offsets[:-1]]).tolist())
        others = iter(self.word_counts([t for t, c in zip(texts, careful) if c]))
        return [next(others) if c else next(plain) for c in careful]

    def word_counts(self, texts: list[str]) -> list[int]:
        return [sum(found) for found in self.memo.values([word_pieces(t) for t in texts], self.encoded_lengths)]

    def encoded_lengths(self, texts: list[str], at_once: int = 64) -> Iterator[int]:
        for at in range(0, len(texts), at_once):
            for coded in self.coder.encode_batch_fast(texts[at : at + at_once], add_special_tokens=False):
                yield len(coded)

    def encoded(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(id, from, to) of each token, in offsets of the whole text."""
        coded = self.coder.encode(text[start:end], add_special_tokens=False)
        return [(i, a + start, b + start) for i, (a, b) in zip(coded.ids, coded.offsets)]

    def stable(self, text: str, place: int) -> bool:
        """Nothing left of the place can change the tokens from there on."""
        if self.blank_leads:
            return text[place] == " " and not text[place - 1].isspace() and text[place + 1 : place + 2].isalnum()
        return text[place - 1] in " \n\t\r" and text[place].isalnum() and not unicodedata.combining(text[place])

    def splice(self, text: str, left: list, right: list, low: int, high: int) -> int | None:
        """The last common boundary between ``low`` and ``high``."""
        starts = {}
        for i, (_, a, _) in enumerate(right):
            starts.setdefault(a, i)
        for i in range(len(left) - 1, -1, -1):
            place = left[i][1]
            if place <= low:
                return None
            if place >= high or place not in starts or (i and left[i - 1][1] == place) or not self.stable(text, place):
                continue
            j, n = starts[place], AGREE
            if left[max(0, i - n) : i] == right[max(0, j - n) : j] and len(left[i : i + n]) == n and left[i : i + n] == right[j : j + n]:
                return place
        return None

    def spliced(self, text: str) -> int:
        end, total = self.chunk, 0
        left = self.encoded(text, 0, end)
        while end < len(text):
            overlap, place = self.overlap, None
            while place is None:
                start = max(0, end - overlap)
                stop = min(len(text), max(end, start + self.chunk))
                right = self.encoded(text, start, stop)
                place = self.splice(text, left, right, start, end)
                if place is None:  # widen to both sides
                    overlap *= 2
                    end = min(len(text), end + overlap)
                    if end == len(text) or overlap >= end:
                        left = self.encoded(text, left[0][1] if left else 0, end := len(text))
                        return total + len(left)
                    left = self.encoded(text, left[0][1] if left else 0, end)
            total += sum(1 for t in left if t[1] < place)
            left, end = [t for t in right if t[1] >= place], stop
        return total + len(left)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    counter: Callable[[str], Counter] = Counter,
) -> DataFrame:
    """id, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer).counts
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            once = texts.dictionary_encode()  # copies in a batch are encoded once
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pc.binary_length(texts).cast(pa.int64()),
                    pc.take(pa.array(counts(once.dictionary.to_pylist()), pa.int64()), once.indices),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", key)
