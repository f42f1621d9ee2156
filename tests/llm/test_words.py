from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest

from roadbook.llm import words

TEXTS = ["É wörd Ñ", None, "", " a\tB\x0bc\x0c\rd \n", "x\x1cy\x85z\xa0w", "日本 語 ẞ", "ÀB " * 50] * 9


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("most", [1, 40, 300, 10**6])
def test_words_of_every_slice(lower, most):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS, pa.string())})
    found, rows = [], 0
    for piece in words.pieces(batch, "text", most):
        assert piece.num_rows == 1 or sum(len((t or "").encode()) for t in piece.column("text").to_pylist()) <= most
        flat, offsets = words.split_words(words.text_column(piece, "text"), lower)
        flat.validate(full=True)
        found += [flat[a:b].to_pylist() for a, b in zip(offsets[:-1], offsets[1:])]
        rows += piece.num_rows
    assert rows == len(TEXTS)
    assert found == [brute.words(t, lower) for t in TEXTS]


def test_hashes_of_runs():
    hashes = np.arange(1, 40, dtype=np.uint64)
    runs = words.run_hashes(hashes, 5)
    assert len(runs) == 35 and len(set(runs.tolist())) == 35
    assert (words.run_hashes(hashes[7:], 5) == runs[7:]).all()
    assert len(words.run_hashes(hashes[:3], 5)) == 0
