"""Packing token streams into sequences of a fixed length by order-preserving dynamic programming.

Documents stay in the order of their table. Each partition of the table is a stream of its own;
its documents' ids follow one another, and the stream is cut into windows, the sequences. Cuts
are chosen where a document or a sentence ends so that padding plus penalties is least: a window
pays for the places it leaves empty, nothing if its length is a power of two, and its end pays by
what it cuts, a document, a sentence, or neither. With x the places of possible cuts,

    cost[j] = penalty[j] + min(min over x[j] - x[i] <= L of (cost[i] + x[i]) + L - x[j],
                               min over x[j] - x[i] a power of two of cost[i])

The first minimum slides with j, so a monotone queue gives it in constant time; the second looks
up at most log2(L) places. Where no sentence ends for long, and in the last two windows of a
block, further places are offered at a higher penalty.

A partition is worked off in blocks of whole documents, each solved on its own, so a task holds one
block, or one document if that is longer. Nothing is shuffled: a task reads its part of the table
and writes its pieces, and a task that is run again gives the same ones, as long as its part is
read in the same order, which holds for a table in files. Sequences never mix partitions.

Defined results: a null text counts as empty; an empty document is its end id alone. Rows that
repeat are documents of their own. An empty table gives no pieces. Columns other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from roadbook.llm.wordmemo import LETTERS, Memo, blank_runs, cuts_at_blanks, slices, word_pieces, words_at_blanks
from roadbook.llm.words import pieces, text_column

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
SENTENCE_PENALTY = 24  # in tokens of padding
INNER_PENALTY = 128
SEQUENCE_COST = 8  # what one more sequence costs, so that short ones are not free
GROUP_CHARS = 4 << 20  # of texts whose new words are encoded together
INNER_STEP = 64  # places offered where no sentence ends

_PLAIN = re.compile(f"[ \\t\\n\\r!-;=>?-~{LETTERS}]*")  # white space, ASCII but for one sign that added tokens hold, letters
_WORD = re.compile(f"[ \\t\\n\\r][ \\t\\n\\r!-;=>?-~{LETTERS}]*[!-;=>?-~{LETTERS}]")  # begins with white space and ends with none
_AFTER_BLANK = f"\\A[\\t\\n\\r!-;=>?-~{LETTERS}]*[!-;=>?-~{LETTERS}]\\z"  # what makes such a word with one blank before it
_SENTENCE_END = re.compile(r"[.!?。！？][\"')\]’”]*$")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return coder


class Encoder:
    """A text's ids as little-endian unsigned 32-bit numbers, the same as the tokenizer's library gives.

    New pieces of plain characters are merged by tiktoken, which is several times as fast, from the tokenizer's own vocabulary;
    all others by the library itself.
    """

    def __init__(self, path: str):
        self.coder = load(path)
        description = json.loads(self.coder.to_str())
        self.merge, self.sizes = same_merges(description)
        self.cuts = cuts_at_blanks(description)
        self.memo = Memo(len)

    def piece(self, text: str) -> bytes:
        if self.merge is not None and _PLAIN.fullmatch(text):
            return self.merge(text).tobytes()
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, texts: list[str]) -> Iterator[bytes]:
        """Words after a blank are merged as one text: each begins at a place to cut, so tokens end where words do."""
        joined = [self.merge is not None and _WORD.fullmatch(t) is not None for t in texts]
        words = [t for t, j in zip(texts, joined) if j]
        ids = self.merge("".join(words)) if words else np.zeros(0, "<u4")
        until = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        cuts = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), until) + 1)).tolist()
        flat, spans = ids.tobytes(), zip([0, *cuts], cuts)
        for text, j in zip(texts, joined):
            if j:
                start, end = next(spans)
                yield flat[start:end]
            else:
                yield self.piece(text)

    def ids(self, texts: pa.Array) -> list[bytes]:
        if not self.cuts:
            return [self.piece(t) for t in texts.to_pylist()]
        careful = blank_runs(texts)
        plain = iter(self.ids_at_blanks(texts.filter(pa.array(~careful))))
        others = iter(texts.filter(pa.array(careful)).to_pylist())
        return [self.ids_by_piece(next(others)) if c else next(plain) for c in careful]

    def ids_by_piece(self, text: str) -> bytes:
        return b"".join(b"".join(values) for part in slices(text) for values in self.memo.values([word_pieces(part)], self.pieces))

    def ids_at_blanks(self, texts: pa.Array) -> Iterator[bytes]:
        """The batch's distinct plain words are merged as one text, and looked at in Arrow and numpy alone; others go through the memo."""
        distinct, heads, codes, offsets = words_at_blanks(texts)
        together = np.zeros(len(distinct), bool)
        if self.merge is not None:
            together = pc.match_substring_regex(distinct, _AFTER_BLANK).to_numpy(zero_copy_only=False)
        words = distinct.filter(pa.array(together))
        merged, merged_sizes = self.merged(words) if len(words) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        others = [f" {w}" for w in distinct.filter(pa.array(~together)).to_pylist()] + heads
        values = self.memo.values([others], self.pieces)[0]
        ids = np.concatenate([merged, np.frombuffer(b"".join(values), "<u4")])
        order = np.concatenate([np.flatnonzero(together), np.flatnonzero(~together), len(distinct) + np.arange(len(heads))])
        in_order = np.concatenate([merged_sizes, np.fromiter(map(len, values), np.int64, len(values)) // 4])
        sizes, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sizes[order], starts[order] = in_order, np.cumsum(in_order) - in_order
        each = sizes[codes]
        until = np.concatenate([[0], np.cumsum(each)])
        flat = ids[np.repeat(starts[codes] - until[:-1], each) + np.arange(until[-1])]
        for a, b in zip(until[offsets[:-1]].tolist(), until[offsets[1:]].tolist()):
            yield flat[a:b].tobytes()

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some plain words, each with a blank before it, one after the other, and how many each word has."""
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        ids = self.merge(" " + pc.binary_join(row, pa.scalar(" ", words.type))[0].as_py())
        until = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), until) + 1, prepend=0)


def _bytes_of_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others counted on from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


def same_merges(parts: dict) -> tuple[Callable[[str], np.ndarray] | None, np.ndarray]:
    """A function that encodes plain text as the described tokenizer does, and the bytes of each id; none where that is not certain.

    It is certain for byte-level BPE with the usual pattern, if each merge makes the next id: tiktoken and the library then
    merge the pair with the smallest id first. Added tokens must hold a character that plain text does not.
    """
    model, cutter = parts["model"], parts.get("pre_tokenizer") or {}
    nothing = None, np.zeros(0, np.int64)
    if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or not cutter["use_regex"] or parts.get("normalizer") is not None:
        return nothing
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return nothing
    alphabet, vocabulary = _bytes_of_alphabet(), dict(model["vocab"])
    for token in parts.get("added_tokens", []):
        vocabulary.pop(token["content"], None)
        if _PLAIN.fullmatch(token["content"]):
            return nothing
    ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in vocabulary.items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    if not in_order or len(ranks) != 256 + len(merges) or sorted(ranks.values()) != list(range(len(ranks))):
        return nothing
    import public_tokenizers

    coder = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(len(ranks), np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return lambda text: coder.encode_to_numpy(text, disallowed_special=()).astype("<u4"), sizes


def boundary_marks(path: str) -> tuple[bytes, bytes]:
    """Per id: whether a sentence may end with it, and whether what it starts may begin one (2: it breaks the line)."""
    coder = load(path)
    size = coder.get_vocab_size(with_added_tokens=True)
    strings = [coder.decode([i], skip_special_tokens=False) for i in range(size)]
    ends = bytes(bool(_SENTENCE_END.search(s)) for s in strings)
    starts = bytes(2 if s[:1] == "\n" else int(s[:1].isspace()) for s in strings)
    return ends, starts


def sentence_cuts(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places between two ids where a sentence or a line ends."""
    next_starts = starts[ids[1:]]
    line = (next_starts == 2) & (starts[ids[:-1]] != 2)
    return np.flatnonzero(line | ((next_starts > 0) & ends[ids[:-1]].astype(bool))) + 1


def places(n: int, documents: np.ndarray, sentences: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of possible cuts, 0 and n among them, and the penalty of each."""
    known = np.union1d(np.union1d(documents, sentences), [0, n])
    gaps = np.flatnonzero(np.diff(known) > 4 * INNER_STEP)
    inner = [np.arange(known[g] + INNER_STEP, known[g + 1], INNER_STEP) for g in gaps]
    inner.append(np.arange(max(0, n - 2 * length), n))
    at = np.unique(np.concatenate([known, *inner]))
    penalty = np.full(len(at), INNER_PENALTY, np.int64)
    penalty[np.searchsorted(at, sentences)] = SENTENCE_PENALTY
    penalty[np.searchsorted(at, documents)] = 0
    penalty[np.searchsorted(at, [0, n])] = 0
    return at, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Indexes into ``at`` of the cheapest row of cuts from its first to its last place."""
    hits = []
    for k in range(length.bit_length() - 1):
        found = np.searchsorted(at, at - (1 << k))
        j = np.flatnonzero(at[found] == at - (1 << k))
        hits.append(np.stack([j, found[j]]))
    to, of = np.concatenate(hits, axis=1)
    order = np.argsort(to, kind="stable")
    to, of = [*to[order].tolist(), -1], of[order].tolist()
    x, fee = at.tolist(), (penalty + SEQUENCE_COST).tolist()
    cost, came = [0] * len(x), [0] * len(x)
    queue, worth, head, hit = [0], [x[0]], 0, 0  # worth: cost[i] + x[i], rising along the queue
    for j in range(1, len(x)):
        here = x[j]
        while x[queue[head]] < here - length:
            head += 1
        best, source = worth[head] + length - here, queue[head]
        while to[hit] == j:
            if cost[of[hit]] < best:
                best, source = cost[of[hit]], of[hit]
            hit += 1
        best += fee[j]
        cost[j], came[j] = best, source
        best += here
        while len(queue) > head and worth[-1] >= best:
            queue.pop()
            worth.pop()
        queue.append(j)
        worth.append(best)
        if head > 4096:  # what has slid out is given back
            del queue[:head], worth[:head]
            head = 0
    path = [len(x) - 1]
    while path[-1]:
        path.append(came[path[-1]])
    return path[::-1]


def pack_block(encoded: list[bytes], ends: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray | list[bytes]]:
    """Pieces of some documents' ids: number of the document, start in it, length, ids, number of the sequence, offset in it."""
    flat = b"".join(encoded)
    ids = np.frombuffer(flat, "<u4")
    until = np.cumsum([len(e) // 4 for e in encoded])
    at, penalty = places(len(ids), until, sentence_cuts(ids, ends, starts), length)
    cuts = at[best_cuts(at, penalty, length)]
    edges = np.union1d(cuts, until)
    edges = edges if edges[0] == 0 else np.concatenate([[0], edges])
    first, last = edges[:-1], edges[1:]
    document = np.searchsorted(until, first, "right")
    sequence = np.searchsorted(cuts, first, "right") - 1
    begun = np.concatenate([[0], until])[document]
    return {
        "document": document,
        "start": first - begun,
        "length": last - first,
        "ids": [flat[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist())],
        "sequence": sequence,
        "offset": first - cuts[sequence],
    }


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    encoder: Callable[[str], Encoder] = Encoder,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset``. Sequences are numbered within their partition, whose number makes the upper bits."""
    path = tokenizer_file(tokenizer)
    ends, starts = (np.frombuffer(b, np.uint8) for b in boundary_marks(path))
    tail = np.array([end_id], "<u4").tobytes()
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path).ids
        number = TaskContext.get().partitionId() << 33
        keys, encoded, held = [], [], 0

        def solved() -> pa.RecordBatch:
            nonlocal number
            found = pack_block(encoded, ends, starts, length)
            tokens = np.array([len(e) // 4 for e in encoded])
            columns = [
                pa.concat_arrays(keys).take(pa.array(found["document"])),
                pa.array(found["start"], pa.int64()),
                pa.array(found["length"], pa.int64()),
                pa.array(found["ids"], pa.binary()),
                pa.array(tokens[found["document"]], pa.int64()),
                pa.array(number + found["sequence"], pa.int64()),
                pa.array(found["offset"], pa.int64()),
            ]
            number += int(found["sequence"][-1]) + 1
            keys.clear()
            encoded.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for piece in pieces(batch, "text", GROUP_CHARS):
                for i, ids in enumerate(code(text_column(piece, "text"))):
                    keys.append(piece.column("id").slice(i, 1))
                    encoded.append(ids + tail)
                    held += len(ids) // 4 + 1
                    if held >= block_tokens:
                        yield solved()
                        held = 0
        if encoded:
            yield solved()

    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    packed = rows.mapInArrow(run, schema)
    return packed.withColumnRenamed("id", key)
