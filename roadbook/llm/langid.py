"""Language identification by compression.

Per language a zstandard raw-content dictionary is made from a bounded sample of labelled texts.
A text is cut into pieces, each piece is encoded with each language's dictionary, and the
language with the smallest sum of sizes wins. The format stores a short text as it is where compression would save less than
its headers cost; so a short text is encoded behind a passage of each dictionary, and its size is what it adds. A text is rejected if the runner-up's sum comes within
``min_margin`` of the winner's, or if it has no letter; nothing but the sizes decides.

Texts and samples are lower-cased and every run of other characters than letters becomes one
blank, so that capitals, digits and marks do not decide. The whole text is read.

Defined results: null texts and texts without a letter are ``und``, score 0, rejected. Of equal sums the
first language code counts, and the text is rejected. Without
any labelled text every row is ``und``. Rows that repeat get equal results. Other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadbook.llm.folders import stored

SAMPLE_ROWS = 400  # distinct labelled texts at most that a language's dictionary is made from; it is full after 96 long ones
DICTIONARY_BYTES = 96 * 1024  # per language
PASSAGE_BYTES = 1024  # that one text gives at most
ALL_BYTES = 24 * 1024 * 1024  # of all languages; more languages get smaller dictionaries
PIECE_BYTES = 8 * 1024
SHORT_BYTES = 160  # a shorter text is encoded behind a passage of the dictionary
WORD_BYTES = 32  # and one of a few words with matches of three letters
LEAD_BYTES = 256
CLOSE_LEVEL = 19
LEVEL = 6  # lower ones miss matches of a few letters
MIN_MARGIN = 0.004
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode() if text else b""


def without_echoes(cleaned: bytes, most: int) -> bytes:
    """The first words of a sample, up to ``most`` bytes, without words that stood shortly before."""
    out: list[bytes] = []
    size = 0
    for word in cleaned.split():
        if word not in out[-8:]:
            size += len(word) + 1
            if size > most:
                break
            out.append(word)
    return b" ".join(out)


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionaries from distinct texts of each language, in order of their hash, ``sample_rows`` at most.

    The first step ranks hashes only; copies of a text count once. A passage of each chosen text, from a place anywhere in it that
    its hash names, comes to the driver.
    """
    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t"))
    ranked = rows.select("l", "h").distinct()
    # in two steps, so that a language in every task's rows does not meet in one task
    chosen = ranked.withColumn("part", F.pmod("h", F.lit(256)))
    for keys in (("l", "part"), ("l",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        chosen = chosen.withColumn("n", place).where(F.col("n") <= sample_rows)
    chosen = chosen.select("l", "h")
    chosen = stored(chosen, "sample")  # of known size, so that Spark need not shuffle the texts if it is small
    share = min(PASSAGE_BYTES, max(64, dictionary_bytes // 8))
    length = 2 * share  # in characters; marks and words that come again soon are left out
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - length, F.lit(0)) + 1) + 1
    pieces = rows.join(chosen, ["l", "h"]).select("l", "h", F.substring("t", start.cast("int"), F.lit(length)).alias("t"))
    found = pieces.groupBy("l", "h").agg(F.min("t").alias("t")).orderBy("l", "h")
    samples: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for row in found.toLocalIterator():
        if held.get(row.l, 0) < dictionary_bytes:
            samples.setdefault(row.l, []).append(part := without_echoes(letters_only(row.t), share))
            held[row.l] = held.get(row.l, 0) + len(part) + 1
    size = min(dictionary_bytes, max(1024, ALL_BYTES // max(1, len(samples))))
    return {code: b" ".join(parts)[:size].decode(errors="ignore").encode() for code, parts in sorted(samples.items())}


class Encoders:
    """One compressor per language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.codes = sorted(dictionaries)
        self.encode, self.short, self.words = [], [], []
        for code in self.codes:
            content = zstandard.ZstdCompressionDict(dictionaries[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            params = zstandard.ZstdCompressor(
                level=level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            self.encode.append(params.compress)
            closer = zstandard.ZstdCompressionParameters.from_level(
                CLOSE_LEVEL, dict_size=len(dictionaries[code]), source_size=2 * LEAD_BYTES, min_match=3,
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            near = zstandard.ZstdCompressionDict(dictionaries[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            close = zstandard.ZstdCompressor(dict_data=near, compression_params=closer).compress
            # a passage of the dictionary costs next to nothing, so what follows it is compressed and not stored as it is
            lead = dictionaries[code][-LEAD_BYTES:] + b" "
            self.short.append((params.compress, lead, len(params.compress(lead))))
            self.words.append((close, lead, len(close(lead))))

    def classify(self, text: str | None, piece_bytes: int = PIECE_BYTES) -> tuple[str, float, float]:
        """Language, score and relative margin over the runner-up."""
        cleaned = letters_only(text)
        if not cleaned or not self.codes:
            return UNDETERMINED, 0.0, 0.0
        pieces = [cleaned[i : i + piece_bytes] for i in range(0, len(cleaned), piece_bytes)]
        if len(cleaned) < SHORT_BYTES:
            led = self.words if len(cleaned) < WORD_BYTES else self.short
            sizes = np.array([max(1, len(encode(lead + cleaned)) - size) for encode, lead, size in led], float)
        else:
            sizes = np.array([sum(len(encode(p)) for p in pieces) for encode in self.encode], float)
        if len(sizes) == 1:
            return self.codes[0], 1.0, 1.0
        best = int(np.argmin(sizes))
        others = np.delete(sizes, best)
        gap = float(others.min() - sizes[best])
        chances = np.exp(-np.clip((sizes - sizes[best]) * 0.5, -50, 50))
        return self.codes[best], float(1 / chances.sum()), gap / max(float(others.min()), 1.0)


def classify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    key: str = "doc_id",
    text: str = "text",
    min_margin: float = MIN_MARGIN,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """id, ``lang_pred``, ``score``, ``margin`` and ``rejected`` of every row."""
    rows = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            out = [encoders.classify(t.as_py(), piece_bytes) for t in batch.column("text")]
            codes, scores, margins = zip(*out) if out else ((), (), ())
            rejected = [c == UNDETERMINED or m < min_margin for c, m in zip(codes, margins)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(codes, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["id", "lang_pred", "score", "margin", "rejected"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, margin double, rejected boolean")
    return found.withColumnRenamed("id", key)


def keep_identified(
    docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            found = [encoders.classify(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            yield batch.filter(pa.array([c != UNDETERMINED and m >= min_margin for c, _, m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
