"""One query per operator over the whole given table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadbook.llm import (
    audit,
    decontaminate,
    exact,
    extract,
    kneser_ney,
    langid,
    minhash,
    mixing,
    packing,
    quality,
    repeats,
    resample,
    tokens,
)

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
GOOD = 0.3
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
MIX_SEED = 7
PACK_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % folds


def held_out(key: str, folds: int, rest: int) -> Column:
    """Whether a row is kept from training; one without an id is not."""
    return F.coalesce(fold(key, folds) == rest, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = quality.score(docs, machine)
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    return langid.train(docs.where(~held_out("doc_id", 4, 2)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.classify(docs, language_dictionaries(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~held_out("doc_id", 7, 2)))
    return kneser_ney.score(docs, model).select(
        "doc_id",
        held_out("doc_id", 7, 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), WEIGHTS, SHARE_PERCENT, MAX_EPOCHS, MIX_SEED)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), PACK_TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_OP2 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""

_SQL_OP10 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight
  FROM d GROUP BY source),
o AS (  -- in the order in which sources reach their caps
  SELECT *, {MAX_EPOCHS} * source_size AS cap,
         coalesce(sum({MAX_EPOCHS} * source_size) OVER before, 0)::BIGINT AS caps,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS free,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS place,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM s
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (  -- the first source that does not reach its cap
  SELECT min(place) AS place FROM o
  WHERE ({SHARE_PERCENT} * total - 100 * caps)::HUGEINT * weight < cap::HUGEINT * 100 * free),
l AS (
  SELECT ({SHARE_PERCENT} * total - 100 * caps)::BIGINT AS rest, 100 * free AS level, place FROM o WHERE place = (SELECT place FROM k)),
t AS (
  SELECT source, source_size,
         CASE WHEN o.place < (SELECT place FROM l) OR (SELECT place FROM l) IS NULL THEN cap::DOUBLE
              ELSE (SELECT rest FROM l)::DOUBLE * weight::DOUBLE / (SELECT level FROM l)::DOUBLE END AS target
  FROM o),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS whole FROM t),
h AS (
  SELECT d.doc_id, d.size, d.source, q.source_size, q.target, q.whole,
         floor(q.target - q.whole::DOUBLE * q.source_size::DOUBLE + 0.5)::BIGINT AS quota,
         ('0x' || substr(md5('{MIX_SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (  -- documents in seeded order; rows that repeat share a place
  SELECT source, hash, doc_id, size, quota, count(*) AS n,
         coalesce(sum(count(*) * size) OVER (PARTITION BY source ORDER BY hash, doc_id NULLS LAST, size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM h GROUP BY source, hash, doc_id, size, quota)
SELECT h.doc_id, h.size, h.source_size, h.target,
       h.whole * h.size + least(h.size, greatest(g.quota - g.before, 0) // g.n)::BIGINT AS taken
FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source AND h.hash = g.hash
             AND h.doc_id IS NOT DISTINCT FROM g.doc_id AND h.size = g.size
"""

# from the definition, order by order: a document falls to the first filter of the order that it fails
_SQL_OP11 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, w.doc_id, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 50,
          100 * len(list_distinct(words)) < 65 * len(words),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text),
                   w.doc_id IS NULL AND min(w.doc_id) OVER (PARTITION BY text) IS NOT NULL)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(letters) AS (
  SELECT '' UNION ALL
  SELECT letters || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(letters, x)),
orders AS (
  SELECT letters AS filter_order, step::INTEGER AS step, [ascii(letters[i]) - 64 for i in range(1, 6)] AS turn
  FROM o, range(1, 6) AS r(step) WHERE length(letters) = 5),
steps AS (
  SELECT part, filter_order, step, turn[step] AS f, n, good, toxic, fails[turn[step]] AS here,
         len([i for i in turn[1:step - 1] if fails[i]]) > 0 AS gone, len([x for x in fails if x]) AS failed
  FROM m, orders),
summed AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND here THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN here AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_exact": op2_exact,
        "op3_language": op3_language,
        "op4_repeats": op4_repeats,
        "op5_extract": op5_extract,
        "op6_decontaminate": op6_decontaminate,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_minhash": op8_minhash,
        "op9_tokens": op9_tokens,
        "op10_mixing": op10_mixing,
        "op11_audit": op11_audit,
        "op12_packing": op12_packing,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact": _SQL_OP2, "op10_mixing": _SQL_OP10, "op11_audit": _SQL_OP11}
