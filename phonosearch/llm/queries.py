"""The queries opN_ and pipeline: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The key of the registered queries, which must give the same rows each time. Anyone who publishes text takes a secret one.
SURROGATE_KEY = "key of the registered queries"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_windows

    found = find_windows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replaced

    found = replaced(documents(spark, sf_dir), SURROGATE_KEY)
    return found.select("doc_id", "text", F.col("_entities_").cast("bigint").alias("n_entities"), F.array_join("_kinds_", ",").alias("kinds"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, predict

    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import perplexity, train

    docs = documents(spark, sf_dir)
    return perplexity(docs, train(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import document_tokens

    return document_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal import fit, grade

    docs = documents(spark, sf_dir)
    return grade(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, judge

    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(documents(spark, sf_dir)).drop("spans")


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_simhash_dedup, op2_decontamination, op3_pii_surrogates, op4_language_id, op5_lm_perplexity, op6_token_counts, op7_packing, op8_quality_classifier, op9_quality_rules, op10_license_scan)}


#: A-Z to lower case, then words of ASCII letters, digits and all other characters from U+0080 on.
WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP2 = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT item, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i : i + 9], ' '))) AS x FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
places AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, p, places.n AS n, item FROM places JOIN windows ON windows.x = places.x AND windows.n = places.n),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits ON hits.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Only contamination: hashes with a seed, automata, models and linear programs are beyond SQL, and are tested against brute force."""
    return {"op2_decontamination": OP2}
