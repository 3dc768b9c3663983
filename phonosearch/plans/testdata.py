"""The tables of /root/testdata as a lexicon, bigrams and vectors.

This adapter is ours: the tables hold no pronunciations, so words get a letter-by-letter reading. Operators
don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonosearch.functions.inventory import CODES, encode
from phonosearch.functions.scores import zipf
from phonosearch.session import table

LETTERS = dict(zip("abcdefghijklmnopqrstuvwyz", "a b k d e f ɡ h i dʒ k l m n o p k ɹ s t u v w j z".split()))
TO_KOREAN = {"b": "p", "d": "t", "ɡ": "k", "f": "pʰ", "v": "p", "dʒ": "tɕ", "ɹ": "ɾ", "z": "tɕ", "w": "u", "j": "i"}
STOPS = ("p", "t", "k")


def native_sounds(word: str) -> list[str]:
    return [LETTERS[c] for c in word.replace("x", "ks") if c in LETTERS]


def koreanized_sounds(word: str) -> list[str]:
    out = [TO_KOREAN.get(p, p) for p in native_sounds(word)]
    return [*out, "ɯ"] if out and out[-1] in STOPS else out


def native_code(word: Column) -> Column:
    return F.translate(F.replace(word, F.lit("x"), F.lit("ks")), "".join(LETTERS), encode(LETTERS.values()))


def koreanized_code(native: Column) -> Column:
    out = F.translate(native, encode(TO_KOREAN), encode(TO_KOREAN.values()))
    return F.when(F.substring(out, -1, 1).isin(*(CODES[p] for p in STOPS)), F.concat(out, F.lit(CODES["ɯ"]))).otherwise(out)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, word: the lower-case [a-z]+ runs of documents, in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    return docs.select("doc_id", F.posexplode("w").alias("pos", "word"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n, zipf of all distinct words; the total is one row, joined by broadcast."""
    counts = words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), how="cross").select("word", "n", zipf(F.col("n"), F.col("total")).alias("zipf"))


def layered(vocabulary: DataFrame) -> DataFrame:
    """A lexicon without word_id: readings of each word as code lists; ord is the word itself.

    Words of [a-z] alone are in the same order by their bytes and by collation, so the word orders ties.
    """
    native = native_code(F.col("word"))
    return vocabulary.select(
        F.col("word").alias("word_id"), "word", F.lit("en").alias("lang"), "zipf", F.col("word").alias("ord"), F.array().cast("array<string>").alias("ko"),
        F.array(native).alias("native"), F.array(koreanized_code(native)).alias("koreanized"),
    )


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; a temporary one where the session names none, as in tests."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="phonosearch-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that is built from the test tables once in an application, written, and read by every query that searches it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        at = folder(spark, name)
        make().repartition(spark.sparkContext.defaultParallelism).write.parquet(at)
        _stored[key] = at
    return spark.read.parquet(_stored[key])


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "lexicon", lambda: layered(vocabulary(spark, sf_dir)))


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "edges", lambda: edges(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first, second, n: pairs of words side by side in a document. A document's words are in one row, so no shuffle finds them."""
    docs = table(spark, sf_dir, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return docs.select(F.explode(pairs).alias("e")).groupBy("e.first", "e.second").agg(F.count("*").alias("n"))
