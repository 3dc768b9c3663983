"""Sources and sinks with fixed schemas."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "word string, lang string, phonemes array<string>, vowels array<string>, zipf double, reading string"


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of words."""
    return spark.read.schema(DICTIONARY).json(path, multiLine=True)


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    """lang, word, events of tab-separated lines `lang word e1|e2|...`."""
    part = F.split("value", "\t")
    events = F.coalesce(F.get(part, F.lit(2)), F.lit(""))
    return spark.read.text(path).select(F.get(part, F.lit(0)).alias("lang"), F.get(part, F.lit(1)).alias("word"), F.when(events == "", F.array().cast("array<string>")).otherwise(F.split(events, r"\|")).alias("events"))


def pronunciations(spark: SparkSession, path: str, key: str) -> DataFrame:
    """word, phonemes of one map of a JSON object of maps {key: {word: "p p"}}."""
    maps = spark.read.schema(f"{key} map<string,string>").json(path, multiLine=True)
    return maps.select(F.explode(key).alias("word", "p")).select("word", F.filter(F.split("p", " "), lambda x: x != "").alias("phonemes"))


def loanwords(spark: SparkSession, path: str) -> DataFrame:
    """word, hangul: the first spelling of each word of a JSON map."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select(F.explode("m").alias("word", "spellings")).select("word", F.get("spellings", F.lit(0)).alias("hangul"))


def surface_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """head, norm, next, count, next_norm of {entries: {head: [norm, [[next, count, score, norm?], ...]]}} or the bare map."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    v = v.select(F.coalesce(F.try_variant_get("v", "$.entries", "variant"), F.col("v")).alias("v"))
    return spark.sql("""
        SELECT h.key AS head, try_variant_get(h.value, '$[0]', 'string') AS norm, try_variant_get(e.value, '$[0]', 'string') AS next,
               try_variant_get(e.value, '$[1]', 'bigint') AS count, try_variant_get(e.value, '$[3]', 'string') AS next_norm
        FROM {bigrams}, LATERAL variant_explode(v) AS h, LATERAL variant_explode(try_variant_get(h.value, '$[1]', 'variant')) AS e""", bigrams=v)


#: Pairs in a file of bigrams, about 3 MB of text: a file is one object, which is made and read as one row.
FILE_PAIRS = 1 << 17


def write_word_bigrams(pairs: DataFrame, path: str, each: int = FILE_PAIRS) -> None:
    """Packed files of `each` pairs (first, second, n, none of them null) at most, as many as it takes, each an object {entries: {head: [[next, count, score], ...]}}.

    Pairs stay in their partitions, so nothing is shuffled again; a head has followers in as many files as partitions have them. The score is 0.5.
    """

    def objects(batches):
        held, count = [], 0
        for b in batches:
            while b.num_rows:
                part, b = b.slice(0, each - count), b.slice(each - count)
                held.append(part)
                count += part.num_rows
                if count == each:
                    yield bigram_object(held)
                    held, count = [], 0
        if held:
            yield bigram_object(held)

    rows = pairs.select("first", "second", F.col("n").cast("string").alias("n")).sortWithinPartitions("first", "second")
    rows.mapInArrow(objects, "value string").write.option("maxRecordsPerFile", 1).text(path, compression="gzip")


def bigram_object(batches: list) -> pa.RecordBatch:
    """One row: the object of pairs (first, second, n) that are sorted by first."""
    first, second, n = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    entry = pc.binary_join_element_wise("[", quoted(second), ',"', n, '","0.5"]', "")
    new = pa.concat_arrays([pa.array([True]), pc.not_equal(first[1:], first[:-1])])
    before = pc.if_else(new, pc.binary_join_element_wise("],", quoted(first), ":[", ""), ",")
    inside = "".join(pc.binary_join_element_wise(before, entry, "").to_pylist())
    return pa.RecordBatch.from_pydict({"value": [f'{{"entries":{{{inside[2:]}]}}}}']})


def quoted(words: pa.Array) -> pa.Array:
    """Words as JSON strings; only where some need escapes one by one."""
    if pc.any(pc.match_substring_regex(words, r'["\\\x00-\x1f]')).as_py():
        return pa.array([json.dumps(w, ensure_ascii=False) for w in words.to_pylist()], words.type)
    return pc.binary_join_element_wise('"', words, '"', "")


def word_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """head, next, count of {entries: {head: [[next, count, score], ...]}}; a folder's files are an object each."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "entries map<string,array<array<string>>>").alias("m"))
    return text.select(F.explode("m.entries").alias("head", "followers")).select("head", F.explode("followers").alias("f")).select("head", F.get("f", F.lit(0)).alias("next"), F.get("f", F.lit(1)).cast("bigint").alias("count"))


def tab_separated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", emptyValue="", nullValue="")


def read_tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", emptyValue="", nullValue="")


def verified_bytes(spark: SparkSession, path: str, sha256: str, unpacked_sha256: str | None = None) -> bytes:
    """A small file's bytes, unpacked if it is gzip, if their digests are the pinned ones."""
    import gzip
    import hashlib

    from phonosearch.sources.store import IntegrityError

    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if hashlib.sha256(raw).hexdigest() != sha256:
        raise IntegrityError(f"{path} is not the pinned file")
    out = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    if unpacked_sha256 is not None and hashlib.sha256(out).hexdigest() != unpacked_sha256:
        raise IntegrityError(f"what {path} holds is not the pinned content")
    return out


def missing(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a resumed extraction still has to do."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_lexicon(lexicon: DataFrame, path: str, pins: dict[str, str] | None = None) -> dict:
    """Partitioned by language, so that a search over one language reads only that; with a manifest, see store."""
    from phonosearch.sources import store

    return store.write(lexicon, path, "lexicon", pins, ("lang",))


def read_lexicon(spark: SparkSession, path: str, pins: dict[str, str] | None = None) -> DataFrame:
    from phonosearch.sources import store

    return store.read(spark, path, "lexicon", pins)
