"""Lexicon building: first and last file wins, joins of readings and counts, vocabularies, distinct sequences, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by the order. min_by combines before the shuffle, so a frequent key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def last_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, n, zipf of a vocabulary by a corpus; words that the corpus lacks have no zipf."""
    from phonosearch.functions.scores import zipf

    n = words.groupBy("word").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return vocabulary.join(n, "word", "left").join(F.broadcast(total), how="cross").select("word", "n", zipf(F.col("n"), F.col("total")).alias("zipf"))


def distinct_sequences(layers: DataFrame, column: str = "code") -> DataFrame:
    """seq_id, code, n_words: a hash of the code is its id, so that ids need no order."""
    return layers.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n_words")).withColumn("seq_id", F.xxhash64("code"))


def assembled(readings: DataFrame) -> DataFrame:
    """lang, word and the layers as arrays in order, from rows lang, word, layer, pos, code."""
    ordered = lambda layer: F.transform(F.array_sort(F.collect_list(F.when(F.col("layer") == layer, F.struct("pos", "code")))), lambda x: x["code"])
    return readings.groupBy("lang", "word").agg(*(ordered(x).alias(x) for x in ("ko", "native", "koreanized")))


def ranks(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Unique ranks from 0 over all rows: sorted ranges are counted, and a row's rank is its place in its range plus the rows before.

    Only the counts of ranges go to one place. The ranges are written first where there is a shared folder, so that they can't move between the two reads.
    """
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = at.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else at.persist()
    numbered = at.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_id", "_part", "_at", "_before")


def collated(rows: DataFrame, word: str = "word", tie: str = "word_id", name: str = "ord") -> DataFrame:
    """Ranks by Korean collation (Hangul before Latin), equal spellings by their id."""
    return ranks(rows, F.collate(F.col(word), "ko"), F.col(tie), name=name)


def endpoints(edges: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with both ids, edges that miss one)."""
    ids = lexicon.select("word", "word_id")
    a = edges.join(ids.select(F.col("word").alias("first"), F.col("word_id").alias("first_id")), "first", "left")
    both = a.join(ids.select(F.col("word").alias("second"), F.col("word_id").alias("second_id")), "second", "left")
    hit = F.col("first_id").isNotNull() & F.col("second_id").isNotNull()
    return both.where(hit), both.where(~hit)


def topic_rows(words: DataFrame, lexicon: DataFrame, extra: DataFrame) -> DataFrame:
    """word, topic_row: of the lexicon, else of the further rows, else -1."""
    a = lexicon.select("word", F.col("topic_row").alias("_a"))
    b = extra.select("word", F.col("topic_row").alias("_b"))
    return words.join(a, "word", "left").join(b, "word", "left").select("word", F.coalesce("_a", "_b", F.lit(-1).cast("bigint")).alias("topic_row"))


def suffixes(words: DataFrame, column: str = "code", most: int = 4) -> DataFrame:
    """suffix, word: a posting for each of the last one to four sounds."""
    size = F.length(column)
    return words.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), size)))).where(size > 0).select(F.expr(f"right({column}, k)").alias("suffix"), "word")


def ordered_union(dictionary: DataFrame, more: DataFrame) -> DataFrame:
    """lang, word, place: the dictionary's words in their order (lang, word, ord), then further words (lang, word), Korean first, sorted; each once, from 0."""
    first = dictionary.groupBy("lang", "word").agg(F.min("ord").alias("ord"))
    rest = more.select("lang", "word").distinct().join(first, ["lang", "word"], "left_anti")
    rows = first.select("lang", "word", F.lit(0).alias("_late"), "ord").unionByName(rest.select("lang", "word", F.when(F.col("lang") == "ko", 1).otherwise(2).alias("_late"), F.lit(None).cast(first.schema["ord"].dataType).alias("ord")))
    return ranks(rows, F.col("_late"), F.col("ord"), F.col("word"), F.col("lang"), name="place").select("lang", "word", "place")


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """key, n, start: the sum of n over all smaller keys, as an export of lists in one array needs. Keys are dealt by range, so only the ranges' sums go to one place."""
    at = counts.select(key, n).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    at = at.checkpoint() if counts.sparkSession.sparkContext.getCheckpointDir() else at.persist()
    at = at.withColumn("_part", F.spark_partition_id())
    before = at.groupBy("_part").agg(F.sum(n).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("_inside", inside).join(F.broadcast(before), "_part").select(key, n, (F.col("_before") + F.col("_inside")).alias("start"))


def frequency_differences(stored: DataFrame, computed: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """lang, word, stored, computed of the stored frequencies (lang, word, zipf) that computing them again doesn't give.

    Words without a stored frequency, and words that the computed table lacks, are not compared; a computed null differs from any number.
    """
    both = stored.where("zipf is not null").select("lang", "word", F.col("zipf").alias("stored")).join(computed.select("lang", "word", F.col("zipf").alias("computed")), ["lang", "word"])
    return both.where(F.col("computed").isNull() | (F.abs(F.col("stored") - F.col("computed")) > tolerance))


def by_length(rows: DataFrame, column: str) -> DataFrame:
    """rows dealt by the length of a text or list and sorted by it, so that the batches of a model hold texts of like length."""
    size = F.length(column) if dict(rows.dtypes)[column] == "string" else F.size(column)
    return rows.repartitionByRange(size).sortWithinPartitions(size)


def lexicon_statistics(lexicon: DataFrame) -> DataFrame:
    """One row: words, ko, en, sequences (over all layers), without_own_reading (Korean words without ko, English ones without koreanized)."""
    every = F.concat("ko", "native", "koreanized")
    missing = F.when(F.col("lang") == "ko", F.size("ko") == 0).otherwise(F.size("koreanized") == 0)
    whole = lexicon.agg(F.count("*").alias("words"), F.count_if(F.col("lang") == "ko").alias("ko"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(missing).alias("without_own_reading"))
    sequences = lexicon.select(F.explode(every).alias("code")).distinct().agg(F.count("*").alias("sequences"))
    return whole.join(F.broadcast(sequences), how="cross")
