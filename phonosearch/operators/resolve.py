"""From query text to sounds: in the lexicon, by the pronunciation model, or letter by letter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonosearch.functions.text import fold, token_class, tokens, written_sounds
from phonosearch.operators.build import first_wins


def readings(lexicon: DataFrame) -> DataFrame:
    """lang, key, native, koreanized: the first word of each lower-case spelling, the first sequence of its layers.

    An English word without a native reading takes its koreanized one; a Korean word's reading is both.
    """
    first = first_wins(lexicon.withColumn("key", F.lower("word")).select("lang", "key", "word_id", "ko", "native", "koreanized"), ["lang", "key"], F.col("word_id"))
    head = lambda c: F.get(c, F.lit(0))
    own = F.when(F.col("lang") == "ko", head("ko")).otherwise(F.coalesce(head("native"), head("koreanized")))
    return first.select("lang", "key", own.alias("native"), F.when(F.col("lang") == "ko", head("ko")).otherwise(F.coalesce(head("koreanized"), F.lit(""))).alias("koreanized"))


def resolve(queries: DataFrame, lexicon: DataFrame, codes: dict[str, str], model: Callable | None = None) -> DataFrame:
    """query_id, native, koreanized (codes), tokens, sources, skipped: a row for each query with a token.

    queries has query_id and text. A number that the lexicon lacks is skipped and reported, as several
    readings are possible. model(tokens column) gives codes for words that the lexicon lacks; without one they are
    skipped too. Queries are many or few; the lexicon side is joined by its key.
    """
    t = queries.select("query_id", F.posexplode(tokens(fold(F.col("text")))).alias("pos", "token"))
    t = t.withColumn("lang", F.when(F.col("token").rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]"), "ko").otherwise("en"))
    found = t.join(readings(lexicon).withColumnRenamed("key", "token"), ["lang", "token"], "left")
    kind = token_class(F.col("token"), F.col("native").isNotNull())
    source = F.when((kind == "hangul") & F.col("native").isNotNull(), "lexicon").when(kind == "hangul", "model").otherwise(kind)
    letters = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    spelled = F.array_join(F.transform(written_sounds(F.col("token")), lambda p: F.coalesce(F.try_element_at(letters, p), F.lit("!"))), "")
    guess = model(F.col("token")) if model else F.lit(None).cast("string")
    at = found.withColumn("source", source)
    native = F.when(F.col("source") == "jamo", spelled).when(F.col("source") == "model", guess).otherwise(F.col("native"))
    koreanized = F.when(F.col("source") == "lexicon", F.col("koreanized")).otherwise(native)
    at = at.select("query_id", "pos", "token", "source", native.alias("n"), koreanized.alias("k"))
    kept = F.coalesce(F.length("n") > 0, F.lit(False))
    rows = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", F.col(c).alias("x"))))), lambda s: s["x"])
    out = at.groupBy("query_id").agg(rows(kept, "n").alias("n"), rows(kept, "k").alias("k"), rows(kept, "token").alias("tokens"), rows(kept, "source").alias("sources"), rows(~kept, "token").alias("skipped"))
    return out.select("query_id", F.array_join("n", "").alias("native"), F.array_join("k", "").alias("koreanized"), "tokens", "sources", "skipped")
