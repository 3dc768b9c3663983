"""The pronunciation table: readings of spoken events, by way of loanword spellings where there are some; its evaluation and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonosearch.operators import events, g2p
from phonosearch.operators.build import last_wins


def spoken(raw: DataFrame) -> DataFrame:
    """lang, word, phonemes, unknown of raw events (lang, word, events, ord): of a word that comes twice the last one counts."""
    n = F.col("n")
    last = last_wins(raw.select("lang", "word", "events", "ord"), ["lang", "word"], F.col("ord"))
    return last.withColumn("n", events.normalize(F.col("events"))).select("lang", "word", n["phonemes"].alias("phonemes"), n["unknown"].alias("unknown"))


def unknown_symbols(raw: DataFrame) -> DataFrame:
    """symbol, n: in how many rows of raw events each symbol occurs that the inventory lacks."""
    return raw.select(F.explode(events.normalize(F.col("events"))["unknown"]).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def table(words: DataFrame, forms: DataFrame, loanwords: DataFrame) -> DataFrame:
    """lang, word, phonemes, from_loanword, aligned, restored of every word with a reading.

    words and forms are spoken(); loanwords has word and hangul. A Korean word gets its codas back. An English word that has a loanword
    spelling whose Korean form was spoken is read as that form, with its codas; any other as it was spoken itself.
    """
    form = forms.where((F.col("lang") == "ko") & (F.size("phonemes") > 0)).select(F.col("word").alias("hangul"), F.col("phonemes").alias("form"))
    loan = loanwords.join(form, "hangul").select(F.lit("en").alias("lang"), "word", "hangul", "form")
    at = words.select("lang", "word", "phonemes").join(loan, ["lang", "word"], "left")
    borrowed, korean = F.col("form").isNotNull(), F.col("lang") == "ko"
    written = F.when(borrowed, F.col("hangul")).when(korean, F.col("word"))
    at = at.withColumn("r", F.when(borrowed | korean, events.restore_codas(written, F.coalesce("form", "phonemes"))))
    out = at.select("lang", "word", F.coalesce("r.phonemes", "phonemes").alias("phonemes"), borrowed.alias("from_loanword"), F.col("r.aligned").alias("aligned"), F.coalesce("r.restored", F.lit(0)).alias("restored"))
    return out.where(F.size("phonemes") > 0)


def statistics(words: DataFrame, made: DataFrame) -> DataFrame:
    """One row: ko, en, en_from_loanword, aligned, unaligned, codas_restored, and how many words have no reading (empty)."""
    n = lambda test, name: F.count_if(test).alias(name)
    out = made.agg(
        n(F.col("lang") == "ko", "ko"), n(F.col("lang") == "en", "en"), n(F.col("from_loanword"), "en_from_loanword"), n(F.col("aligned"), "aligned"),
        n(~F.col("aligned"), "unaligned"), F.coalesce(F.sum("restored"), F.lit(0)).alias("codas_restored"), F.count("*").alias("_made"),
    )
    total = words.agg(F.count("*").alias("_all"))
    return out.join(F.broadcast(total), how="cross").withColumn("empty", F.col("_all") - F.col("_made")).drop("_all", "_made")


def write_json(made: DataFrame, path: str) -> None:
    """One JSON object {ko: {word: "p p"}, en_koreanized: {word: "p p"}}: a whole table in one row, for tables of a few million words."""
    of = lambda lang: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("lang") == lang, F.struct("word", F.array_join("phonemes", " "))))))
    made.agg(of("ko").alias("ko"), of("en").alias("en_koreanized")).coalesce(1).write.mode("overwrite").json(path)


def best_of(predictions: DataFrame, references: DataFrame, inventory: list[str]) -> DataFrame:
    """word, exact, error_rate: each prediction (word, phonemes) against the nearest of its references (word, phonemes).

    The rate is edits over the reference's sounds, 1 at most. Words without a reference have no row.
    """
    both = predictions.select("word", F.col("phonemes").alias("p")).join(references.select("word", F.col("phonemes").alias("r")), "word")
    edits = g2p.distance(F.col("p"), F.col("r"), inventory)
    rate = edits / F.greatest(F.size("r"), F.lit(1))
    return both.groupBy("word").agg(F.least(F.min(rate), F.lit(1.0)).alias("error_rate"), (F.min(edits) == 0).alias("exact"))


def summary(best: DataFrame) -> DataFrame:
    """count, exact, exact_rate, mean_error_rate of best_of()."""
    n = F.greatest(F.count("*"), F.lit(1))
    return best.agg(F.count("*").alias("count"), F.count_if("exact").alias("exact"), (F.count_if("exact") / n).alias("exact_rate"), F.coalesce(F.avg("error_rate"), F.lit(0.0)).alias("mean_error_rate"))


def parity(expected: DataFrame, predicted: Column) -> DataFrame:
    """count, identical, rate of rows word, phonemes against another runtime's prediction (a column of the word)."""
    same = F.count_if(F.col("phonemes") == predicted)
    return expected.agg(F.count("*").alias("count"), same.alias("identical"), (same / F.greatest(F.count("*"), F.lit(1))).alias("rate"))
