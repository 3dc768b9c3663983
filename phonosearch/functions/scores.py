"""Scalar functions of ranking: frequency, topic, tie key, pair similarity, zipf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zipf(count: Column, total: Column) -> Column:
    """Log frequency a thousand million tokens, to four places; null where the count is zero or missing."""
    return F.when(count > 0, F.round(F.log10(count / total) + 9, 4))


def frequency_weight(score: Column, value: Column, weight: float) -> Column:
    """Raises the score of frequent words (zipf 3.5 and up) and lowers that of rare ones; a missing zipf counts as 1."""
    z = F.coalesce(value, F.lit(1.0))
    share = weight / 10
    raised = score + (100 - score) * (F.least(F.lit(1.0), (z - 3.5) / 4.5) * share * 0.8)
    lowered = score * (1 - F.pow((3.5 - F.greatest(F.lit(0.0), z)) / 3.5, F.lit(2.5)) * share)
    return F.when(z >= 3.5, raised).otherwise(lowered)


def topic_weight(score: Column, similarity: Column, weight: float) -> Column:
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2))
    return score * (1 - (1 - near) * (weight / 10 * 0.7))


def tie_key(score: Column) -> Column:
    """Thousandths, rounded half up: scores that are equal here are ordered by their words."""
    return F.floor(score * 1000 + 0.5)


def pair_similarity(a: Column, b: Column, cosine: Column) -> Column:
    """Of the mean of two word vectors with a topic, from each one's similarity and their own cosine."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a + b) / F.sqrt(F.greatest(2 + 2 * cosine, F.lit(1e-9)))))
