"""Linked search: neighbouring words whose shared boundary sounds like the query.

A query is split in two. Heads are scored by how their end sounds like the left part, followers by how
their start sounds like the right part; each distinct word is scored once for a split, and only words above the
threshold reach the join with the edges. Splits are columns' worth of work, not rows: a word carries an
array of its scores, one for each split, and a pair keeps its best split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonosearch.functions.inventory import INDEX, VOWELS
from phonosearch.functions.scores import frequency_weight, pair_similarity, tie_key, topic_weight
from phonosearch.functions.text import bracketed, holds_any
from phonosearch.operators.kernel import Query, boundary_best, prepare
from phonosearch.plans.request import Request, variants

THRESHOLD = 40.0


class NoSplits(ValueError):
    code = "no_splits"


@dataclass(frozen=True)
class Split:
    number: int
    left: Query
    right: Query
    left_weight: float
    right_weight: float
    left_text: str
    right_text: str
    syllabic: bool

    @property
    def label(self) -> str:
        return f"{self.left_text} / {self.right_text}"


def importance(detail) -> float:
    """Sum of the weights that count; a side without any counts 1."""
    return sum(max(0.0, x) if x == x and abs(x) != float("inf") else 1.0 for x in detail) or 1.0


def split_points(phonemes, syllables=None, is_vowel=lambda p: p in VOWELS) -> list[tuple[int, str, str, bool]]:
    """(place, left text, right text, syllabic): between written syllables, else next to a vowel.

    Without syllables each side has one sound at least, two if the query has more than four.
    """
    if syllables is not None:
        chars, starts = [c for c, _ in syllables], [s for _, s in syllables]
        return [(at, "".join(chars[:k]), "".join(chars[k:]), True) for k, at in enumerate(starts) if k and 0 < at < len(phonemes)]
    least = 1 if len(phonemes) <= 4 else 2
    return [(at, " ".join(phonemes[:at]), " ".join(phonemes[at:]), False) for at in range(least, len(phonemes) - least + 1) if is_vowel(phonemes[at - 1]) or is_vowel(phonemes[at])]


def splits(request: Request, which: str) -> list[Split]:
    """The splits of all variants that a language is searched by. Written syllables hold for the query's own sounds only."""
    r, v = request.normalized(), variants(request)
    if which == "ko":
        found = v.korean
    else:
        found = {"native": (v.native,), "koreanized": v.koreanized}.get(r.mode, (v.native, *v.koreanized))
    vowel = lambda p: p in VOWELS if p in INDEX else r.is_vowel(p)
    make = lambda p, d: prepare(p, d, r.vowel_weight, r.consonant_weight, r.use_detail, False, r.is_vowel, r.config)
    out: list[Split] = []
    for phonemes, detail in found:
        syllables = r.syllables if r.syllables is not None and phonemes == v.native[0] else None
        for at, left, right, syllabic in split_points(phonemes, syllables, vowel):
            out.append(Split(len(out), make(phonemes[:at], detail[:at]), make(phonemes[at:], detail[at:]), importance(detail[:at]), importance(detail[at:]), left, right, syllabic))
    return out


def side_scores(lists: tuple[Column, ...], plan: list[Split], side: str) -> Column:
    """An array of a word's best boundary score for each split, over all pronunciations of its layers (each a list of codes)."""
    part = lambda s: s.left if side == "end" else s.right
    best = lambda s: F.greatest(F.lit(0.0), *(F.coalesce(boundary_best(c, part(s), side), F.lit(0.0)) for c in lists))
    return F.array(*(best(s) for s in plan))


def meaning_zipf(surfaces: DataFrame) -> DataFrame:
    """sid, meaning_zipf: of the normal form if it has one with a count, else its own; 1 where both are missing."""
    norm = surfaces.select(F.col("sid").alias("norm_sid"), F.col("zipf").alias("norm_zipf"))
    return surfaces.join(norm, "norm_sid", "left").select("sid", F.coalesce("norm_zipf", "zipf", F.lit(1.0)).alias("meaning_zipf"))


def normal_texts(surfaces: DataFrame) -> DataFrame:
    norm = surfaces.select(F.col("sid").alias("norm_sid"), F.col("text").alias("norm_text"))
    return surfaces.join(norm, "norm_sid", "left")


def score_sides(units: DataFrame, request: Request, plan: list[Split], layers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(heads, followers): id with an array of scores, of those that pass for one split at least.

    units: id, text, norm_text, is_particle and the layers, each a code or a list of codes.
    """
    r = request.normalized()
    free = units
    if r.exclude:
        free = free.where(~holds_any(F.col("text"), list(r.exclude)) & ~F.coalesce(holds_any(F.col("norm_text"), list(r.exclude)), F.lit(False)))
    kinds = dict(units.dtypes)
    codes = tuple(F.col(x) if kinds[x].startswith("array") else F.when(F.col(x).isNotNull(), F.array(x)) for x in layers)
    heads = free if r.allow_first_particle else free.where(~F.col("is_particle"))
    passes = lambda c: F.exists(c, lambda s: s > THRESHOLD)
    left = heads.select("id", side_scores(codes, plan, "end").alias("lefts")).where(passes("lefts"))
    right = free.select("id", side_scores(codes, plan, "start").alias("rights")).where(passes("rights"))
    return left, right


def collect(units: DataFrame, edges: DataFrame, request: Request, which: str, layers: tuple[str, ...]) -> tuple[DataFrame, list[Split]]:
    """first, second, split, left, right, boundary of every pair that passes on both sides, by its best split.

    Of splits with equal boundary the earliest stays. A frequent head's edges are split by the adaptive join.
    """
    plan = splits(request, which)
    if not plan:
        raise NoSplits("the query can't be split")
    left, right = score_sides(units, request, plan, layers)
    joined = edges.join(left.withColumnRenamed("id", "first"), "first").join(right.withColumnRenamed("id", "second"), "second")
    options = []
    for s in plan:
        a, b = F.get("lefts", F.lit(s.number)), F.get("rights", F.lit(s.number))
        whole = (a * s.left_weight + b * s.right_weight) / (s.left_weight + s.right_weight)
        options.append(F.when((a > THRESHOLD) & (b > THRESHOLD), F.struct(whole.alias("boundary"), F.lit(-s.number).alias("nearer"), a.alias("left"), b.alias("right"))))
    best = F.array_max(F.array(*options))
    out = joined.select("first", "second", best.alias("b")).where(F.col("b").isNotNull())
    return out.select("first", "second", (-F.col("b.nearer")).alias("split"), "b.left", "b.right", "b.boundary"), plan


def rank(pairs: DataFrame, request: Request) -> DataFrame:
    """pairs with zipf (the mean of both words') get score and key; with a topic also similarity.

    Topic: columns similarity_first, similarity_second and cosine; pairs without vectors drop out.
    """
    out = pairs.withColumn("score", frequency_weight(F.col("boundary"), F.col("zipf"), request.frequency_weight))
    if request.topic_weight is not None:
        out = out.withColumn("similarity", pair_similarity(F.col("similarity_first"), F.col("similarity_second"), F.col("cosine"))).where(F.col("similarity").isNotNull())
        out = out.withColumn("score", topic_weight(F.col("score"), F.col("similarity"), request.topic_weight))
    return out.withColumn("key", tie_key(F.col("score")))


def describe(page: DataFrame, plan: list[Split]) -> DataFrame:
    """display and split label of a page's pairs; first_text and second_text are the words."""
    number = F.col("split")
    label, display = F.lit(None).cast("string"), F.concat("first_text", F.lit(" + "), "second_text")
    for s in plan:
        label = F.when(number == s.number, s.label).otherwise(label)
        if s.syllabic:
            display = F.when(number == s.number, bracketed(F.col("first_text"), F.col("second_text"), F.lit(s.left_text), F.lit(s.right_text))).otherwise(display)
    return page.withColumns({"display": display, "split_label": label})
