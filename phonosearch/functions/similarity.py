"""Similarity of two phonemes from their features, as columns and as a matrix.

One definition serves both: the operations are given as arguments, so that columns and numbers go
through the same steps in the same order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inventory import CONSONANTS, PHONEMES, VOWELS


@dataclass(frozen=True)
class Config:
    """Fixed values of the two formulas. Caps are (largest difference, cap) in rising order, then what holds beyond."""

    vowel: tuple = (0.42, 0.36, 0.22)
    strict: float = 0.55
    blend: float = 0.45
    consonant: tuple = (0.4, 0.34, 0.16, 0.1)
    place_caps: tuple = ((0.25, 0.72), (0.5, 0.58))
    place_else: float = 0.42
    manner_caps: tuple = ((0.25, 0.68), (0.5, 0.52))
    manner_else: float = 0.35
    both: float = 0.46

    def __post_init__(self) -> None:
        for caps in (self.place_caps, self.manner_caps):
            limits = [d for d, _ in caps]
            if limits != sorted(set(limits)):
                raise ValueError("tiers must rise")


class Numbers:
    """The operations on floats; on columns the class below."""

    low, high = staticmethod(min), staticmethod(max)
    size = staticmethod(abs)

    @staticmethod
    def pick(test, yes, no):
        return yes if test else no


class Columns:
    size = staticmethod(F.abs)

    @staticmethod
    def low(a, b):
        return F.least(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))

    @staticmethod
    def high(a, b):
        return F.greatest(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))

    @staticmethod
    def pick(test, yes, no):
        return F.when(test, yes).otherwise(no)


def unit(op, x):
    return op.high(0.0, op.low(1.0, x))


def tier(op, difference, caps, beyond):
    out = beyond
    for limit, cap in reversed(caps):
        out = op.pick(difference <= limit, cap, out)
    return out


def vowel_similarity(op, height, backness, rounding, config: Config = Config()):
    """From similarities of the features."""
    strict = height * backness * rounding
    h, b, r = config.vowel
    return unit(op, strict * config.strict + (height * h + backness * b + rounding * r) * config.blend)


def consonant_similarity(op, place, manner, strength, voice, config: Config = Config()):
    """From differences of the features; the caps keep far places and manners apart."""
    weights = config.consonant
    near = [unit(op, 1 - d) for d in (place, manner, strength, voice)]
    score = near[0] * weights[0] + near[1] * weights[1] + near[2] * weights[2] + near[3] * weights[3]
    cap = op.pick(place > 0, tier(op, place, config.place_caps, config.place_else), 1.0)
    cap = op.low(cap, op.pick(manner > 0, tier(op, manner, config.manner_caps, config.manner_else), 1.0))
    cap = op.low(cap, op.pick((place > 0) & (manner > 0), config.both, 1.0))
    return unit(op, op.low(score, cap))


def phoneme_similarity(a: str, b: str, config: Config = Config()) -> float:
    """Of two phonemes: 1 if they are the same, 0 for unknown ones and for a vowel with a consonant."""
    if a == b:
        return 1.0
    for table, formula, turn in ((VOWELS, vowel_similarity, lambda d: unit(Numbers, 1 - d)), (CONSONANTS, consonant_similarity, lambda d: d)):
        if a in table and b in table:
            return float(formula(Numbers, *(turn(abs(x - y)) for x, y in zip(table[a], table[b])), config=config))
    return 0.0


@cache
def matrix(config: Config = Config()) -> np.ndarray:
    """similarity[i, j] of PHONEMES by a configuration; a last row and column of zeros for the unknown phoneme."""
    n = len(PHONEMES)
    out = np.zeros((n + 1, n + 1))
    for i, a in enumerate(PHONEMES):
        for j, b in enumerate(PHONEMES):
            out[i, j] = phoneme_similarity(a, b, config)
    return out


def phonemes(spark: SparkSession) -> DataFrame:
    """p, is_vowel, f: the inventory as a table of 68 rows."""
    rows = [(p, True, [float(x) for x in f]) for p, f in VOWELS.items()] + [(p, False, [float(x) for x in f]) for p, f in CONSONANTS.items()]
    return spark.createDataFrame(rows, "p string, is_vowel boolean, f array<double>")


def similarity_table(inventory: DataFrame) -> DataFrame:
    """a, b, s for all pairs of an inventory, a table of bounded size."""
    a = inventory.select(F.col("p").alias("a"), F.col("is_vowel").alias("va"), F.col("f").alias("fa"))
    b = inventory.select(F.col("p").alias("b"), F.col("is_vowel").alias("vb"), F.col("f").alias("fb"))
    d = [F.abs(F.get("fa", F.lit(i)) - F.get("fb", F.lit(i))) for i in range(4)]
    vowel = vowel_similarity(Columns, *(unit(Columns, 1 - x) for x in d[:3]))
    score = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("va") & F.col("vb"), vowel).when(~F.col("va") & ~F.col("vb"), consonant_similarity(Columns, *d)).otherwise(0.0)
    return a.crossJoin(F.broadcast(b)).select("a", "b", score.alias("s"))


def load_config(spark: SparkSession, path: str) -> Config:
    """A Config from a JSON object with its fields; fields that are left out keep their values, unknown ones and falling tiers are errors."""
    import json
    from dataclasses import fields

    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else float(x)
    return Config(**{k: tuples(v) for k, v in given.items()})
