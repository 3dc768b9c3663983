"""The sequence kernel: weighted alignment and sliding window, the higher of both.

Sequences are strings of one-character codes (functions/inventory.py). score() is an Arrow function that
scores a whole batch at once: sequences of one length are rows of an array, and the alignment's table
is filled column by column for all of them. The steps and their order are those of the formula, so
results don't depend on the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from phonosearch.functions.inventory import FIRST_CODE, INDEX, PHONEMES, VOWELS, encode
from phonosearch.functions.similarity import Config, matrix

VOWEL = np.array([p in VOWELS for p in PHONEMES] + [False])


def default_is_vowel(phoneme: str) -> bool:
    return phoneme in VOWELS


@dataclass(frozen=True)
class Query:
    """A query's sounds with the weight of each, and the weights of the targets' sounds."""

    phonemes: tuple[str, ...]
    weights: tuple[float, ...]
    vowel_weight: float = 1.0
    consonant_weight: float = 1.0
    vowels_only: bool = False
    detail: tuple[float, ...] = ()
    config: Config = Config()

    @property
    def code(self) -> str:
        return encode(self.phonemes)

    @property
    def joined(self) -> str:
        return "".join(self.phonemes)


def prepare(phonemes, detail=None, vowel_weight: float = 1.0, consonant_weight: float = 1.0, use_detail: bool = False, vowels_only: bool = False, is_vowel: Callable[[str], bool] = default_is_vowel, config: Config = Config()) -> Query:
    """Weights are base times detail; with use_detail both bases are 1; vowels_only drops the consonants of both."""
    phonemes = list(phonemes)
    detail = [1.0] * len(phonemes) if detail is None else [float(detail[i]) if i < len(detail) else 1.0 for i in range(len(phonemes))]
    vowel = [p in VOWELS if p in INDEX else is_vowel(p) for p in phonemes]
    if vowels_only:
        phonemes, detail = ([x for x, v in zip(xs, vowel) if v] for xs in (phonemes, detail))
        vowel = [True] * len(phonemes)
    base = (1.0, 1.0) if use_detail else (float(vowel_weight), float(consonant_weight))
    weights = tuple((base[0] if v else base[1]) * d for v, d in zip(vowel, detail))
    return Query(tuple(phonemes), weights, *base, vowels_only, tuple(detail), config)


def sequences(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of an Arrow string array of codes; nulls have length 0."""
    codes = codes.cast(pa.large_string())
    offsets = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
    data = np.frombuffer(codes.buffers()[2], np.uint8) if codes.buffers()[2] else np.zeros(0, np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    if codes.null_count:
        lengths = np.where(codes.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return data, starts, lengths


def symbols(block: np.ndarray) -> np.ndarray:
    """Phoneme numbers of codes; what is no code is the unknown phoneme."""
    ids = block.astype(np.int16) - FIRST_CODE
    return np.where((ids >= 0) & (ids < len(PHONEMES)), ids, len(PHONEMES))


def aligned(ids: np.ndarray, query: Query, sim: np.ndarray) -> np.ndarray:
    """Alignment scores of the rows of ids, which all have one length."""
    q = [INDEX.get(p, len(PHONEMES)) for p in query.phonemes]
    weight = np.where(VOWEL[ids], query.vowel_weight, query.consonant_weight)
    n, size = ids.shape
    row = [np.zeros(n)]
    for w in query.weights:
        row.append(row[-1] + w)
    total = np.zeros(n)
    first = np.zeros(n)
    for i in range(size):
        tw, s = weight[:, i], sim[ids[:, i]]
        first = first + tw
        now = [first]
        for j, w in enumerate(query.weights):
            now.append(np.minimum(np.minimum(now[j] + w, row[j + 1] + tw), row[j] + np.maximum(tw, w) * (1 - s[:, q[j]])))
        row, total = now, total + tw
    own = 0.0
    for w in query.weights:
        own += w
    most = np.maximum(total, own)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.maximum(1 - row[-1] / most, 0) * 100
    return np.where(most > 0, out, 0.0)  # without any weight the alignment says nothing


def slid(ids: np.ndarray, query: Query, sim: np.ndarray) -> np.ndarray:
    """The best window's share of the query's weight; 0 for shorter targets and for a query without weight."""
    q = [INDEX.get(p, len(PHONEMES)) for p in query.phonemes]
    n, size = ids.shape
    own = 0.0
    for w in query.weights:
        own += w
    best = np.zeros(n)
    if own > 0:
        for s in range(size - len(q) + 1):
            total = np.zeros(n)
            for j, w in enumerate(query.weights):
                total = total + sim[ids[:, s + j], q[j]] * w
            best = np.maximum(best, total / own * 100)
    return best


def score_codes(codes: pa.Array, query: Query, parts: str = "both", shortcut: bool = True, sim: np.ndarray | None = None) -> np.ndarray:
    """Scores of an array of codes: 100 for an equal joined spelling, else the higher of alignment and window; 0 if either is empty."""
    sim = matrix(query.config) if sim is None else sim
    data, starts, lengths = sequences(codes)
    out = np.zeros(len(lengths))
    if not query.phonemes:
        return out
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        ids = symbols(data[starts[at][:, None] + np.arange(size)])
        if query.vowels_only:
            # consonants drop out, so rows differ in length again
            keep = VOWEL[ids]
            for k in np.unique(keep.sum(axis=1)):
                rows = keep.sum(axis=1) == k
                if k:
                    out[at[rows]] = score_ids(ids[rows][keep[rows]].reshape(-1, k), query, parts, shortcut, sim)
        else:
            out[at] = score_ids(ids, query, parts, shortcut, sim)
    return out


def score_ids(ids: np.ndarray, query: Query, parts: str, shortcut: bool, sim: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids))
    if parts in ("both", "alignment"):
        out = np.maximum(out, aligned(ids, query, sim))
    if parts in ("both", "window") and ids.shape[1] >= len(query.phonemes):
        out = np.maximum(out, slid(ids, query, sim))
    if shortcut:
        # spelling, not sounds, has to be equal: two lists of sounds may join to the same string
        names = np.array([*PHONEMES, "\0"], object)
        close = ids.shape[1] > 0 and np.isin(ids[:, 0], [i for i, p in enumerate(PHONEMES) if query.joined.startswith(p)])
        for r in np.flatnonzero(close):
            if "".join(names[ids[r]]) == query.joined:
                out[r] = 100.0
    return out


def score(code: Column, query: Query, parts: str = "both", shortcut: bool = True) -> Column:
    """Score of a column of codes."""

    @F.arrow_udf("double")
    def run(codes: pa.Array) -> pa.Array:
        return pa.array(score_codes(codes, query, parts, shortcut))

    return run(code)


def once(function):
    """The function marked so that the optimizer doesn't compute it again for a filter on its result."""
    return function.asNondeterministic()


def best_score(lists: Column, queries: list[Query]) -> Column:
    """Best score over a row's list of sequences and several queries; null where the list is empty."""

    @F.arrow_udf("double")
    def run(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(flat) or not queries:
            return pa.nulls(len(lists), pa.float64())
        top = np.max([score_codes(flat, q) for q in queries], axis=0)
        ends = np.cumsum(sizes)
        out = np.full(len(sizes), -1.0)
        some = sizes > 0
        out[some] = np.maximum.reduceat(top, (ends - sizes)[some])
        return pa.array(out, pa.float64(), mask=~some)

    return once(run)(lists)


def plain_score(code: Column, query: Query) -> Column:
    """The same score by higher-order functions alone, for sessions without Python on the executors.

    The alignment's row is an array that an aggregate carries over the target's sounds.
    """
    sim = matrix(query.config)
    n = len(query.phonemes)
    q = [INDEX.get(p, len(PHONEMES)) for p in query.phonemes]
    own = 0.0
    first = [0.0]
    for w in query.weights:
        own += w
        first.append(first[-1] + w)
    rows = F.array(*(F.array(F.lit(query.vowel_weight if VOWEL[i] else query.consonant_weight), *(F.lit(float(sim[i, j])) for j in q)) for i in range(len(PHONEMES))))
    sounds = F.transform(F.split(code, ""), lambda c: F.get(rows, F.ascii(c) - FIRST_CODE))

    def step(row: Column, t: Column) -> Column:
        start = F.array(F.get(row, F.lit(0)) + F.get(t, F.lit(0)))

        def cell(now: Column, j: Column) -> Column:
            tw, w = F.get(t, F.lit(0)), F.get(F.array(*(F.lit(x) for x in query.weights)), j)
            return F.array_append(now, F.least(F.get(now, j) + w, F.get(row, j + 1) + tw, F.get(row, j) + F.greatest(tw, w) * (1 - F.get(t, j + 1))))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, cell)

    def whole(sounds: Column) -> Column:
        distance = F.get(F.aggregate(sounds, F.array(*(F.lit(x) for x in first)), step), F.lit(n))
        total = F.aggregate(sounds, F.lit(0.0), lambda a, t: a + F.get(t, F.lit(0)))
        most = F.greatest(total, F.lit(own))
        dp = F.when(most > 0, F.greatest(1 - distance / most, F.lit(0.0)) * 100).otherwise(0.0)

        def window(s: Column) -> Column:
            out = F.lit(0.0)
            for j, w in enumerate(query.weights):
                out = out + F.get(F.get(sounds, s + j), F.lit(j + 1)) * F.lit(w)
            return out / F.lit(own) * 100

        slide = F.when((F.size(sounds) >= n) & F.lit(own > 0), F.array_max(F.transform(F.sequence(F.lit(0), F.size(sounds) - n), window))).otherwise(0.0)
        return F.greatest(dp, slide)

    once = F.get(F.transform(F.array(sounds), whole), F.lit(0))  # inside lambdas a column would be computed for each element
    return F.when(code == query.code, 100.0).when((F.length(code) == 0) | F.lit(n == 0), 0.0).otherwise(once)


def traced(like: np.ndarray, target: np.ndarray, query: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The alignment's score and its pairs (target, query), by what each cell of the table chose.

    Of choices within a thousandth a cell pairs, else it leaves the target's sound alone, else the query's.
    """
    n, m = like.shape
    cost = np.zeros((n + 1, m + 1))
    cost[1:, 0], cost[0, 1:] = np.cumsum(target), np.cumsum(query)
    pairs, alone = np.zeros((n + 1, m + 1), bool), np.zeros((n + 1, m + 1), bool)
    for i, t in enumerate(target):
        for j, q in enumerate(query):
            both, only = cost[i, j] + max(t, q) * (1 - like[i, j]), cost[i, j + 1] + t
            least = cost[i + 1, j + 1] = min(cost[i + 1, j] + q, only, both)
            pairs[i + 1, j + 1], alone[i + 1, j + 1] = both - least < 0.001, only - least < 0.001
    path, i, j = [], n, m
    while i and j:
        if pairs[i, j]:
            i, j = i - 1, j - 1
            path.append((i, j))
        elif alone[i, j]:
            i -= 1
        else:
            j -= 1
    most = max(target.sum(), query.sum())
    return (max(1 - cost[n, m] / most, 0) * 100 if most else 0.0), path[::-1]


def match_indices(target: list[str], query: Query) -> tuple[float, list[int]]:
    """The score of one target and which of its sounds matched; for the few rows of a page.

    A pair of the better of alignment and window, the window on a tie, counts as a match if it is more similar than 0.4 and the query's sound has weight.
    """
    n, m = len(target), len(query.phonemes)
    if not n or not m:
        return 0.0, []
    if "".join(target) == query.joined:
        return 100.0, list(range(n))
    ids = lambda xs: [INDEX.get(p, len(PHONEMES)) for p in xs]
    like = np.where(np.equal.outer(np.array(target, object), np.array(query.phonemes, object)), 1.0, matrix(query.config)[np.ix_(ids(target), ids(query.phonemes))])
    weight = np.array(query.weights, float)
    score, found = traced(like, np.array([query.vowel_weight if p in VOWELS else query.consonant_weight for p in target], float), weight)
    own = sum(query.weights)
    if own > 0 and n >= m:
        shares = [sum(like[s + j, j] * w for j, w in enumerate(query.weights)) / own * 100 for s in range(n - m + 1)]
        if max(shares) >= score:
            s = int(np.argmax(shares))
            score, found = shares[s], [(s + j, j) for j in range(m)] if shares[s] > 0 else []
    elif score <= 0:
        found = []
    return score, [i for i, j in found if like[i, j] > 0.4 and weight[j] > 0]


def boundary(code: Column, query: Query, side: str) -> Column:
    """boundary_best() of one sequence; 0 if it has fewer sounds than the query."""
    return F.coalesce(boundary_best(F.array(code), query, side), F.lit(0.0))


def boundary_best(codes: Column, query: Query, side: str) -> Column:
    """Best score of the last (side `end`) or first (`start`) sounds of a list of sequences, as many as the query has; null where none has as many."""
    n = len(query.phonemes)
    part = (lambda c: F.substring(c, -n, n)) if side == "end" else (lambda c: F.substring(c, 1, n))
    parts = F.transform(F.filter(codes, lambda c: F.length(c) >= n), part)

    @F.arrow_udf("double")
    def run(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        if not len(flat):
            return pa.nulls(len(lists), pa.float64())
        # equal segments are scored once in a batch
        held = flat.dictionary_encode()
        top = score_codes(held.dictionary, query, shortcut=False)
        top[np.array([c == query.code for c in held.dictionary.to_pylist()], bool)] = 100.0
        scores, some = top[held.indices.to_numpy(zero_copy_only=False)], sizes > 0
        out = np.zeros(len(sizes))
        out[some] = np.maximum.reduceat(scores, (np.cumsum(sizes) - sizes)[some])
        return pa.array(out, pa.float64(), mask=~some)

    return once(run)(parts)
