"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(s(x) - t_k) with ordered thresholds t_0 < t_1 < ...; all grades share the weights
of s. Features are hashed: each distinct word of a text that the labelled sample shows in enough
documents and with a grade of their own, and a few scaled shares of the text's shape. Training is full-batch gradient descent with
momentum and a penalty, in numpy on the driver, over a bounded sample of labelled rows; scoring is
a pass over all texts.

Grades come from the labels: 0 for toxic text, 1 for text of low quality, 2 for good text.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

#: Bounds of the fit: labelled rows, and words that the model looks at.
SAMPLE_ROWS, BITS, LEAST_DOCS = 12_000, 22, 5
#: What a word must tell about the grade to get a weight (chance alone gives 20 to one word in twenty thousand).
LEAST_GAIN = 20.0
GRADES = 3
SHAPES = 5
STRIP = b".,;:!?\"'()[]"


def words_of(text: str | None) -> tuple[list[int], list[float]]:
    """Hashes of the distinct words of a whole text, and its shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    distinct = {w.strip(STRIP) for w in set(words)}
    distinct.discard(b"")
    size = max(1, len(raw) - raw.count(b" "))
    marks = sum(raw.count(bytes([c])) for c in b"#*$%&|<>!")
    upper = size - len(raw.translate(None, bytes(range(65, 91)))) + raw.count(b" ") if raw else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shape = [len(set(words)) / n, marks / size, max(0, upper) / size, 1 - len(set(lines)) / max(1, len(lines)), 1.0 if not words else 0.0]
    digest = xxhash.xxh32_intdigest
    mask = (1 << BITS) - 1
    return sorted({digest(w.lower()) & mask for w in distinct}), shape


def features(docs: DataFrame, *more: str) -> DataFrame:
    def rows(read):
        for doc_id, text, *rest in read:
            hashes, shape = words_of(text)
            yield doc_id, hashes, shape, *rest

    kinds = dict(docs.dtypes)
    return arrow_map(texts(docs, *more), rows, ", ".join(["doc_id bigint, words array<int>, shape array<double>", *(f"{c} {kinds[c]}" for c in more)]))


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, shape: np.ndarray, centre: np.ndarray, scale: np.ndarray, cuts: np.ndarray) -> None:
        self.words, self.weights, self.shape, self.centre, self.scale, self.cuts = words, weights, shape, centre, scale, cuts

    def above(self, held: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        if not held:
            return np.zeros((0, len(self.cuts)))
        sizes = [len(h) for h, _ in held]
        flat = np.fromiter((x for h, _ in held for x in h), np.int64, sum(sizes))
        s = ((np.array([x for _, x in held]) - self.centre) / self.scale) @ self.shape
        if len(self.words) and len(flat):
            at = np.searchsorted(self.words, flat)
            at[at == len(self.words)] = 0
            value = np.where(self.words[at] == flat, self.weights[at], 0.0)
            s = s + np.bincount(np.repeat(np.arange(len(held)), sizes), value, len(held))
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts, -40, 40)))


def associated(place: np.ndarray, grade_of: np.ndarray, grades: np.ndarray, n: int) -> np.ndarray:
    """How much each word tells about the grade: the log-likelihood ratio of its documents' grades to all documents'."""
    share = np.maximum(np.bincount(grades, minlength=GRADES) / max(1, len(grades)), 1e-9)
    counts = np.bincount(place * GRADES + grade_of, minlength=n * GRADES).reshape(n, GRADES).astype(float)
    expected = counts.sum(axis=1, keepdims=True) * share
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(counts > 0, counts * np.log(counts / expected), 0.0).sum(axis=1)


def objective(z, row, col, grades, weight, penalty, w, v, low, step) -> tuple[float, tuple]:
    """The weighted negative log-likelihood with its penalty, and its slopes by w, v, low and step (cuts: low, low + exp(step), ...).

    Row i has shape z[i] and the words col[row == i].
    """
    n = len(z)
    cuts = low + np.concatenate(([0.0], np.cumsum(np.exp(step))))
    s = z @ v + np.bincount(row, w[col], n)
    up = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40)))  # P(grade > k)
    full = np.concatenate((np.ones((n, 1)), up, np.zeros((n, 1))), axis=1)
    slope = full * (1 - full)
    i = np.arange(n)
    p = np.maximum(full[i, grades] - full[i, grades + 1], 1e-12)
    ds = -weight * (slope[i, grades] - slope[i, grades + 1]) / p
    dcut = np.array([(weight * (np.where(grades == k + 1, slope[:, k + 1], 0) - np.where(grades == k, slope[:, k + 1], 0)) / p).sum() for k in range(GRADES - 1)])
    gstep = np.array([dcut[j + 1 :].sum() for j in range(GRADES - 2)]) * np.exp(step)
    value = -(weight * np.log(p)).sum() + penalty / 2 * ((w * w).sum() + (v * v).sum())
    return float(value), (np.bincount(col, ds[row], len(w)) + penalty * w, z.T @ ds + penalty * v, dcut.sum(), gstep)


def train(held: list[tuple[list[int], list[float]]], grades: np.ndarray, least_docs: int = LEAST_DOCS, rounds: int = 400, penalty: float = 2e-4) -> Model:
    """Maximum likelihood of the cumulative-link model, by gradient steps scaled by each weight's past gradients.

    Rarer grades weigh as much in sum as common ones do by a square root, so that a few toxic texts count.
    """
    n = max(1, len(held))
    seen = np.concatenate([np.array(h, np.int64) for h, _ in held]) if held else np.zeros(0, np.int64)
    words, place, docs_with = np.unique(seen, return_inverse=True, return_counts=True)
    words = words[(docs_with >= least_docs) & (associated(place, np.repeat(grades, [len(h) for h, _ in held]), grades, len(words)) >= LEAST_GAIN)] if held else words
    shape = np.array([x for _, x in held]) if held else np.zeros((1, SHAPES))
    centre, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-3)
    z = (shape - centre) / scale
    row = np.repeat(np.arange(len(held)), [len(h) for h, _ in held])
    at = np.searchsorted(words, seen)
    at[at == len(words)] = 0
    hit = words[at] == seen if len(words) else np.zeros(len(seen), bool)
    row, col = row[hit], at[hit]
    share = np.bincount(grades, minlength=GRADES) / n if len(grades) else np.ones(GRADES) / GRADES
    weight = 1 / np.sqrt(np.maximum(share, 1e-6))[grades] if len(grades) else np.zeros(0)
    weight = weight / max(weight.sum(), 1e-9)
    w, v = np.zeros(len(words)), np.zeros(z.shape[1])
    low, step = 1.0, np.full(GRADES - 2, 1.0)  # cuts: low, low + exp(step), ... stay in order
    low = -1.0
    sums = [np.full(len(words), 1e-8), np.full(z.shape[1], 1e-8), 1e-8, np.full(GRADES - 2, 1e-8)]
    for _ in range(rounds if held else 0):
        _, (gw, gv, glow, gstep) = objective(z, row, col, grades, weight, penalty, w, v, low, step)
        for j, (x, g) in enumerate(((w, gw), (v, gv), (None, glow), (step, gstep))):
            sums[j] = 0.95 * sums[j] + 0.05 * g * g
            if j == 2:
                low -= 0.05 * g / np.sqrt(sums[j])
            else:
                x -= 0.05 * g / np.sqrt(sums[j])
    return Model(words, w, v, centre, scale, low + np.concatenate(([0.0], np.cumsum(np.exp(step)))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bad_share: float = 0.5) -> Model:
    """Learns from about sample_rows labelled documents, drawn by a hash of the id, grade by grade.

    Of the sample at most bad_share goes to each of the two lower grades, as far as they have rows. Null
    ids and labels are not used; of several labels of one id the lowest grade counts.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade.alias("grade")).where("doc_id is not null").where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sizes = {r.grade: r["count"] for r in named.groupBy("grade").count().collect()}
    room = {g: sample_rows * (1 - bad_share) if g == GRADES - 1 else sample_rows * bad_share / (GRADES - 1) for g in range(GRADES)}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.create_map(*(x for g in range(GRADES) for x in (F.lit(g), F.lit(int(min(1.0, room[g] / max(1, sizes.get(g, 0))) * (1 << 30))))))
    drawn = named.where(part < limit[F.col("grade")])  # a little over sample_rows rows of two numbers at most
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = sorted((r.doc_id, r.grade, r.words, r["shape"]) for r in features(own, "grade").collect())
    return train([(w, s) for _, _, w, s in rows], np.array([g for _, g, _, _ in rows], np.int64))


def grade(docs: DataFrame, model: Model, least: float = 0.5, hold: int = 500) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_not_toxic, p_good, selected (p_good >= least) for each row of docs.

    Null and empty texts have no words; they get the model's value for a text without words. Without
    labels all texts of one shape get the same values. Columns other than doc_id and text are not looked at. Repeated rows are graded each; an
    empty table gives an empty result; p_good equal to `least` selects.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(read):
        m: Model = shared.value
        ids, held = [], []

        def out():
            for doc_id, up in zip(ids, m.above(held).tolist()):
                yield doc_id, sum(up), up[0], up[-1], up[-1] >= least

        for doc_id, text in read:
            ids.append(doc_id)
            held.append(words_of(text))
            if len(ids) >= hold:
                yield from out()
                ids, held = [], []
        yield from out()

    return arrow_map(texts(docs), rows, "doc_id bigint, expected_grade double, p_not_toxic double, p_good double, selected boolean")
