"""Grapheme to phoneme: vocabulary, split, greedy inference and error rates.

The network is a bidirectional GRU encoder and a GRU decoder with multiplicative attention whose context
is fed back as input. Weights come as a dictionary of arrays; inference runs over batches of words inside an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")


def part_of(word: Column) -> Column:
    """train, dev or test: by the first two bytes of the word's SHA-1, mod 100, below 90, below 95, else."""
    n = F.conv(F.substring(F.sha1(word.cast("binary")), 1, 4), 16, 10).cast("int") % 100
    return F.when(n < 90, "train").when(n < 95, "dev").otherwise("test")


def training_pairs(table: DataFrame) -> DataFrame:
    """Usable (lang, word, phonemes) rows, the first of each word: no unknown symbols, at most 32 characters, no white space.

    table has lang, word, phonemes, unknown and ord, by which the first is chosen.
    """
    ok = table.where(F.col("lang").isin("ko", "en") & (F.size("phonemes") > 0) & (F.size("unknown") == 0) & (F.length("word") <= 32) & ~F.col("word").rlike(r"\s"))
    first = ok.groupBy("lang", "word").agg(F.min_by("phonemes", "ord").alias("phonemes"))
    return first.withColumn("part", part_of(F.col("word")))


def symbols(tokens: DataFrame, column: str = "token") -> DataFrame:
    """symbol, id: the specials first, then the distinct tokens in order. A vocabulary is small."""
    from pyspark.sql import Window

    found = tokens.select(F.col(column).alias("symbol")).distinct()
    own = found.withColumn("id", F.row_number().over(Window.orderBy("symbol")) + len(SPECIALS) - 1)
    fixed = tokens.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "symbol string, id int")
    return fixed.unionByName(own)


def distance(a: Column, b: Column, inventory: list[str]) -> Column:
    """Edit distance of two lists of sounds: each sound is one character, then levenshtein."""
    letters = F.create_map(*(x for i, p in enumerate(inventory) for x in (F.lit(p), F.lit(chr(0x4E00 + i)))))
    spell = lambda xs: F.array_join(F.transform(xs, lambda p: F.coalesce(F.try_element_at(letters, p), F.lit("?"))), "")
    return F.levenshtein(spell(a), spell(b))


def error_rates(rows: DataFrame, distance: str = "d", size: str = "n") -> DataFrame:
    """exact, error_rate (all edits over all sounds) and mean_rate of rows with a distance and the gold's size."""
    d, n = F.col(distance), F.col(size)
    return rows.agg(F.avg((d == 0).cast("double")).alias("exact"), (F.sum(d) / F.sum(n)).alias("error_rate"), F.avg(d / n).alias("mean_rate"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru(x: np.ndarray, h: np.ndarray, w: dict[str, np.ndarray], name: str) -> np.ndarray:
    """One step of a gated recurrent unit; gates in the order reset, update, new."""
    a, b = x @ w[f"{name}.wi"].T + w[f"{name}.bi"], h @ w[f"{name}.wh"].T + w[f"{name}.bh"]
    k = h.shape[-1]
    reset, update = sigmoid(a[..., :k] + b[..., :k]), sigmoid(a[..., k : 2 * k] + b[..., k : 2 * k])
    new = np.tanh(a[..., 2 * k :] + reset * b[..., 2 * k :])
    return (1 - update) * new + update * h


def decode(tokens: list[int], w: dict[str, np.ndarray], bos: int = 1, eos: int = 2) -> list[int]:
    """Greedy output ids of one word, at most twice its tokens and eight."""
    k = w["forward.wh"].shape[1]
    x = w["source"][tokens]
    there, back, h = [], [], np.zeros(k)
    for v in x:
        h = gru(v, h, w, "forward")
        there.append(h)
    g = np.zeros(k)
    for v in x[::-1]:
        g = gru(v, g, w, "backward")
        back.append(g)
    states = np.concatenate((np.array(there), np.array(back[::-1])), axis=1)
    keys = states @ w["attention"].T
    s = np.tanh(w["bridge"] @ np.concatenate((h, g)) + w["bridge.b"])
    context, out, last = np.zeros(w["combine"].shape[0]), [], bos
    for _ in range(2 * len(tokens) + 8):
        s = gru(np.concatenate((w["target"][last], context)), s, w, "decoder")
        score = keys @ s
        p = np.exp(score - score.max())
        context = np.tanh(w["combine"] @ np.concatenate(((p / p.sum()) @ states, s)))
        last = int((w["output"] @ context + w["output.b"]).argmax())
        if last == eos:
            break
        out.append(last)
    return out


def shapes(source: int, target: int, embed: int, hidden: int) -> dict[str, tuple[int, ...]]:
    cell = lambda name, size: {f"{name}.wi": (3 * hidden, size), f"{name}.bi": (3 * hidden,), f"{name}.wh": (3 * hidden, hidden), f"{name}.bh": (3 * hidden,)}
    return {"source": (source, embed), "target": (target, embed), **cell("forward", embed), **cell("backward", embed), **cell("decoder", embed + hidden), "bridge": (hidden, 2 * hidden), "bridge.b": (hidden,), "attention": (hidden, 2 * hidden), "combine": (hidden, 3 * hidden), "output": (target, hidden), "output.b": (target,)}


def load(raw: bytes, sizes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Weights from little-endian 32-bit floats that stand one after the other."""
    flat, at, out = np.frombuffer(raw, "<f4").astype(float), 0, {}
    for name, shape in sizes.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    if at != len(flat):
        raise ValueError("the weights don't have the model's size")
    return out


def save(weights: dict[str, np.ndarray]) -> tuple[bytes, str]:
    """Weights as little-endian 32-bit floats one after the other, and where each stands, as JSON {name: [offset, shape]}."""
    import json

    offsets, at = {}, 0
    for name, w in weights.items():
        offsets[name] = [at, list(w.shape)]
        at += w.size
    return b"".join(np.ascontiguousarray(w, "<f4").tobytes() for w in weights.values()), json.dumps(offsets)


def sizes_of(offsets: str) -> dict[str, tuple[int, ...]]:
    """The shapes for load() of what save() has written, in the order in which they stand."""
    import json

    found = sorted(json.loads(offsets).items(), key=lambda x: x[1][0])
    at = 0
    for name, (start, shape) in found:
        if start != at:
            raise ValueError(f"a gap before {name}")
        at += int(np.prod(shape))
    return {name: tuple(shape) for name, (_, shape) in found}


def write_pairs(pairs: DataFrame, path: str) -> None:
    """training_pairs() by part and language, with sounds as one text."""
    pairs.withColumn("phonemes", F.array_join("phonemes", " ")).write.mode("overwrite").partitionBy("part", "lang").parquet(path)


def read_pairs(spark, path: str, part: str | None = None) -> DataFrame:
    found = spark.read.schema("word string, phonemes string, part string, lang string").parquet(path)
    found = found if part is None else found.where(F.col("part") == part)
    return found.withColumn("phonemes", F.filter(F.split("phonemes", " "), lambda p: p != ""))


def part_counts(pairs: DataFrame) -> DataFrame:
    """lang, part, n."""
    return pairs.groupBy("lang", "part").agg(F.count("*").alias("n"))


def predictor(raw: bytes, sizes: dict, source: dict[str, int], target: list[str]) -> Callable[[Column], Column]:
    """A function of a column of token lists that gives phoneme lists; the weights are loaded once for each batch stream."""

    @F.arrow_udf("array<string>")
    def run(tokens: pa.Array) -> pa.Array:
        w = load(raw, sizes)
        unk = source.get("<unk>", 3)
        return pa.array([None if t is None else [target[i] for i in decode([source.get(x, unk) for x in t], w)] if t else [] for t in tokens.to_pylist()], pa.list_(pa.string()))

    return run
