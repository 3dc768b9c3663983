"""Packing by cutting-stock column generation.

Every document is tokenized once. Its full blocks of `capacity` tokens are sequences by themselves; the
remainder is cut to the largest class length (all lengths to 32, coarser ones beyond) and a rest of under
16 tokens. Pieces are counted by class, which gives a histogram of bounded size whatever the corpus. Over it the
driver solves the cutting-stock linear program: a pattern says how many pieces of each class fill a
sequence, a knapsack dynamic program over the duals prices the next patterns, and generation ends when the plan
is proven to be within a thousandth of the optimum. Pattern counts are rounded down; first-fit decreasing places the
few pieces that are left. Documents are ranked within their class and the ranks are dealt to the
patterns' slots, in Spark: a slot says the sequence and the offset, so nothing is sorted by sequence.
"""

from __future__ import annotations

import zlib
from array import array
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, texts

CAPACITY, END_ID = 2048, 1
#: Distinct words whose ids a worker remembers in each of two generations.
REMEMBER = 150_000
#: Pieces that one task ranks at most, about.
RANKED = 100_000
#: The linear program is solved to within this share of its optimum (the bound is optimum >= value / best pattern's worth).
GAP = 1e-3


#: Marks that often stand behind a word, each a token's beginning of its own.
MARKS = (b".", b",", b";", b":", b"!", b"?")


class WordIds:
    """Ids of the words between ASCII white space, by a BPE vocabulary with word ends and lower-casing.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its words'
    ids in order. A plain word is split as the vocabulary's pattern does and merged by rank; any other
    word goes through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken

        self.path, self.slow = path, None
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        end = b"\xff"  # no byte of UTF-8: stands for a word's end; by itself it is no token, so ids are ranks less one
        ranks = {end: 0}
        for token, i in model["vocab"].items():
            body, last = (token[: -len("</w>")], end) if token.endswith("</w>") else (token, b"")
            ranks[bytes(byte_of[c] for c in body) + last] = i + 1
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.known = Remembered(self.word)

    def tokenizer(self):
        """The tokenizer itself, loaded where a word needs it."""
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def word(self, word: bytes) -> bytes:
        """A word's ids plus one."""
        body, mark = (word[:-1], word[-1:]) if word[-1:] in MARKS else (word, b"")
        if body.isalpha():  # letters of ASCII, and one mark at most behind them
            ids = self.merge(body.lower() + b"\xff")
            return array("I", ids + self.merge(mark + b"\xff") if mark else ids).tobytes()
        text = word.decode("utf-8", "replace")
        if max(text) > "ſ" or "İ" in text or "<|" in text:
            ids = [i + 1 for i in self.tokenizer().encode(text, add_special_tokens=False).ids]
        else:
            ids = [i for p in self.pieces(text.lower()) for i in self.merge(p.encode() + b"\xff")]
        return array("I", ids).tobytes()

    def text(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit numbers."""
        raw = (text or "").encode("utf-8", "replace")
        # the vocabulary lower-cases anyway, but finds special tokens before that
        words = (raw if b"<|" in raw else raw.lower()).split()
        return (np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") - np.uint32(1)).tobytes()


class Remembered(dict):
    """Word ids plus one by word. A full generation becomes the older one, whose words come back when they are met again."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        ids = self[word] = self.older.get(word) or self.make(word)
        return ids


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in printable else chr(256 + n))
        n += b not in printable
    return out


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process, kept between its tasks."""
    return _made.get(path) or _made.setdefault(path, WordIds(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row (a row's own number), start, length, ids_crc32, doc_tokens.

    A document is cut into full blocks, the largest class length that fits what remains, and the rest of
    under 16 tokens, so that every piece has exactly its class's length.
    """
    tops = class_tops(capacity)

    def rows(read):
        ids = word_ids(tokenizer)
        for doc_id, text, row in read:
            raw = ids.text(text) + END_ID.to_bytes(4, "little")
            n = len(raw) // 4
            start = 0
            while start < n:
                length = int(tops[np.searchsorted(tops, n - start, "right") - 1])
                yield doc_id, row, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n
                start += length

    return arrow_map(texts(docs).withColumn("row", F.monotonically_increasing_id()), rows, "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", 20_000)


def class_tops(capacity: int = CAPACITY) -> np.ndarray:
    """The length of each class: all to 32, multiples of 4 to 128, multiples of 16 beyond, and the capacity."""
    tops = [*range(1, 33), *range(36, 128, 4), *range(128, capacity, 16)]
    return np.array([*(t for t in tops if t < capacity), capacity], np.int64)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """An unbounded knapsack dynamic program: patterns (rows) of great value within the capacity, and the greatest value.

    One item after the other: with q pieces of size s before room c = q s + r, best[c] - q v only grows along q, so a
    running maximum over the rows of a folded table does all rooms at once. The first pattern has the greatest
    value; each other one is the best among those that hold a given item, all read off the same table.
    """
    order = np.flatnonzero(values > 1e-12)
    if not len(order):
        return np.zeros((0, len(sizes)), np.int64), np.zeros(0)
    v, s = values[order], sizes[order]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for k in np.argsort(-v / s, kind="stable"):
        rows = -(-(capacity + 1) // s[k])
        gain = v[k] * np.arange(rows)[:, None]
        folded = np.full(rows * s[k], -np.inf)
        folded[: capacity + 1] = best
        grown = (np.maximum.accumulate(folded.reshape(rows, -1) - gain, axis=0) + gain).ravel()[: capacity + 1]
        better = grown > best + 1e-12
        best[better], took[better] = grown[better], k
    # a room that no piece ends at is worth what the one below it is
    top = np.maximum.accumulate(best)
    at = np.searchsorted(top, top - 1e-12)
    worth = v + top[capacity - s]
    found, values_of = [], []
    for first in np.argsort(-worth, kind="stable"):
        if found and worth[first] <= 1 + 1e-9:
            break
        pattern, c = np.zeros(len(sizes), np.int64), int(capacity - s[first])
        pattern[order[first]] += 1
        while (c := int(at[c])) > 0 and took[c] >= 0:
            pattern[order[took[c]]] += 1
            c -= int(s[took[c]])
        found.append(pattern)
        values_of.append(pattern @ values)
    return np.array(found), np.array(values_of)


def first_basis(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis (patterns as columns): the largest class that is left, filled up with the next ones, as long as none runs out.

    Each pattern exhausts a class that no later one holds, so the basis is a triangular matrix.
    """
    m, left = len(sizes), demand.astype(float).copy()
    basis = np.zeros((m, m))
    done = np.zeros(m, bool)
    while not done.all():
        room, pattern = capacity, np.zeros(m)
        for i in np.flatnonzero(~done)[::-1]:
            pattern[i] = room // sizes[i]
            room -= pattern[i] * sizes[i]
        runs = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        i = int(runs.argmin())
        basis[:, i] = pattern
        left = np.maximum(left - runs[i] * pattern, 0)
        left[i], done[i] = 0, True
    return basis


def solve(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows), how often each is used in the linear program min sum x, sum x * pattern = demand, and a lower bound of it.

    A revised simplex with column generation. It ends on the gap alone: a plan of total z whose best pattern is worth w
    at the plan's prices can't be beaten below z / w. Demands are spread by a millionth while it runs, so that no two
    classes run out at once and every pivot gains; the result is that of the demands themselves.
    """
    m = len(sizes)
    spread = demand * (1 + 1e-6 * (np.arange(m) * 0.6180339887 % 1))
    basis = first_basis(spread, sizes, capacity)
    bound, pivots = 0.0, 0
    inverse = np.linalg.inv(basis)
    while True:
        x = np.maximum(inverse @ spread, 0)
        columns, worth = price(inverse.sum(axis=0), sizes, capacity)
        bound = max(bound, x.sum() / max(1.0, worth.max(initial=1.0)))
        if x.sum() <= (1 + gap) * bound:
            break
        before = pivots
        while True:  # all columns of one pricing that still gain at the prices of the moment
            worth = columns @ inverse.sum(axis=0)
            k = int(worth.argmax())
            if worth[k] <= 1 + gap / 2:
                break
            direction = inverse @ columns[k]
            ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
            out = int(ratio.argmin())
            x = np.maximum(x - ratio[out] * direction, 0)
            x[out] = ratio[out]
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
            basis[:, out] = columns[k]
            pivots += 1
            if pivots % 100 == 0:
                inverse = np.linalg.inv(basis)
                x = np.maximum(inverse @ spread, 0)
        if pivots == before:  # rounding errors only: the prices of a fresh inverse decide
            break
        inverse = np.linalg.inv(basis)
    return basis.T.astype(np.int64), np.maximum(inverse @ demand, 0), bound


def plan(histogram: dict[int, int], tops: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each class, how many such sequences): covers the histogram of classes exactly."""
    classes = sorted(histogram)
    if not classes:
        return []
    sizes, demand = tops[classes], np.array([histogram[c] for c in classes], np.int64)
    patterns, x, _ = solve(demand.astype(float), sizes, capacity)
    out, left = [], demand.copy()
    for k in np.argsort(-x):
        holds = patterns[k] > 0
        use = min(int(x[k] + 1e-9), int((left[holds] // patterns[k][holds]).min()))
        if use > 0:
            out.append(({classes[i]: int(n) for i, n in enumerate(patterns[k]) if n}, use))
            left -= use * patterns[k]
    while left.any():  # first fit, largest first: what rounding down has left, a bounded number of sequences
        room, held = capacity, {}
        for i in range(len(classes) - 1, -1, -1):
            n = min(int(left[i]), room // int(sizes[i]))
            if n:
                held[classes[i]] = n
                room -= n * int(sizes[i])
        use = min(int(left[i]) // n for i, n in ((classes.index(c), n) for c, n in held.items()))
        for c, n in held.items():
            left[classes.index(c)] -= use * n
        out.append((held, use))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    docs needs doc_id and text; null and empty texts are the end id alone. Repeated rows and rows without
    doc_id are documents of their own; columns other than doc_id and text are not looked at. An empty table gives
    an empty result. Pieces of one class take their slots in the order of the rows, which decides all ties.
    """
    spark = docs.sparkSession
    tops = class_tops(capacity)
    # a class's number by its length
    by_length = np.searchsorted(tops, np.arange(capacity + 1))
    table = F.array(*(F.lit(int(c)) for c in by_length))
    own = cut(pieces(docs, tokenizer, capacity).withColumn("class", table[F.col("length").cast("int")]))
    histogram = {r["class"]: r["count"] for r in own.groupBy("class").count().collect()}  # a row for each class
    if not histogram:
        return own.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    # a class is ranked in as many parts as its size asks for, and a small one in up to 64, so that no task has most rows
    parts = F.create_map(*(F.lit(x) for c, n in histogram.items() for x in (c, max(-(-n // ranked), min(64, -(-n // 100))))))
    own = own.withColumn("salt", F.pmod(F.xxhash64("row", "start"), parts[F.col("class")]).cast("int"))
    before: list[tuple[int, int, int]] = []
    seen = dict.fromkeys(histogram, 0)
    for r in sorted(own.groupBy("class", "salt").count().collect(), key=lambda r: (r["class"], r["salt"])):  # pieces / ranked rows, and 64 for each class at most besides
        before.append((r["class"], r["salt"], seen[r["class"]]))
        seen[r["class"]] += r["count"]
    # slots: in pattern order, a class's ranks from `first` on go to sequences from `base` on, `each` to a sequence, from offset `at` on
    slots: dict[int, list[tuple[int, int, int, int]]] = {c: [] for c in histogram}
    seen, base = dict.fromkeys(histogram, 0), 0
    for held, use in plan(histogram, tops, capacity):
        at = 0
        for c, each in sorted(held.items(), reverse=True):
            slots[c].append((seen[c], base, each, at))
            seen[c] += each * use
            at += each * int(tops[c])
        base += use
    assert seen == histogram
    offsets = spark.createDataFrame(before, "class int, salt int, before bigint")
    # of bounded size: a row for each class, with its slots
    tables = spark.createDataFrame(list(slots.items()), "class int, slots array<struct<first:bigint,base:bigint,each:bigint,at:bigint>>")
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("row", "start")) - 1 + F.col("before")
    placed = own.join(F.broadcast(offsets), ["class", "salt"]).withColumn("rank", rank).join(F.broadcast(tables), "class")
    placed = placed.withColumn("slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1)).withColumn("nth", F.expr("rank - slot.first"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("slot.base + nth div slot.each").alias("sequence_id"), F.expr("slot.at + nth % slot.each * length").alias("offset"))
