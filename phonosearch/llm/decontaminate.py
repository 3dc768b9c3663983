"""Benchmark decontamination by a prefix-filtered set join.

An item's window of words is a set of shingles (runs of three words). A document holds the window only
if it holds all of them, so the necessary prefix of the window's shingles, ordered from the rarest in the
corpus, is one shingle: the rarest. Documents are joined with windows on that shingle alone. Its
place in the document and its offset in the window give the only place where the window can begin; the
length and positional bounds require it to lie within the document; then all of its words are compared, as 64-bit hashes.

The benchmark side is broadcast in blocks of at most ``block_bytes`` of text, as flat arrays of 30 bytes for each word or
less (16 MB of text: about 90 MB). A benchmark beyond that is as many blocks as it takes, each counted and streamed over all documents;
nothing is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map, small_batches, texts

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 16 << 20
SPANS = "array<struct<start:bigint,length:bigint>>"
#: Odd multipliers, one for each word of a shingle.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    words = alnum_words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hash(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` (three at most) hashed words."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h += words[i : i + n] * FACTORS[i]
    return h


class Windows:
    """The windows of a block of items as flat arrays: 30 bytes for each word of the items, or less.

    `words` are the items' words one after the other, as 64-bit hashes; a window is the place where it begins. After order(), for each
    shingle size, `keys` are the windows' rarest shingles, and the windows of key k are `place` and `offset` (of the shingle in the window) from first[k] on.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int = SHINGLE) -> None:
        held = [(item, h) for item, h in ((i, word_hashes(t)) for i, t in items) if len(h)]
        self.items = [i for i, _ in held]
        self.words = np.concatenate([*(h for _, h in held), np.zeros(0, np.uint64)])
        size = np.array([len(h) for _, h in held], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(size)))
        self.window = np.minimum(size, window)  # words of each item's windows
        self.shingle = np.minimum(self.window, min(shingle, len(FACTORS)))
        self.sizes = sorted(set(self.shingle.tolist()))
        self.keys: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        self.offset: dict[int, np.ndarray] = {}

    def shingles(self) -> np.ndarray:
        """All distinct shingles of the windows, sorted."""
        out = [np.zeros(0, np.uint64)]
        for s in self.sizes:
            out.append(shingle_hash(self.words, s)[self.inside(s, s)])
        return np.unique(np.concatenate(out))

    def inside(self, size: int, words: int) -> np.ndarray:
        """The places where a run of so many words begins that lies within one item whose shingles have `size` words."""
        at = np.arange(max(0, len(self.words) - words + 1))
        item = np.searchsorted(self.begins, at, "right") - 1
        return at[(at + words <= self.begins[item + 1]) & (self.shingle[item] == size)]

    def order(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        """Chooses each window's rarest shingle, the first on a tie; a window with one that no document has can't occur."""
        for s in self.sizes:
            h = shingle_hash(self.words, s)
            n = counts[np.minimum(np.searchsorted(shingles, h), len(shingles) - 1)]
            places, offsets = [], []
            for words in sorted(set(self.window[self.shingle == s].tolist())):
                at = self.inside(s, words)
                at = at[self.window[np.searchsorted(self.begins, at, "right") - 1] == words]
                least, offset = n[at], np.zeros(len(at), np.int16)
                for i in range(1, words - s + 1):
                    fewer = n[at + i] < least
                    offset[fewer] = i
                    least = np.minimum(least, n[at + i])
                places.append(at[least > 0])
                offsets.append(offset[least > 0])
            place, offset = np.concatenate(places), np.concatenate(offsets)
            key = h[place + offset]
            by = np.argsort(key, kind="stable")
            self.keys[s], first = np.unique(key[by], return_index=True)
            self.first[s] = np.append(first, len(key)).astype(np.int32)
            self.place[s], self.offset[s] = place[by].astype(np.int32), offset[by]

    def find(self, words: np.ndarray, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of all places where a window of an item stands."""
        items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, keys in self.keys.items():
            if not len(keys) or len(words) < s:
                continue
            h = shingle_hash(words, s)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.flatnonzero(keys[k] == h)
            if not len(at):
                continue
            times = np.diff(self.first[s])[k[at]].astype(np.int64)
            total = np.cumsum(times)
            lo = 0
            while lo < len(at):  # a bounded number of candidates at a time
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
                n = times[lo:hi]
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[s][k[at[lo:hi]]], n)
                start = np.repeat(at[lo:hi], n) - self.offset[s][entry]
                place = self.place[s][entry].astype(np.int64)
                item = np.searchsorted(self.begins, place, "right") - 1
                size = self.window[item]
                ok = (start >= 0) & (start + size <= len(words))
                place, item, start, size = place[ok], item[ok], start[ok], size[ok]
                for i in range(int(size.max(initial=0))):
                    same = (i >= size) | (words[np.minimum(start + i, len(words) - 1)] == self.words[np.minimum(place + i, len(self.words) - 1)])
                    place, item, start, size = place[same], item[same], start[same], size[same]
                items.append(item)
                starts.append(start)
                lo = hi
        return np.concatenate(items), np.concatenate(starts)


def merged(spans) -> list[tuple[int, int]]:
    """Spans as (start, length), joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b - a) for a, b in out]


def shingle_counts(docs: DataFrame, w: Windows, shingles: np.ndarray) -> np.ndarray:
    """How often each of the sorted shingles occurs over all documents; gathers a row for each at most."""
    shared = docs.sparkSession.sparkContext.broadcast((shingles, w.sizes))

    def rows(read):
        keys, sizes = shared.value
        total = np.zeros(len(keys), np.int64)
        for (text,) in read:
            words = word_hashes(text)
            for s in sizes:
                h = shingle_hash(words, s)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                at = at[keys[at] == h]
                if len(at):
                    np.add.at(total, at, 1)
        for i in np.flatnonzero(total).tolist():
            yield i, int(total[i])

    found = arrow_map(docs.select("text"), rows, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = np.zeros(len(shingles), np.int64)
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings), spans (start, length in words): a row for each row of docs.

    docs needs doc_id and text, benchmark item_id and text; other columns are not looked at. Null and
    empty texts have no words: such documents are clean and such items have no window. Items without an
    id are left out of item_ids, but their windows count for hits. Repeated items count once. With an
    empty benchmark all documents are clean; an empty docs gives an empty result.
    """
    out = texts(docs).withColumns({"items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast(SPANS)})
    blocks = list(windows_by_block(docs, benchmark, window, block_bytes))
    for b, shared in enumerate(blocks):
        last = b == len(blocks) - 1
        out = arrow_map(out, search(shared, last), f"doc_id bigint, text string, items array<string>, spans {SPANS}" + ", n_words bigint" * last, 500)
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"]), F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.array_sort("items").alias("item_ids"), "spans")


def windows_by_block(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int):
    """A broadcast Windows for each block of the benchmark, one at least, its shingles in order of rarity over docs."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        # a block is bounded: block_bytes of the benchmark's text, dealt by hash
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        w = Windows([(r.item, r.text) for r in part], window)
        if len(w.words):
            shingles = w.shingles()
            w.order(shingles, shingle_counts(texts(docs), w, shingles))
        yield spark.sparkContext.broadcast(w)


def search(shared, last: bool):
    """Adds what the windows of a block hit to a row's items and spans; the last block drops the text."""

    def rows(read):
        w: Windows = shared.value
        for doc_id, text, items, spans in read:
            words = word_hashes(text)
            got, at = set(items or ()), [(x["start"], x["length"]) for x in spans or ()]
            item, start = w.find(words)
            if len(item):
                got.update(x for i in np.unique(item).tolist() if (x := w.items[i]) is not None)
                at += set(zip(start.tolist(), w.window[item].tolist()))
            row = (doc_id, None if last else text, list(got), [{"start": a, "length": n} for a, n in merged(at)])
            yield (*row, len(words)) if last else row

    return rows


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns.

    A row is judged by its own text where it is, without a join; null and empty texts stay.
    """
    at = docs.columns.index("text")
    out = small_batches(docs)
    for shared in windows_by_block(docs, benchmark, window, block_bytes):
        out = out.mapInArrow(clean_rows(shared, at), docs.schema)
    return out


def clean_rows(shared, at: int):
    def run(batches):
        w: Windows = shared.value
        for b in batches:
            keep = [not len(w.find(word_hashes(t))[0]) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run
