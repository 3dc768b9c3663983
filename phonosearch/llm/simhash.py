"""Near duplicates by SimHash and an inverted index of positional bytes.

A fingerprint has 64 bits, that is eight bytes at eight positions. Two fingerprints that differ in at
most ``max_bits`` bits differ in at most that many bytes, so they share at least ``8 - max_bits``
(position, byte) entries: the guaranteed minimum. The inverted index posts every distinct fingerprint
under combinations of one entry fewer than that, as few combinations as it takes for every choice of the minimum to
hold one: a pair that reaches the minimum meets in a posting list. Within a list the shared entries of a pair are
tallied, pairs below the minimum go (by chance most share no more than what brought them together), and of the
others the differing bits are counted.

Exact copies are one fingerprint, so they never meet. A list emits a spanning forest of its links, not
its pairs: a breadth-first search compares a fingerprint with those that are not yet reached. Lists
beyond ``bucket_rows`` are dealt out in tiles of two blocks each, so that no task holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, rows_of, small, space_words, texts

SHINGLE, MAX_BITS, SEED = 4, 4, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of all word shingles of the whole text, as a signed 64-bit number; 0 without words."""
    words = space_words(text)
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        value = xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return value - (1 << 64) if value >> 63 else value
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (uint64), as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp bigint: a row for each row of docs."""

    def rows(read):
        for doc_id, text in read:
            yield doc_id, fingerprint(text, shingle)

    return arrow_map(texts(docs), rows, "doc_id bigint, fp bigint", 20_000)


def close(one: np.ndarray, other: np.ndarray, least: int, max_bits: int) -> np.ndarray:
    """Where fingerprints share at least `least` positional bytes and differ in at most max_bits bits."""
    x = np.atleast_1d(one ^ other).view(np.uint64)
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (tally >= least) & (np.bitwise_count(x) <= max_bits)


def forest(fps: np.ndarray, least: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what any links of a posting list connect."""
    out: list[tuple[int, int]] = []
    rest = np.unique(fps)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = close(rest, at, least, max_bits)
            if hit.any():
                found = rest[hit]
                out.extend((int(at), int(f)) for f in found)
                queue.extend(found)
                rest = rest[~hit]
    return out


class Roots:
    """Union-find over the links that one task has seen; it keeps what a task emits to a forest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (r := up.get(root, root)) != root:
            root = r
        while (r := up.get(x, x)) != root:
            up[x] = root
            x = r
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


LINK = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("block", pa.int64())])
LINK_DDL = "u bigint, v bigint, k bigint, block bigint"


def links_of(keys: np.ndarray, fps: np.ndarray, roots: Roots, least: int, max_bits: int) -> Iterator[tuple[int, int]]:
    """New links among rows that are sorted by key."""
    if len(keys) < 2:
        return
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edge)
    firsts = edge[:-1]
    small = sizes <= 32
    for d in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero((keys[d:] == keys[:-d]) & np.repeat(small, sizes)[: len(keys) - d])
        if len(a):
            ok = a[close(fps[a], fps[a + d], least, max_bits)]
            for u, v in zip(fps[ok].tolist(), fps[ok + d].tolist()):
                if u != v and roots.join(u, v):
                    yield u, v
    for i in np.flatnonzero(~small):
        for u, v in forest(fps[firsts[i] : firsts[i] + sizes[i]], least, max_bits):
            if roots.join(u, v):
                yield u, v


def lists_to_links(least: int, max_bits: int, bucket_rows: int, chunk: int = 1 << 20):
    """Streams posting lists sorted by key; emits links, or the rows of a list that is too long with their block."""

    def run(batches):
        roots, held, count = Roots(), [], 0
        over_key, over_rows = None, 0

        def out(pairs):
            pairs = list(pairs)
            if pairs:
                u, v = zip(*pairs)
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none, none], schema=LINK)

        def spill(keys, fps, before=0):
            block = (before + np.arange(len(fps))) // bucket_rows
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(keys), pa.array(block)], schema=LINK)

        def flush(last):
            nonlocal held, count, over_key, over_rows
            if not held:
                return
            keys, fps = (np.concatenate(x) for x in zip(*held))
            held, count = [], 0
            if over_key is not None:  # the list that was too long goes on
                n = int(np.searchsorted(keys != over_key, True)) if (keys != over_key).any() else len(keys)
                yield from spill(keys[:n], fps[:n], over_rows)
                over_rows += n
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    return
                over_key = None
            if not last:
                tail = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                if len(keys) - tail > bucket_rows:
                    over_key, over_rows = keys[-1], len(keys) - tail
                    yield from spill(keys[tail:], fps[tail:])
                else:
                    held, count = [(keys[tail:], fps[tail:])], len(keys) - tail
                keys, fps = keys[:tail], fps[:tail]
            if len(keys):
                edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
                for i in np.flatnonzero(np.diff(edge) > bucket_rows):
                    yield from spill(keys[edge[i] : edge[i + 1]], fps[edge[i] : edge[i + 1]])
                keep = np.repeat(np.diff(edge) <= bucket_rows, np.diff(edge))
                yield from out(links_of(keys[keep], fps[keep], roots, least, max_bits))

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            count += b.num_rows
            if count >= chunk:
                yield from flush(False)
        yield from flush(True)

    return run


def tiles_to_links(least: int, max_bits: int):
    """A tile holds two blocks of a long list; its links are searched as those of a list."""

    def run(key, table):
        fps = table.column("u").to_numpy()
        pairs = forest(fps, least, max_bits)
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def positions(least: int) -> list[tuple[int, ...]]:
    """Combinations of least - 1 byte positions (one at least) such that any `least` of the eight positions hold one of them: the greedy choice."""
    open_sets = [set(c) for c in combinations(range(8), least)]
    out = []
    while open_sets:
        out.append(max(combinations(range(8), max(1, least - 1)), key=lambda c: sum(s.issuperset(c) for s in open_sets)))
        open_sets = [s for s in open_sets if not s.issuperset(out[-1])]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = 1 << 16) -> DataFrame:
    """u, v bigint: links between distinct fingerprints (column fp) that connect what all links connect."""
    least = 8 - max_bits
    if least < 1:
        raise ValueError("max_bits must be below 8, the number of byte positions")
    masks = [F.lit(m - (1 << 64) if m >> 63 else m) for m in (sum(0xFF << (8 * p) for p in c) for c in positions(least))]
    posts = fps.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(m)) for i, m in enumerate(masks)))).alias("k")).select("k", "fp")
    found = cut(posts.repartition("k").sortWithinPartitions("k").mapInArrow(lists_to_links(least, max_bits, bucket_rows), LINK_DDL))
    short = found.where("block is null").select("u", "v")
    long = found.where("block is not null")
    if long.isEmpty():
        return short
    blocks = long.groupBy("k").agg((F.max("block") + 1).alias("n"))
    tiles = (
        long.join(blocks, "k")
        .select("k", "u", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        .where("block <> other or n = 1")
        .select("k", "u", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    return short.unionByName(tiles.groupBy("k", "i", "j").applyInArrow(tiles_to_links(least, max_bits), "u bigint, v bigint"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root bigint for every node of the edges u, v: root is the smallest node that it reaches.

    Alternates large-star and small-star steps; each step is written to the shared folder. The steps
    take the minimum of a node's neighbours by a partial aggregate, so a node with many links is no
    list in one task.
    """
    at = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        at = cut(small)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id, for each row of docs.

    component_id is the smallest doc_id that links of at most max_bits differing bits reach, the row's
    own included. Null or empty texts have fingerprint zero and are linked like any other. Rows without
    doc_id get a row too and count for links, but never give a component its id; a component of such
    rows alone has a null id. Repeated rows give repeated rows. Columns other than doc_id and text are
    not looked at. An empty table gives an empty result.
    """
    own = cut(fingerprints(docs, shingle))
    reps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("times")))
    linked = components(links(reps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = cut(linked.join(reps.select("fp", "least_id"), "fp"))
    named = linked.join(linked.groupBy("root").agg(F.min("least_id").alias("id")), "root").select("fp", "id")
    # only fingerprints with copies or links name their rows; a row without either is its own component
    shared = reps.join(named, "fp", "left").where("times > 1 or id is not null").select("fp", F.struct(F.coalesce("id", "least_id").alias("id")).alias("found"))
    component = F.when(F.col("found").isNull(), F.col("doc_id")).otherwise(F.col("found.id"))
    return own.join(small(shared), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all columns: the one with the smallest doc_id.

    Of rows that share that id the one with the smaller hash of its text stays; rows without doc_id come last. Equal rows
    (doc_id and text) are one and stay once. An empty table gives an empty result; columns other than doc_id and text are
    kept, whatever their names.
    """
    own = cut(arrow_map(texts(docs, F.xxhash64("text").alias("th")), lambda read: ((i, th, fingerprint(t)) for i, t, th in read), "doc_id bigint, th bigint, fp bigint", 20_000))
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    reps = cut(own.groupBy("fp").agg(F.min(head).alias("head")))
    linked = cut(components(links(reps.select("fp"))).withColumnRenamed("node", "fp").join(reps, "fp"))
    named = linked.join(linked.groupBy("root").agg(F.min("head").alias("group")), "root").select("fp", "group")
    kept = reps.join(named, "fp", "left").where("group is null or head = group").select("head.doc_id", "head.th")
    return rows_of(docs, own, kept)
