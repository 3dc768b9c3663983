"""Interpolated modified Kneser-Ney trigram model over memory-mapped sorted hash arrays.

Model. c(uvw) counts a trigram, N(vw) the distinct words before a pair, N(w) the distinct words before a word; texts
begin after two start marks and end with an end token.

    p(w | uv) = (c(uvw) - D3) / c(uv) + g(uv) p(w | v)
    p(w | v)  = (N(vw) - D2) / N(v) + g(v) p(w)
    p(w)      = (N(w) - D1) / N + g / (V + 1)

The three discounts of each order come from its counts of counts, g gives back what they took, and V + 1 are the training
tokens' distinct values and one for all unknown. Nothing is left out, so each of the three sums to one.

Counting. A trigram is dealt by its middle word v: one shard then has all that follows each uv and all that precedes each
vw. A task emits, for each shard, the distinct trigrams of up to HOLD tokens as one block, so a shuffle moves blocks,
never occurrences. Words that are frequent in a sample have codes of two bytes in a block, others the first `width` bytes
of their hash. The most frequent ones (HOT) are dealt by u and v together instead; their pairs vw meet in a second shuffle
by w, which also counts N(w). Shards are as many as the corpus's bytes ask for. What the sample holds changes sizes, never counts.

Storage. A shard's n-grams are sorted hash arrays in the folder that the cluster shares: an index over the first
bits, 32 more bits for each n-gram, then counts; those of count one have none. Of pairs as contexts only those seen twice or more are stored: one
that is known as a pair but isn't there was seen once. Two of a shard's n-grams are taken for one another with a chance of about one in
5e8. Workers map the files into memory and look hashes up shard by shard; pages are the system's to keep or drop.
"""

from __future__ import annotations

import contextlib
import json
import mmap
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, mix, scratch, space_words, texts

END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Fewest shards; bytes of text that one shard's trigrams come from, about.
SHARDS, SHARD_BYTES = 48, 32 << 20
#: Tokens that a task holds before it emits their blocks; words that it holds when it scores.
HOLD, SCORE_HOLD = 4_000_000, 1_000_000
#: Documents of the sample for frequent words, how many words get a code, and from which share of the tokens on a word is hot.
SAMPLE, CODES, HOT = 20_000, 65_535, 1 / 400
ESCAPE = 65_535


def held_out_crc(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, then the end token."""
    words = space_words(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def shifted(x: np.ndarray, starts: np.ndarray, fill) -> np.ndarray:
    """What stands before each token, or fill at a text's start; every text has a token."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = fill
    return out


def text_starts(held: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(t) for t in held])[:-1])).astype(np.int64)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By the top bits, so that shards in order are sorted in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def by_shard_and(shard: np.ndarray, h: np.ndarray, shards: int) -> np.ndarray:
    """The order by shard and, within it, by as many of the hash's first bits as one sorted number holds besides."""
    bits = np.uint64(max(1, (shards - 1).bit_length()))
    return np.argsort((shard.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))


def member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether h is among the sorted keys."""
    if not len(keys):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v ^ mix(w))


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(pair_key(u, v) ^ mix(w + np.uint64(1)))


class Layout:
    """How n-grams are dealt: shards, bytes of a word's hash, words with codes, hot words (both sorted)."""

    def __init__(self, shards: int, width: int, coded: np.ndarray, hot: np.ndarray) -> None:
        self.shards, self.width = shards, width
        self.coded, self.hot = coded, np.unique(np.append(hot, START))

    def short(self, h: np.ndarray) -> np.ndarray:
        """Hashes without the bytes that no block has."""
        low = np.uint64(64 - 8 * self.width)
        return h >> low << low if low else h

    def of_context(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The shard of trigrams uvw and of the context uv; u as short() gives it."""
        return shard_of(np.where(member(v, self.hot), pair_key(u, v), v), self.shards)

    def of_pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The shard of the pair vw."""
        return shard_of(np.where(member(v, self.hot), w, v), self.shards)


def cut_bytes(h: np.ndarray, width: int) -> bytes:
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def whole(raw, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(-1, width)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def codes_of(word: np.ndarray, layout: Layout) -> np.ndarray:
    code = np.full(len(word), ESCAPE, np.uint16)
    if len(layout.coded):
        at = np.minimum(np.searchsorted(layout.coded, word), len(layout.coded) - 1)
        known = layout.coded[at] == word
        code[known] = at[known]
    return code


def pack_words(h: np.ndarray, code: np.ndarray, layout: Layout) -> list[bytes]:
    """Codes of two bytes, and the other words' short hashes."""
    rest = h[code == ESCAPE]
    return [np.array([len(h), len(rest)], np.uint64).tobytes(), code.tobytes(), cut_bytes(rest, layout.width)]


def unpack_words(raw: bytes, at: int, layout: Layout) -> tuple[np.ndarray, int]:
    n, rest = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
    code = np.frombuffer(raw, np.uint16, n, at + 16)
    at += 16 + 2 * n
    out = np.empty(n, np.uint64)
    out[code == ESCAPE] = whole(raw, rest, layout.width, at)
    if len(layout.coded):
        out[code != ESCAPE] = layout.short(layout.coded)[code[code != ESCAPE]]
    return out, at + rest * layout.width


def pack_counts(n: np.ndarray) -> list[bytes]:
    """Only counts above one, with their places."""
    more = np.flatnonzero(n > 1).astype(np.uint32)
    return [np.array([len(n), len(more)], np.uint64).tobytes(), more.tobytes(), n[more].astype(np.uint64).tobytes()]


def unpack_counts(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, more = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
    out = np.ones(n, np.int64)
    out[np.frombuffer(raw, np.uint32, more, at + 16)] = np.frombuffer(raw, np.uint64, more, at + 16 + 4 * more)
    return out, at + 16 + 12 * more


def pack(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, u_code: np.ndarray, w_code: np.ndarray, layout: Layout) -> bytes:
    """Distinct trigrams sorted by v as a block: each v with how many it has, then the words around it and the counts."""
    at = starts_of(v)
    head = np.array([len(at)], np.uint64)
    sizes = np.diff(np.append(at, len(v))).astype(np.uint32)
    return b"".join([head.tobytes(), v[at].tobytes(), sizes.tobytes(), *pack_words(u, u_code, layout), *pack_words(w, w_code, layout), *pack_counts(n)])


def unpack(raw: bytes, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u (short), v, w (short), n."""
    words = int(np.frombuffer(raw, np.uint64, 1)[0])
    v = np.repeat(np.frombuffer(raw, np.uint64, words, 8), np.frombuffer(raw, np.uint32, words, 8 + 8 * words))
    u, at = unpack_words(raw, 8 + 12 * words, layout)
    w, at = unpack_words(raw, at, layout)
    return u, v, w, unpack_counts(raw, at)[0]


def by_shard(order_shards: np.ndarray, shards: int):
    """(shard, slice) of rows that are sorted by shard."""
    edge = np.searchsorted(order_shards, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        yield s, slice(int(edge[s]), int(edge[s + 1]))


#: Kinds of rows: trigrams, a word's uses, words before which a pair's first word is not hot, pairs with a hot first word, counts for the driver.
TRIGRAMS, USES, BEFORE, HOT_PAIRS, SAID = range(5)
ROWS = "shard int, kind int, raw binary"


def blocks(docs: DataFrame, shared, layout_of) -> DataFrame:
    """Rows of trigrams and of words' uses of the training documents."""

    def rows(read) -> Iterator[tuple]:
        layout: Layout = layout_of(shared.value)
        held: list[np.ndarray] = []
        size = 0

        def emit():
            w, starts = np.concatenate(held), text_starts(held)
            word, to, uses = np.unique(w, return_inverse=True, return_counts=True)
            v = shifted(w, starts, START)
            u = shifted(v, starts, START)
            w_code = codes_of(word, layout)[to]
            u_code = shifted(shifted(w_code, starts, ESCAPE), starts, ESCAPE)
            for s, part in by_shard(shard_of(word, layout.shards), layout.shards):
                yield s, USES, b"".join([word[part].tobytes(), uses[part].astype(np.uint32).tobytes()])
            key = triple_key(u, v, w)
            order = np.argsort(key)
            at = starts_of(key[order])
            n, first = np.diff(np.append(at, len(order))), order[at]
            shard = layout.of_context(layout.short(u[first]), v[first])
            order = by_shard_and(shard, v[first], layout.shards)
            first = first[order]
            cols = (u[first], v[first], w[first], n[order], u_code[first], w_code[first])
            for s, part in by_shard(shard[order], layout.shards):
                yield s, TRIGRAMS, pack(*(c[part] for c in cols), layout)

        for doc_id, text in read:
            if held_out_crc(doc_id):
                continue
            held.append(tokens(text))
            size += len(held[-1])
            if size >= HOLD:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    return arrow_map(docs, rows, ROWS, 1)


def discounts(counts: list[int]) -> list[float]:
    """D1, D2, D3+ from how many values have the counts 1 to 4 (Chen and Goodman); one half where they can't be estimated."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    more = [n2 / n1, n3 / n2, n4 / n3 if n3 else 0]
    return [min(max(k + 1 - (k + 2) * y * r, 0.05), k + 1 - 0.05) for k, r in enumerate(more)]


def of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


class Files:
    """The model's folder: written and read by any filesystem that pyarrow knows; a local one is mapped in place."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def at(self, name: str):
        if self.folder.startswith("/"):
            return pafs.LocalFileSystem(), f"{self.folder}/{name}"
        at = self.folder if "://" in self.folder else self.folder.replace("file:", "file://", 1)
        return pafs.FileSystem.from_uri(f"{at}/{name}")

    def write(self, name: str, arrays: list[np.ndarray]) -> None:
        """Under another name first: a task that runs again or twice writes the same bytes and replaces whole files only."""
        fs, path = self.at(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            for a in arrays:
                out.write(a.tobytes())
        fs.move(part, path)

    def map(self, name: str) -> mmap.mmap:
        """A worker's copy of a file on another store is a temporary file that has no name and goes with its last map."""
        fs, path = self.at(name)
        if isinstance(fs, pafs.LocalFileSystem):
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as got:
            while part := got.read(1 << 22):
                f.write(part)
            f.flush()
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Table:
    """N-grams of a shard by their 64-bit keys: an index over the first bits, then the next 32 bits of each, then values."""

    @staticmethod
    def arrays(keys: np.ndarray, *values: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """How many first bits are indexed, and the arrays, of sorted distinct keys."""
        bits = max(0, (len(keys) // 8).bit_length() - 1)
        first = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        rest = (keys << np.uint64(bits) if bits else keys) >> np.uint64(32)
        return bits, [np.searchsorted(first, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32), rest.astype(np.uint32), *values]

    def __init__(self, raw, at: int, n: int, bits: int, types: tuple) -> None:
        self.bits = bits
        self.index = np.frombuffer(raw, np.uint32, (1 << bits) + 1, at)
        at += self.index.nbytes
        self.rest = np.frombuffer(raw, np.uint32, n, at)
        at += self.rest.nbytes
        self.values = []
        for t in types:
            self.values.append(np.frombuffer(raw, t, n, at))
            at += self.values[-1].nbytes
        self.end = at

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and where those are: a binary search within each key's first bits."""
        bits = np.uint64(self.bits)
        first = (keys >> (np.uint64(64) - bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        rest = ((keys << bits) >> np.uint64(32)).astype(np.uint32)
        low, end = self.index[first].astype(np.int32 if len(self.rest) < 1 << 30 else np.int64), self.index[first + 1]
        most = int((end - self.index[first]).max(initial=0))
        step = 1 << max(0, most.bit_length() - 1)
        while most and step:
            at = low + (step - 1)
            inside = at < end
            at[~inside] = 0
            low += (inside & (self.rest[at] < rest)) * low.dtype.type(step)
            step >>= 1
        there = low < end
        there[there] = self.rest[low[there]] == rest[there]
        return there, low[there]


def table_file(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[list[list[int]], list[np.ndarray]]:
    """Sizes and index bits of several tables, and all their arrays padded to eight bytes, for one file."""
    sizes, out = [], []
    for keys, values in parts:
        bits, arrays = Table.arrays(keys, *values)
        sizes.append([len(keys), bits])
        for a in arrays:
            out.append(a)
        out.append(np.zeros(-sum(a.nbytes for a in arrays) % 8, np.uint8))
    return sizes, out


def split_counts(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Tables of the keys with count one (no value), to 255 (a byte) and beyond (eight bytes)."""
    few, many = (n > 1) & (n < 256), n >= 256
    return [(keys[n == 1], []), (keys[few], [n[few].astype(np.uint8)]), (keys[many], [n[many].astype(np.uint64)])]


COUNTS = ((), (np.uint8,), (np.uint64,))
CONTEXTS = ((np.uint8,) * 4, (np.uint64,) * 4)


def followers(groups: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by group: where each begins, and its total, ones, twos, and threes or more, as columns of one array."""
    at = starts_of(groups)
    if not len(at):
        return at, np.zeros((4, 0), np.int64), groups
    return at, np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n > 2)]), groups[at]


def train(docs: DataFrame, shards: int | None = None, shard_bytes: int = SHARD_BYTES, hot: float = HOT, sample: int = SAMPLE) -> dict:
    """Counts the documents that are not held out and writes the model; gives what a worker needs to open it.

    Shards are what one task holds at a time; if not given, as many as the texts have shard_bytes, SHARDS and the session's
    shuffle partitions at least. A word above the share `hot` of the sample's tokens is dealt with the word before it.
    """
    spark = docs.sparkSession
    own = texts(docs)
    size = own.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = shards or max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // shard_bytes))
    width = 5 if (size["bytes"] or 0) < 1 << 40 else 7
    coded, frequent = frequent_words(own, max(1, size["rows"] // sample), hot)
    layout_of = lambda x: Layout(x[0], x[1], np.frombuffer(x[2], np.uint64), np.frombuffer(x[3], np.uint64))
    given = (shards, width, coded.tobytes(), frequent.tobytes())
    shared = spark.sparkContext.broadcast(given)  # CODES words of eight bytes at most
    folder = scratch(spark, "kneser-ney")
    files = Files(folder)

    def reduce(read):
        """Writes a shard's trigrams, contexts and pairs; passes on what is counted by the last word."""
        layout = layout_of(shared.value)
        for shard, kinds in grouped(read):
            if USES in kinds:
                word, uses = summed(*words_of(kinds[USES]))
                yield shard, USES, b"".join([word.tobytes(), uses.astype(np.uint64).tobytes()])
            if TRIGRAMS not in kinds:
                continue
            u, v, w, n = (np.concatenate(c) for c in zip(*(unpack(raw, layout) for raw in kinds.pop(TRIGRAMS))))
            key = triple_key(u, v, w)
            order = np.argsort(key)
            at = starts_of(key[order])
            n = np.add.reduceat(n[order], at)
            order = order[at]
            key, u, v, w = key[order], u[order], v[order], w[order]
            tri_sizes, tri = table_file(split_counts(key, n))
            context = pair_key(u, layout.short(v))
            order = np.argsort(context)
            _, stats, contexts = followers(context[order], n[order])
            keep = stats[0] > 1
            few = keep & (stats[0] < 256)
            ctx_sizes, ctx = table_file([(contexts[few], [c.astype(np.uint8) for c in stats[:, few]]), (contexts[keep & ~few], [c.astype(np.uint64) for c in stats[:, keep & ~few]])])
            files.write(f"tri-{shard}", [*tri, *ctx])
            said = {"shard": shard, "tri": tri_sizes, "ctx": ctx_sizes, "counts3": of_counts(n), "tokens": int(n.sum())}
            # pairs vw with how many words come before them
            pair = pair_key(layout.short(v), w)
            order = np.argsort(pair)
            at = starts_of(pair[order])
            before = np.diff(np.append(at, len(order)))
            first = order[at]
            v, w, pair = v[first], w[first], pair[order][at]
            is_hot = member(v, layout.hot)
            if is_hot.any():
                at = np.flatnonzero(is_hot)
                to = shard_of(w[at], layout.shards)
                order = by_shard_and(to, v[at], layout.shards)
                at, to = at[order], to[order]
                for s, part in by_shard(to, layout.shards):
                    mine = at[part]
                    index = np.searchsorted(layout.hot, v[mine]).astype(np.uint32)
                    yield s, HOT_PAIRS, b"".join([np.array([len(mine)], np.uint64).tobytes(), index.tobytes(), cut_bytes(w[mine], layout.width), *pack_counts(before[mine])])
            v, w, pair, before = (x[~is_hot] for x in (v, w, pair, before))
            if len(v):
                sizes, arrays = table_file(split_counts(pair, before))
                order = np.argsort(v, kind="stable")
                _, stats, words = followers(v[order], before[order])
                more = stats[0] > 1
                files.write(f"bi-{shard}", [words[more], *(c[more].astype(np.float64) for c in stats), *arrays])
                said |= {"bi": sizes, "back": int(more.sum()), "counts2": of_counts(before)}
                word, times = np.unique(w, return_counts=True)
                for s, part in by_shard(shard_of(word, layout.shards), layout.shards):
                    yield s, BEFORE, b"".join([np.array([part.stop - part.start], np.uint64).tobytes(), cut_bytes(word[part], layout.width), *pack_counts(times[part])])
            yield shard, SAID, json.dumps(said).encode()

    def finish(read):
        """Writes a shard's words and the pairs of hot words with them; passes on what is for the driver."""
        layout = layout_of(shared.value)
        for shard, kinds in grouped(read):
            yield from ((bytes(raw).decode(),) for raw in kinds.get(SAID, ()))
            if USES not in kinds:
                continue
            word, uses = words_of(kinds[USES], np.uint64)
            short, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            said = {"shard": shard}
            for raw in kinds.get(BEFORE, ()):
                n = int(np.frombuffer(raw, np.uint64, 1)[0])
                short.append(whole(raw, n, layout.width, 8))
                times.append(unpack_counts(raw, 8 + n * layout.width)[0])
            index, w, before = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for raw in kinds.get(HOT_PAIRS, ()):
                n = int(np.frombuffer(raw, np.uint64, 1)[0])
                index.append(np.frombuffer(raw, np.uint32, n, 8))
                w.append(whole(raw, n, layout.width, 8 + 4 * n))
                before.append(unpack_counts(raw, 8 + (4 + layout.width) * n)[0])
            index, w, before = (np.concatenate(x) for x in (index, w, before))
            if len(w):
                pair = pair_key(layout.short(layout.hot)[index], w)
                order = np.argsort(pair, kind="stable")
                at = starts_of(pair[order])
                before = np.add.reduceat(before[order], at)
                first = order[at]
                index, w = index[first], w[first]
                sizes, arrays = table_file(split_counts(pair[first], before))
                files.write(f"hot-{shard}", arrays)
                order = np.argsort(index, kind="stable")
                at, stats, which = followers(index[order], before[order])
                said |= {"hot": sizes, "hot_counts2": of_counts(before), "hot_back": [which.tolist(), stats.tolist()]}
                short.append(w)
                times.append(np.ones(len(w), np.int64))
            key, n = summed(np.concatenate(short), np.concatenate(times))
            own = layout.short(word)  # in the order of the words
            at = np.searchsorted(key, own)
            preceded = n[at]
            files.write(f"word-{shard}", [word, preceded.astype(np.float64), uses.astype(np.float64)])
            said |= {"word": len(word), "counts1": of_counts(preceded), "pairs": int(preceded.sum())}
            yield (json.dumps(said),)

    dealt = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")
    spread = arrow_map(dealt(blocks(own, shared, layout_of)), reduce, ROWS, 1)
    model = {"folder": folder, "layout": given, "tokens": 0, "pairs": 0, "vocabulary": 0, "tri": {}, "ctx": {}, "bi": {}, "back": {}, "hot": {}, "word": {}}
    counts = np.zeros((3, 4), np.int64)
    hot_back = np.zeros((4, len(layout_of(given).hot)), np.int64)
    # two rows for each shard, written by all tasks at once and then read one file after the other
    for r in cut(arrow_map(dealt(spread), finish, "said string", 1)).coalesce(8).toLocalIterator():
        said = json.loads(r.said)
        for k in ("tri", "ctx", "bi", "back", "hot", "word"):
            if k in said:
                model[k][said["shard"]] = said[k]
        model["tokens"] += said.get("tokens", 0)
        model["vocabulary"] += said.get("word", 0)
        model["pairs"] += said.get("pairs", 0)
        for k, order in (("counts1", 0), ("counts2", 1), ("hot_counts2", 1), ("counts3", 2)):
            counts[order] += said.get(k, [0] * 4)
        if "hot_back" in said:
            which, stats = said["hot_back"]
            hot_back[:, which] += np.array(stats)
    taken = counts[0].tolist()
    return model | {"discounts": [discounts(c) for c in counts.tolist()], "taken": [taken[0], taken[1], max(0, model["vocabulary"] - taken[0] - taken[1])], "hot_back": hot_back.tolist()}


def grouped(read) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The rows of one shard after the other by kind, from rows sorted by shard."""
    now, kinds = None, {}
    for shard, kind, raw in read:
        if shard != now and kinds:
            yield now, kinds
            kinds = {}
        now = shard
        kinds.setdefault(kind, []).append(raw)
    if kinds:
        yield now, kinds


def words_of(parts: list[bytes], count=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Words and numbers that follow each other in each part."""
    size = 8 + np.dtype(count).itemsize
    return tuple(np.concatenate(x) for x in zip(*((np.frombuffer(raw, np.uint64, len(raw) // size), np.frombuffer(raw, count, len(raw) // size, len(raw) // size * 8).astype(np.int64)) for raw in parts)))


def summed(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with the sum of n."""
    order = np.argsort(word, kind="stable")
    word = word[order]
    at = starts_of(word)
    return word[at], np.add.reduceat(n[order], at) if len(at) else n


def frequent_words(docs: DataFrame, every: int, hot: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents whose hash is a multiple of `every`: the most frequent words, and those above the share `hot`, both sorted."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)

    def count(read):
        held = [tokens(text) for _, text in read]
        if held:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            yield (word.tobytes() + n.astype(np.uint32).tobytes(),)

    def merge(read):
        parts = [raw for (raw,) in read]
        if parts:
            word, n = summed(*words_of(parts))
            top = np.argsort(-n, kind="stable")[:CODES]
            top = top[n[top] > 1]
            yield np.sort(word[top]).tobytes(), np.sort(word[n > hot * n.sum()]).tobytes()

    found = arrow_map(arrow_map(part, count, "raw binary", 1).repartition(1), merge, "coded binary, hot binary").collect()  # one row at most
    return tuple(np.frombuffer(bytes(x), np.uint64) for x in found[0]) if found else (np.zeros(0, np.uint64),) * 2


class Arrays:
    """The model as a worker sees it: mapped files, searched by hash."""

    def __init__(self, model: dict) -> None:
        self.model, self.files, self.open = model, Files(model["folder"]), {}
        shards, width, coded, hot = model["layout"]
        self.layout = Layout(shards, width, np.frombuffer(coded, np.uint64), np.frombuffer(hot, np.uint64))
        self.d = [np.array([0.0, *d]) for d in model["discounts"]]
        self.pairs = max(1, model["pairs"])
        self.spread = float(np.dot(model["taken"], model["discounts"][0])) / self.pairs / (model["vocabulary"] + 1)
        self.hot_back = np.array(model["hot_back"], np.float64)

    def mapped(self, name: str, make):
        if name not in self.open:
            self.open[name] = make(self.files.map(name))
        return self.open[name]

    @staticmethod
    def tables(raw, at: int, kinds: list[tuple[list[list[int]], tuple]]) -> list[list[Table]]:
        out = []
        for sizes, types in kinds:
            out.append([])
            for (n, bits), t in zip(sizes, types):
                out[-1].append(Table(raw, at, n, bits, t))
                at = out[-1][-1].end
                at += -at % 8
        return out

    def trigram_tables(self, s: int) -> list[list[Table]]:
        return self.mapped(f"tri-{s}", lambda raw: self.tables(raw, 0, [(self.model["tri"][s], COUNTS), (self.model["ctx"][s], CONTEXTS)]))

    def pair_tables(self, kind: str, s: int):
        """The table of pairs; for pairs without a hot first word also their first words and what back-off needs."""
        words = self.model["back"].get(s, 0) if kind == "bi" else 0

        def make(raw):
            cols = [np.frombuffer(raw, t, words, 8 * words * i) for i, t in enumerate((np.uint64, *(np.float64,) * 4))] if words else None
            return cols, self.tables(raw, 40 * words, [(self.model[kind][s], COUNTS)])[0]

        return self.mapped(f"{kind}-{s}", make)

    def each_shard(self, shards: np.ndarray):
        order = np.argsort(shards.astype(np.uint16) if self.layout.shards < 1 << 16 else shards, kind="stable")
        for s, part in by_shard(shards[order], self.layout.shards):
            yield s, order[part]

    @staticmethod
    def counted(tables: list[Table], keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for t in tables:
            if len(t.rest) and len(left):
                there, at = t.find(keys[left])
                out[left[there]] = t.values[0][at] if t.values else 1
                left = left[~there]
        return out

    def pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """N(vw) of each pair, of short hashes but for v."""
        out = np.zeros(len(v))
        hot, key, shard = member(v, self.layout.hot), pair_key(self.layout.short(v), w), self.layout.of_pair(v, w)
        for kind, which in (("bi", np.flatnonzero(~hot)), ("hot", np.flatnonzero(hot))):
            for s, at in self.each_shard(shard[which]):
                if s in self.model[kind]:
                    out[which[at]] = self.counted(self.pair_tables(kind, s)[1], key[which[at]])
        return out

    def words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N(w) and c(w) of distinct words."""
        out = np.zeros((2, len(word)))
        for s, at in self.each_shard(shard_of(word, self.layout.shards)):
            if s in self.model["word"]:
                n = self.model["word"][s]
                keys, *values = self.mapped(f"word-{s}", lambda raw, n=n: [np.frombuffer(raw, t, n, 8 * n * i) for i, t in enumerate((np.uint64, np.float64, np.float64))])
                there = member(word[at], keys)
                found = np.searchsorted(keys, word[at[there]])
                out[:, at[there]] = [x[found] for x in values]
        return out[0], out[1]

    def back(self, word: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Total, ones, twos, threes or more of distinct words as contexts; zeros where a word is none."""
        out = np.zeros((4, len(word)))
        out[0, seen], out[1, seen] = 1, 1  # those that no table has
        hot = member(word, self.layout.hot)
        out[:, hot] = self.hot_back[:, np.searchsorted(self.layout.hot, word[hot])]
        rest = np.flatnonzero(~hot & seen)
        for s, at in self.each_shard(shard_of(word[rest], self.layout.shards)):
            if self.model["back"].get(s):
                keys, *values = self.pair_tables("bi", s)[0]
                mine = rest[at]
                there = member(word[mine], keys)
                found = np.searchsorted(keys, word[mine[there]])
                out[:, mine[there]] = [x[found] for x in values]
        return out

    def score(self, held: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base log10, model log10) of each text."""
        w, starts = np.concatenate(held), text_starts(held)
        v = shifted(w, starts, START)
        u = shifted(v, starts, START)
        ends = np.append(starts[1:], len(w))
        layout, (d1, d2, d3) = self.layout, self.d
        taken = lambda d, n: d[np.minimum(n, 3).astype(np.int64)]
        # the lowest order and the base, of distinct words
        word, to = np.unique(w, return_inverse=True)
        preceded, count = self.words(word)
        lowest = (preceded - taken(d1, preceded)) / self.pairs + self.spread
        n, vocabulary = self.model["tokens"], self.model["vocabulary"]
        base, known = np.log10((count + 1) / (n + vocabulary + 1))[to], (count > 0)[to]
        # the middle order, of distinct pairs; the start mark is the last of the middle words
        middle = np.append(word, START)
        v_to = shifted(to, starts, len(word))
        total, one, two, more = self.back(middle, np.append(count > 0, False))
        give = np.where(total > 0, (d2[1] * one + d2[2] * two + d2[3] * more) / np.maximum(total, 1), 1)
        hot = member(middle, layout.hot)[v_to]
        us, ws = layout.short(u), layout.short(w)
        key = pair_key(v, w)
        order = by_shard_and(shard_of(np.where(hot, w, v), layout.shards), key, layout.shards)
        at = starts_of(key[order])
        first = order[at]
        n_pair = self.pair_counts(v[first], ws[first])
        lower = np.empty(len(w))
        lower[order] = np.repeat((n_pair - taken(d2, n_pair)) / np.maximum(total, 1)[v_to[first]] + give[v_to[first]] * lowest[to[first]], np.diff(np.append(at, len(order))))
        # the highest order, of distinct trigrams
        context = pair_key(us, layout.short(middle)[v_to])
        key = triple_key(us, v, ws)
        shard = shard_of(np.where(hot, pair_key(us, v), v), layout.shards)
        order = by_shard_and(shard, key, layout.shards)
        at = starts_of(key[order])
        first = order[at]
        uses, total, give = np.zeros(len(first)), np.zeros(len(first)), np.ones(len(first))
        contexts, keys = context[first], key[first]
        for s, mine in by_shard(shard[first], layout.shards):
            if s not in self.model["tri"]:
                continue
            tri, ctx = self.trigram_tables(s)
            uses[mine] = self.counted(tri, keys[mine])
            left = np.arange(mine.start, mine.stop)
            for t in ctx:
                if len(t.rest) and len(left):
                    there, found = t.find(contexts[left])
                    hit = left[there]
                    total[hit] = t.values[0][found]
                    give[hit] = sum(d3[i] * t.values[i][found] for i in (1, 2, 3)) / total[hit]
                    left = left[~there]
        # contexts that were seen once: those of a trigram that is known, and other pairs that are known
        once = (total == 0) & (uses > 0)
        ask = np.flatnonzero((total == 0) & (uses == 0))
        if len(ask):
            a, b = u[first[ask]], v[first[ask]]
            once[ask] = (self.pair_counts(a, layout.short(b)) > 0) | ((a == START) & (b == START))
        total[once], give[once] = 1, d3[1]
        high = (uses - taken(d3, uses)) / np.maximum(total, 1)
        full = np.empty(len(w))
        spread_to = np.repeat(np.arange(len(first)), np.diff(np.append(at, len(order))))
        full[order] = high[spread_to] + give[spread_to] * lower[order]
        full = np.log10(full)
        return list(zip((ends - starts).tolist(), np.add.reduceat(known.astype(np.int64), starts).tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(full, starts).tolist()))


_opened: dict[str, Arrays] = {}


def opened(model: dict) -> Arrays:
    """The model's arrays, opened once in each worker process."""
    if model["folder"] not in _opened:
        _opened.clear()
        _opened[model["folder"]] = Arrays(model)
    return _opened[model["folder"]]


def perplexity(docs: DataFrame, model: dict, hold: int = SCORE_HOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs.

    Scores are log10 probabilities of whole texts, end token included. Null texts are empty: the end token
    alone. Rows without doc_id are never held out. Repeated rows are scored and counted each. Where there
    is nothing to learn from, every token has the one unknown value's probability, 1. An empty table gives an empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers for each shard

    def rows(read):
        arrays = opened(shared.value)
        ids, held, size = [], [], 0
        for doc_id, text in read:
            ids.append(doc_id)
            held.append(tokens(text))
            size += len(held[-1])
            if size >= hold:
                yield from out(arrays, ids, held)
                ids, held, size = [], [], 0
        if held:
            yield from out(arrays, ids, held)

    def out(arrays, ids, held):
        if not arrays.model["tokens"]:
            yield from ((d, held_out_crc(d), len(t), 0, 0, 0.0, 0.0) for d, t in zip(ids, held))
            return
        for doc_id, (n, known, base, score) in zip(ids, arrays.score(held)):
            yield doc_id, held_out_crc(doc_id), n, known, arrays.model["tokens"], base, score

    return arrow_map(texts(docs), rows, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", 5000)


def remove(model: dict) -> None:
    """Deletes the model's folder, once nothing reads it any more."""
    fs, path = Files(model["folder"]).at("")
    with contextlib.suppress(OSError):
        fs.delete_dir(path.rstrip("/"))
