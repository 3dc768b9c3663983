"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is cross-parsed against it: from
the start of a phrase the automaton is walked as long as a transition exists, which gives the longest
match; the next phrase begins at the letter that failed. The fewer phrases a language needs, the more of
the text it has seen. Phrase counts are normalised by log2 of the language's sample length over the number of letters,
which is the cross-parsing estimate of bits a letter, and the language with the least bits wins.

Texts are letters only: lower-cased, every run of other characters is one separator. Sets of equal-length
pieces are walked in lockstep over one transition table, so whole texts are read without a loop over
their letters in Python. A phrase ends where its piece of ``PIECE`` symbols (a parameter) does, which is one phrase more in that many at
most, for every language alike. Every letter of the samples is a symbol: the commonest have columns in the table, the others sorted keys.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Bounds of the labelled sample: documents and letters for each language, and letters that one document gives at most, in SPREAD pieces
#: from all over it, so that one very long text is no language's whole sample.
SAMPLE_DOCS, SAMPLE_LETTERS, SAMPLE_EACH, SPREAD = 200, 24_000, 1_500, 5
#: Symbols of a piece; symbols with a column of their own.
PIECE, DENSE = 512, 96
#: A text of LEAST letters or more is in none of the languages if the best one needs SLACK times the bits a letter that any text of its own needed.
LEAST, SLACK = 200, 1.5
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}")


def held_out(column) -> F.Column:
    """crc32 of doc_id as text mod 4 is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Automaton:
    """Suffix automaton over a sequence of small integers: `go` has a dictionary for each state."""

    def __init__(self, symbols: list[int]) -> None:
        go: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            now = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = now
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        self.go = go


class Model:
    """One transition table for all languages.

    Entry (s, c) is the next state; where a language's automaton has no transition the entry is that of
    its start state with a mark that a phrase has ended. Symbols from `dense` on have no column: their transitions are sorted keys.
    """

    END = np.int32(1 << 30)

    def __init__(self, samples: dict[str, str], piece: int = PIECE, dense: int = DENSE) -> None:
        self.languages, self.piece = sorted(samples), piece
        common = Counter("".join(samples.values()))
        common.pop(" ", None)
        # 0 is the separator, 1 any letter that no sample has
        self.symbols = {c: i + 2 for i, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0])))}
        self.symbols[" "] = 0
        self.dense = min(dense, len(self.symbols) + 1)
        size = max(map(ord, self.symbols)) + 2
        self.code = np.full(size, 1, np.int32)
        for c, i in self.symbols.items():
            self.code[ord(c)] = i
        tables, starts, alone, self.scale, base = [], [], [], [], 0
        keys, nexts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for lang in self.languages:
            go = Automaton([self.symbols[c] for c in samples[lang]]).go
            t = np.full((len(go), self.dense), -1, np.int32)
            rare = []
            for s, row in enumerate(go):
                for c, to in row.items():
                    if c < self.dense:
                        t[s, c] = to
                    else:
                        rare.append((((base + s) << 32) | c, base + to))
            # one more state: behind a symbol that the sample lacks, which is a phrase by itself
            none = len(t)
            fresh = np.where(t[0] >= 0, t[0], none)
            full = np.where(t >= 0, t, fresh[None, :] | self.END)
            full[0] = fresh  # a piece's first phrase is counted from the start
            tables.append(np.concatenate((full, fresh[None, :] | self.END)).astype(np.int32) + np.int32(base))
            starts.append(base)
            alone.append(base + none)
            if rare:
                k, to = zip(*sorted(rare))
                keys.append(np.array(k, np.int64))
                nexts.append(np.array(to, np.int32))
            self.scale.append(np.log2(max(2, len(samples[lang]))))
            base += len(t) + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.keys, self.nexts = np.concatenate(keys), np.concatenate(nexts)  # sorted, as bases grow
        self.starts, self.alone = np.array(starts, np.int32), np.array(alone, np.int32)
        self.scale = np.array(self.scale)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text: letters, and a separator for each run of other characters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.code[np.minimum(points, len(self.code) - 1)]
        other = out == 1  # a letter without a symbol, or no letter at all
        if other.any():
            at = np.flatnonzero(other)
            kinds = {p: bool(LETTERS.match(chr(p))) for p in np.unique(points[at]).tolist()}
            out[at] = [1 if kinds[p] else 0 for p in points[at].tolist()]
        keep = (out != 0) | np.concatenate(([True], out[:-1] != 0)) if len(out) else np.zeros(0, bool)
        return out[keep]

    def rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The entries of symbols without a column, as the table has those of the others."""

        def look(s):
            key = (s.astype(np.int64) << 32) | symbol[:, None]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.nexts[at], -1)

        got, fresh = look(state), look(np.broadcast_to(self.starts, state.shape))
        fresh = np.where(fresh >= 0, fresh, self.alone)
        return np.where(got >= 0, got, np.where(state == self.starts, fresh, fresh | self.END))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language, as an array (texts, languages)."""
        owner, start, size = [], [], []
        flat = np.concatenate([*texts, np.zeros(self.piece, np.int32)])
        at = 0
        for i, t in enumerate(texts):
            for s in range(0, len(t), self.piece):
                owner.append(i)
                start.append(at + s)
                size.append(min(self.piece, len(t) - s))
            at += len(t)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not owner:
            return out
        order = np.argsort(-np.array(size), kind="stable")
        owner, start, size = (np.array(x)[order] for x in (owner, start, size))
        n = len(self.languages)
        state = np.tile(self.starts, (len(owner), 1))
        count = np.ones((len(owner), n), np.int32)
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # pieces that still have a symbol
        table, some = self.table, len(self.keys) > 0
        for step in range(size[0]):
            m = alive[step]
            symbol = flat[start[:m] + step]
            got = table[state[:m] * self.dense + (np.minimum(symbol, self.dense - 1) if some else symbol)[:, None]]
            if some and (far := np.flatnonzero(symbol >= self.dense)).size:
                got[far] = self.rare(state[far], symbol[far])
            count[:m] += got >> 30
            state[:m] = got & (self.END - 1)
        np.add.at(out, owner, count)
        return out

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and its bits a letter in each language."""
        coded = [self.encode(t) if t else np.zeros(0, np.int32) for t in texts]
        letters = np.array([np.count_nonzero(c) for c in coded], np.int64)
        return letters, self.phrases(coded) * self.scale / np.maximum(letters, 1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) for each text; und with score 0 where there is no letter."""
        if not self.languages or not texts:
            return [(UNKNOWN, 0.0)] * len(texts)
        letters, bits = self.bits(texts)
        best = bits.argmin(axis=1)
        # the share of the winner if each language is weighted by two to the minus its bits a letter
        weight = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
        score = 1 / weight.sum(axis=1)
        return [(self.languages[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best.tolist(), score.tolist(), letters.tolist())]


_built: dict[str, Model] = {}


def model_of(samples: dict[str, str]) -> Model:
    """The model of some samples, built once in each worker process."""
    key = repr(sorted((k, len(v), zlib.crc32(v.encode("utf-8", "surrogatepass"))) for k, v in samples.items()))
    if key not in _built:
        _built.clear()
        _built[key] = Model(samples)
    return _built[key]


def drawn(docs: DataFrame, sample_docs: int, each: int, spread: int) -> list[tuple[str, str]]:
    """(language, text) of about sample_docs documents of each language, drawn by a hash; of a longer text `spread` pieces from all over it.

    At most 2 * each characters of a document come to the driver, and languages are as many as lang has values.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return []
    # two to the 20th parts by hash; a language's documents in the first parts are its sample
    limit = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << 20, -(-sample_docs * (1 << 20) // n))))))
    piece, n = 2 * each // spread, F.length("text")
    # whole texts up to 2 * each characters; else `spread` pieces, the first at the beginning, the last at the end
    parts = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda i: F.substr("text", (F.floor(i * (n - piece) / max(1, spread - 1)) + 1).cast("int"), F.lit(piece)))
    some = own.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < limit[F.col("lang")])
    some = some.select("lang", F.when(n <= 2 * each, F.col("text")).otherwise(F.array_join(parts, " ")).alias("text"))
    return sorted({(r.lang, r.text) for r in some.collect()}, key=lambda x: (x[0], zlib.crc32(x[1].encode("utf-8", "surrogatepass")), x[1]))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS, sample_each: int = SAMPLE_EACH, spread: int = SPREAD) -> dict[str, str]:
    """Learns from text and non-null lang of the documents that are not held out.

    The result is each language's sample; workers build the automata from it (model_of).

    Of each language a sample is drawn by a hash of text and id: about sample_docs documents, distinct
    texts only, each of which gives sample_each letters at most, of which sample_letters letters are used. All bounds are parameters; languages are as
    many as lang has values. Where there is nothing to learn from the result is empty.
    """
    return samples_of(drawn(docs, sample_docs, sample_each, spread), sample_letters, sample_each, spread)


def samples_of(texts: list[tuple[str, str]], sample_letters: int = SAMPLE_LETTERS, sample_each: int = SAMPLE_EACH, spread: int = SPREAD) -> dict[str, str]:
    """Each language's letters from its texts, in their order."""
    samples: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for lang, text in texts:
        left = room.setdefault(lang, sample_letters)
        clean = " ".join(LETTER_RUNS(text.lower()))
        if len(clean) > sample_each:
            piece = sample_each // spread
            clean = " ".join(clean[i * (len(clean) - piece) // max(1, spread - 1) :][:piece] for i in range(spread))
        clean = clean[:left]
        if clean and left > 0:
            samples.setdefault(lang, []).append(clean)
            room[lang] -= len(clean) + 1
    return {k: " ".join(x) for k, x in samples.items()}


LETTER_RUNS = regex.compile(r"\p{L}+").findall
RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, samples: dict[str, str], batch_chars: int = 2_000_000) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, from the text alone.

    Null texts and texts without a letter are `und` with score 0; ties go to the language that sorts first. Where nothing
    could be learned, all are `und`. Columns other than doc_id and text are not looked at. Repeated rows are predicted each; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        m = model_of(shared.value)
        for b in batches:
            ids, found = b.column(0), []
            held: list[str | None] = []
            room = 0
            for t in b.column(1).to_pylist():
                held.append(t)
                room += len(t or "")
                if room > batch_chars:
                    found += m.predict(held)
                    held, room = [], 0
            found += m.predict(held)
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=RESULT)

    return texts(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def limit_of(docs: DataFrame, least: int = LEAST, slack: float = SLACK) -> float:
    """Bits a letter from which on a text is in none of the languages: slack times what any text of one half of the sample needs, if only the other half is known."""
    texts = drawn(docs, SAMPLE_DOCS, SAMPLE_EACH, SPREAD)
    known, others = samples_of(texts[::2]), [t for _, t in texts[1::2]]
    if not known or not others:
        return float("inf")
    letters, bits = Model(known).bits(others)
    needed = bits.min(axis=1)[letters >= least]
    return slack * float(needed.max()) if len(needed) else float("inf")


def accepted(docs: DataFrame, least: int = LEAST, slack: float = SLACK) -> DataFrame:
    """The rows of docs in one of the languages that lang has; all columns stay.

    Rejected are null texts, texts without a letter, and texts of `least` letters or more that even the best language's
    automaton takes `slack` times the bits a letter for that labelled texts need (other languages, other scripts, random letters). Where nothing can be learned only the letters count.
    A text is judged where it is: no join, and rows that repeat an id are judged each by its own text. An empty table gives an empty result.
    """
    samples = fit(docs)
    limit = limit_of(docs, least, slack) if samples else float("inf")
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    names = docs.columns

    def run(batches):
        m = model_of(shared.value) if shared.value else None
        at = names.index("text")
        for b in batches:
            texts = b.column(at).to_pylist()
            if m is None:
                keep = [bool(t and LETTERS.search(t)) for t in texts]
            else:
                letters, bits = m.bits(texts)
                keep = (letters > 0) & ((letters < least) | (bits.min(axis=1) <= limit))
            yield b.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
