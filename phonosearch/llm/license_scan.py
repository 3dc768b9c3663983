"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all templates and base phrases. A text is streamed through it:
at each word the state and the length of the longest run of template words that ends there are the
matching statistics; the state's suffix links give those of each single template. Base phrases are read off the states (a
phrase stands where it is a suffix of the match). A match of ``least_match`` words or a whole template that the next word
doesn't lengthen is an anchor at every place where its template has it. A chain is a row of anchors in the same order in
text and template, no more than ``gap`` words apart in the text; where two overlap the later one counts for
what it adds. Dynamic programming finds the chains that cover most words, and one that covers ``least_cover`` of its
template is a span.

Words that no template has, and pairs of words that no template has side by side, end every match, so
only runs of known pairs are streamed, and all of those are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map, texts
from .license_texts import BASE_PHRASES, TEMPLATES

LEAST_MATCH, LEAST_COVER, GAP = 3, 0.7, 8


class Automaton:
    """Generalised suffix automaton over word ids; ends[s][t] are the last word's places wherever runs of state s stand in sequence t.

    States whose longest run has fewer than `floor` words have no places.
    """

    def __init__(self, sequences: list[list[int]], floor: int = 1) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in sequences:
            last = 0
            for c in seq:
                last = self.extend(last, c)
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.go]
        for t, seq in enumerate(sequences):
            s = 0
            for i, c in enumerate(seq):
                s = at = self.go[s][c]
                while at > 0 and self.length[at] >= floor:
                    self.ends[at].setdefault(t, []).append(i)
                    at = self.link[at]

    def extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self.clone(last, c, q)
        now = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            link[now] = q if length[q] == length[p] + 1 else self.clone(p, c, q)
        return now

    def clone(self, p: int, c: int, q: int) -> int:
        go, link = self.go, self.link
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = copy
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = copy
            p = link[p]
        return copy

    def state(self, seq: list[int]) -> int:
        s = 0
        for c in seq:
            s = self.go[s][c]
        return s


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, least_match=LEAST_MATCH, least_cover=LEAST_COVER, gap=GAP) -> None:
        self.vocab: dict[bytes, int] = {}
        ids = lambda text: [self.vocab.setdefault(w, len(self.vocab)) for w in alnum_words(text)]
        self.least_match, self.least_cover, self.gap = max(1, least_match), least_cover, gap
        named = [(label, t) for label, found in sorted(templates.items()) for t in map(ids, found) if t]
        self.labels = [label for label, _ in named]
        self.templates = [t for _, t in named]
        base = [(t, label) for t, label in ((ids(p), label) for p, label in phrases.items()) if t]
        sequences = [*self.templates, *(p for p, _ in base)]
        self.floor = min([self.least_match, *map(len, self.templates)])
        self.auto = Automaton(sequences, self.floor)
        # phrases that are a suffix of a state's longest run: its own and those of the states that it links to
        own: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for p, label in base:
            own[self.auto.state(p)].append((len(p), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.auto.go]
        for s in range(1, len(self.auto.go)):
            at = s
            while at > 0:
                self.phrases[s] += own.get(at, [])
                at = self.auto.link[at]
        # for each state and template the nearest state, itself or one that it links to, whose runs the template has
        self.near: list[dict[int, int]] = [{} for _ in self.auto.go]
        for s in sorted(range(1, len(self.auto.go)), key=self.auto.length.__getitem__):
            self.near[s] = self.near[self.auto.link[s]] | {t: s for t in self.auto.ends[s] if t < len(self.templates)}
        v = len(self.vocab)
        self.pairs = np.zeros((v + 1, v + 1), bool)  # the last row and column are the unknown word
        self.short = np.zeros((v + 1, v + 1), bool)  # pairs that are a whole phrase or template, or make a match: a run of one pair counts
        self.single = np.zeros(v + 1, bool)  # words that do so
        for t in sequences:
            for a, b in zip(t, t[1:]):
                self.pairs[a, b] = True
                if len(t) == 2 or self.least_match <= 2:
                    self.short[a, b] = True
            if len(t) == 1 or self.least_match == 1:
                self.single[t] = True

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, float]]]:
        """((start, label) of base phrases, (template, start, words, cover) of spans)."""
        if not words:
            return [], []
        get, unknown = self.vocab.get, len(self.vocab)
        ids = np.array([get(w, unknown) for w in words], np.int32)
        known = self.pairs[ids[:-1], ids[1:]]
        single = self.single[ids]
        if not known.any() and not single.any():
            return [], []
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        short = self.short[ids[:-1], ids[1:]]
        base: list[tuple[int, str]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        alone = single.copy()
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a >= 2 or short[a:b].any() or single[a : b + 1].any():
                self.stream(ids[a : b + 1].tolist(), a, base, anchors)
            alone[a : b + 1] = False
        for a in np.flatnonzero(alone).tolist():
            self.stream([int(ids[a])], a, base, anchors)
        return base, [(t, *span) for t in sorted(anchors) for span in self.chains(t, sorted(anchors[t]))]

    def stream(self, run: list[int], first: int, base: list, anchors: dict) -> None:
        go, link, length, ends, near, phrases, floor = self.auto.go, self.auto.link, self.auto.length, self.auto.ends, self.near, self.phrases, self.floor
        s = n = 0
        before: dict[int, tuple[int, int]] = {}
        for i, c in enumerate(run):
            while s and c not in go[s]:
                s = link[s]
                n = length[s]
            if c in go[s]:
                s = go[s][c]
                n += 1
            for size, label in phrases[s]:
                if n >= size:
                    base.append((first + i + 1 - size, label))
            now = {t: (m, p) for t, p in near[s].items() if (m := min(n, length[p])) >= floor} if n >= floor else {}
            for t, (m, p) in before.items():
                got = now.get(t)
                if got is None or got[0] != m + 1:
                    self.anchor(t, ends[p][t], first + i, m, anchors)
                elif len(ends[got[1]][t]) < len(ends[p][t]):  # some of its places go on otherwise
                    on = {e - 1 for e in ends[got[1]][t]}
                    self.anchor(t, [e for e in ends[p][t] if e not in on], first + i, m, anchors)
            before = now
        for t, (m, p) in before.items():
            self.anchor(t, ends[p][t], first + len(run), m, anchors)

    def anchor(self, t: int, ends: list[int], stop: int, n: int, anchors: dict) -> None:
        if n >= self.least_match or n == len(self.templates[t]):
            anchors[t] += [(stop - n, end + 1 - n, n) for end in ends]

    def chains(self, t: int, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """(start, words, cover) of the chains of sorted anchors (start, place, words) that cover enough of a template."""
        size = len(self.templates[t])
        if sum(n for _, _, n in anchors) < self.least_cover * size:
            return []
        start, place, n = (np.array(c, np.int64) for c in zip(*anchors))
        covered, back = n.copy(), np.full(len(n), -1)
        first = np.searchsorted(start, start - self.gap - size)
        for j in range(1, len(n)):
            i = slice(int(first[j]), j)
            lost = np.maximum(np.maximum(start[i] + n[i] - start[j], place[i] + n[i] - place[j]), 0)
            ok = (start[i] < start[j]) & (place[i] < place[j]) & (lost < n[j]) & (start[j] + lost - start[i] - n[i] <= self.gap)
            total = np.where(ok, covered[i] - lost, -1)
            k = int(total.argmax()) if len(total) else -1
            if k >= 0 and total[k] > 0:
                covered[j] += total[k]
                back[j] = first[j] + k
        out: list[tuple[int, int, float]] = []
        for j in np.lexsort((np.arange(len(n)), -covered)).tolist():
            if covered[j] < self.least_cover * size:
                break
            at = j
            while back[at] >= 0:
                at = int(back[at])
            a, b = int(start[at]), int(start[j] + n[j])
            if all(b <= x or a >= x + m for x, m, _ in out):
                out.append((a, b - a, min(1.0, int(covered[j]) / size)))
        return sorted(out)


SPANS = "array<struct<label:string,start:bigint,length:bigint,cover:double>>"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of docs.

    labels holds the base phrases' labels and those of the spans; score is the best cover, 1 for a base
    phrase, else 0. Null and empty texts have no words and no labels; then the label strings are empty and first_word and last_word null. Columns other
    than doc_id and text are not looked at; repeated rows are scanned each; an empty table gives an empty result. Of chains of
    one template that overlap in the text the one that covers most stays, the earlier on a tie.
    """

    def rows(read):
        scanner = Scanner(templates, phrases)
        for doc_id, text in read:
            words = alnum_words(text)
            base, spans = scanner.scan(words)
            starts = [s for s, _ in base]
            own = {label for _, label in base}
            named = [{"label": scanner.labels[t], "start": a, "length": n, "cover": c} for t, a, n, c in spans]
            yield (
                doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                sorted(own), sorted(own | {x["label"] for x in named}), 1.0 if base else max((x["cover"] for x in named), default=0.0), named,
            )

    out = arrow_map(texts(docs), rows, f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, found array<string>, score double, spans {SPANS}")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("found", ",").alias("labels"), "score", "spans")
