"""Token counts by offset-mapped attribution.

A whole text is encoded once with a byte-level vocabulary, whose tokens' bytes joined are the text's
bytes: the running sum of their lengths maps each token to its span. Sections are spans too (lines, by
default). The two sorted lists of spans are joined as intervals: a token belongs to the sections that
its span overlaps. The rule for a token that crosses a boundary: it is counted whole in the section
that holds most of its bytes, in the earlier one if two hold as many. So sections' counts sum to the text's.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, texts

#: Distinct pieces whose token lengths a worker remembers.
REMEMBER = 200_000


class Spans:
    """Lengths in bytes of a text's tokens, in order."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.encode = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.size = np.zeros(max(ranks.values()) + 1, np.uint32)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def lengths(self, text: str) -> np.ndarray:
        pieces, known = self.split(text), self.known
        if len(known) > REMEMBER:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.size[self.encode(p.encode("utf-8", "replace"))].tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), np.uint32)


_made: dict[tuple[str, str], Spans] = {}


def spans_of(path: str, pattern: str) -> Spans:
    """One for each worker process."""
    return _made.get((path, pattern)) or _made.setdefault((path, pattern), Spans(path, pattern))


def line_sections(raw: bytes) -> np.ndarray:
    """Where each line of a text begins, in bytes; a line holds its line feed. No text has no line."""
    if not raw:
        return np.zeros(0, np.int64)
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate(([0], feeds[feeds < len(raw)])).astype(np.int64)


def attribute(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) of each section.

    A token that overlaps more than two sections (a run of empty lines) goes by the same rule.
    """
    n = len(starts)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(lengths):
        return counts, crossing
    ends = np.cumsum(lengths.astype(np.int64))
    begins = ends - lengths
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    home = first.copy()
    stops = np.append(starts[1:], ends[-1])
    for i in np.flatnonzero(first != last).tolist():
        sections = np.arange(first[i], last[i] + 1)
        held = np.minimum(stops[sections], ends[i]) - np.maximum(starts[sections], begins[i])
        home[i] = sections[held.argmax()]
        crossing[home[i]] += 1
    counts += np.bincount(home, minlength=n)
    return counts, crossing


def section_tokens(docs: DataFrame, path: str, pattern: str, sections=line_sections) -> DataFrame:
    """doc_id, section (from 0), start, length (in bytes), n_tokens, n_crossing: a row for each section of each row of docs.

    sections(raw) gives where the sections of a text's bytes begin, the first at 0. Null and empty texts
    have no section and give no row. Repeated rows give repeated rows. Columns other than doc_id and text are not looked at.
    """

    def rows(read):
        spans = spans_of(path, pattern)
        for doc_id, text in read:
            if not text:
                continue
            raw = text.encode("utf-8", "replace")
            starts = sections(raw)
            counts, crossing = attribute(spans.lengths(text), starts)
            size = np.diff(np.append(starts, len(raw)))
            for k, row in enumerate(zip(starts.tolist(), size.tolist(), counts.tolist(), crossing.tolist())):
                yield doc_id, k, *row

    return arrow_map(texts(docs), rows, "doc_id bigint, section bigint, start bigint, length bigint, n_tokens bigint, n_crossing bigint", 20_000)


def document_tokens(docs: DataFrame, path: str, pattern: str, sections=line_sections) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, sections (start, length, n_tokens each): a row for each row of docs.

    Null and empty texts have no tokens and no sections. Of sections that hold equally many of a token's bytes the earlier gets it.
    Repeated rows are counted each; an empty table gives an empty result; columns other than doc_id and text are not looked at.
    """

    def rows(read):
        spans = spans_of(path, pattern)
        for doc_id, text in read:
            raw = (text or "").encode("utf-8", "replace")
            starts = sections(raw)
            counts, crossing = attribute(spans.lengths(text) if text else np.zeros(0, np.uint32), starts)
            size = np.diff(np.append(starts, len(raw)))
            yield doc_id, int(counts.sum()), len(starts), int(crossing.sum()), [{"start": a, "length": b, "n_tokens": c} for a, b, c in zip(starts.tolist(), size.tolist(), counts.tolist())]

    return arrow_map(texts(docs), rows, "doc_id bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, sections array<struct<start:bigint,length:bigint,n_tokens:bigint>>", 500)
