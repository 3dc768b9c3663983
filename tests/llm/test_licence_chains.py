"""Spans of licences against chains found by plain search, one template at a time."""

import random
from collections import Counter

import pytest

from phonosearch.llm import license_scan
from phonosearch.llm.common import alnum_words

WORDS = "a b c d e f g h".split()


def slow_anchors(template, words, least_match):
    def places(run):
        return [i for i in range(len(template) - len(run) + 1) if template[i : i + len(run)] == run]

    longest = []
    for i in range(len(words)):
        longest.append(next((n for n in range(i + 1, 0, -1) if places(words[i + 1 - n : i + 1])), 0))
    out = set()
    for i, n in enumerate(longest):
        if n < least_match and n != len(template) or not n:
            continue
        for p in places(words[i + 1 - n : i + 1]):
            goes_on = i + 1 < len(words) and longest[i + 1] == n + 1 and p + n < len(template) and template[p + n] == words[i + 1]
            if not goes_on:
                out.add((i + 1 - n, p, n))
    return sorted(out)


def slow_spans(template, words, least_match, cover, gap):
    anchors = slow_anchors(template, words, least_match)
    best, since = [], []
    for start, place, n in anchors:
        most, begin = n, start
        for (s, p, m), b, f in zip(anchors, best, since):
            lost = max(s + m - start, p + m - place, 0)
            if s < start and p < place and lost < n and start + lost - s - m <= gap and b - lost + n > most:
                most, begin = b - lost + n, f
        best.append(most)
        since.append(begin)
    out = []
    for j in sorted(range(len(anchors)), key=lambda j: (-best[j], j)):
        a, b = since[j], anchors[j][0] + anchors[j][2]
        if best[j] >= cover * len(template) and all(b <= x or a >= x + m for x, m, _ in out):
            out.append((a, b - a, min(1.0, best[j] / len(template))))
    return sorted(out)


@pytest.mark.parametrize("least_match, cover, gap", [(3, 0.7, 8), (2, 0.5, 2), (1, 0.6, 1)])
def test_spans_are_the_best_chains(least_match, cover, gap):
    rng, found = random.Random(least_match), 0
    for _ in range(150):
        templates = {str(i): [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 16)))] for i in range(3)}
        scanner = license_scan.Scanner(templates, {}, least_match, cover, gap)
        words = []
        while len(words) < 40:  # pieces of templates, other words, quotations
            t = rng.choice(list(templates.values()))[0].split()
            a = rng.randrange(len(t))
            words += t[a : a + rng.randrange(1, 16)] + [rng.choice([*WORDS, "zz"]) for _ in range(rng.randrange(3))]
        _, spans = scanner.scan([w.encode() for w in words])
        want = [(i, *x) for i, t in enumerate(scanner.templates) for x in slow_spans([list(scanner.vocab)[w].decode() for w in t], words, least_match, cover, gap)]
        assert spans == want, (templates, words)
        found += len(want)
    assert found > 30


def test_a_quoted_phrase_in_the_middle_breaks_no_span():
    """A template's own words, quoted a second time within it, leave its other words in order."""
    scanner = license_scan.Scanner()
    rng, missed, trials = random.Random(9), 0, 0
    for t, ids in enumerate(scanner.templates):
        names = list(scanner.vocab)
        words = [names[i] for i in ids]
        if len(words) < 40:
            continue
        for _ in range(220):
            at = rng.randrange(20, len(words) - 10)
            a = rng.randrange(0, at - 8)
            text = [b"x", *words[:at], b"see", *words[a : a + 4], b"here", *words[at:], b"y"]
            _, spans = scanner.scan(text)
            trials += 1
            missed += not any(k == t and n >= len(words) and cover > 0.95 for k, _, n, cover in spans)
    assert trials >= 1300 and missed == 0


def test_phrases_and_templates_of_one_word():
    scanner = license_scan.Scanner({"short": ["licensed"], "two": ["as is"]}, {"mit": "mit", "gnu licence": "gpl"})
    base, spans = scanner.scan(alnum_words("MIT or licensed as is, gnu mit. GNU licence mit"))
    assert Counter(base) == Counter([(0, "mit"), (6, "mit"), (7, "gpl"), (9, "mit")])
    assert [(scanner.labels[t], a, n) for t, a, n, _ in spans] == [("short", 2, 1), ("two", 3, 2)]
    assert scanner.scan([]) == ([], []) and scanner.scan([b"mit"]) == ([(0, "mit")], [])


def test_ties_take_the_earlier_of_equal_copies_and_keep_both():
    scanner = license_scan.Scanner({"t": ["a b c d e f g h"]}, {})
    _, spans = scanner.scan(alnum_words("a b c d e f g h x a b c d e f g h"))
    assert [(a, n) for _, a, n, _ in spans] == [(0, 8), (9, 8)]


def test_scan_of_repeated_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, None), (2, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in license_scan.scan(df).collect())
    assert got == [(0, 0, 0, ""), (1, 2, 1, "mit"), (1, 2, 1, "mit"), (2, 0, 0, "")]
    assert license_scan.scan(df.limit(0)).count() == 0
