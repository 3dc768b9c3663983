"""Operators with exact answers against brute force: near duplicates, contamination, packing, rules, licences."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonosearch.llm import decontaminate, license_scan, packing, quality_rules, simhash
from phonosearch.llm.common import alnum_words, space_words

DOCS = "doc_id bigint, text string"
ODD = [None, "", " \t\n\x0b\f\r", "one", "One two", "a b c d e", "ÄÖ x   y", "퟿\U0001f600 z", "x" * 5000, "w " * 3000]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).withColumns({k: F.lit(v) for k, v in more.items()})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_words(text):
    assert [w.decode() for w in space_words(text)] == re.findall("[^\x20\x09-\x0d]+", low(text))
    assert [w.decode() for w in alnum_words(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))


def slow_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", low(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB \n\té", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def groups(fps, bits=4):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(40)) for _ in range(120)) for _ in range(12)]
    texts = [*ODD, *base, *base[:3]]
    for b in base:
        w = b.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts, component_id=7, fp="x")).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    expected = groups(fps)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == expected
    assert len(set(expected)) < len(texts) - 10
    kept = simhash.keep_first(docs_of(spark, texts, kept_id=1)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected))


def test_links_through_long_lists(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(20)]
    near = set(fps)
    for _ in range(400):
        f = rng.choice(sorted(near))
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(16)
        near.add(f)
    near = sorted(near)
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    roots = {}
    for cap in (1 << 16, 40):
        found = simhash.components(simhash.links(df, bucket_rows=cap)).collect()
        roots[cap] = {r.node: r.root for r in found}
    group = groups(near)
    for found in roots.values():
        for i, x in enumerate(signed):
            assert found.get(x, x) == min(signed[j] for j in range(len(near)) if group[j] == group[i])


def test_streamed_lists_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 30, 3000))
    fps = rng.integers(0, 1 << 12, 3000)

    def components(step, cap, chunk):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(fps[i : i + step])], names=["k", "fp"]) for i in range(0, len(keys), step)]
        links, over = [], Counter()
        for b in simhash.lists_to_links(4, 4, cap, chunk)(iter(batches)):
            for u, v, k, block in zip(*(c.to_pylist() for c in b.columns)):
                if block is None:
                    links.append((u, v))
                else:
                    over[k] += 1
        return links, over

    _, none = components(100, 1 << 16, 500)
    assert not none
    sizes = Counter(keys.tolist())
    for step, chunk in ((7, 50), (100, 500), (3000, 10_000)):
        _, over = components(step, 90, chunk)
        assert over == {k: n for k, n in sizes.items() if n > 90}


def test_empty_near_duplicates(spark):
    assert simhash.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], DOCS)
    assert {r.component_id for r in simhash.near_duplicates(nameless).collect()} == {3}


def slow_contamination(texts, items, window=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    held = {}
    for i, t in items:
        w = pattern.findall(low(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            held.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = pattern.findall(low(t or "")), set(), set()
        for n in {len(k) for k in held}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit.update(range(k, k + n))
                    found |= held[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("the of a in it thing other Word9 né".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "...")]
    texts = [*ODD]
    for _ in range(40):
        t = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            t[rng.randrange(len(t) + 1) : 0] = rng.choice(items[:30])[1].split()
        texts.append(", ".join(t))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    expected = slow_contamination(texts, items)
    for size in (1 << 20, 200):
        got = {r.doc_id: r for r in decontaminate.find_windows(docs_of(spark, texts, n_hit=5), bench, block_bytes=size).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].item_ids) for i in range(len(texts))] == expected
    clean = decontaminate.decontaminated(docs_of(spark, texts, items="x"), bench, block_bytes=200)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, e in enumerate(expected) if not e[1]]
    assert decontaminate.find_windows(docs_of(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_windows(docs_of(spark, texts).limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_are_the_tokenizers(vocabulary):
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(vocabulary), packing.WordIds(vocabulary)
    rng = random.Random(4)
    texts = [t for t in ODD if t] + ["don't WE'LL it's 3.14 foo_bar <|endoftext|> a<|startoftext|>b İx ſt Ǆ ß ½ é e ́ 한국어 \x1c\x85 ²"]
    texts += ["".join(rng.choice("abcdeéèüßñ ABC.,!'’#\n12½") for _ in range(200)) for _ in range(100)]
    for t in texts:
        ids = np.frombuffer(fast.text(t), "<u4").tolist()
        assert ids == exact.encode(t, add_special_tokens=False).ids, t


def test_every_merged_token_is_reached_by_its_own_letters(vocabulary):
    """Then merging by rank gives what the merge list gives for any word."""
    import json

    model = json.load(open(vocabulary, encoding="utf-8"))["model"]
    fast = packing.WordIds(vocabulary)
    byte_of = {c: b for b, c in enumerate(packing.byte_letters())}
    bad = 0
    for token, i in model["vocab"].items():
        if token.endswith("</w>"):
            raw = bytes(byte_of[c] for c in token[:-4])
            bad += [x - 1 for x in fast.merge(raw + b"\xff")] != [i]
    assert bad == 0


def test_packing(spark, vocabulary):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice([3, 700, 2047, 2048, 5000]))) for _ in range(40)), *["same text"] * 300]
    got = packing.pack(docs_of(spark, texts, row=1, length=2), vocabulary).orderBy("sequence_id", "offset").collect()
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    fill, pieces = Counter(), {}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.offset == fill[r.sequence_id] and r.length > 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *own[r.start : r.start + r.length]))
        fill[r.sequence_id] += r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own)
    assert max(fill.values()) <= 2048 and sum(fill.values()) > 0.97 * 2048 * (len(fill) - 1)
    assert packing.pack(docs_of(spark, ["x"]).limit(0), vocabulary).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 500), min_size=1, max_size=12))
def test_plan_covers_exactly(histogram):
    tops = packing.class_tops(256)
    histogram = {c: n for c, n in histogram.items() if c < len(tops)}
    made = packing.plan(histogram, tops, 256)
    total = Counter()
    for held, use in made:
        assert use > 0 and sum(int(tops[c]) * n for c, n in held.items()) <= 256
        for c, n in held.items():
            total[c] += n * use
    assert total == histogram


def slow_quality(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    count, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = [*ODD, "a b c a b c", "a b c\n\na b c\n \n", "x " * 3 + "# <|> \U0001f600"]
    texts += [" ".join(rng.choice("a b c d e f g h".split()[:k]) for _ in range(n)) + rng.choice(["", "\n", "\nq\nq"]) for k in (2, 4, 8) for n in (3, 10, 60, 400)]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, texts, words="x", n_words=9), []).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_quality(t), repr(t)[:80]
        assert r.kept == (not r.base_failed)
    assert quality_rules.judge(docs_of(spark, ["x"]).limit(0), []).count() == 0


def test_rules_are_learned_and_ordered(spark):
    rng = random.Random(7)
    good = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(90)]
    bad = [" ".join(f"W{rng.randrange(900)}!!" for _ in range(80)) for _ in range(30)] + [" ".join(f"w{rng.randrange(900)}###" for _ in range(80)) for _ in range(30)]
    docs = docs_of(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < 90), 0) for i in range(150)] + [(None, 1, 0), (0, None, 0)], "doc_id bigint, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert 1 <= len(rules) <= 4
    kept = {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").collect()}
    assert len(kept & set(range(90))) >= 88 and len(kept & set(range(90, 150))) <= 2
    assert quality_rules.fit(docs, labels.limit(0)) == []


def test_licences(spark):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    texts = [*ODD, "Released under the MIT License.", "mit mit license apache license license", "GNU general public public license; General-Public-License", "All rights reserved.", "all rights", "MIT\nLicense"]
    texts += [license_scan.TEMPLATES["bsd"][0], "x " + " y ".join(license_scan.TEMPLATES["mit"][:2]), license_scan.TEMPLATES["bsd"][1][:40]]
    rng = random.Random(8)
    texts += [" ".join(rng.choice("mit license apache general public the of software".split()) for _ in range(60)) for _ in range(40)]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts, labels="x")).collect()}
    for i, t in enumerate(texts):
        w = pattern.findall(low(t or ""))
        at = [(k, v) for p, v in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        starts = [k for k, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at}))), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    n = len(ODD)
    assert got[n + 3].labels == "proprietary" and got[n + 4].labels == "" and got[n + 6].labels == "bsd" and got[n + 8].labels == ""
    assert "mit" in got[n + 7].labels and all(s.cover >= 0.7 for s in got[n + 7].spans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=12))
def test_generalised_automaton(sequences, text):
    """The matching statistics are the longest runs that some sequence holds."""
    auto = license_scan.Automaton(sequences)
    held = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    s = n = 0
    for i, c in enumerate(text):
        while s and c not in auto.go[s]:
            s = auto.link[s]
            n = auto.length[s]
        if c in auto.go[s]:
            s, n = auto.go[s][c], n + 1
        longest = max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in held), default=0)
        assert n == longest
        for t, ends in auto.ends[s].items():
            assert ends == [e for e in range(n - 1, len(sequences[t])) if sequences[t][e + 1 - n : e + 1] == text[i + 1 - n : i + 1]]
        assert {t for t, q in enumerate(sequences) if n and any(q[k : k + n] == text[i + 1 - n : i + 1] for k in range(len(q)))} == (set(auto.ends[s]) if n else set())


def test_digest_columns(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]


def test_plan_of_all_classes_is_within_a_thousandth_of_the_linear_program():
    tops = packing.class_tops()
    rng = np.random.default_rng(3)
    mixed = [rng.integers(1, 10**6, len(tops)), (10 ** rng.uniform(0, 6, len(tops))).astype(int) + 1, np.where(tops % 3 == 0, 10**5, 7)]
    for demand in mixed:
        patterns, x, bound = packing.solve(demand.astype(float), tops, 2048)
        assert np.allclose(patterns.T @ x, demand) and (patterns @ tops <= 2048).all()
        # the bound is that of prices at which no pattern is worth more than one: by a plain dynamic program
        prices = np.linalg.solve(patterns.astype(float), np.ones(len(tops)))
        best = [0.0]
        for c in range(1, 2049):
            best.append(max([best[c - 1], *(best[c - s] + v for v, s in zip(prices, tops.tolist()) if s <= c)]))
        assert x.sum() <= 1.001 * (demand @ prices) / best[2048] * (1 + 1e-5) and x.sum() <= 1.0011 * bound
        made = packing.plan(dict(enumerate(demand.tolist())), tops)
        assert sum(use for _, use in made) <= x.sum() + len(tops)
        assert Counter({c: sum(use * held.get(c, 0) for held, use in made) for c in range(len(tops))}) == dict(enumerate(demand.tolist()))


def test_packing_ignores_how_a_class_is_dealt(spark, vocabulary):
    """Ranked in many parts or in one, each sequence is gapless and each id lies in one piece; clashing column names are not looked at."""
    texts = [" ".join(["alpha beta"] * n) for n in (3, 3, 3, 900, 2048, 5000)] * 30 + [None, "", "x"]
    docs = docs_of(spark, texts, **{"class": 1, "salt": 2, "rank": 3, "slot": 4})
    for ranked in (5, 10**6):
        got = packing.pack(docs, vocabulary, ranked=ranked).orderBy("sequence_id", "offset").collect()
        fill = Counter()
        for r in got:
            assert r.offset == fill[r.sequence_id]
            fill[r.sequence_id] += r.length
        assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 2048
        by_doc = Counter()
        for r in got:
            by_doc[r.doc_id] += r.length
        assert all(by_doc[r.doc_id] == r.doc_tokens for r in got)


def test_every_pair_that_reaches_the_minimum_meets_in_a_list():
    from itertools import combinations

    for least in range(1, 9):
        posted = simhash.positions(least)
        assert len(set(posted)) == len(posted) and all(any(set(p) <= set(c) for p in posted) for c in combinations(range(8), least))
    assert {len(p) for p in simhash.positions(4)} == {3} and len(simhash.positions(4)) < 30
    # a pair that shares three bytes meets, but is ruled out by the tally though it differs in few bits
    one = np.array([0], np.int64)
    assert not simhash.close(one, np.array([0x0101010101], np.int64), 4, 64)[0]
    assert simhash.close(one, np.array([0x01010101], np.int64), 4, 4)[0]


def test_first_rows_of_components(spark):
    """Texts under one doc_id are judged each; equal rows are one; rows without an id come last."""
    rng = random.Random(12)
    one, two = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(2))
    rows = [(3, one, "a"), (3, two, "b"), (4, one, "c"), (3, one, "a"), (None, two, "d"), (None, "alone here", "e"), (None, "alone here", "e"), (8, None, "f"), (7, " ", "g")]
    df = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id bigint, text string, own string, fp int")
    assert sorted(map(tuple, simhash.keep_first(df).collect()), key=str) == sorted([(3, one, "a", 1), (3, two, "b", 1), (None, "alone here", "e", 1), (7, " ", "g", 1)], key=str)
    assert simhash.keep_first(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def slow_rules(rows, precise, least, most):
    """Sequential covering as the module describes it, by plain search over all thresholds."""
    import math

    def meets(r, c):
        return r[c[0]] >= c[2] if c[1] == ">=" else r[c[0]] <= c[2]

    def gain(inside, outside_p, outside_n):
        p = sum(r["bad"] for r in inside)
        return p * (math.log2(p / len(inside)) - math.log2(outside_p / (outside_p + outside_n))) if p else -1.0

    rules, rest = [], rows
    while len(rules) < most:
        part, rule = [r for r in rest if r["part"] != 0], []
        while len(rule) < 3 and part and any(r["bad"] for r in part) and not all(r["bad"] for r in part):
            p0 = sum(r["bad"] for r in part)
            options = []
            for f in quality_rules.FEATURES:
                found = sorted({r[f] for r in part})
                for t in [(a + b) / 2 for a, b in zip(found, found[1:])]:
                    for op in ("<=", ">="):
                        c = (f, op, t)
                        options.append((gain([r for r in part if meets(r, c)], p0, len(part) - p0), c))
            top = max(options, key=lambda x: x[0], default=(0, None))
            if top[0] <= 0:
                break
            rule.append(top[1])
            part = [r for r in part if meets(r, top[1])]
        prune = [r for r in rest if r["part"] == 0]

        def worth(conditions):
            got = [r["bad"] for r in prune if all(meets(r, c) for c in conditions)]
            return ((2 * sum(got) - len(got)) / len(got) if got else -1.0), sum(got)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = [r["bad"] for r in rest if rule and all(meets(r, c) for c in rule)]
        if sum(got) < least or sum(got) < precise * len(got):
            break
        rules.append(rule)
        rest = [r for r in rest if not all(meets(r, c) for c in rule)]
    return rules


@pytest.mark.parametrize("seed", range(6))
def test_learned_rules_are_those_of_plain_covering(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        r = {f: float(rng.randrange(12)) for f in quality_rules.FEATURES}
        a, b, c = quality_rules.FEATURES[:3]
        r["bad"] = int(r[a] >= 9 or (r[b] <= 2 and r[c] >= 7))
        r["part"] = rng.randrange(3)
        rows.append(r)
    got = quality_rules.learn(rows)
    assert got and got == slow_rules(rows, 0.98, 4, 12)


def test_judging_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (2, "word " * 60)], DOCS).withColumn("n_words", F.lit("x")).withColumn("rule", F.lit(1))
    rules = [[(quality_rules.FEATURES[0], ">=", 1e9)]]
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(df, rules).collect())
    assert got == [(0, 0, True, False), (1, 3, True, False), (1, 3, True, False), (2, 60, True, False)]
    assert quality_rules.judge(df.limit(0), rules).count() == 0
