"""Kernel, word search and linked search on small lexicons."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonosearch.functions.inventory import CODES, PHONEMES, encode
from phonosearch.functions.similarity import phoneme_similarity
from phonosearch.functions.inventory import VOWELS
from phonosearch.operators import kernel, linked_search, word_search
from phonosearch.operators.service import SearchError, SearchService
from phonosearch.plans.request import Request, aligned, pairings, proportional, unique_lists, variants

SOME = ["k", "a", "n", "t", "o", "i", "s", "ʌ", "aɪ"]
sounds = st.lists(st.sampled_from(SOME), min_size=0, max_size=6)


def plain(target, query, weights, vw, cw):
    """The kernel's formula, one pair at a time."""
    if not target or not query:
        return 0.0
    if "".join(target) == "".join(query):
        return 100.0
    tw = [vw if p in VOWELS else cw for p in target]
    d = [[0.0] * (len(query) + 1) for _ in range(len(target) + 1)]
    for i, w in enumerate(tw):
        d[i + 1][0] = d[i][0] + w
    for j, w in enumerate(weights):
        d[0][j + 1] = d[0][j] + w
    for i, t in enumerate(target):
        for j, q in enumerate(query):
            d[i + 1][j + 1] = min(d[i + 1][j] + weights[j], d[i][j + 1] + tw[i], d[i][j] + max(tw[i], weights[j]) * (1 - phoneme_similarity(t, q)))
    most = max(sum(tw), sum(weights))
    best = max(1 - d[-1][-1] / most, 0) * 100 if most else 0.0
    if sum(weights) > 0:
        for s in range(len(target) - len(query) + 1):
            best = max(best, sum(phoneme_similarity(target[s + j], q) * weights[j] for j, q in enumerate(query)) / sum(weights) * 100)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(sounds, min_size=1, max_size=5), sounds, st.lists(st.sampled_from([0.0, 1.0, 2.0, 7.0]), min_size=6, max_size=6))
def test_kernel_is_the_formula(targets, query, detail):
    q = kernel.prepare(query, detail[: len(query)], 2.5, 1.0)
    got = kernel.score_codes(pa.array([encode(t) for t in targets]), q)
    expected = [plain(t, query, list(q.weights), 2.5, 1.0) for t in targets]
    assert np.allclose(got, expected, atol=1e-9)
    assert ((got >= 0) & (got <= 100 + 1e-9)).all()


def test_kernel_without_python(spark):
    words = [list("kana"), list("kano"), list("tin"), ["s"], []]
    q = kernel.prepare(list("kan"), [1.0, 3.0, 1.0], 2.5, 1.0)
    df = spark.createDataFrame([(encode(w),) for w in words], "c string")
    for a, b in df.select(kernel.score(F.col("c"), q), kernel.plain_score(F.col("c"), q)).collect():
        assert a == b


def test_null_codes():
    assert kernel.score_codes(pa.array([None, encode("ka")]), kernel.prepare(list("ka")))[0] == 0


@pytest.mark.parametrize("detail, source, target, expected", [
    ([1, 10, 1], "l ʌ v", "ɾ ʌ p ɯ", [1, 10, 1, 1]), ([1, 1, 10], "l ʌ v", "ɾ ʌ p ɯ", [1, 1, 10, 10]), ([1, 10, 1], "t aɪ m", "tʰ a i m", [1, 10, 10, 1]),
    ([10, 5, 1], "f l oʊ", "pʰ ɯ l ɾ o", [10, 10, 5, 5, 1]), ([3, 1, 7], "l ʌ v", "l ʌ v", [3, 1, 7]),
])
def test_aligned_transfer(detail, source, target, expected):
    assert aligned(detail, source.split(), target.split()) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*SOME, "?"]), min_size=1, max_size=5), st.lists(st.sampled_from([*SOME, "?"]), min_size=1, max_size=5))
def test_pairing_is_the_cheapest(source, target):
    """Against all pairings in order, by enumeration."""
    from itertools import combinations

    from phonosearch.plans.request import GAP, pairing, resemblance

    like = resemblance(source, target)
    assert all(like[i, j] == pytest.approx(phoneme_similarity(p, q)) for i, p in enumerate(source) for j, q in enumerate(target))
    cost = lambda pairs: GAP * (len(source) + len(target) - 2 * len(pairs)) + sum(1 - like[i, j] for i, j in pairs)
    best = min(cost(list(zip(a, b))) for k in range(min(len(source), len(target)) + 1) for a in combinations(range(len(source)), k) for b in combinations(range(len(target)), k))
    partner = pairing(like)
    pairs = [(int(i), j) for j, i in enumerate(partner) if i >= 0]
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs)
    assert cost(pairs) == pytest.approx(best)
    moved = aligned(list(range(1, len(source) + 1)), source, target)
    assert [moved[j] for _, j in pairs] == [i + 1 for i, _ in pairs] and len(moved) == len(target)


@settings(max_examples=80, deadline=None)
@given(sounds, sounds)
def test_matches_have_the_kernels_score(target, query):
    q = kernel.prepare(query, None, 2.5, 1.0)
    score, found = kernel.match_indices(target, q)
    assert score == pytest.approx(plain(target, query, list(q.weights), 2.5, 1.0)) and found == sorted(set(found)) and all(0 <= i < len(target) for i in found)


def test_a_word_of_several_pronunciations_is_one_unit(spark):
    """One edge between two words of two pronunciations each is one pair, scored by the best of them."""
    rows = [(0, "x", None, False, [encode("s a k a".split()), encode("t a k a".split())], 1.0), (1, "y", None, False, [encode("n o p i".split()), encode("n a p i".split())], 1.0)]
    two = spark.createDataFrame(rows, "id int, text string, norm_text string, is_particle boolean, ko array<string>, zipf double")
    pairs, _ = linked_search.collect(two, spark.createDataFrame([(0, 1)], "first int, second int"), LINK, "ko", ("ko",))
    assert [(r.first, r.second, r.boundary) for r in pairs.collect()] == [(0, 1, 100.0)]


def test_other_transfers_and_lists():
    assert proportional([1, 2], ["a", "b"], list("abcd")) == [1, 1, 2, 2]
    assert proportional([], [], ["a"]) == [1.0] and aligned([], [], ["a"]) == [1.0] and aligned([1], ["a"], []) == []
    assert unique_lists([["a"], [], ["a"], ["b"]]) == [("a",), ("b",)]


WORDS = [(0, "가나", "ko", 5.0, "k a n a", None, None), (1, "다나", "ko", 2.0, "t a n a", None, None), (2, "기니", "ko", None, "k i n i", None, None), (3, "canna", "en", 3.0, None, "k a n ʌ", "k a n a"), (4, "tuna", "en", 4.0, None, "t o n ʌ", "t o n a")]


def lexicon(spark):
    code = lambda p: [encode(p.split())] if p else []
    rows = [(i, w, lang, z, code(a), code(b), code(c)) for i, w, lang, z, a, b, c in WORDS]
    df = spark.createDataFrame(rows, "word_id int, word string, lang string, zipf double, ko array<string>, native array<string>, koreanized array<string>")
    return df.withColumn("ord", F.col("word_id"))


def request(**more):
    return Request("카나", tuple("kana"), korean=(tuple("kana"),), **more)


def found(df):
    return [(r.word, r.key) for r in df.orderBy(F.desc("key"), "ord").collect()]


def test_word_search(spark):
    lex = lexicon(spark)
    got = found(word_search.search(lex, request(frequency_weight=0.0)))
    assert got[0] == ("가나", 100000) and "tuna" in dict(got)
    # Korean words take the koreanized queries too, English ones all four pairings: canna's Korean reading is exact
    assert dict(got)["canna"] == 100000
    again = word_search.rank(word_search.score_raw(lex, request()), request(frequency_weight=9.0))
    assert found(again) == found(word_search.search(lex, request(frequency_weight=9.0)))


def test_filters(spark):
    lex = lexicon(spark)
    words = lambda **m: {w for w, _ in found(word_search.search(lex, request(**m)))}
    assert "가나" not in words(exclude=(" 나",)) and "canna" in words(exclude=("나",))
    assert words(languages=("en",)) <= {"canna", "tuna"}
    own = word_search.search(lex, Request("CANNA", tuple("kana")))
    assert "canna" not in {w for w, _ in found(own)}
    vowels = found(word_search.search(lex, request(vowels_only=True, frequency_weight=0.0, languages=("ko",))))
    assert [v for v in vowels[:2]] == [("가나", 100000), ("다나", 100000)]
    assert not words(languages=())


def test_explain_and_pages(spark):
    lex = lexicon(spark)
    ranked = word_search.search(lex, request())
    rows = word_search.explain(word_search.page(ranked), request()).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    first = next(r for r in rows if r.word == "가나")
    assert first.label == "ko" and first.target == list("kana") and first.matched == [0, 1, 2, 3]
    assert [r.word for r in word_search.page(ranked, 1, 2).orderBy("rank").collect()] == [r.word for r in rows[1:3]]


def test_topic_drops_words_without_vector(spark):
    raw = word_search.score_raw(lexicon(spark), request()).withColumn("similarity", F.when(F.col("word") == "가나", 1.0).when(F.col("word") == "다나", -1.0))
    got = found(word_search.rank(raw, request(topic_weight=10.0, frequency_weight=0.0)))
    assert [w for w, _ in got] == ["가나", "다나"] and got[0][1] == 100000 and got[1][1] < 40000


def test_empty_lexicon(spark):
    assert found(word_search.search(lexicon(spark).limit(0), request())) == []


def test_variants_missing_is_not_empty():
    assert variants(Request("x", ("a",))).korean and variants(Request("x", ("a",), korean=())).korean == ()
    assert len(pairings(Request("x", ("a",)))) == 5
    with pytest.raises(ValueError):
        Request("x", ("a",), mode="other")


SURFACES = [(0, "사가", "s a k a", None, 4.0), (1, "나비", "n a p i", None, 4.0), (2, "마니", "m a n i", None, 3.0), (3, "가을", "k a i l", None, 4.0), (4, "사가는", "s a k a n i n", 0, 3.0), (5, "소금", "s o k i m", None, 2.0)]
EDGES = [(0, 1), (0, 2), (0, 3), (4, 1), (5, 1)]


def units(spark):
    rows = [(i, t, SURFACES[n][1] if n is not None else None, n is not None, encode(p.split()), z) for i, t, p, n, z in SURFACES]
    return spark.createDataFrame(rows, "id int, text string, norm_text string, is_particle boolean, ko string, zipf double")


LINK = Request("가나", tuple("kana"), korean=(tuple("kana"),), syllables=(("가", 0), ("나", 2)), frequency_weight=0.0)


def linked(spark, request=LINK):
    edges = spark.createDataFrame(EDGES, "first int, second int")
    return linked_search.collect(units(spark), edges, request, "ko", ("ko",))


def test_linked_search(spark):
    pairs, plan = linked(spark)
    assert [s.label for s in plan] == ["가 / 나"]
    got = {(r.first, r.second): (r.left, r.right, r.boundary) for r in pairs.collect()}
    assert got[0, 1] == (100, 100, 100) and (4, 1) not in got
    text = lambda side: F.col(side)
    page = pairs.where("first = 0 and second = 1").withColumns({"first_text": F.lit("사가"), "second_text": F.lit("나비")})
    assert linked_search.describe(page, plan).first().display == "사[가 나]비"
    assert text


def test_linked_exclusion_and_particles(spark):
    from dataclasses import replace

    pairs, _ = linked(spark, replace(LINK, exclude=("나비",)))
    assert (0, 1) not in {(r.first, r.second) for r in pairs.collect()}
    pairs, _ = linked(spark, replace(LINK, allow_first_particle=True))
    assert (4, 1) not in {(r.first, r.second) for r in pairs.where("boundary > 99").collect()}
    pairs, _ = linked(spark, replace(LINK, allow_first_particle=True, exclude=("사가",)))
    assert {r.first for r in pairs.collect()} <= {5}
    with pytest.raises(linked_search.NoSplits):
        linked(spark, Request("k", ("k",)))


def test_korean_pairs_are_the_formula(spark):
    """The registered query's rows against the formula, one edge and side at a time."""
    from phonosearch.plans.build_queries import linked_search_korean

    weight = lambda query: [2.5 if p in VOWELS else 1.0 for p in query]
    side = lambda part, query: plain(part, query, weight(query), 2.5, 1.0) if len(part) == len(query) else 0.0
    expected = {}
    for first, second in EDGES:
        a, b = SURFACES[first], SURFACES[second]
        left, right = side(a[2].split()[-2:], ["k", "a"]), side(b[2].split()[:2], ["n", "a"])
        if a[3] is None and left > 40 and right > 40:
            expected[f"{a[1][:-1]}[{a[1][-1]} {b[1][0]}]{b[1][1:]}"] = (left + right) / 2
    got = {r.display: r.score / 1000 for r in linked_search_korean(spark, "").collect()}
    assert got == pytest.approx(expected, abs=5.01e-4)
    assert len(got) > 1


def test_split_points():
    places = lambda p: [x[0] for x in linked_search.split_points(p)]
    assert places(list("kana")) == [1, 2, 3] and places(list("ktsn")) == []
    assert places(list("kanata")) == [2, 3, 4]
    assert linked_search.importance([0, 0]) == 1 and linked_search.importance([float("nan"), -1, 2]) == 3


def test_service(spark):
    service = SearchService(lambda: lexicon(spark))
    number, rows = service.handle({"type": "search", "request": request()})
    assert rows[0].rank == 1
    raw = service.raw
    service.search(request(frequency_weight=5.0))
    assert service.raw is raw  # ranked again, not scored again
    service.search(request(exclude=("x",)))
    with pytest.raises(SearchError) as e:
        service.page(number)
    assert e.value.code == "stale_results"
    for message, code in (({"type": "x"}, "unsupported_message"), ({"type": "search", "request": Request("1", ())}, "no_pronunciation")):
        with pytest.raises(SearchError) as e:
            service.handle(message)
        assert e.value.code == code


def test_loader_tries_again():
    calls = []

    def load():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("gone")
        return "table"

    from phonosearch.operators.service import Loader

    loader = Loader(load)
    with pytest.raises(SearchError):
        loader.get()
    assert loader.get() == loader.get() == "table" and len(calls) == 2


def test_all_codes_are_single_characters():
    assert len(set(CODES.values())) == len(PHONEMES) and all(len(c) == 1 for c in CODES.values())


def test_another_similarity(spark):
    """A request's own configuration decides the scores of both kernels and of linked search."""
    from dataclasses import replace

    from phonosearch.functions.similarity import Config

    other = Config(consonant=(0.1, 0.1, 0.4, 0.4), place_caps=((0.25, 0.9), (0.5, 0.8)), place_else=0.7)
    q, own = kernel.prepare(list("kan"), None, 2.5, 1.0), kernel.prepare(list("kan"), None, 2.5, 1.0, config=other)
    df = spark.createDataFrame([(encode(list("tan")),)], "c string")
    a, b, c = df.select(kernel.score(F.col("c"), q), kernel.score(F.col("c"), own), kernel.plain_score(F.col("c"), own)).first()
    assert a != b == c
    plain_pairs, _ = linked(spark)
    pairs, _ = linked(spark, replace(LINK, config=other))
    assert {(r.first, r.second): r.boundary for r in pairs.collect()} != {(r.first, r.second): r.boundary for r in plain_pairs.collect()}
