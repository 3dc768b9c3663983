"""Similarity, scores and text functions against published cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonosearch.functions import scores, text
from phonosearch.functions.inventory import PHONEMES, decode, encode
from phonosearch.functions.similarity import Config, Numbers, consonant_similarity, phoneme_similarity, vowel_similarity

VOWEL_CASES = [((1, 1, 1), 1), ((0, 0, 0), 0), ((1, 0, 0), 0.189), ((0.5, 0.5, 0.5), 0.29375), ((0.9, 0.1, 1), 0.3348), ((0.3, 0.8, 0.55), 0.31335), ((1, 1, 0), 0.351), ((0.75, 0.25, 0.5), 0.2833125)]
CONSONANT_CASES = [
    ((0, 0, 0, 0), 1), ((0.25, 0, 0, 0), 0.72), ((0.26, 0, 0, 0), 0.58), ((0.5, 0, 0, 0), 0.58), ((0.51, 0, 0, 0), 0.42), ((1, 0, 0, 0), 0.42), ((0, 0.25, 0, 0), 0.68), ((0, 0.26, 0, 0), 0.52),
    ((0, 0.5, 0, 0), 0.52), ((0, 0.51, 0, 0), 0.35), ((0, 1, 0, 0), 0.35), ((0.25, 0.25, 0, 0), 0.46), ((0.5, 0.5, 0.5, 0.5), 0.46), ((1, 1, 1, 1), 0), ((0.1, 0.9, 0.3, 0.7), 0.35), ((0.75, 0.2, 1, 0), 0.42),
]


@pytest.mark.parametrize("given_, expected", VOWEL_CASES)
def test_vowel_formula(given_, expected):
    assert vowel_similarity(Numbers, *given_) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("given_, expected", CONSONANT_CASES)
def test_consonant_formula(given_, expected):
    assert consonant_similarity(Numbers, *given_) == pytest.approx(expected, abs=1e-9)


def test_similarity_order():
    assert phoneme_similarity("p", "b") > phoneme_similarity("p", "t") > phoneme_similarity("p", "k")
    assert phoneme_similarity("a", "p") == 0 and phoneme_similarity("?", "a") == 0 and phoneme_similarity("?", "?") == 1


def test_tiers_must_rise():
    with pytest.raises(ValueError):
        Config(place_caps=((0.5, 0.5), (0.25, 0.7)))


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(PHONEMES), st.sampled_from(PHONEMES))
def test_similarity_laws(a, b):
    assert 0 <= phoneme_similarity(a, b) <= 1
    assert phoneme_similarity(a, b) == phoneme_similarity(b, a)


def test_codes_round_trip():
    assert decode(encode(PHONEMES)) == PHONEMES
    assert encode(["a", "?"])[1] == "!"


def test_frequency_weight(spark):
    df = spark.createDataFrame([(80.0, 5.0), (80.0, None), (80.0, 0.0)], "s double, z double")
    got = [r[0] for r in df.select(scores.frequency_weight(F.col("s"), F.col("z"), 10.0)).collect()]
    assert got[0] == pytest.approx(85.33333333333333)
    assert got[1] > got[2] == 0


SPANS = [
    ("맛있다", "m a t i t t* a", "맛:mat 있:it 다:t*a"), ("사람이", "s a ɾ a m i", "사:sa 람:ɾam 이:i"), ("괜찮아", "k wɛ n tɕʰ a n a", "괜:kwɛn 찮:tɕʰan 아:a"), ("없어", "ʌ p s* ʌ", "없:ʌps* 어:ʌ"),
    ("국가", "k u k k* a", "국:kuk 가:k*a"), ("신라", "s i l ɾ a", "신:sil 라:ɾa"), ("읽는", "i ŋ n ɯ n", "읽:iŋ 는:nɯn"), ("좋다", "tɕ o tʰ a", "좋:tɕo 다:tʰa"), ("가나다", "k a n a t a t a", "가:ka 나:nat 다:ata"),
]


def test_syllable_spans(spark):
    df = spark.createDataFrame([(w, p.split()) for w, p, _ in SPANS], "word string, p array<string>")
    got = {r.word: (r.p, r.s) for r in df.select("word", "p", text.syllable_spans(F.col("word"), F.col("p")).alias("s")).collect()}
    for w, _, expected in SPANS:
        p, s = got[w]
        assert " ".join(f"{x.char}:{''.join(p[x.start:x.end])}" for x in s) == expected


NAMES = [("나도", "n a t o", "ㄴㅏㄷㅗ"), ("맛있다", "m a t i t t* a", "ㅁㅏㄷㅣㄷㄸㅏ"), ("국가", "k u k k* a", "ㄱㅜㄱㄲㅏ"), ("사랑", "s a ɾ a ŋ", "ㅅㅏㄹㅏㅇ"), ("외계", "we k je", "ㅚㄱㅖ"), ("웨이브", "we i p ɯ", "ㅞㅣㅂㅡ"), ("의사", "ɯ s a", "ㅡㅅㅏ")]


def test_sound_names(spark):
    df = spark.createDataFrame([(w, p.split()) for w, p, _ in NAMES], "word string, p array<string>")
    got = {r.word: "".join(r.n) for r in df.select("word", text.sound_names(F.col("word"), F.col("p")).alias("n")).collect()}
    assert got == {w: n for w, _, n in NAMES}


def test_hangul_and_jamo(spark):
    df = spark.createDataFrame([("없어",), ("ㅋㅏ",), ("a",), ("",), (None,)], "w string")
    got = [r[0] for r in df.select(text.written_sounds(F.col("w"))).collect()]
    assert got == [["ʌ", "p", "ʌ"], ["kʰ", "a"], [], [], None]


def test_fold(spark):
    df = spark.createDataFrame([("  Café Ñandú ",), ("사랑",), (None,)], "w string")
    got = df.select(text.fold(F.col("w")).alias("a"), text.fold_any(F.col("w")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("cafe nandu", "cafe nandu"), ("사랑", "사랑"), (None, None)]
