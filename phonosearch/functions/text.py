"""Functions of written text: folding, tokens, Hangul, jamo, lists of words."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inventory import CODA_LETTERS, CODAS, KOREAN_VOWELS, NUCLEI, NUCLEUS_LETTERS, ONSET_LETTERS, ONSETS, SOUND_NAMES

TOKEN = "[가-힣ㄱ-ㅎㅏ-ㅣ]+|[a-z0-9']+"
JAMO, HANGUL, DIGITS = "[ㄱ-ㅎㅏ-ㅣ]", "^[가-힣]+$", "^[0-9]+$"


def accents() -> tuple[str, str]:
    """Lower-case Latin letters with accents below U+0250 and what they are without."""
    pairs = [(c, "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")) for c in map(chr, range(0xC0, 0x250))]
    kept = [(c, b) for c, b in pairs if len(b) == 1 and b != c]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


def fold(text: Column) -> Column:
    """Trimmed, lower-cased, without accents. Latin letters stay in the JVM; other scripts go through fold_any."""
    before, after = accents()
    return F.translate(F.lower(F.trim(text)), before, after)


@F.arrow_udf(T.StringType())
def fold_any(text: pa.Array) -> pa.Array:
    """fold() for all scripts: decompose, drop combining marks U+0300 to U+036F, compose."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        apart = unicodedata.normalize("NFD", t.strip().lower())
        return unicodedata.normalize("NFC", "".join(c for c in apart if not "̀" <= c <= "ͯ"))

    return pa.array([one(t) for t in text.to_pylist()], pa.string())


def tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def token_class(token: Column, in_lexicon: Column) -> Column:
    """jamo, hangul, lexicon, number (dropped and reported), or model."""
    return F.when(token.rlike(JAMO), "jamo").when(token.rlike(HANGUL), "hangul").when(in_lexicon, "lexicon").when(token.rlike(DIGITS), "number").otherwise("model")


def literal_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def literal_map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs for x in kv))


def syllable(char: Column) -> Column:
    """Number of a Hangul syllable from 0, null for any other character."""
    code = F.ascii(char) - 0xAC00
    return F.when(code.between(0, 11171), code)


def onset(s: Column) -> Column:
    return F.floor(s / 588).cast("int")


def nucleus(s: Column) -> Column:
    return F.floor((s % 588) / 28).cast("int")


def coda(s: Column) -> Column:
    return (s % 28).cast("int")


def syllable_sounds(s: Column) -> Column:
    parts = F.array(F.get(literal_array(ONSETS), onset(s)), F.get(literal_array(NUCLEI), nucleus(s)), F.get(literal_array(CODAS), coda(s)))
    return F.filter(parts, lambda p: p != "")


def hangul_sounds(word: Column) -> Column:
    """Sounds by spelling, syllable by syllable; a silent onset has none; other characters are skipped."""
    return F.flatten(F.filter(F.transform(F.split(word, ""), lambda c: syllable_sounds(syllable(c))), lambda x: x.isNotNull()))


def jamo_table() -> list[tuple[str, str]]:
    """A letter's sound: as a vowel, else as an onset, else as a coda."""
    out: dict[str, str] = {}
    for letters, sounds in ((NUCLEUS_LETTERS, NUCLEI), (ONSET_LETTERS, ONSETS), (CODA_LETTERS, CODAS)):
        for letter, sound in zip(letters, sounds):
            if letter and sound:
                out.setdefault(letter, sound)
    return list(out.items())


def written_sounds(text: Column) -> Column:
    """Sounds of mixed syllables and single letters; characters without a sound are skipped."""
    table = literal_map(jamo_table())

    def one(c: Column) -> Column:
        return F.when(syllable(c).isNotNull(), syllable_sounds(syllable(c))).when(F.map_contains_key(table, c), F.array(F.try_element_at(table, c))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(text, ""), one))


def model_tokens(word: Column) -> Column:
    """Input tokens of the pronunciation model: parts of syllables by number; other characters as they are."""

    def one(c: Column) -> Column:
        s = syllable(c)
        last = F.when(coda(s) > 0, F.array(F.concat(F.lit("J"), coda(s)))).otherwise(F.array().cast("array<string>"))
        return F.when(s.isNotNull(), F.concat(F.array(F.concat(F.lit("C"), onset(s)), F.concat(F.lit("V"), nucleus(s))), last)).otherwise(F.array(c))

    return F.flatten(F.transform(F.split(word, ""), one))


def vowel_places(sounds: Column) -> Column:
    vowels = literal_array(KOREAN_VOWELS)
    return F.filter(F.transform(sounds, lambda p, i: F.when(F.array_contains(vowels, p), i)), lambda i: i.isNotNull())


def sound_names(word: Column, sounds: Column) -> Column:
    """A letter for each sound; a vowel's written letter where it is pronounced as written."""
    names, nuclei, letters = literal_map(SOUND_NAMES.items()), literal_array(NUCLEI), literal_array(NUCLEUS_LETTERS)
    vowels = literal_array(KOREAN_VOWELS)
    written = F.transform(F.split(word, ""), lambda c: nucleus(syllable(c)))
    aligned = F.size(vowel_places(sounds)) == F.length(word)

    def one(p: Column, i: Column) -> Column:
        # which vowel of the word the i-th sound is
        k = F.size(F.filter(F.slice(sounds, 1, i + 1), lambda x: F.array_contains(vowels, x))) - 1
        at = F.get(written, k)
        as_written = aligned & F.array_contains(vowels, p) & (F.get(nuclei, at) == p)
        return F.when(F.coalesce(as_written, F.lit(False)), F.get(letters, at)).otherwise(F.coalesce(F.try_element_at(names, p), p))

    return F.transform(sounds, one)


def syllable_spans(word: Column, sounds: Column) -> Column:
    """(char, start, end) of each written syllable over the sounds.

    Before a silent onset all consonants between two vowels belong to the earlier syllable; else the last
    one is the onset, and the rest the coda if the earlier syllable is written with one. Where vowels and
    syllables differ in number, sounds are spread evenly.
    """
    chars, places = F.split(word, ""), vowel_places(sounds)
    n, m = F.length(word), F.size(sounds)
    at = lambda k: syllable(F.get(chars, k))
    aligned = (F.size(places) == n) & ~F.exists(chars, lambda c: syllable(c).isNull())

    def start(k: Column) -> Column:
        first = F.get(places, k - 1) + 1
        between = F.get(places, k) - first
        back = F.when(onset(at(k)) == 11, between).when(coda(at(k - 1)) != 0, F.greatest(between - 1, F.lit(0))).otherwise(0)
        exact = F.when(k == 0, 0).otherwise(first + back)
        even = F.floor(k * m / n).cast("int")
        return F.when(k >= n, m).otherwise(F.when(aligned, exact).otherwise(even))

    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(chars, k).alias("char"), start(k).cast("int").alias("start"), start(k + 1).cast("int").alias("end")))


def exclude_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of some words."""
    lower, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | lower.contains(w)
    return out


def bracketed(first: Column, second: Column, left: Column, right: Column) -> Column:
    """The shared part in brackets, one character at least on each side."""
    a = F.greatest(F.lit(1), F.least(F.length(first), F.when(F.length(left) > 0, F.length(left)).otherwise(1)))
    b = F.greatest(F.lit(1), F.least(F.length(second), F.when(F.length(right) > 0, F.length(right)).otherwise(1)))
    cut = F.length(first) - a
    return F.concat(F.substr(first, F.lit(1), cut), F.lit("["), F.substr(first, cut + 1), F.lit(" "), F.substr(second, F.lit(1), b), F.lit("]"), F.substr(second, b + 1))


# What can be read letter by letter.
PHONETIC_INPUT = "^[가-힣ㄱ-ㅎㅏ-ㅣ]+$"


def is_phonetic(text: Column) -> Column:
    """Whether a text is Hangul syllables and single letters alone; false for null and empty texts."""
    return F.coalesce(text.rlike(PHONETIC_INPUT), F.lit(False))


def phoneme_spans(sounds: Column, offset: int = 0) -> Column:
    """(char, start, end) of each sound, where no written syllables give spans."""
    return F.transform(sounds, lambda p, i: F.struct(p.alias("char"), (i + offset).alias("start"), (i + offset + 1).alias("end")))


def detail_multipliers(spans: Column, values: Column, size: Column) -> Column:
    """A multiplier for each of `size` sounds: the value of the last span that holds it, 1 where none does or a span has no value."""
    held = lambda i: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (F.get(spans, k)["start"] <= i) & (i < F.get(spans, k)["end"]))
    value = lambda i: F.coalesce(F.get(values, F.element_at(F.concat(F.array(F.lit(-1)), held(i)), -1)), F.lit(1.0))
    return F.when(size == 0, F.array().cast("array<double>")).when(F.size(spans) == 0, F.array_repeat(F.lit(1.0), size)).otherwise(F.transform(F.sequence(F.lit(0), size - 1), value))
