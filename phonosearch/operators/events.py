"""Voice events to the Korean inventory, and codas that a tense onset has swallowed; all of it as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonosearch.functions.inventory import AFFRICATES, ALLOPHONES, GLIDES, KOREAN_VOWELS, OBSTRUENT_CODAS, SIMPLE_VOWELS, SOUND_NAMES
from phonosearch.functions.text import coda, literal_array, literal_map, syllable
from phonosearch.operators.topic import let

# Characters that say nothing (end of transmission, zero-width space, unreleased), and the marks of a tie, breath and tension.
IGNORED = ["\u0004", "\u200b", "\u031a"]
TIE, ASPIRATED, TENSE = "͡", "ʰ", "ʼ"


def none() -> Column:
    return F.array().cast("array<string>")


def sounds_of(events: Column) -> Column:
    """Single characters joined to sounds: marks go to the sound before, a tie joins two."""
    chars = F.filter(F.split(F.array_join(events, ""), ""), lambda c: ~c.isin("", *IGNORED))

    def add(state: Column, c: Column) -> Column:
        out, tied = state["out"], state["tied"]
        some = F.size(out) > 0
        # what is added to the last sound, null for a sound of its own
        mark = F.when(c == ASPIRATED, c).when(c == TENSE, F.lit("*")).when(tied, F.concat(F.lit(TIE), c))
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), mark)))
        grown = F.when(c == TIE, out).when(some & mark.isNotNull(), joined).otherwise(F.concat(out, F.array(c)))
        stays = F.when(c == TIE, True).when(c.isin(ASPIRATED, TENSE) | ~some, tied).otherwise(False)
        return F.struct(grown.alias("out"), stays.alias("tied"))

    return F.aggregate(chars, F.struct(none().alias("out"), F.lit(False).alias("tied")), add, lambda s: s["out"])


def merged(sounds: Column) -> Column:
    """A glide joins its vowel, or is dropped before one that it can't join."""
    joins = literal_map((f"{g}|{v}", both) for g, found in GLIDES.items() for v, both in found.items())

    def one(s: Column, i: Column) -> Column:
        before, after = F.get(sounds, i - 1), F.get(sounds, i + 1)
        taken = F.map_contains_key(joins, F.concat_ws("|", F.coalesce(before, F.lit("")), s))
        both = F.try_element_at(joins, F.concat_ws("|", s, F.coalesce(after, F.lit(""))))
        lost = s.isin(*GLIDES) & F.coalesce(after.isin(*SIMPLE_VOWELS), F.lit(False))
        return F.when(~taken, F.coalesce(both, F.when(~lost, s)))

    return F.filter(F.transform(sounds, one), lambda s: s.isNotNull())


def lateral(sounds: Column) -> Column:
    """l and ɾ by what follows."""
    return F.transform(sounds, lambda s, i: F.when(s.isin("l", "ɾ"), F.when(F.coalesce(F.get(sounds, i + 1).isin(*KOREAN_VOWELS), F.lit(False)), "ɾ").otherwise("l")).otherwise(s))


def normalize(events: Column) -> Column:
    """phonemes (sounds of the inventory) and unknown (distinct symbols that it lacks); null for null events."""
    known = literal_map([*ALLOPHONES.items(), *AFFRICATES.items()])
    mapped = F.transform(sounds_of(events), lambda s: F.coalesce(F.try_element_at(known, s), s))
    out = let(let(mapped, merged), lateral)
    lacking = lambda p: F.array_distinct(F.filter(p, lambda s: ~s.isin(*SOUND_NAMES)))
    return F.when(events.isNotNull(), let(out, lambda p: F.struct(p.alias("phonemes"), lacking(p).alias("unknown"))))


def restore_codas(word: Column, phonemes: Column) -> Column:
    """phonemes, restored, aligned: a written obstruent coda comes back before a tense onset that stands alone between two vowels.

    Only where every character is a Hangul syllable and there are as many vowels as syllables (aligned).
    """
    written = F.transform(F.split(word, ""), lambda c: coda(syllable(c)))
    sounds = literal_array(OBSTRUENT_CODAS)

    def with_vowels(p: Column, vowel: Column) -> Column:
        n = F.size(F.filter(vowel, lambda v: v))
        fits = (n > 0) & (n == F.length(word)) & ~F.exists(written, lambda c: c.isNull())

        def one(s: Column, i: Column) -> Column:
            syllable_before = F.size(F.filter(F.slice(vowel, 1, i), lambda v: v)) - 1
            back = F.get(sounds, F.get(written, syllable_before))
            alone = fits & s.endswith("*") & F.get(vowel, i - 1) & F.get(vowel, i + 1) & (back != "")
            return F.when(F.coalesce(alone, F.lit(False)), F.array(back, s)).otherwise(F.array(s))

        return let(F.flatten(F.transform(p, one)), lambda out: F.struct(out.alias("phonemes"), (F.size(out) - F.size(p)).alias("restored"), fits.alias("aligned")))

    found = let(phonemes, lambda p: let(F.transform(p, lambda s: s.isin(*KOREAN_VOWELS)), lambda v: with_vowels(p, v)))
    return F.when(word.isNotNull() & phonemes.isNotNull(), found)
