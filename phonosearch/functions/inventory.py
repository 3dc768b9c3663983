"""Phoneme inventory and Hangul tables, and the one-character codes that sequences are stored in."""

from __future__ import annotations

# Vowels as (height, backness, rounding).
VOWELS = {
    "i": (1, 0, -0.5), "ɯ": (1, 1, -0.5), "u": (1, 1, 0.5),
    "ɛ": (0.5, 0, -0.5), "ʌ": (0.5, 1, -0.5), "o": (0.5, 1, 0.5),
    "a": (0, 1, -0.5), "ɑ": (0, 1, -0.5), "æ": (0.1, 0.1, -0.5),
    "e": (0.7, 0, -0.5), "ɔ": (0.2, 1, 0.5), "ɪ": (0.9, 0.1, -0.5),
    "ʊ": (0.9, 0.9, 0.5), "ə": (0.5, 0.5, -0.5), "ɚ": (0.5, 0.5, -0.5),
    "aɪ": (0.45, 0.55, -0.5), "eɪ": (0.8, 0.05, -0.5), "ɔɪ": (0.55, 0.55, 0),
    "aʊ": (0.45, 0.95, 0), "oʊ": (0.7, 0.95, 0.5),
    "ju": (1, 0.67, 0.5), "jʌ": (0.7, 0.67, -0.5), "jo": (0.7, 0.67, 0.5),
    "jɛ": (0.7, 0.67, -0.5), "ja": (0.4, 0.67, -0.5), "je": (0.85, 0.33, -0.5),
    "wi": (1, 0.33, -0.17), "wʌ": (0.7, 1, -0.17), "wɛ": (0.7, 0.33, -0.17),
    "wa": (0.2, 1, -0.17), "we": (0.85, 0.33, -0.17), "ɰi": (1, 0.33, 0.17),
}

# Consonants as (place, manner, strength, voice).
CONSONANTS = {
    "p": (0, 1, 0, 0), "pʰ": (0, 1, 0.5, 0), "p*": (0, 1, 1, 0), "b": (0, 1, 0, 0.5), "m": (0, 0.25, 0, 0.5),
    "t": (0.25, 1, 0, 0), "tʰ": (0.25, 1, 0.5, 0), "t*": (0.25, 1, 1, 0), "d": (0.25, 1, 0, 0.5),
    "s": (0.25, 0.5, 0.5, 0), "s*": (0.25, 0.5, 1, 0),
    "n": (0.25, 0.25, 0, 0.5), "ɾ": (0.25, 0, 0, 0.5), "l": (0.25, 0, 0, 0.5),
    "tɕ": (0.5, 0.75, 0, 0), "tɕʰ": (0.5, 0.75, 0.5, 0), "tɕ*": (0.5, 0.75, 1, 0), "dʑ": (0.5, 0.75, 0, 0.5),
    "k": (0.75, 1, 0, 0), "kʰ": (0.75, 1, 0.5, 0), "k*": (0.75, 1, 1, 0), "ɡ": (0.75, 1, 0, 0.5),
    "ŋ": (0.75, 0.25, 0, 0.5), "h": (1, 0.5, 0.5, 0),
    "f": (0.1, 0.5, 0, 0), "v": (0.1, 0.5, 0, 0.5), "θ": (0.2, 0.5, 0, 0), "ð": (0.2, 0.5, 0, 0.5),
    "ʃ": (0.5, 0.5, 0, 0), "ʒ": (0.5, 0.5, 0, 0.5), "tʃ": (0.5, 0.75, 0.5, 0), "dʒ": (0.5, 0.75, 0, 0.5),
    "ɹ": (0.25, 0, 0, 0.5), "w": (0, 0.1, 0, 0.5), "j": (0.6, 0.1, 0, 0.5), "z": (0.25, 0.5, 0, 0.5),
}

# Onsets, nuclei and neutralised codas of Hangul syllables, as sounds and as letters.
ONSETS = ["k", "k*", "n", "t", "t*", "ɾ", "m", "p", "p*", "s", "s*", "", "tɕ", "tɕ*", "tɕʰ", "kʰ", "tʰ", "pʰ", "h"]
NUCLEI = ["a", "ɛ", "ja", "jɛ", "ʌ", "e", "jʌ", "je", "o", "wa", "wɛ", "we", "jo", "u", "wʌ", "we", "wi", "ju", "ɯ", "ɰi", "i"]
CODAS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ŋ", "t", "t", "k", "t", "p", "t"]
ONSET_LETTERS = ["ㄱ", "ㄲ", "ㄴ", "ㄷ", "ㄸ", "ㄹ", "ㅁ", "ㅂ", "ㅃ", "ㅅ", "ㅆ", "", "ㅈ", "ㅉ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
NUCLEUS_LETTERS = ["ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅘ", "ㅙ", "ㅚ", "ㅛ", "ㅜ", "ㅝ", "ㅞ", "ㅟ", "ㅠ", "ㅡ", "ㅢ", "ㅣ"]
CODA_LETTERS = ["", "ㄱ", "ㄲ", "ㄳ", "ㄴ", "ㄵ", "ㄶ", "ㄷ", "ㄹ", "ㄺ", "ㄻ", "ㄼ", "ㄽ", "ㄾ", "ㄿ", "ㅀ", "ㅁ", "ㅂ", "ㅄ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
# Vowels that Korean has, and the letter by which a sound is named.
KOREAN_VOWELS = ["a", "ɛ", "ʌ", "e", "o", "u", "ɯ", "i", "ja", "jɛ", "jʌ", "je", "jo", "ju", "wa", "wɛ", "we", "wʌ", "wi", "ɰi"]
SOUND_NAMES = {
    "k": "ㄱ", "k*": "ㄲ", "kʰ": "ㅋ", "n": "ㄴ", "t": "ㄷ", "t*": "ㄸ", "tʰ": "ㅌ", "ɾ": "ㄹ", "l": "ㄹ", "m": "ㅁ",
    "p": "ㅂ", "p*": "ㅃ", "pʰ": "ㅍ", "s": "ㅅ", "s*": "ㅆ", "tɕ": "ㅈ", "tɕ*": "ㅉ", "tɕʰ": "ㅊ", "h": "ㅎ", "ŋ": "ㅇ",
    "a": "ㅏ", "ɛ": "ㅐ", "ja": "ㅑ", "jɛ": "ㅒ", "ʌ": "ㅓ", "e": "ㅔ", "jʌ": "ㅕ", "je": "ㅖ", "o": "ㅗ", "wa": "ㅘ", "wɛ": "ㅙ",
    "we": "ㅞ", "jo": "ㅛ", "u": "ㅜ", "wʌ": "ㅝ", "wi": "ㅟ", "ju": "ㅠ", "ɯ": "ㅡ", "ɰi": "ㅢ", "i": "ㅣ",
}
# What voice events become in the Korean inventory.
GLIDES = {
    "j": {"a": "ja", "ɛ": "jɛ", "ʌ": "jʌ", "e": "je", "o": "jo", "u": "ju"},
    "w": {"a": "wa", "ɛ": "wɛ", "e": "we", "ʌ": "wʌ", "i": "wi"},
    "ɰ": {"i": "ɰi"},
}
ALLOPHONES = {
    "ø": "we", "y": "wi", "b": "p", "d": "t", "g": "k", "ɡ": "k", "ɦ": "h", "ç": "h", "x": "h", "ɸ": "h", "ɕ": "s", "ɕ*": "s*",
    "ɲ": "n", "ʎ": "l",
}
AFFRICATES = {"t͡ɕ": "tɕ", "d͡ʑ": "tɕ", "t͡ɕʰ": "tɕʰ", "t͡ɕ*": "tɕ*"}
SIMPLE_VOWELS = ["a", "ɛ", "ʌ", "e", "o", "u", "ɯ", "i"]
OBSTRUENT_CODAS = ["", "k", "k", "k", "", "", "", "t", "", "k", "", "", "", "", "", "", "", "p", "p", "t", "t", "", "t", "t", "k", "t", "p", "t"]

PHONEMES = [*VOWELS, *CONSONANTS]
INDEX = {p: i for i, p in enumerate(PHONEMES)}
#: A phoneme's code is one ASCII character, so that a sequence is a string and its length is its number of sounds.
FIRST_CODE, UNKNOWN_CODE = 48, "!"
CODES = {p: chr(FIRST_CODE + i) for i, p in enumerate(PHONEMES)}


def encode(phonemes) -> str:
    return "".join(CODES.get(p, UNKNOWN_CODE) for p in phonemes)


def decode(code: str) -> list[str]:
    return [PHONEMES[ord(c) - FIRST_CODE] for c in code if c != UNKNOWN_CODE]
