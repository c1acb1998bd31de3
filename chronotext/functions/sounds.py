"""Families of sounds: of syllables as they are written, and of single letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The family of a syllable's first consonant; 0 is none.
SYLLABLE_FAMILY = {"k": 1, "g": 1, "q": 1, "s": 2, "z": 2, "j": 2, "c": 2, "t": 3, "d": 3, "n": 4, "h": 5, "f": 5, "b": 6, "p": 6, "v": 6, "m": 7, "y": 8, "r": 9, "l": 9, "w": 10}
HISSING, HISS = ("ts", "ch", "sh"), 2
VOWELS, NO_VOWEL = "aiueo", 5
#: Families of letters as a reader hears them; a vowel is 1, others are 10.
LETTER_FAMILY = {2: "bpfv", 3: "m", 4: "n", 5: "lr", 6: "gk", 7: "szjc", 8: "dt", 9: "h"}
SILENT, OTHER, SPELLED = "yw'", 10, 7
#: Frames within which letters are of one word, and a family heard again is the same sound.
ONE_WORD, ONE_SOUND = 10, 15


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def syllable_family(text: Column) -> Column:
    onset = F.regexp_extract(_letters(text), f"^[^{VOWELS}]*", 0)
    family = F.create_map(*[F.lit(x) for pair in SYLLABLE_FAMILY.items() for x in pair])
    return F.when(F.left(onset, F.lit(2)).isin(*HISSING), HISS).otherwise(F.coalesce(family[F.left(onset, F.lit(1))], F.lit(0)))


def syllable_vowel(text: Column) -> Column:
    """The place of a syllable's first vowel in a i u e o, NO_VOWEL if it has none."""
    first = F.regexp_extract(_letters(text), f"[{VOWELS}]", 0)
    return F.when(first == "", NO_VOWEL).otherwise(F.instr(F.lit(VOWELS), first) - 1)


def letter_family(letter: Column, before: Column, pinyin: bool = False) -> Column:
    """The family of a letter after the letter before it in its word (empty at its start); 0
    for a letter that is no sound of its own. q and x hiss where they spell pinyin."""
    family = F.when(letter.rlike("^[aeiou]$"), 1)
    family = family.when(letter.isin(*SILENT) | (letter == "h") & before.isin("s", "z", "c") | (letter == "g") & (before == "n"), 0)
    family = family.when(letter.isin("q", "x"), SPELLED if pinyin else 6)
    for number, members in LETTER_FAMILY.items():
        family = family.when(letter.isin(*members), number)
    return family.otherwise(OTHER)

