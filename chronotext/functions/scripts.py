"""Scripts of texts, kana, squashed titles, clocks and escapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of the scripts that decide a text's language.
KANA, CYRILLIC, HANGUL, HAN, LATIN = "[ぁ-ゟ゠-ヿ]", "[Ѐ-ӿ]", "[가-힣]", "[一-鿿]", "[A-Za-zÀ-ɏ]"
#: Katakana and the hiragana that sound the same, from the distance of the two blocks.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


#: The romanisation of a Hangul syllable's first sound, vowel, last sound at the
#: end, and last sound carried over to a vowel that follows.
FIRST = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWEL = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
LAST = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")
CARRIED = ("", "g", "kk", "ks", "n", "nj", "n", "d", "r", "lg", "m", "lb", "ls", "lt", "lp", "r", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k", "t", "p", "h")
SYLLABLES, SILENT, NG = 0xAC00, 11, 21


def language(text: Column) -> Column:
    """ja, ru or ko by kana, Cyrillic and Hangul; en for two Latin words before the first Han
    sign or Latin without Han; zh for Han; else unknown."""
    before = F.regexp_extract(text, f"^(?s:(.*?)){HAN}", 1)
    return (
        F.when(text.rlike(KANA), "ja")
        .when(text.rlike(CYRILLIC), "ru")
        .when(text.rlike(HANGUL), "ko")
        .when(text.rlike(HAN) & (F.regexp_count(before, F.lit("[A-Za-z]{2,}")) >= 2), "en")
        .when(text.rlike(HAN), "zh")
        .when(text.rlike(LATIN), "en")
        .otherwise("unknown")
    )


def characters(text: Column) -> Column:
    """A text's code points as one-character strings."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def romanised(text: Column) -> Column:
    """For each character the reading of a Hangul syllable, empty for any other. A last sound
    moves to a following syllable that begins with a vowel, but ng stays."""
    table = lambda values: F.array(*[F.lit(v) for v in values])
    codes = F.transform(characters(text), lambda c: F.when(c.rlike(f"^{HANGUL}$"), F.ascii(c) - SYLLABLES))
    first, last = lambda k: F.floor(k / 588).cast("int"), lambda k: (k % 28).cast("int")
    pick = lambda values, k: F.element_at(table(values), k + 1)

    def read(codes: Column) -> Column:
        at = lambda i: F.when((i >= 0) & (i < F.size(codes)), F.get(codes, i))

        def one(k: Column, i: Column) -> Column:
            before, after = at(i - 1), at(i + 1)
            moves_in = before.isNotNull() & (first(k) == SILENT) & ~last(before).isin(0, NG)
            moves_out = after.isNotNull() & (first(after) == SILENT) & ~last(k).isin(0, NG)
            begin = F.when(moves_in, pick(CARRIED, last(before))).otherwise(pick(FIRST, first(k)))
            end = F.when(moves_out, "").otherwise(pick(LAST, last(k)))
            return F.when(k.isNull(), "").otherwise(F.concat(begin, pick(VOWEL, F.floor(k % 588 / 28).cast("int")), end))

        return F.transform(codes, one)

    return F.element_at(F.transform(F.array(codes), read), 1)


def hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


def squash(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def xml_text(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def metadata(text: Column) -> Column:
    """A value that can stand in a tag row: no brackets, no line breaks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\[\]]", ""), r"[\r\n\t ]+", " "))


def title(text: Column) -> Column:
    """A title without bracketed parts and without what follows a feat. mark."""
    bare = F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)[ ](feat|ft)[.]? .*$", ""), r"[ ]+", " "))


def valid_name(text: Column) -> Column:
    """Whether a text can be a file's name."""
    return ~text.rlike(r'[<>:"/\\|?*\x00-\x1f]') & ~text.rlike(r"[. ]$") & (F.length(text) > 0)


def ttml(seconds: Column) -> Column:
    """s.mmm"""
    ms = F.greatest(F.lit(0).cast("long"), F.floor(seconds * 1000 + 0.5))
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)


def clock(seconds: Column) -> Column:
    """m:ss.cc"""
    t = F.greatest(F.lit(0).cast("long"), F.floor(seconds * 100 + 0.5))
    return F.format_string("%d:%02d.%02d", F.floor(t / 6000), F.floor(t / 100) % 60, t % 100)
