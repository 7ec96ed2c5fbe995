"""Script folding, romanisation and phonetic keys.

The scalar functions run inside Arrow batches; what SQL can express is a column expression.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: romanisation of the Brahmic scripts by offset in their blocks, which share one layout
BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
CONSONANTS = {0x15 + k: v for k, v in enumerate("k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l zh v sh sh s h".split())}
CONSONANTS |= {0x58 + k: v for k, v in enumerate("q kh g z d dh f y".split())}
VOWELS = {0x05 + k: v for k, v in enumerate("a a i i u u ri l e e e ai o o o au".split())} | {0x60: "ri", 0x61: "l"}
SIGNS = {0x3E + k: v for k, v in enumerate("a i i u u ri ri e e e ai o o o au".split())} | {0x62: "l", 0x63: "l"}
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA, NUKTA = 0x4D, 0x3C
JOINERS = "‌‍"

_KINDS: dict[int, tuple[str, str]] = {}
for _b in BLOCKS:
    for _kind, _table in (("c", CONSONANTS), ("v", VOWELS), ("m", SIGNS), ("n", NASALS), ("d", {0x66 + k: str(k) for k in range(10)})):
        _KINDS |= {_b + o: (_kind, s) for o, s in _table.items()}
    _KINDS[_b + VIRAMA] = ("x", "")
    _KINDS |= {_b + NUKTA: ("z", "")}
_INDIC = re.compile("[ऀ-ൿ]")


def romanise(text: str) -> str:
    """Latin spelling of Brahmic text; a consonant's own vowel is silent at the end of a word, unless it ends a cluster."""
    units: list[tuple[str, str]] = []
    for ch in text:
        kind, latin = _KINDS.get(ord(ch), ("o", ch))
        if kind == "z" or ch in JOINERS:
            continue
        if kind == "o" and _INDIC.match(ch):
            kind, latin = "s", " "
        units.append((kind, latin))
    out = []
    for k, (kind, latin) in enumerate(units):
        out.append(latin)
        if kind != "c":
            continue
        follows = units[k + 1] if k + 1 < len(units) else ("e", "")
        if follows[0] in "cvnd" or (follows[0] == "e" or follows[0] == "o" and not follows[1].isalpha()) and k and units[k - 1][0] == "x":
            out.append("a")
    return "".join(out)


def to_ascii(text: str | None) -> str:
    """Lower-case ASCII: Brahmic scripts romanised, accents dropped, what remains transcribed by its Unicode name."""
    text = text or ""
    if text.isascii():
        return text.lower()
    if _INDIC.search(text):
        text = romanise(text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(c if c.isascii() else _by_name(c) for c in text).lower()


# fixed values: letters that neither decompose nor have a one-letter name
_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "ð": "d", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}
_NAME = re.compile(r"(?:CYRILLIC|GREEK|ARMENIAN|GEORGIAN|HEBREW|ARABIC|KATAKANA|HIRAGANA|HANGUL) (?:CAPITAL |SMALL )*(?:LETTER |SYLLABLE )(?:SMALL )?([A-Z]+)")


def _by_name(ch: str) -> str:
    """A rough Latin spelling: a letter's name, or nothing."""
    if ch in _LETTERS:
        return _LETTERS[ch]
    m = _NAME.match(unicodedata.name(ch, ""))
    return m[1].lower() if m else " " if ch.isspace() else ""


# fixed values: sound-alike spellings, in order
SOUNDS = (("ph", "f"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("w", "v"), ("z", "j"), ("b", "v"), ("g", "j"))


def skeleton(token: Column) -> Column:
    """Consonant skeleton of a lower-case token, in SQL: sound-alikes merged, vowels and h dropped, doubles collapsed."""
    t = token
    for a, b in SOUNDS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.replace(F.regexp_replace(t, "c(?=[eiy])", "s"), F.lit("c"), F.lit("k"))
    head = F.regexp_replace(F.substring(t, 1, 1), "[aeiouyh]", "")
    return F.regexp_replace(F.concat(head, F.regexp_replace(F.substring(t, 2, 1 << 20), "[aeiouyh]", "")), r"(.)\1+", "$1")


def phonetic_class(text: Column) -> Column:
    """Coarse sound classes of consonants: four digits for sixteen letters."""
    return F.translate(text, "bfpvcgjkqsxzdtmn", "1111222222223355")


def ocr_fix(token: Column) -> Column:
    """0, 1 and 5 read as o, l and s in tokens with three letters or more and no other digit."""
    letters = F.length(F.regexp_replace(token, "[^A-Za-z]", "")) >= 3
    return F.when(letters & F.regexp_like(token, F.lit("[015]")) & ~F.regexp_like(token, F.lit("[2346789]")), F.translate(token, "015", "ols")).otherwise(token)


def house_ids(text: Column) -> Column:
    """First three distinct house ids such as c346 or 19b, joined and without leading zeros after the letter."""
    t = F.regexp_replace(F.lower(text), r"\b([a-z])\s?[-/]?\s?0*(\d{1,5})\b", "$1$2")
    t = F.regexp_replace(t, r"\b(\d{1,5})\s?[-/]\s?([a-z])\b", "$1$2")
    return F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b[a-z]\d{1,5}\b|\b\d{1,5}[a-z]\b"), F.lit(0))), 1, 3)


def norm_part(text: Column) -> Column:
    """Lower-case letters and digits of *text*, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def street_text(text: Column) -> Column:
    """*text* without digits, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[0-9]+", " "), r"\s+", " "))


def fold(text: Column) -> Column:
    """:func:`to_ascii` as a column: plain ASCII stays in the JVM, the rest goes through an Arrow batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(to_ascii, na_action="ignore")

    return F.when(text.isNull(), "").when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), run(text)).otherwise(F.lower(text))
