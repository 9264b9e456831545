"""Diacritic folding and transliteration to Latin script."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin forms of Greek and Hebrew letters; modern Greek differs in four.
GREEK = dict(
    zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t y ph ch ps o".split(), strict=True)
)
MODERN_GREEK = {"β": "v", "η": "i", "υ": "i", "φ": "f"}
HEBREW = {"א": "", "ע": ""} | dict(
    zip("בגדהוזחטיכךלמםנןספףצץקרשת", "v g d h v z ch t y k k l m m n n s f f ts ts k r sh t".split(), strict=True)
)

_FOREIGN = r"[\p{IsAlphabetic}&&[^A-Za-z\u00C0-\u024F]]"


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))


def _folding() -> tuple[str, str]:
    """For ``translate``: letters that decompose into a letter and marks, then all marks; and the letters they become."""
    pairs, marks = [], []
    for code in range(0x80, 0x110000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code < 0xE000:  # Hangul is spelled out by rule; surrogates are no letters
            continue
        letter = chr(code)
        if unicodedata.category(letter).startswith("M"):
            marks.append(letter)
        elif unicodedata.decomposition(letter) and len(folded := fold(letter)) == 1 and folded != letter:
            pairs.append((letter, folded))
    return "".join([a for a, _ in pairs] + marks), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def _letter(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _hangul(c: Column) -> Column:
    """A Hangul syllable as its two or three parts."""
    at = F.ascii(c) - 0xAC00
    parts = [_letter(0x1100 + F.floor(at / 588)), _letter(0x1161 + F.floor(F.pmod(at, F.lit(588)) / 28))]
    last = F.pmod(at, F.lit(28))
    return F.when(c.between("\uac00", "\ud7a3"), F.concat(*parts, F.when(last > 0, _letter(0x11A7 + last)).otherwise(""))).otherwise(c)


def fold_diacritics(text: Column) -> Column:
    """Canonical decomposition without its marks, in built-in functions."""
    spelled = F.when(text.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(text, ""), _hangul), "")).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(spelled, _FROM, _TO)).otherwise(text)


def is_latin_script(word: Column) -> Column:
    """No letter outside the Latin blocks."""
    return ~word.rlike(_FOREIGN)


def _letters(text: Column, mapping: dict[str, str]) -> Column:
    upper = {k.upper(): v for k, v in mapping.items()}
    single = {k: v for k, v in (upper | mapping).items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for letter, to in (upper | mapping).items():
        if len(to) != 1:
            out = F.replace(out, F.lit(letter), F.lit(to))
    return out


def to_latin(word: Column, language: Column) -> Column:
    """Latin form of a word in another script; null if it is Latin already. Unknown letters stay."""
    folded = fold_diacritics(word)
    modern = _letters(folded, GREEK | MODERN_GREEK | HEBREW)
    classic = _letters(folded, GREEK | HEBREW)
    return F.when(~is_latin_script(word), F.when(F.coalesce(language == "el", F.lit(False)), modern).otherwise(classic))


def latin_form(word: Column, translit: Column, language: Column) -> Column:
    given = F.nullif(F.regexp_replace(translit, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(given, to_latin(word, language), word)
