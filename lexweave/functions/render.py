"""Display forms of words and matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import truncate_chars
from .translit import latin_form


def display_word(word: Column, translit: Column, language: Column, script: str = "latin") -> Column:
    latin = latin_form(word, translit, language)
    if script == "native":
        return word
    if script == "latin":
        return latin
    if script == "both":
        return F.when(latin != word, F.concat(latin, F.lit(" ("), word, F.lit(")"))).otherwise(word)
    raise ValueError(f"script is latin, native or both, not {script!r}")


def meaning_of(tags: Column, most: int = 64) -> Column:
    """Gloss phrases joined by ``; `` up to the first that does not fit."""
    phrases = F.filter(F.transform(F.split(tags, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        fits = F.char_length(s["out"]) + F.char_length(p) + 2 <= most
        out = F.when(s["done"], s["out"]).when(s["out"] == "", p).when(fits, F.concat(s["out"], F.lit("; "), p)).otherwise(s["out"])
        return F.struct(out.alias("out"), (s["done"] | ((s["out"] != "") & ~fits)).alias("done"))

    return truncate_chars(F.nullif(F.aggregate(phrases, start, step)["out"], F.lit("")), most)


def spur_compact(matched: Column, most: int = 4) -> Column:
    once = F.array_distinct(matched)
    more = F.size(once) - most
    return F.concat(F.array_join(F.slice(once, 1, most), " · "), F.when(more > 0, F.concat(F.lit(" · +"), more.cast("string"))).otherwise(""))


def explain(display: Column, etymology: Column, origin_lang: Column, system: Column, matched: Column) -> Column:
    """``word — etymology (language) · System: s · Spur: a, b``; absent parts are left out."""
    origin = F.concat(F.lit("("), origin_lang, F.lit(")"))
    root = F.when(etymology.isNotNull() | origin_lang.isNotNull(), F.concat_ws(" ", etymology, origin))
    return F.concat(display, F.lit(" — "), F.concat_ws(" · ", root, F.concat(F.lit("System: "), system), F.concat(F.lit("Spur: "), F.array_join(matched, ", "))))


def rich_block(word: Column, translit: Column, language: Column, tags: Column, system: Column, registers: Column, etymology: Column, origin_lang: Column, matched: Column, script: str = "latin", show_root: bool = False) -> Column:
    """Several lines on one match: word and meaning, the trail, and the root on demand."""
    shown, latin = display_word(word, translit, language, script), latin_form(word, translit, language)
    native = F.when(F.lit(script == "latin") & (latin != word), F.concat(F.lit(" ("), word, F.lit(")"))).otherwise("")
    meaning = F.coalesce(F.concat(F.lit(" — "), meaning_of(tags)), F.lit(""))
    noted = F.coalesce(F.concat(F.lit(" · "), F.replace(registers, F.lit(","), F.lit(" · "))), F.lit(""))
    place = F.concat(F.lit("  ["), F.coalesce(language, F.lit("?")), F.lit(" · "), F.coalesce(system, F.lit("?")), noted, F.lit("]"))
    root = F.concat(etymology, F.coalesce(F.concat(F.lit(" ("), origin_lang, F.lit(")")), F.lit("")))
    last = F.when(F.lit(show_root), F.concat(F.lit("  Wurzel: "), truncate_chars(root, 110)))
    return F.concat(F.concat_ws("\n", F.concat(shown, native, meaning, place), F.concat(F.lit("  Spur..: "), spur_compact(matched)), last), F.lit("\n"))
