"""Tokens, glosses and term comparison as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a description.
STOP_WORDS = (
    "der die das ein eine und oder für mit von zu im am auf aus dem den des einer eines über unter bei nach vor durch als wie ist sind wird werden "
    "the a an of for and or to in on with that is it its be by at as this these are from into over app tool"
).split()
# Words that dominate dictionary glosses.
GLOSS_NOISE = (
    "one who which used being having act state quality person something someone any other such made given form type kind member unit way esp "
    "especially usually often certain various general also etc sense senses term word"
).split()
# Phrases of glosses that only point to another entry.
JUNK_GLOSSES = (
    "surname",
    "given name",
    "misspelling of",
    "abbreviation of",
    "initialism of",
    "acronym of",
    "alternative form of",
    "alternative spelling of",
    "alternative letter-case form of",
    "obsolete form of",
    "obsolete spelling of",
    "archaic form of",
    "archaic spelling of",
    "dated form of",
    "dated spelling of",
    "plural of",
    "genitive of",
    "dative of",
    "accusative of",
    "inflection of",
    "romanization of",
    "clipping of",
    "participle of",
    "gerund of",
    "supine of",
    "infinitive of",
    "verbal noun of",
)
# Languages whose words read as origin material, and their bonus.
ORIGIN_FACTORS = {1.3: "la grc he non ang goh sa sux akk egy got nci yua qu".split(), 1.15: ["el"]}

NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
GLOSS_BYTES, ETYMOLOGY_BYTES = 80, 160


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def tokenize(text: Column) -> Column:
    """Lower-cased alphanumeric runs without stop words, each once, in order."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM)
    return F.array_distinct(F.filter(runs, lambda t: (t != "") & ~t.isin(STOP_WORDS)))


def is_concept_token(token: Column) -> Column:
    return (F.char_length(token) >= 3) & ~token.isin(STOP_WORDS + GLOSS_NOISE)


def gloss_tokens(tags: Column) -> Column:
    """Concept tokens of all gloss phrases; the comma between phrases separates tokens anyway."""
    return F.filter(tokenize(tags), is_concept_token)


def singularish(term: Column) -> Column:
    return F.when((F.octet_length(term) > 3) & term.endswith("s"), F.left(term, F.char_length(term) - 1)).otherwise(term)


def _prefixes(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


def terms_match(a: Column, b: Column) -> Column:
    """Equal without a plural ending, or one begins the other and both have five bytes."""
    return stems_match(singularish(a), singularish(b))


def stems_match(x: Column, y: Column) -> Column:
    """``terms_match`` of terms that have lost their plural ending; matching stems share their first two characters."""
    return (x == y) | ((F.octet_length(x) >= 5) & (F.octet_length(y) >= 5) & _prefixes(x, y))


def score_text(text: Column, token: Column, exact: float, partial: float) -> Column:
    near = (F.octet_length(token) >= 3) & (F.octet_length(text) >= 3) & _prefixes(text, token)
    return F.when(text == token, F.lit(exact)).when(near, F.lit(partial)).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.lit(1.0) + F.least(F.greatest(F.ln(n / F.greatest(df, F.lit(1))), F.lit(0.0)), F.lit(5.0))


def origin_factor(language: Column) -> Column:
    out = F.lit(1.0)
    for factor, languages in ORIGIN_FACTORS.items():
        out = F.when(language.isin(languages), F.lit(factor)).otherwise(out)
    return out


def register_factor(registers: Column) -> Column:
    hit = F.lit(False)
    for name in ("poetic", "literary", "figurative"):
        hit = hit | F.contains(registers, F.lit(name))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(1.15)).otherwise(F.lit(1.0))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def split_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""

    def cut(t: Column) -> Column:
        raw = F.substring(t.cast("binary"), 1, most)
        cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, max(most - 4, 0), -1)]
        return F.when(F.octet_length(t) > most, F.coalesce(*cuts, F.lit(""))).otherwise(t)  # null stays null

    return bound(text, cut)


def truncate_chars(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(most - 1, 0))), F.lit("…")))


def fold_gloss(text: Column) -> Column:
    """A gloss without commas, on one line and in lower case, not yet cut."""
    return F.lower(normalize_whitespace(F.replace(text, F.lit(","), F.lit(""))))


def gloss_is_junk(folded: Column) -> Column:
    return bound(folded, lambda f: F.exists(F.array(*map(F.lit, JUNK_GLOSSES)), lambda m: F.contains(f, m)))


def clean_gloss(text: Column) -> Column:
    """A usable gloss, or null if it only points to another entry."""
    return bound(fold_gloss(text), lambda f: F.when(~gloss_is_junk(f), truncate_bytes(f, GLOSS_BYTES)))


def clean_etymology(text: Column) -> Column:
    return truncate_bytes(F.nullif(F.lower(normalize_whitespace(text)), F.lit("")), ETYMOLOGY_BYTES)
