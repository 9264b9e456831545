"""Quality rules: a threshold table compiled into one projection of built-in functions.

``quality_rules(df)`` adds the base counts, the ratios and the verdict to a table of texts. There is one
pass over each text, no shuffle and no user function. A text is split once, bound to a lambda variable and
used by every count.

Defined results: a null or blank text has zero counts and fails the base; repeated rows and null keys
pass through unchanged (a row is judged by its own text alone); an empty table gives an empty table; extra
columns stay, and an existing column of the name of an added one is replaced. Cost is n log n in the
words of a text, so very long texts are judged whole. Word windows are compared by a 64-bit hash within
one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, let

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der die ein eine er es für ist mit nicht sich sie und von zu im "
    "au avec ce dans de des du elle en est et la le les ne par pas pour que qui sur un une "
    "al como con del el está las los más no o para por se su una y que"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is rejected if ``metric`` lies outside [least, most]; a null metric passes."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are per word or per line; wide margins keep unusual but sound texts.
RULES = (
    Rule("word_length", "mean_word_chars", least=1.8, most=20.0),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("stop_words", "stop_ratio", least=0.03),
    Rule("repeated_lines", "dup_line_ratio", most=0.6),
    Rule("shouting", "shout_ratio", most=0.3),
)


def _spaced(text: Column) -> Column:
    """The text with every kind of word space turned into a plain space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WORD_SPACE[1:]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def _split_words(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; a null text has none."""
    return _split_words(_spaced(text))


def _repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows that occur at least twice in the text, first occurrence included.

    A first sort orders one long per window, the upper bits of its hash above its position, and keeps the
    positions whose upper bits meet again. Only those are ordered by their full hash.
    """
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + F.lit(k)) for k in range(1, window)]),
    )

    def met_again(h: Column, low: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x - F.pmod(x, low) + i))
        upper = lambda x: x - F.pmod(x, low)
        return let(
            packed,
            lambda s: F.transform(
                F.filter(s, lambda x, k: (upper(x) == upper(F.get(s, k - 1))) | (upper(x) == upper(F.get(s, k + 1)))),
                lambda x: F.pmod(x, low).cast("int"),
            ),
        )

    def repeated(h: Column, some: Column) -> Column:
        ordered = F.sort_array(F.transform(some, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
        same = let(ordered, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + F.lit(1)) - x, F.lit(window))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def count(h: Column) -> Column:
        low = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(h) + F.lit(1.0)))).cast("long")
        return let(let(low, lambda n: met_again(h, n)), lambda some: F.when(F.size(some) == 0, F.lit(0)).otherwise(let(repeated(h, some), covered)))

    return let(hashes, count)


def text_counts(text: Column) -> Column:
    """Struct of every count the rules need, from one split of the text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    stop = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})
    of_words = lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        long(_repeat_words(w)).alias("n_repeat_words"),
        long(F.size(F.filter(w, lambda x: x.isin(stop)))).alias("n_stop"),
        long(F.size(F.filter(w, lambda x: x.endswith("!!")))).alias("n_shout"),
    )
    counts = let(
        _spaced(text),
        lambda s: F.struct(
            let(_split_words(s), of_words).alias("of_words"),
            long(F.length(F.replace(s, F.lit(" "), F.lit("")))).alias("word_chars"),
        ),
    )
    line_counts = let(
        lines,
        lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")),
    )
    return F.struct(
        counts.alias("c"),
        line_counts.alias("l"),
        long(F.regexp_count(whole, F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole threshold table as one boolean expression."""
    ok = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            ok = ok & F.coalesce(F.col(rule.metric) >= rule.least, F.lit(True))
        if rule.most is not None:
            ok = ok & F.coalesce(F.col(rule.metric) <= rule.most, F.lit(True))
    return ok


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(
    df: DataFrame,
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Add counts, ratios, ``base_failed`` and ``kept`` to ``df``."""
    s = "__counts"
    at = df.withColumn(s, text_counts(F.col(text_col)))
    at = at.withColumns(
        {
            "n_words": F.col(f"{s}.c.of_words.n_words"),
            "word_chars": F.col(f"{s}.c.word_chars"),
            "n_symbols": F.col(f"{s}.n_symbols"),
            "n_dup_lines": F.col(f"{s}.l.n_dup_lines"),
            "n_repeat_words": F.col(f"{s}.c.of_words.n_repeat_words"),
            "mean_word_chars": F.try_divide(F.col(f"{s}.c.word_chars"), F.col(f"{s}.c.of_words.n_words")),
            "symbol_ratio": F.try_divide(F.col(f"{s}.n_symbols"), F.col(f"{s}.c.of_words.n_words")),
            "stop_ratio": F.try_divide(F.col(f"{s}.c.of_words.n_stop"), F.col(f"{s}.c.of_words.n_words")),
            "dup_line_ratio": F.try_divide(F.col(f"{s}.l.n_dup_lines"), F.col(f"{s}.l.n_lines")),
            "shout_ratio": F.try_divide(F.col(f"{s}.c.of_words.n_shout"), F.col(f"{s}.c.of_words.n_words")),
        }
    ).drop(s)
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words"))
    return at.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
