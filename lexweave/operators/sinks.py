"""Text and JSON forms of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import display_word, explain, rich_block


def text_lines(matches: DataFrame, script: str = "latin", with_reason: bool = False) -> DataFrame:
    """(value): the display form of each match, or its explanation; write it with ``.write.text``."""
    shown = display_word(F.col("word"), F.col("translit"), F.col("language"), script)
    line = explain(shown, F.col("etymology"), F.col("origin_lang"), F.col("system"), F.col("matched")) if with_reason else shown
    return matches.select(line.alias("value"))


def rich_blocks(matches: DataFrame, script: str = "latin", show_root: bool = False) -> DataFrame:
    names = ("word", "translit", "language", "tags", "system", "registers", "etymology", "origin_lang", "matched")
    return matches.select(rich_block(*map(F.col, names), script=script, show_root=show_root).alias("value"))


def json_lines(matches: DataFrame, script: str = "latin") -> DataFrame:
    """(value): one JSON object for each match; absent fields are left out."""
    shown = display_word(F.col("word"), F.col("translit"), F.col("language"), script)
    fields = [shown.alias("display"), *[F.col(c) for c in ("word", "translit", "language", "system", "etymology", "origin_lang", "score", "matched")]]
    return matches.select(F.to_json(F.struct(*fields)).alias("value"))


def names_json(names: DataFrame) -> DataFrame:
    """(value): the seed and the generated names in order; ``names`` is as small as the count that was asked for."""
    ordered = F.sort_array(F.collect_list(F.struct("n", "name")))
    return names.groupBy("seed").agg(ordered.alias("x")).select(F.to_json(F.struct("seed", F.transform("x", lambda r: r["name"]).alias("names"))).alias("value"))
