"""Lexicon CSV: a header line, columns by position, strict width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators.store import Store, unknown_class, word_id
from ..schema import LEXICON, conform

#: Columns by position; files carry the first 7, 9 or 11 of them.
COLUMNS = "word language word_class system tags seed_weight source etymology origin_lang translit registers".split()
_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": "true", "multiLine": "false"}


def _width(header: str) -> int:
    import csv

    return min(len(next(csv.reader([header]))), len(COLUMNS))


def _mapped(raw: DataFrame) -> DataFrame:
    found = raw.columns
    at = raw.select(*[blank_to_null(F.col(c)).alias(c) for c in found if c not in ("word", "seed_weight")], *[c for c in ("word", "seed_weight") if c in found])
    word = F.coalesce(F.regexp_replace("word", r"(?U)^\s+|\s+$", ""), F.lit(""))
    weight = F.coalesce(F.trim("seed_weight").try_cast("double"), F.lit(1.0)) if "seed_weight" in found else F.lit(1.0)
    at = at.withColumns({"word": word, "seed_weight": weight})
    language = F.col("language") if "language" in found else F.lit(None).cast("string")
    return conform(at.withColumn("id", word_id(language, F.col("word"))), LEXICON)


def _schema(width: int) -> str:
    return ", ".join(f"{c} string" for c in COLUMNS[:width])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon rows of a CSV file; a row of another width than the header's fails the read."""
    header = spark.read.text(path).first()
    width = _width(header["value"]) if header else len(COLUMNS)
    return _mapped(spark.read.options(**_OPTIONS).schema(_schema(width)).csv(path))


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and what is counted of them in the same read: ``imported`` and ``unknown_class``."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("imported"), F.count_if(unknown_class(F.col("word_class"))).alias("unknown_class")), seen


def import_file(store: Store, path: str) -> dict[str, int]:
    """Write the rows of a CSV file into the store, later lines over earlier ones, and report the counters of that read."""
    rows, seen = counted(read(store.spark, path))
    store.insert_words(rows.withColumn("ingest_seq", F.monotonically_increasing_id()))
    return dict(seen.get)


def read_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """The same from lines in memory, the header first."""
    import csv

    width = _width(lines[0])
    rows = [tuple(r) for r in csv.reader(lines[1:])]
    if wrong := next((r for r in rows if len(r) != width), None):
        raise ValueError(f"a row of {len(wrong)} fields under a header of {width}: {wrong}")
    return _mapped(spark.createDataFrame(rows, _schema(width)))
