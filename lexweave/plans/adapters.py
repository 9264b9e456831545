"""Views of general tables as a lexicon and as edges, in Spark and as SQL of the oracle.

Texts are used whole: all of a document's text is its gloss and its etymology.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_ALNUM, STOP_WORDS
from ..operators.store import WORD_CLASSES
from ..schema import EDGES, LEXICON, conform

CLASSES = [*WORD_CLASSES[:5], "other"]
REGISTERS = ["poetic,dated", "archaic", "literary"]
# relation and weight by the place of a pair
RELATIONS = [("synonym", 0.8), ("verwandt", 0.6), ("ableitung", 0.5), ("gegenteil", 0.4), ("nachbar", 0.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("low", F.lower(F.coalesce("text", F.lit(""))))
    pick = lambda names, by: F.try_element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % by + 1).cast("int"))
    made = docs.withColumns(
        {
            "id": F.concat_ws("_", "lang", F.col("doc_id").cast("string")),
            "word": F.regexp_extract("low", r"\p{L}{3,30}", 0),
            "word_class": pick(CLASSES, 6),
            "language": F.col("lang"),
            "system": F.col("source"),
            "tags": F.translate("low", ".\n", ",,"),
            "seed_weight": F.lit(1.0) + F.lit(0.1) * (F.col("doc_id") % 3),
            "etymology": F.col("low"),
            "registers": pick(REGISTERS, 5),
        }
    )
    return conform(made, LEXICON)


def _listed(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


LEX_SQL = rf"""lex AS (SELECT doc_id, concat_ws('_', lang, doc_id::VARCHAR) AS id, regexp_extract(lower(coalesce(text, '')), '\p{{L}}{{3,30}}') AS word,
  {_listed(CLASSES)}[(doc_id % 6 + 1)::INT] AS word_class, lang AS language, source AS system, translate(lower(coalesce(text, '')), '.' || chr(10), ',,') AS tags,
  1.0::DOUBLE + 0.1::DOUBLE * (doc_id % 3) AS seed_weight, source, lower(coalesce(text, '')) AS etymology, {_listed(REGISTERS)}[(doc_id % 5 + 1)::INT] AS registers FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words of the benchmark, with ``ingest_seq``."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split(F.lower("text"), NOT_ALNUM), lambda w: w != "").alias("w"))
    pairs = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))).alias("i")).where("size(w) > 1")
    rel = F.array(*[F.struct(F.lit(r).alias("rel"), F.lit(w).alias("weight")) for r, w in RELATIONS])
    at = pairs.select("item_id", "i", F.get("w", F.col("i") - 1).alias("src"), F.get("w", F.col("i")).alias("dst"), F.get(rel, F.col("i") % 5).alias("r"))
    return at.select("src", "r.rel", "dst", "r.weight", F.lit("benchmark").alias("source"), (F.col("item_id") * 1000 + F.col("i")).cast("long").alias("ingest_seq"))


def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.store import insert_edges

    return insert_edges(None, edges(spark, sf_dir)).select(*EDGES.fieldNames())


EDG_SQL = rf"""edg_all AS (SELECT w[i] AS src, w[i + 1] AS dst, {_listed([r for r, _ in RELATIONS])}[(i % 5 + 1)::INT] AS rel,
  [{", ".join(f"{w}::DOUBLE" for _, w in RELATIONS)}][(i % 5 + 1)::INT] AS weight, 'benchmark' AS source, item_id * 1000 + i AS ingest_seq
  FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark))),
edg AS (SELECT src, rel, dst, weight, source FROM (SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY ingest_seq) AS n FROM edg_all) WHERE n = 1)"""


def stops_sql(more: list[str] | None = None) -> str:
    return ", ".join(f"'{w}'" for w in [*STOP_WORDS, *(more or [])])
