"""Seeded names: every draw is a hash of (seed, attempt, draw), so results do not depend on partitions.

Pools are numbered by (bucket, id), which needs no sort of a whole pool in one task; an attempt picks by number and a
join brings the words.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.specs import GeneratorConfig
from .store import pools

ATTEMPTS = 100
BUCKETS = 1024
# Placeholders of a template and the pools behind them.
SLOTS = {"prefix": "prefixes", "word": "words", "suffix_adj": "suffix_adjs", "suffix": "suffix_names"}


@dataclass(frozen=True)
class Part:
    literal: str | None = None
    pool: str | None = None


def parse_template(text: str) -> list[Part]:
    """Literals and slots; an unknown name is an error, a slot left open at the end counts, a lone ``}`` is literal."""
    head, *rest = text.split("{")
    out = [Part(literal=head)] if head else []
    for piece in rest:
        name, _, literal = piece.partition("}")
        if name not in SLOTS:
            raise ValueError(f"unknown placeholder {{{name}}}; known: {', '.join(SLOTS)}")
        out.append(Part(pool=SLOTS[name]))
        if literal:
            out.append(Part(literal=literal))
    return out


def _hash(seed: int, *what: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.lit(w) if isinstance(w, str) else w for w in what])


def chance(seed: int, attempt: Column, draw: str, probability: float) -> Column:
    """True with the given probability, clamped to [0, 1]."""
    uniform = F.shiftrightunsigned(_hash(seed, attempt, draw), 11).cast("double") / F.lit(float(1 << 53))
    return uniform < F.lit(min(max(float(probability), 0.0), 1.0))


def numbered_pools(lexicon: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """((pool, n, word), sizes): each pool's words with dense numbers from 0."""
    at = pools(lexicon).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    sizes = at.groupBy("pool", "b").count()
    before = sizes.withColumn("before", F.sum("count").over(W.partitionBy("pool").orderBy("b").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("pool", "b", F.coalesce("before", F.lit(0)).alias("before"))  # at most BUCKETS rows a pool
    inner = F.row_number().over(W.partitionBy("pool", "b").orderBy("id", "word")) - 1
    rows = at.withColumn("i", inner).join(F.broadcast(before), ["pool", "b"]).select("pool", (F.col("before") + F.col("i")).alias("n"), "word")
    totals = {r["pool"]: r["count"] for r in pools(lexicon).groupBy("pool").count().collect()}
    return rows, totals


def _pick(at: DataFrame, rows: DataFrame, totals: dict[str, int], pool: str, seed: int, draw: str, name: str) -> DataFrame:
    """Add the word that a draw takes from a pool; null if the pool is empty."""
    if not totals.get(pool):
        return at.withColumn(name, F.lit(None).cast("string"))
    chosen = rows.where(F.col("pool") == pool).select(F.col("n").alias("__n"), F.col("word").alias(name))
    return at.withColumn("__n", F.pmod(_hash(seed, F.col("attempt"), draw), F.lit(totals[pool]))).join(chosen, "__n", "left").drop("__n")


def attempts(lexicon: DataFrame, seed: int, count: int, template: str | None = None, config: GeneratorConfig | None = None) -> DataFrame:
    """(attempt, name) for every attempt; a null name means that nothing can be made."""
    config = config or GeneratorConfig()
    rows, totals = numbered_pools(lexicon)
    at = lexicon.sparkSession.range(count * ATTEMPTS).withColumnRenamed("id", "attempt")
    if template is not None:
        parts = parse_template(template)
        pieces: list[Column] = []
        for k, part in enumerate(parts):
            if part.pool is None:
                pieces.append(F.lit(part.literal))
            else:
                at = _pick(at, rows, totals, part.pool, seed, f"slot{k}", f"w{k}")
                pieces.append(F.coalesce(F.col(f"w{k}"), F.lit("")))
        slots = [F.col(f"w{k}").isNotNull() for k, p in enumerate(parts) if p.pool is not None]
        some = F.lit(not slots)
        for s in slots:
            some = some | s
        made = F.trim(F.regexp_replace(F.concat(*pieces) if pieces else F.lit(""), r"(?U)\s+", " "))
        return at.select("attempt", F.when(some, made).alias("name"))
    for pool, name in (("prefixes", "p"), ("words", "w"), ("suffix_names", "s"), ("suffix_adjs", "a")):
        at = _pick(at, rows, totals, pool, seed, name, name)
    will = lambda draw, p: chance(seed, F.col("attempt"), draw, p)
    with_prefix = will("prefix", config.prefix_probability) & F.col("p").isNotNull()
    with_suffix = will("suffix", config.suffix_name_probability) & F.col("s").isNotNull()
    tokens = [
        F.when(with_prefix & will("The", config.prefix_article_probability), F.lit("The")),
        F.when(with_prefix, F.col("p")),
        F.col("w"),
        F.when(with_suffix, F.lit(config.fillword)),
        F.when(with_suffix & will("the", config.suffix_article_probability), F.lit("the")),
        F.when(with_suffix & will("adj", config.suffix_adjectiv_probability), F.col("a")),
        F.when(with_suffix, F.col("s")),
    ]
    joined = F.concat_ws(config.separator, *[F.nullif(t, F.lit("")) for t in tokens])
    return at.select("attempt", F.when(F.col("w").isNotNull(), joined).alias("name"))


def generate(lexicon: DataFrame, count: int, seed: int | None = None, template: str | None = None, config: GeneratorConfig | None = None) -> DataFrame:
    """(seed, n, name): unique names in order; fewer if ``ATTEMPTS`` attempts in a row bring nothing new."""
    seed = secrets.randbits(63) if seed is None else seed
    made = attempts(lexicon, seed, count, template, config).where("name is not null")
    first = made.groupBy("name").agg(F.min("attempt").alias("attempt"))
    order = W.orderBy("attempt")  # over at most count * ATTEMPTS rows
    gap = F.col("attempt") - F.coalesce(F.lag("attempt").over(order), F.lit(-1))
    late = first.withColumn("gap", gap)
    late = late.withColumn("late", F.max((F.col("gap") > ATTEMPTS).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    numbered = late.where("late = 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= count)
    return numbered.select(F.lit(seed).cast("long").alias("seed"), F.col("n").cast("long").alias("n"), "name")
