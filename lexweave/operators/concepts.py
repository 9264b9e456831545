"""From a description to weighted concepts: its tokens, the gloss bridge, one hop over edges, outside candidates.

What is read from the tables is bounded by the caps: window limits, applied before their shuffle, leave a few candidate rows
for each token or source, whatever the size of the tables. The caps themselves are a fold in order over those rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import gloss_tokens, is_concept_token, tokenize

# Weights and caps of the expansion.
BRIDGE_WEIGHT, ONLINE_WEIGHT = 0.7, 0.6
BRIDGE_PER_TOKEN, ASSOC_PER_SRC, ASSOC_TOTAL = 8, 6, 24
COMPOUND_BYTES = 4  # tokens of so many bytes mark words that contain them as compounds


@dataclass(frozen=True)
class Concept:
    term: str
    weight: float
    kind: str  # token, bridge, assoc or online
    via: str | None = None
    rel: str | None = None


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    return list(spark.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"])


def _bridge_rows(bridge: DataFrame, tokens: list[str], most: int) -> dict[str, list[str]]:
    """For each token the first ``most`` distinct gloss tokens of the words that it names, in order of (id, place)."""
    words = bridge.select("id", F.lower("word").alias("via"), "tags").where(F.col("via").isin(tokens))
    terms = words.select("id", "via", F.posexplode(gloss_tokens(F.col("tags"))).alias("pos", "term"))
    first = terms.groupBy("via", "term").agg(F.min(F.struct("id", "pos")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("via").orderBy("at"))).where(F.col("n") <= most)
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.select("via", "n", "term").collect(), key=lambda r: r["n"]):
        out.setdefault(r["via"], []).append(r["term"])
    return out


def _edge_rows(edges: DataFrame, sources: list[str], tokens: list[str], most: int) -> list[tuple[str, str, str, float]]:
    """For each source the first ``most`` distinct usable targets in order of (rel, dst)."""
    compound = F.lit(False)
    for t in tokens:
        if len(t.encode()) >= COMPOUND_BYTES:
            compound = compound | F.contains("dst", F.lit(t))
    usable = edges.where(F.col("src").isin(sources) & is_concept_token(F.col("dst")) & ~compound)
    first = usable.groupBy("src", "dst").agg(F.min(F.struct("rel", "weight")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("at.rel", "dst"))).where(F.col("n") <= most)
    rows = ranked.select("src", "at.rel", "dst", "at.weight").collect()
    return sorted((r["src"], r["rel"], r["dst"], r["weight"]) for r in rows)


def _candidates(spark: SparkSession, candidates: list[str]) -> list[str]:
    lowered = F.transform(F.array(*map(F.lit, candidates)), F.lower)
    return list(spark.range(1).select(F.filter(lowered, is_concept_token).alias("c")).first()["c"])


def build_concepts(spark: SparkSession, query: str, bridge: DataFrame | None, candidates: tuple[str, ...] = (), edges: DataFrame | None = None) -> list[Concept]:
    """The concepts of a description in order; a term counts once, where it comes first."""
    tokens = query_tokens(spark, query)
    out = [Concept(t, 1.0, "token") for t in tokens]
    seen = set(tokens)
    if bridge is not None and tokens:
        # a token's rows need not go beyond its cap plus all that others may have taken before
        found = _bridge_rows(bridge, tokens, BRIDGE_PER_TOKEN + len(tokens) * (1 + BRIDGE_PER_TOKEN))
        for token in tokens:
            fresh = [t for t in found.get(token, ()) if t not in seen][:BRIDGE_PER_TOKEN]
            seen.update(fresh)
            out += [Concept(t, BRIDGE_WEIGHT, "bridge", token) for t in fresh]
    if edges is not None and out:
        base = {c.term: c.weight for c in out}
        added: dict[str, int] = {}
        for src, rel, dst, weight in _edge_rows(edges, list(base), tokens, ASSOC_PER_SRC + len(seen) + ASSOC_TOTAL):
            if sum(added.values()) >= ASSOC_TOTAL:
                break
            if added.get(src, 0) < ASSOC_PER_SRC and dst not in seen:
                seen.add(dst)
                added[src] = added.get(src, 0) + 1
                out.append(Concept(dst, base[src] * weight, "assoc", src, rel))
    for term in _candidates(spark, list(candidates)) if candidates else ():
        if term not in seen:
            seen.add(term)
            out.append(Concept(term, ONLINE_WEIGHT, "online"))
    return out


def edge_source_terms(spark: SparkSession, query: str, bridge: DataFrame | None) -> list[str]:
    """The terms whose outgoing edges matter for a description."""
    return [c.term for c in build_concepts(spark, query, bridge)]


CONCEPT = "term string, weight double, kind string, via string, rel string"


def concept_frame(spark: SparkSession, concepts: list[Concept]) -> DataFrame:
    rows = [(i, c.term, c.weight, c.kind, c.via, c.rel) for i, c in enumerate(concepts)]
    return spark.createDataFrame(rows, f"pos int, {CONCEPT}")


def concept_array(concepts: list[Concept]) -> Column:
    """The concepts as one constant array of structs."""
    text = F.lit(None).cast("string")
    made = [F.struct(F.lit(c.term).alias("term"), F.lit(float(c.weight)).alias("weight"), F.lit(c.kind).alias("kind"), (F.lit(c.via) if c.via is not None else text).alias("via"), (F.lit(c.rel) if c.rel is not None else text).alias("rel")) for c in concepts]
    kind = "array<struct<" + ",".join(f.replace(" ", ":") for f in CONCEPT.split(", ")) + ">>"
    return (F.array(*made) if made else F.array()).cast(kind)
