"""Candidates for a description from an outside service, by a provider that stands for it."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.concepts import query_tokens
from .dictionary import expansion_words, merge_candidates
from .specs import ExpansionSpec

# Associations asked for each of the first tokens of a description.
TRIGGERS_PER_TOKEN, TRIGGER_TOKENS = 5, 3


class Provider(Protocol):
    """Answers with the body of a response: a JSON array of objects with ``word`` and ``score``."""

    def means_like(self, query: str, most: int) -> str: ...

    def triggered_by(self, token: str, most: int) -> str: ...


class Folder:
    """Responses kept as files: ``ml/<query>.json`` and ``rel_trg/<token>.json``; there is no network here."""

    def __init__(self, path: str):
        self.path = Path(path)

    def means_like(self, query: str, most: int) -> str:
        return (self.path / "ml" / f"{query}.json").read_text()

    def triggered_by(self, token: str, most: int) -> str:
        return (self.path / "rel_trg" / f"{token}.json").read_text()


def _words(spark: SparkSession, body: str, most: int) -> list[str]:
    return list(spark.range(1).select(expansion_words(F.lit(body), most).alias("w")).first()["w"])


def expand(spark: SparkSession, provider: Provider, spec: ExpansionSpec, query: str) -> tuple[str, ...]:
    """Words like the whole description, then those that its first tokens bring to mind; each once whatever its case.

    A failure of the first response is an error; one of the others is passed over.
    """
    lists = [_words(spark, provider.means_like(query, spec.max_candidates), spec.max_candidates)]
    for token in query_tokens(spark, query)[:TRIGGER_TOKENS]:
        try:
            lists.append(_words(spark, provider.triggered_by(token, TRIGGERS_PER_TOKEN), TRIGGERS_PER_TOKEN))
        except Exception:  # associations are a bonus
            continue
    made = spark.createDataFrame([(lists,)], "lists array<array<string>>")
    return tuple(made.select(merge_candidates(F.col("lists")).alias("w")).first()["w"])
