"""Stored tables: the lexicon keyed by ``id`` and the association edges keyed by (src, rel, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_S, _D = T.StringType(), T.DoubleType()

LEXICON = _fields(id=_S, word=_S, word_class=_S, language=_S, system=_S, tags=_S, seed_weight=_D, source=_S, etymology=_S, origin_lang=_S, translit=_S, registers=_S)
EDGES = _fields(src=_S, rel=_S, dst=_S, weight=_D, source=_S)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: absent ones are null, others are dropped."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
