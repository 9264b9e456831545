"""Keyed tables: upserts, filters and the catalogue's counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EDGES, LEXICON, conform

# The word classes that the store knows.
WORD_CLASSES = "prefix noun proper adj suffix suffix_noun".split()
# Which classes feed which pool of the name generator.
POOLS = {"prefixes": ["prefix"], "words": ["noun", "proper"], "suffix_adjs": ["adj"], "suffix_names": ["suffix", "suffix_noun"]}


def word_id(language: Column, word: Column) -> Column:
    return F.when(language.isNotNull(), F.concat_ws("_", language, word)).otherwise(word)


def _survivors(df: DataFrame, keys: list[str], seq: str, last: bool) -> DataFrame:
    """One row a key, that of the largest or smallest ``seq``: a partial aggregate, so hot keys fold before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(seq))
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def _numbered(df: DataFrame, schema: T.StructType, seq: Column, batch: int) -> DataFrame:
    """The columns of ``schema`` and the order of writing: stored rows come before new ones."""
    at = df.withColumn("__seq", F.struct(F.lit(batch).alias("batch"), seq.alias("n")))
    return conform(at, T.StructType([*schema.fields, T.StructField("__seq", at.schema["__seq"].dataType)]))


def _place(df: DataFrame, seq: str) -> Column:
    """The order of new rows: a number, or a struct that is compared as it stands."""
    return F.col(seq) if isinstance(df.schema[seq].dataType, T.StructType) else F.col(seq).cast("long")


def upsert_words(existing: DataFrame | None, new: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The lexicon after ``new`` rows: for each id the last write stays."""
    rows = _numbered(new, LEXICON, _place(new, seq), 1)
    if existing is not None:
        rows = _numbered(existing, LEXICON, F.lit(0).cast("long"), 0).unionByName(rows)
    return _survivors(rows, ["id"], "__seq", last=True).drop("__seq")


def insert_edges(existing: DataFrame | None, new: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The edges after ``new`` rows: for each (src, rel, dst) the first write stays."""
    rows = _numbered(new, EDGES, _place(new, seq), 1)
    if existing is not None:
        rows = _numbered(existing, EDGES, F.lit(0).cast("long"), 0).unionByName(rows)
    return _survivors(rows, ["src", "rel", "dst"], "__seq", last=False).drop("__seq")


COMPACT = 16  # batches after which a table is rewritten


class Store:
    """The two tables as Parquet under one path, with additive migration on read.

    A write adds a batch: its own survivors, nothing else is touched. A read folds the base and its batches; after ``COMPACT`` batches
    the next write makes a new base of them. The base before stays for readers that have begun, older ones go.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _written(self, name: str) -> list[tuple[int, int]]:
        """(base, batch) of all that has been written whole, in order."""
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = [x.split("-") for x in found if x.startswith(f"{name}-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        return sorted((int(base), int(batch)) for _, base, batch in whole)

    def _parts(self, name: str) -> tuple[int, list[int]]:
        """(newest base, its batches); the base's own number is 0 among them."""
        parts = self._written(name)
        base = max((b for b, batch in parts if batch == 0), default=0)
        return base, [batch for b, batch in parts if b == base]

    def _read(self, name: str, schema: T.StructType, keys: list[str], last: bool) -> DataFrame | None:
        base, batches = self._parts(name)
        if not batches:
            return None
        kept = [_numbered(self.spark.read.parquet(f"{self.path}/{name}-{base}-{k}"), schema, F.lit(0).cast("long"), k) for k in batches]
        if len(kept) == 1:
            return kept[0].drop("__seq")
        rows = kept[0]
        for more in kept[1:]:
            rows = rows.unionByName(more)
        return _survivors(rows, keys, "__seq", last).drop("__seq")

    def _words(self) -> DataFrame | None:
        return self._read("words", LEXICON, ["id"], True)

    def _edges(self) -> DataFrame | None:
        return self._read("edges", EDGES, ["src", "rel", "dst"], False)

    def words(self) -> DataFrame:
        found = self._words()
        return self.spark.createDataFrame([], LEXICON) if found is None else found

    def edges(self) -> DataFrame:
        found = self._edges()
        return self.spark.createDataFrame([], EDGES) if found is None else found

    def _add(self, name: str, batch: DataFrame, read: Callable[[], DataFrame | None]) -> None:
        base, batches = self._parts(name)
        batch.write.mode("overwrite").parquet(f"{self.path}/{name}-{base}-{max(batches, default=-1) + 1}")
        if len(batches) >= COMPACT:
            self.compact(name, read)

    def compact(self, name: str, read: Callable[[], DataFrame | None]) -> None:
        """Make one base of a base and its batches."""
        base, batches = self._parts(name)
        if len(batches) > 1:
            read().write.mode("overwrite").parquet(f"{self.path}/{name}-{base + 1}-0")
            fs, path = self._fs()
            for s in fs.listStatus(path):
                kind, of, _ = s.getPath().getName().split("-")
                if kind == name and int(of) < base:
                    fs.delete(s.getPath(), True)

    def insert_words(self, new: DataFrame, seq: str = "ingest_seq") -> None:
        self._add("words", upsert_words(None, new, seq), self._words)

    def insert_edges(self, new: DataFrame, seq: str = "ingest_seq") -> None:
        self._add("edges", insert_edges(None, new, seq), self._edges)

    def index_words(self) -> None:
        """Store the postings of the words as they stand, in order of tokens, so that a query reads those of its concepts only."""
        from .rank import postings

        base, batches = self._parts("words")
        if batches:
            postings(self.words()).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{self.path}/postings-{base}-{max(batches)}")

    def postings(self) -> DataFrame | None:
        """The stored postings, if no word was written after them."""
        base, batches = self._parts("words")
        newest = (base, max(batches, default=0))
        return self.spark.read.parquet(f"{self.path}/postings-{base}-{newest[1]}") if newest in self._written("postings") else None

    def bootstrap(self) -> DataFrame:
        """The words; the seed lexicon first if the store is empty."""
        if self._words() is None:
            from ..sources.seed import seed_lexicon

            self._add("words", seed_lexicon(self.spark), self._words)
        return self.words()


def in_systems(lexicon: DataFrame, systems: list[str] | None) -> DataFrame:
    """Rows of the systems named; None or no name is no filter."""
    return lexicon.where(F.col("system").isin(systems)) if systems else lexicon


def in_register(lexicon: DataFrame, register: str | None) -> DataFrame:
    return lexicon if register is None else lexicon.where(F.coalesce(F.contains("registers", F.lower(F.lit(register))), F.lit(False)))


def list_words(lexicon: DataFrame, system: str | None = None, language: str | None = None) -> DataFrame:
    at = lexicon if system is None else lexicon.where(F.col("system") == system)
    at = at if language is None else at.where(F.col("language") == language)
    return at.orderBy("word", "id")


def count_by(lexicon: DataFrame, column: str) -> DataFrame:
    return lexicon.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), F.asc(column))


def language_summary(lexicon: DataFrame, most: int = 4) -> DataFrame:
    """One line: the ``most`` frequent languages, then ``...`` if there are more."""
    top = count_by(lexicon, "language").where("language is not null").limit(most + 1)
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "language"))).alias("x"))
    part = F.transform(F.slice("x", 1, most), lambda r: F.concat(r["language"], F.lit(" "), (-r["n"]).cast("string")))
    return ordered.select(F.concat(F.array_join(part, " · "), F.when(F.size("x") > most, " · ...").otherwise("")).alias("summary"))


def unknown_class(word_class: Column) -> Column:
    return word_class.isNotNull() & ~word_class.isin(WORD_CLASSES)


def import_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("imported"), F.count_if(unknown_class(F.col("word_class"))).alias("unknown_class"))


def pool_of(word_class: Column) -> Column:
    out = F.lit(None).cast("string")
    for pool, classes in POOLS.items():
        out = F.when(word_class.isin(classes), F.lit(pool)).otherwise(out)
    return out


def pools(lexicon: DataFrame) -> DataFrame:
    """(pool, id, word): the rows that feed the name generator."""
    return lexicon.select(pool_of(F.col("word_class")).alias("pool"), "id", "word").where("pool is not null")


def edges_from(edges: DataFrame, terms: list[str]) -> DataFrame:
    """Edges that leave one of the terms, in the order that decides caps."""
    return edges.where(F.col("src").isin(terms)).orderBy("src", "rel", "dst")
