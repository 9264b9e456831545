"""Benchmark decontamination by winnowing.

Both sides are cut into words; every ``k`` consecutive words have a hash; each sliding window of
``window - k + 1`` hashes keeps its minimum. Two texts that share ``window`` consecutive words share a
sliding window, and so its minimum: no shared span of that length is missed. Training fingerprints are
joined with the benchmark's, and each meeting place is extended word by word in both directions; a
meeting counts if the common span holds a whole benchmark window. Items shorter than ``window`` words are
windows of their own; their length m is its own class with k = m.

The benchmark's index is broadcast in blocks of a checked size: its bytes are counted first and items are dealt to
as many blocks as the bound asks for. A single block is probed in one pass without a shuffle. Of several, each is probed by a job of
its own, which writes the hits of each different text and then gives its index up, so never more than one is held; the
hits of all blocks meet by a digest of the text. Passages, sources and copies never gather in one task.

Defined results: a null or wordless text has no words and no hit; a null benchmark text or one without words
is no item; an item with a null id marks words but is not listed; items that share an id count once;
repeated rows each get the same row; empty tables give no rows or no hits; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 8 << 20  # text of one broadcast block of the benchmark
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LETTER = bytearray(b" " * 128) + bytearray(range(128, 256))
for _c in range(128):
    if chr(_c).isalnum():
        _LETTER[_c] = ord(chr(_c).lower())
_LETTER = bytes(_LETTER)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z, as UTF-8 bytes."""
    return text.translate(_LETTER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += words[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some window of ``width`` hashes (the last such place of each window)."""
    if len(hashes) <= width:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    best = hashes.copy()
    at = np.arange(len(hashes))
    n = len(hashes) - width + 1
    low, where = best[:n].copy(), at[:n].copy()
    for i in range(1, width):
        now = hashes[i : i + n]
        better = now <= low
        low[better] = now[better]
        where[better] = at[i : i + n][better]
    return np.unique(where)


class Index:
    """One block of the benchmark: its words, and its fingerprints by class (gram length, window length)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids, self.words = [], []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            of = len(self.words)
            self.ids.append(item_id)
            self.words.append(words)
            size = min(window, len(words))  # the class: length of this item's windows
            k, width = (gram, window - gram + 1) if size == window else (size, 1)
            hashes = gram_hashes(word_hashes(words), k)
            for p in winnow(hashes, width).tolist():
                found.setdefault(size, {}).setdefault(int(hashes[p]), []).append((of, p))
        self.classes = {}
        for size, by in found.items():
            keys = np.array(sorted(by), dtype=np.uint64)
            self.classes[size] = (keys, by)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans [start, end) of hit words, and the ids of the items found."""
        spans: set[tuple[int, int]] = set()
        items: set[str | None] = set()
        if not words or not self.classes:
            return [], items
        base = word_hashes(words)
        for size, (keys, by) in self.classes.items():
            k, width = (self.gram, self.window - self.gram + 1) if size == self.window else (size, 1)
            hashes = gram_hashes(base, k)
            if not len(hashes) or len(words) < size:
                continue
            near = np.searchsorted(keys, hashes)
            near[near == len(keys)] = 0
            same = keys[near] == hashes
            if not same.any():
                continue
            if width > 1:
                chosen = np.zeros(len(hashes), bool)
                chosen[winnow(hashes, width)] = True
                same &= chosen
            done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the last extended span
            for p in np.flatnonzero(same).tolist():
                for of, q in by[int(hashes[p])]:
                    if p < done.get((of, p - q), -1):
                        continue
                    theirs = self.words[of]
                    a, b = p, q
                    while a and b and words[a - 1] == theirs[b - 1]:
                        a, b = a - 1, b - 1
                    end, to = p, q
                    while end < len(words) and to < len(theirs) and words[end] == theirs[to]:
                        end, to = end + 1, to + 1
                    done[(of, p - q)] = max(end, p + 1)
                    if end - a >= size:
                        spans.add((a, end))
                        items.add(self.ids[of])
        return sorted(spans), items


def _blocks(scratch: Scratch, benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[int, list[tuple[str | None, bytes]]]]:
    """(number of blocks, items) of each block of about ``block_bytes`` of text, one at a time on the driver."""
    some = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = some.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    if n > 1:
        some = scratch.table(some.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int")), "benchmark", "b")
    for b in range(n):
        yield n, [(r["i"], r["t"].encode()) for r in (some.where(F.col("b") == b) if n > 1 else some).collect()]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_NAMES = ("items", "hit_starts", "hit_ends")
_HITS = "items array<string>, hit_starts array<int>, hit_ends array<int>"


def _union(spans: Column) -> Column:
    """Sorted spans (a, b) as maximal runs."""
    kind = "array<struct<a:int,b:int>>"

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(F.coalesce(s["a"] <= last["b"], F.lit(False)), grown).otherwise(F.concat(out, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), step)


def _probe(held, window: int, gram: int, carried: list[str], only_hits: bool = False):
    """Worker: rows (*carried, text); out: their word counts, and the items and spans hit in the block that is held (None: no block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value if held else [], window, gram)
        for batch in batches:
            rows, n_words, items, starts, ends = [], [], [], [], []
            for i, text in enumerate(as_bytes(batch.column(len(carried)))):
                words = words_of(text)
                spans, ids = index.hits(words)
                if only_hits and not spans:
                    continue
                merged = _merge(spans)
                rows.append(i)
                n_words.append(len(words))
                items.append(sorted(x for x in ids if x is not None))
                starts.append([a for a, _ in merged])
                ends.append([b for _, b in merged])
            own = batch.take(pa.array(rows, pa.int64())) if only_hits else batch
            made = [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), *[pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]]
            yield pa.RecordBatch.from_arrays([*own.columns[: len(carried)], *made], [*carried, "n_words", *_NAMES])

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, *keep, n_words, n_hit, n_items, items, hit_starts, hit_ends) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    carried = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    text = F.col(text_col).cast("string")
    hits = None
    for k, (n, block) in enumerate(_blocks(scratch, benchmark, item_id_col, item_text_col, block_bytes)):
        held = spark.sparkContext.broadcast(block)
        if n == 1:
            at = docs.select(*carried, text.alias("__text")).mapInArrow(_probe(held, window, gram, carried), f"{schema}, n_words long, {_HITS}")
            break
        found = docs.select(F.sha2(text, 256).alias("__key"), text.alias("__text")).mapInArrow(_probe(held, window, gram, ["__key"], only_hits=True), f"__key string, n_words long, {_HITS}")
        found = scratch.table(found.groupBy("__key").agg(*[F.any_value(c).alias(c) for c in _NAMES]), f"hits-{k}")
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)
    else:
        counted = docs.select(*carried, F.sha2(text, 256).alias("__key"), text.alias("__text")).mapInArrow(_probe(None, window, gram, [*carried, "__key"]), f"{schema}, __key string, n_words long, {_HITS}")
        spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("hit_starts").alias("a"), F.col("hit_ends").alias("b")))))
        merged = hits.groupBy("__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), _union(spans).alias("spans"))
        merged = scratch.table(merged.select("__key", "items", F.col("spans.a").alias("hit_starts"), F.col("spans.b").alias("hit_ends")), "hits")
        none = {"items": "array<string>", "hit_starts": "array<int>", "hit_ends": "array<int>"}
        at = counted.drop(*_NAMES).join(merged, "__key", "left").select(*carried, "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return at.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
