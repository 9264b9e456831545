"""Exact removal of repeated byte strings by a depth-limited, most-significant-digit radix order of suffixes.

Two bytes strings of ``length`` bytes are repeats if they are equal; the first (smallest document id, then
smallest start) stays, every byte covered by a later one goes. Suffixes are ordered only through ``length``
bytes: passes over digits of eight bytes split groups of equal prefixes, groups of one are dropped at once, and
the groups left after the last pass are exactly the repeated windows.

What enters the passes is thinned first, without loss. Later copies of a whole text (told by SHA-256) are removed as a
whole and not looked at. Every window picks its anchor, the place of its smallest gram hash; equal windows pick the
same place, so windows whose anchor hash occurs once cannot repeat. Only anchors whose hash occurs again are joined back
to their texts and cut into segments of adjacent windows. A partial aggregate folds equal segments to the first, so a
passage that a third of all texts share is one segment a task before anything is dealt; what the first holds, the
others repeat. The first digit of a window is its anchor's hash and its distance from the anchor: segments are dealt by the hash and
a task orders the windows of its groups digit by digit. A hash with more than ``crowd`` different segments takes its next
digit before it is dealt: its windows are halved by their distance from the anchor, and each half is dealt by the bytes
that all its windows must share, which grow from pass to pass until the whole window is the digit.

Defined results: a null text is empty; texts shorter than ``length`` are never touched; a null id comes after all
others; rows that share id and text are one document and get the same result; rows that share an id but
not the text come in the order of a text hash; an empty table gives an empty table; only the id and the
results are returned.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, shuffle_partitions

LENGTH = 100  # bytes of a repeat
GRAM = 32  # bytes of a gram; a power of two
CROWD = 20_000  # different segments of one digit (about 3 MB) that one task may order
PIECE = 1 << 19  # windows of a text that are scanned at once
LAST = (1 << 63) - 1  # stands for a null id
_LOW = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram`` consecutive bytes, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, size = 0x9E3779B97F4A7C15, 1
    while size < gram:
        h = h[:-size] * np.uint64(step) + h[size:]
        step = step * step % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) of every run of windows with the same anchor."""
    parts = []
    for at in range(0, max(len(text) - length + 1, 0), PIECE):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, PIECE + length - 1), at)
        hashes = gram_hashes(data, gram)
        packed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equal hashes is the smallest
        where = (sliding_min(packed, length - gram + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        last = np.append(first[1:], len(where)) - 1
        anchor = where[first]
        parts.append((hashes[anchor].view(np.int64), anchor + at, first + at, last + at))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def radix_groups(data: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows that repeat within their group: (index into ``starts``, id of equal windows), ordered by that id.

    One pass per digit of eight bytes, most significant first; each pass orders the windows of a group by the
    digit, splits the group where it changes and drops groups of one.
    """
    digits = np.ndarray((max(len(data) - 7, 0),), ">u8", data, strides=(1,))
    at = np.arange(len(starts))
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] != length - 8:
        offsets.append(length - 8)
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    for offset in [None, *offsets]:
        if offset is not None:
            digit = digits[starts[at] + offset].astype(np.uint64)
            order = np.lexsort((digit, group))
            at, group, digit = at[order], group[order], digit[order]
            new = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            new = group[1:] != group[:-1]
        start = np.concatenate(([True], new)) if len(at) else np.zeros(0, bool)
        group = np.cumsum(start)
        alone = start & np.append(start[1:], True) if len(at) else start
        at, group = at[~alone], group[~alone]
        if not len(at):
            break
    return at, group


SEGMENT = "k long, id long, tie long, p long, digest binary"
BYTES = "k long, id long, tie long, p long, bytes binary"
RUN = "id long, tie long, s long, e long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _pack(a: np.ndarray, most: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """One number for an anchor's place and its windows' largest and least distance before it."""
    return (a * length + most) * length + least


def _unpack(p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, least = np.divmod(p, length)
    return *np.divmod(rest, length), least


def _digest(some: bytes, *numbers: int) -> bytes:
    return hashlib.blake2b(some, digest_size=16, salt=b"".join(n.to_bytes(8, "little") for n in numbers)).digest()


def _scan(length: int, gram: int):
    """Worker: texts; out: every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "id", "tie", "p"]
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple] = []
            held = 0
            for i, text in enumerate(as_bytes(batch.column(2))):
                if len(text) < length:
                    continue
                h, a, lo, hi = anchors(text, length, gram)
                out.append((h, np.full(len(h), ids[i]), np.full(len(h), ties[i]), _pack(a, a - lo, a - hi, length)))
                held += len(h)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return run


def _rows(rows: Iterator[tuple], schema: str, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        kinds = [*[pa.int64()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), kinds, strict=True)], _names(schema))


def _placed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(text, id, tie, k, p, a, most, least) of every segment of the texts (id, tie, text, found)."""
    for batch in batches:
        ids, ties, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        offsets = found.offsets.to_numpy()
        k, p = (found.values.field(i).to_numpy() for i in range(2))
        for i, text in enumerate(as_bytes(batch.column(2))):
            own = slice(offsets[i], offsets[i + 1])
            for each in zip(k[own].tolist(), p[own].tolist(), *(x.tolist() for x in _unpack(p[own], length)), strict=True):
                yield text, ids[i], ties[i], *each


def _first_digit(length: int):
    """Worker: texts with their repeated anchors; out: the segment of each, from its first window's start to its last one's end, by digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text, i, t, k, p, a, most, least in _placed(batches, length):
            yield k, i, t, p, _digest(text[a - most : a - least + length], most, least)

    return lambda batches: _rows(rows(batches), SEGMENT)


def _next_digit(length: int, width: int):
    """Worker: texts with their segments of crowded digits; out: the windows by ranges of ``width`` distances from the anchor, each dealt by the bytes that all windows of its range share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text, i, t, k, _, a, most, least in _placed(batches, length):
            for r in range(least // width, most // width + 1):
                first, last = r * width, r * width + width - 1
                x, y = max(least, first), min(most, last)
                shared = text[a - first : max(a + length - last, a - first)]
                digit = int.from_bytes(_digest(shared, k % (1 << 64), r)[:8], "little", signed=True)
                yield digit, i, t, (a * length + y) * length + x, _digest(text[a - y : a - x + length], y, x)

    return lambda batches: _rows(rows(batches), SEGMENT)


def _with_bytes(length: int):
    """Worker: texts with their segments; out: the segments with their bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text, i, t, k, p, a, most, least in _placed(batches, length):
            yield k, i, t, p, text[a - most : a - least + length]

    return lambda batches: _rows(rows(batches), BYTES)


def _order(length: int):
    """Worker: segments sorted by their digit; out: runs of repeated windows (id, tie, s, e)."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        key, ids, ties, p = (rows.column(c).to_numpy() for c in ("k", "id", "tie", "p"))
        parts = rows.column("bytes").to_pylist()
        a, most, least = _unpack(p, length)
        data = b"".join(parts)
        base = np.cumsum([0, *map(len, parts)])[:-1]
        size = most - least + 1
        of = np.repeat(np.arange(len(key)), size)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        _, of_key = np.unique(key, return_inverse=True)
        # equal windows stand at the same distance from their anchor, so that distance is a digit too
        at, group = radix_groups(data, base[of] + inner, of_key[of] * length + most[of] - inner, length)
        if not len(at):
            return None
        of, place = of[at], (a - most)[of[at]] + inner[at]
        order = np.lexsort((place, ties[of], ids[of], group))
        of, place, group = of[order], place[order], group[order]
        later = np.concatenate(([False], group[1:] == group[:-1]))  # of equal windows the first stays
        i, t, s = ids[of[later]], ties[of[later]], place[later]
        order = np.lexsort((s, t, i))
        i, t, s = i[order], t[order], s[order]
        cut = np.concatenate(([True], (s[1:] != s[:-1] + 1) | (i[1:] != i[:-1]) | (t[1:] != t[:-1])))
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(s)) - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (i[first], t[first], s[first], s[last])], _names(RUN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < 8192:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column("k").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last digit may go on in the next batch
            if cut and (found := solve(rows.slice(0, cut))) is not None:
                yield found
            held = rows.slice(cut).to_batches()
            count = len(key) - cut
        if count and (found := solve(pa.Table.from_batches(held))) is not None:
            yield found

    return run


SPAN = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _remove(length: int):
    """Worker: texts with runs of repeated windows; out: what is removed and the hash of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3)
            offsets = runs.offsets.to_numpy()
            starts, ends = (runs.values.field(i).to_numpy() for i in range(2))
            removed, spans, digests = [], [], []
            for i, text in enumerate(as_bytes(batch.column(2))):
                own = slice(offsets[i], offsets[i + 1])
                order = np.argsort(starts[own], kind="stable")
                s, e = starts[own][order], np.maximum.accumulate(ends[own][order] + length)
                first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                s, e = s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist()
                rest, at = hashlib.sha256(), 0
                for x, y in zip(s, e, strict=True):
                    rest.update(text[at:x])
                    at = y
                rest.update(text[at:])
                removed.append(sum(e) - sum(s))
                spans.append([{"s": x, "e": y} for x, y in zip(s, e, strict=True)])
                digests.append(rest.hexdigest())
            columns = [pa.array(removed, pa.int64()), pa.array(spans, SPAN), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "tie", "n_removed", "spans", "rest"])

    return run


def _at_texts(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts (id, tie, text, found) with their segments (k, id, tie, p)."""
    found = segments.groupBy("id", "tie").agg(F.collect_list(F.struct("k", "p")).alias("found"))
    return texts.join(found, ["id", "tie"]).select("id", "tie", "text", "found")


def _repeated_windows(scratch: Scratch, texts: DataFrame, marked: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """(id, tie, s, e): runs of windows, by their starts, that an earlier place has as well."""
    segments = _at_texts(texts, marked).mapInArrow(_first_digit(length), SEGMENT)
    runs = None
    width, level = length - gram + 1, 0
    place = F.struct("id", "tie", "p")
    while True:
        segments = scratch.table(segments, f"segments-{level}")
        folded = segments.groupBy("digest").agg(F.min(place).alias("head"), F.any_value("k").alias("k"), F.count("*").alias("n"))
        heads = scratch.table(folded.select("k", "digest", "head.*", "n"), f"heads-{level}")
        head = heads.where("n > 1").select("digest", place.alias("head"))
        others = segments.drop("k").join(head, "digest").where(place != F.col("head"))
        a = F.expr(f"p div {length * length}")
        whole = others.select("id", "tie", (a - F.pmod(F.expr(f"p div {length}"), F.lit(length))).alias("s"), (a - F.pmod("p", F.lit(length))).alias("e"))

        digits = scratch.table(heads.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), f"digits-{level}")
        met = scratch.table(heads.select("k", "id", "tie", "p").join(digits, "k"), f"met-{level}")
        read = _at_texts(texts, met.where(F.col("m") <= crowd)).mapInArrow(_with_bytes(length), BYTES)
        dealt = read.repartition(shuffle_partitions(scratch.spark), "k").sortWithinPartitions("k")
        found = scratch.table(whole, f"whole-{level}").unionByName(scratch.table(dealt.mapInArrow(_order(length), RUN), f"runs-{level}"))
        runs = found if runs is None else runs.unionByName(found)
        scratch.drop(f"segments-{level}", f"heads-{level}", f"digits-{level}")
        crowded = met.where(F.col("m") > crowd)
        if crowded.isEmpty():
            return runs
        width, level = (width + 1) // 2, level + 1
        segments = _at_texts(texts, crowded).mapInArrow(_next_digit(length, width), SEGMENT)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) for every row; ``spans`` are the maximal removed runs of bytes."""
    scratch = Scratch(df.sparkSession, "dedup")
    gram = 1 << max(0, (length // 3).bit_length() - 1)
    named = df.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("id", F.coalesce("own", F.lit(LAST)))
    rows = named.select("own", "id", F.xxhash64("text").alias("th"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    rows = scratch.table(rows, "rows")
    unique = rows.groupBy("id").count().where("count > 1 or id = " + str(LAST)).isEmpty()
    zero = F.pmod("id", F.lit(1).cast("long"))  # a literal would be dropped from the keys, and texts dealt twice
    texts = named.select("id", (zero if unique else F.xxhash64("text")).alias("tie"), "text")
    rows = rows.withColumn("tie", zero if unique else F.col("th"))
    firsts = rows.groupBy("sha").agg(F.min(F.struct("id", "tie")).alias("first")).select("first.*")
    firsts = scratch.table(firsts, "firsts")

    texts = texts.join(firsts.hint("merge"), ["id", "tie"], "left_semi")  # deals the texts once, for the join and the buckets
    with scratch.dealt(texts if unique else texts.dropDuplicates(["id", "tie"]), "texts", "id", "tie") as texts:
        scanned = texts.mapInArrow(_scan(length, gram), "h long, id long, tie long, p long")
        scanned = scratch.table(scanned, "anchors")
        again = scratch.table(scanned.groupBy("h").count().where("count > 1").select("h"), "again")  # a table, so that the join can split a hot anchor
        marked = scratch.table(scanned.join(again, "h").select(F.col("h").alias("k"), "id", "tie", "p"), "marked")
        scratch.drop("anchors", "again")
        runs = _repeated_windows(scratch, texts, marked, length, gram, crowd)
        scratch.drop("marked")

        by_run = runs.groupBy("id", "tie").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
        cut = texts.join(by_run, ["id", "tie"]).select("id", "tie", "text", "runs")
        cut = cut.mapInArrow(_remove(length), "id long, tie long, n_removed long, spans array<struct<s:long,e:long>>, rest string")
        cut = scratch.table(cut, "cut")
    is_first = firsts.withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<s:long,e:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))
    return rows.join(is_first, ["id", "tie"], "left").join(cut, ["id", "tie"], "left").select(
        F.col("own").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
