"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: majority bits of XXH64 over word shingles, made in one Arrow pass. Equal fingerprints fold to
one node by a partial aggregate, so groups of exact copies never travel as rows.

Index: the root nodes are masked bit patterns. The 64 bits are cut into ``max_distance + r`` blocks and each
choice of ``r`` blocks is a mask: two fingerprints within ``max_distance`` bits agree on all bits of at least
one mask, so a shared (mask, pattern) root holds every link. Beneath a root, fingerprints are sorted by Gray
rank and packed into leaf nodes and upper nodes; a node keeps the bits on which its members agree. A pair of
nodes whose agreed bits already differ in more than ``max_distance`` places is pruned as a whole, first on the
upper level, then on the lower with the differences accumulated; only what is left is compared one by one.
Cells report a spanning star per linked group, never all pairs. A root with many members is cut into tiles of bounded size,
dealt anew for each mask, and every tile is a cell. What these cells link is contracted first; then members are tiled by
component, and only pairs of tiles that can join two components are compared: a group that has become one
component costs no more, and every link between different components is still looked for. ``r`` follows the number of
fingerprints and changes cost only: every choice finds every link.

Components: stars are contracted by minimum neighbour and pointer jumping, each round written to the shared
folder.

Defined results: a null or blank text has fingerprint zero, which links like any other; rows with a null id
keep their row and take the smallest known id of their component (null if there is none); repeated rows stay
as they are; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, shuffle_partitions

LEAF, UPPER = 16, 8  # members of a leaf node, leaf nodes of an upper node
TILE = 1024  # members of a root that are compared within one cell; larger roots are tiled
ROOT_MEMBERS = 512  # expected members of a root above which masks take one more block


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # on bytes: lowers A-Z only, splits on the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash64(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = [hash64(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text never unpacks at once
        some = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle, seed) for t in as_bytes(batch.column(batch.num_columns - 1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], ["id", *keep, "fp"])

    kinds = "".join(f"`{name}` {df.schema[c].dataType.simpleString()}, " for name, c in (("id", id_col), *((k, k) for k in keep)))
    return df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"{kinds}fp long")


def _masks(max_distance: int, blocks_kept: int) -> list[int]:
    n = max_distance + blocks_kept
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, blocks_kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order: the prefix XOR of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _shifted_pairs(group: np.ndarray, alive) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i <= j, of one sorted group id, by rising distance; ``alive(i, j)`` prunes."""
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.concatenate(([0], np.cumsum(size)[:-1]))[group] if len(group) else group
    left = size[group] - rank
    at = np.arange(len(group))
    for s in range(int(size.max()) if len(size) else 0):
        at = at[left[at] > s]
        keep = alive(at, at + s)
        if keep.any():
            yield at[keep], at[keep] + s


def _expand(i: np.ndarray, j: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of the node pairs (i, j), each unordered pair once."""
    ni, nj = count[i], count[j]
    total = ni * nj
    of = np.repeat(np.arange(len(i)), total)
    k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    a, b = first[i][of] + k // nj[of], first[j][of] + k % nj[of]
    keep = a <= b
    return a[keep], b[keep]


def _nodes(group: np.ndarray, width: int) -> np.ndarray:
    """First row of each node: up to ``width`` consecutive rows of one group."""
    size = np.bincount(group)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    rank = np.arange(len(group)) - start[group]
    return np.flatnonzero(rank % width == 0)


def linked(group: np.ndarray, codes: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``max_distance`` bits inside each group, by the hierarchical index.

    ``group`` must be ascending from 0 without gaps and ``codes`` in Gray order within a group.
    """
    none = np.zeros(0, np.int64)
    if len(codes) < 2:
        return none, none
    leaf_first = _nodes(group, LEAF)
    both, any_ = np.bitwise_and.reduceat(codes, leaf_first), np.bitwise_or.reduceat(codes, leaf_first)
    leaf_group, leaf_mask = group[leaf_first], ~(both ^ any_)
    leaf_count = np.diff(np.append(leaf_first, len(codes)))
    upper_first = _nodes(leaf_group, UPPER)
    up_both, up_any = np.bitwise_and.reduceat(both, upper_first), np.bitwise_or.reduceat(any_, upper_first)
    upper_group, upper_mask = leaf_group[upper_first], ~(up_both ^ up_any)
    upper_count = np.diff(np.append(upper_first, len(leaf_first)))
    upper_of = np.repeat(np.arange(len(upper_first)), upper_count)

    def upper_alive(i, j):
        return np.bitwise_count((up_both[i] ^ up_both[j]) & upper_mask[i] & upper_mask[j]) <= max_distance

    out_a, out_b = [], []
    for i, j in _shifted_pairs(upper_group, upper_alive):
        for at in range(0, len(i), 4096):
            a, b = _expand(i[at : at + 4096], j[at : at + 4096], upper_first, upper_count)
            above = upper_mask[upper_of[a]] & upper_mask[upper_of[b]]
            differ = both[a] ^ both[b]
            shared = np.bitwise_count(differ & above)  # what the upper level has found
            new = np.bitwise_count(differ & leaf_mask[a] & leaf_mask[b] & ~above)
            keep = shared + new <= max_distance
            a, b = a[keep], b[keep]
            for to in range(0, len(a), 4096):
                x, y = _expand(a[to : to + 4096], b[to : to + 4096], leaf_first, leaf_count)
                near = (x < y) & (np.bitwise_count(codes[x] ^ codes[y]) <= max_distance)
                out_a.append(x[near])
                out_b.append(y[near])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _cell_links(max_distance: int):
    """Worker: rows (cell, fp) sorted by cell; out: stars (a, b) of each cell."""

    def solve(cells: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
        codes = prints.view(np.uint64)
        order = np.lexsort((gray_rank(codes), cells))
        cells, codes = cells[order], codes[order]
        group = np.cumsum(np.concatenate(([0], (cells[1:] != cells[:-1]).astype(np.int64))))
        a, b = linked(group, codes, max_distance)
        if not len(a):
            return None
        root = _stars(len(codes), a, b)
        child = np.flatnonzero(root != np.arange(len(codes)))
        signed = codes.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held_c = np.concatenate((held_c, batch.column(0).to_numpy()))
            held_p = np.concatenate((held_p, batch.column(1).to_numpy()))
            if len(held_c) < 1 << 14:
                continue
            cut = np.searchsorted(held_c, held_c[-1])  # the last cell may go on in the next batch
            if cut and (found := solve(held_c[:cut], held_p[:cut])) is not None:
                yield found
            held_c, held_p = held_c[cut:], held_p[cut:]
        if len(held_c) and (found := solve(held_c, held_p)) is not None:
            yield found

    return run


def _compared(cells: DataFrame, max_distance: int) -> DataFrame:
    """Stars (a, b) of the cells (cell, fp)."""
    dealt = cells.repartition(shuffle_partitions(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_cell_links(max_distance), "a long, b long")


def _between(roots: DataFrame, large: DataFrame, label: DataFrame | None, tile: int, scratch: Scratch) -> DataFrame:
    """(cell, fp): the pairs of tiles of large roots that hold members of different components.

    Components with many members in a root have tiles of their own, which are never compared with each other; the others share
    tiles by a hash of the component.
    """
    root = ["mask", "bits"]
    members = roots.join(large.select(*root), root)
    members = members.withColumn("comp", F.col("fp")) if label is None else members.join(label.select(F.col("node").alias("fp"), F.col("root").alias("to")), "fp", "left").select(*root, "fp", F.coalesce("to", "fp").alias("comp"))
    members = scratch.table(members, "members")
    counts = members.groupBy(*root, "comp").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") > tile // 4, F.col("comp"))
    tiled = counts.groupBy(*root, own.alias("own")).agg(F.ceil(F.sum("n") / F.lit(tile)).cast("int").alias("tiles"))
    tiled = scratch.table(tiled, "tiled")
    each = tiled.select(*root, "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k"))
    listed = each.groupBy(*root).agg(F.collect_list(F.struct("own", "k")).alias("all"))  # a few for every ``tile`` members
    shared = tiled.where("own is null").select(*root, F.col("tiles").alias("shared"))
    listed = scratch.table(listed.join(shared, root, "left"), "listed")
    alone = scratch.table(tiled.where("own is not null").select(*root, F.col("own").alias("comp"), "tiles"), "alone")
    at = members.join(alone, [*root, "comp"], "left").join(listed, root)
    mine = F.struct(F.when(F.col("tiles").isNotNull(), F.col("comp")).alias("own"), F.pmod(F.xxhash64(F.when(F.col("tiles").isNotNull(), F.col("fp")).otherwise(F.col("comp"))), F.coalesce("tiles", "shared")).cast("int").alias("k"))
    at = at.select(*root, "fp", mine.alias("mine"), "all")
    at = at.select(*root, "fp", "mine", F.explode(F.filter("all", lambda t: ~F.coalesce(t["own"] == F.col("mine.own"), F.lit(False)))).alias("other"))
    name = lambda t: F.xxhash64(F.col(f"{t}.own").isNull(), F.coalesce(f"{t}.own", F.lit(0)), F.col(f"{t}.k"))
    return at.select(F.xxhash64(*root, F.least(name("mine"), name("other")), F.greatest(name("mine"), name("other"))).alias("cell"), "fp")


def links(nodes: DataFrame, max_distance: int = 4, n_nodes: int | None = None, tile: int = TILE) -> DataFrame:
    """Stars (a, b) that connect the distinct fingerprints ``fp`` just as all links would."""
    scratch = Scratch(nodes.sparkSession, "simhash-links")
    n = nodes.count() if n_nodes is None else n_nodes
    kept = 1
    while kept < 4 and n / 2 ** (64 * kept / (max_distance + kept)) > ROOT_MEMBERS:
        kept += 1
    masks = [_signed(m) for m in _masks(max_distance, kept)]
    roots = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"))
    large = scratch.table(roots.groupBy("mask", "bits").agg(F.count("*").alias("m")).where(F.col("m") > tile), "large")
    # A cell is known by a hash: cells that meet in a hash are compared together, which costs time but no link.
    tiles = F.ceil(F.coalesce("m", F.lit(1)) / F.lit(tile)).cast("int")
    at = roots.join(large, ["mask", "bits"], "left")
    cell = F.xxhash64("mask", "bits", F.pmod(F.xxhash64("fp", "mask"), tiles))
    found = _compared(at.select(cell.alias("cell"), "fp"), max_distance)
    if large.isEmpty():
        return found
    found = scratch.table(found, "within")
    return found.unionByName(_compared(_between(roots, large, components(found, scratch), tile, scratch), max_distance))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame | None:
    """(node, root) for every node of ``edges`` (a, b) that is not its own root; None without edges.

    Each round points every node at its smallest neighbour, jumps pointers once and contracts, so stars
    and chains of stars end in a few rounds.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    at = scratch.table(edges.where("a <> b").distinct(), "edges-0")
    rounds: list[DataFrame] = []
    while not at.isEmpty():
        k = len(rounds)
        both = at.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(at.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("up"))
        parent = scratch.table(parent.where("up <> node"), f"up-{k}")
        jump = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        point = scratch.table(parent.join(jump, "up", "left").select("node", F.coalesce("top", "up").alias("root")), f"root-{k}")
        rounds.append(point)
        for side in ("a", "b"):
            at = at.join(point.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        at = scratch.table(at.where("a <> b").distinct(), f"edges-{k + 1}")
        scratch.drop(f"up-{k}", f"edges-{k}")
    if not rounds:
        return None
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        found = found.unionByName(later)
    found = scratch.table(found.groupBy("node").agg(F.min("root").alias("root")), "roots")
    scratch.drop(*(f"root-{k}" for k in range(len(rounds))))
    return found


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, shingle: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fp, root, component_id) for every row: ``root`` is a fingerprint that names the component."""
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.table(add_fingerprint(df, id_col, text_col, shingle, keep=keep), "prints")
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    root_of = components(links(nodes.select("fp"), max_distance), scratch)
    if root_of is not None:
        rooted = nodes.join(root_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rooted = scratch.table(rooted, "rooted")
        best = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "best")  # a table, so that the join can split a large component
        nodes = scratch.table(rooted.join(best, "root").select("fp", "root", "component_id"), "component")
        scratch.drop("nodes", "roots", "rooted", "best")
    else:
        nodes = nodes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return prints.join(nodes, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, shingle: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``df``."""
    out = grouped(df, id_col, text_col, max_distance, shingle)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row of ``df`` for each component: that of the smallest id (null comes last), then of the smallest row hash."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    at = df.withColumn("__row", F.xxhash64(*df.columns)).withColumn("__key", key)
    found = grouped(at, id_col, text_col, max_distance, shingle, keep=("__key", "__row"))
    best = found.groupBy("root").agg(F.min(F.struct("__key", "__row")).alias("best")).select("best.*")
    return at.join(best, ["__key", "__row"], "left_semi").dropDuplicates(["__key", "__row"]).select(*df.columns)
