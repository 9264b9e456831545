import random

import numpy as np
import xxhash
from lexweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def rows_with_copies():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows, n = [], 0
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 40, 200]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "a b"), (None, "a b"), (5, rows[5][1]), (n + 3, "x " * 30000)]
    return rows


def check(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_matches_brute_force(spark):
    check(spark, rows_with_copies())


def test_tiles_and_more_masks_find_the_same_links(spark):
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 2**63))
    codes = {center ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3))) for _ in range(300)}
    nodes = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    for n_nodes, tile in ((None, 1024), (None, 40), (10**8, 64)):
        stars = simhash.links(nodes, n_nodes=n_nodes, tile=tile)
        assert simhash.components(stars).where("root is not null").select("root").distinct().count() == 1
        assert all((a ^ b) != 0 for a, b in stars.collect())


def test_large_roots_connect_like_all_pairs(spark):
    """Families that share roots far beyond a tile: dense, sparse and in chains; and a family that is one component costs nothing more."""
    rng = np.random.default_rng(5)
    codes = set()
    for _ in range(3):  # dense
        center = int(rng.integers(0, 2**63))
        codes |= {center ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 4)))) for _ in range(120)}
    base = int(rng.integers(0, 2**63))
    codes |= {base ^ int(x) for x in rng.integers(0, 2**40, 250)}  # share the upper bits, hardly link
    for step in range(0, 40, 3):
        base ^= 0b111 << step
        codes.add(base)  # a chain
    codes = sorted(codes)
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(codes):
        for y in codes[:i]:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    want = {}
    for c in codes:
        want.setdefault(find(c), set()).add(c)
    nodes = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    for tile in (1024, 30, 8):
        stars = simhash.links(nodes, tile=tile)
        found = simhash.components(stars)
        of = {r["node"] % 2**64: r["root"] % 2**64 for r in found.collect()}
        got = {}
        for c in codes:
            got.setdefault(of.get(c, c), set()).add(c)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_component_is_not_compared_again(spark, monkeypatch):
    made = []
    real = simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda cells, d: (made.append(cells.count()), real(cells, d))[1])
    base = 0x0123456789ABCDEF
    codes = {base ^ x for x in range(1 << 9)}  # nine bits differ, so each code has over 200 neighbours
    simhash.links(spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long"), tile=64).collect()
    assert made == [5 * 512, 0]


def test_long_chain_is_one_component(spark):
    codes = [0]
    for bit in range(0, 63, 3):
        codes.append(codes[-1] | (0b111 << bit))
    edges = spark.createDataFrame([(a, b) for a, b in zip(codes, codes[1:])], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(got.values()) == {0} and set(got) == set(codes) - {0}


def test_index_prunes_nothing_that_links():
    rng = np.random.default_rng(0)
    codes = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 6)))) for b in rng.integers(0, 2**63, 30) for _ in range(30)], dtype=np.uint64))
    group = rng.integers(0, 3, len(codes))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    a, b = simhash.linked(group, codes, 4)
    i, j = np.triu_indices(len(codes), 1)
    near = (group[i] == group[j]) & (np.bitwise_count(codes[i] ^ codes[j]) <= 4)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(i[near].tolist(), j[near].tolist()))


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
