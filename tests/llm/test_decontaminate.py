import random
import re

import numpy as np
from lexweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        mine, hit, found = words(text), set(), set()
        for item, passage in items:
            theirs = words(passage)
            size = min(10, len(theirs))
            windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
            for i in range(len(mine) - size + 1):
                if tuple(mine[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(item)
        out.append((doc, len(mine), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "dé", "E1", "f", "été", "x9"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 9, 10, 11, 25, 60])) if i % 2 else ["w%d" % rng.randrange(500) for _ in range(30)])) for i in range(25)]
    items += [(None, items[0][1] + " tail"), (3, items[4][1]), (90, None), (91, " .,")]
    docs = []
    for d in range(80):
        text = ["w%d" % rng.randrange(500) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            passage = words(rng.choice(items)[1])
            cut = rng.randrange(len(passage) + 1)
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[cut : cut + rng.choice([5, 9, 10, 14, 99])]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text).upper() if d % 5 == 0 else " ".join(text)))
    docs += [(None, items[0][1]), (7, None), (8, ""), (8, "")]
    frame = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = decontaminate.contamination(frame, bench, block_bytes=block).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=str) == brute(docs, items)


def test_every_shared_window_keeps_a_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(200):
        shared = rng.integers(0, 5, 10).astype(np.uint64)
        a = np.concatenate((rng.integers(0, 5, 7).astype(np.uint64), shared, rng.integers(0, 5, 9).astype(np.uint64)))
        b = np.concatenate((rng.integers(0, 5, 3).astype(np.uint64), shared))
        ha, hb = decontaminate.gram_hashes(a, 5), decontaminate.gram_hashes(b, 5)
        pa, pb = decontaminate.winnow(ha, 6), decontaminate.winnow(hb, 6)
        assert {int(p) - 7 for p in pa} & {int(p) - 3 for p in pb} & set(range(6))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).first()["n_hit"] == 0
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(6)
    text = ["w%d" % rng.randrange(5000) for _ in range(300_000)]
    items = [(1, " ".join(text[150_000:150_040])), (2, " ".join(text[-10:])), (3, "not there at all but long enough to be one window of words"), (4, text[7] + " " + text[8])]
    docs = [(1, " ".join(text)), (2, "x " * 200_000)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        got = decontaminate.contamination(frame, bench, block_bytes=block).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got), key=str) == brute(docs, items)
