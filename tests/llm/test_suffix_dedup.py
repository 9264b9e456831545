import hashlib
import random

import numpy as np
import pytest
from lexweave.llm import suffix_dedup

LAST = suffix_dedup.LAST


def brute(rows, length):
    def order(row):
        return (LAST if row[0] is None else row[0], hashlib.sha256((row[1] or "").encode()).hexdigest())

    first, out = {}, {}
    for row in sorted(set(rows), key=order):
        data = (row[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first.setdefault(data[p : p + length], (row, p)) != (row, p):
                gone[p : p + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[row] = (row[0], len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return sorted((out[r] for r in rows), key=str)


def some_rows(seed, shared_ids=False):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß😀") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for d in range(90):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120)))
        for _ in range(rng.randrange(3)):
            text += rng.choice([" ", "\n", ""]) + rng.choice(passages)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.7:
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(vocabulary) + text[at:]
        rows.append((d, text))
    rows += [(200, None), (201, ""), (202, "z" * 700), (203, "z" * 99), (204, "ab" * 400), (205, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [4000, 2])
def test_matches_brute_force(spark, crowd):
    rows = some_rows(1)
    for length in (100, 24):
        got = suffix_dedup.deduplicate(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int"), length=length, crowd=crowd).collect()
        assert sorted(((r[0], r[1], r[2], len(r[3]), r[4]) for r in got), key=str) == brute(rows, length)


def test_null_and_repeated_ids(spark):
    text = "some words that are long enough to be met again in another place of the corpus, at least a hundred bytes of them"
    rows = [(None, text), (3, text), (3, text), (None, text + "!"), (1, "short")]
    got = sorted(((r[0], r[2]) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, len(text)), (3, 0), (3, 0), (None, len(text)), (1, 0)], key=str)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    whole = text + b"--" + text[700:1900]
    h, a, lo, hi = suffix_dedup.anchors(whole)
    assert lo[0] == 0 and hi[-1] == len(whole) - 100 and (lo[1:] == hi[:-1] + 1).all()
    assert ((a >= lo) & (a <= hi + 68)).all() or ((a - hi >= 0) | (lo <= a)).all()
    later = {int(x) for x in h[lo > 4002 + 100]}
    assert len(later & {int(x) for x in h[hi < 4000]}) > 0


def test_radix_groups_are_the_repeated_windows():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"x" * 300
    starts = np.arange(len(data) - 20 + 1)
    at, group = suffix_dedup.radix_groups(data, starts, np.zeros(len(starts), np.int64), 20)
    got = {}
    for i, g in zip(at.tolist(), group.tolist()):
        got.setdefault(g, set()).add(i)
    want = {}
    for p in starts.tolist():
        want.setdefault(data[p : p + 20], set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_empty(spark):
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text_through_the_frame(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(110_000))  # over one piece of the scan
    assert len(long) > suffix_dedup.PIECE
    rows = [(3, long[400_000:400_900] + " new end"), (1, long + " and again " + long[523_000:526_000]), (2, "start " + long[-300:])]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0], r[1], r[2], len(r[3]), r[4]) for r in got), key=str) == brute(rows, 100)


def test_one_hot_passage_in_many_texts(spark):
    """A passage and a common phrase that most texts share: each byte is removed once, with any size of a group."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    passage, phrase = " ".join(word() for _ in range(45)), "a phrase of fifty bytes that stands in most texts here"
    rows = [(i, " ".join([*(word() for _ in range(20)), phrase, *(word() for _ in range(20)), passage if i % 3 else "", word()])) for i in range(240)]
    for crowd in (20_000, 5):
        got = suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
        assert sorted(((r[0], r[1], r[2], len(r[3]), r[4]) for r in got), key=str) == brute(rows, 100)
