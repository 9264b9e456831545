import zlib

import numpy as np
from lexweave.llm import bradley_terry as bt
from lexweave.llm.queries import op5_bradley_terry


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    scored = {r["doc_id"]: r for r in op5_bradley_terry(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [r for r in labels if scored[r["doc_id"]]["held_out"]]
    right = [scored[r["doc_id"]]["predicted"] == r["quality"] for r in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    for d, r in scored.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_pairs_order_the_scores():
    rng = np.random.default_rng(0)
    better, worse = rng.normal(0.5, 1, (300, len(bt.NAMES))), rng.normal(-0.5, 1, (200, len(bt.NAMES)))
    model = bt.fit(better, worse)
    scores = lambda x: (x - model["mean"]) / model["scale"] @ model["weights"]
    assert (scores(better)[:, None] > scores(worse)[None, :]).mean() > 0.9
    assert abs((scores(np.concatenate((better, worse))) < model["threshold"]).mean() - 0.4) < 0.01


def test_held_out_labels_are_never_read(spark):
    texts = ["the good word of it and more", "BAD!! BAD!! ### $$$"]
    docs = spark.createDataFrame([(i, texts[i % 2] * (1 + i % 5)) for i in range(60)], "doc_id long, text string")
    own = lambda flip: spark.createDataFrame([(i, (1 - i % 2) if zlib.crc32(str(i).encode()) % 3 != 1 else (1 - i % 2) ^ flip) for i in range(60)], "doc_id long, quality int")
    a, b = bt.learn(docs, own(0)), bt.learn(docs, own(1))
    assert (a["weights"] == b["weights"]).all() and a["threshold"] == b["threshold"]


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "w " * 90000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 7)], "doc_id long, quality int")
    rows = bt.score(docs, bt.learn(docs, labels)).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 for r in rows) and [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert bt.score(docs.limit(0), bt.learn(docs, labels.limit(0))).count() == 0


def test_fit_is_the_minimum_over_all_pairs():
    """Against plain descent on the loss, pair by pair."""
    rng = np.random.default_rng(3)
    width = len(bt.NAMES)
    better, worse = rng.normal(0.4, 1, (14, width)), rng.normal(-0.2, 2, (9, width))
    model = bt.fit(better, worse, ridge=0.05)
    both = np.concatenate((better, worse))
    pairs = [(a - b) / both.std(axis=0) for a in better for b in worse]

    def loss(w):
        return sum(np.log1p(np.exp(-(x @ w))) for x in pairs) / len(pairs) + 0.05 * (w @ w) / 2

    w = np.zeros(width)
    for _ in range(4000):
        gradient = 0.05 * w
        for x in pairs:
            gradient = gradient - x / (1 + np.exp(x @ w)) / len(pairs)
        w = w - 0.2 * gradient
    assert np.allclose(w, model["weights"], atol=1e-4)
    assert all(loss(np.asarray(model["weights"])) <= loss(np.asarray(model["weights"]) + d) for d in rng.normal(0, 0.01, (50, width)))


def test_whole_result_from_labels_and_texts(spark, sf):
    """Every row of the query, computed again one by one."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    x = {d: np.array(bt.features(t.encode())) for d, t in docs.items()}
    by = {y: np.array([x[d] for d in docs if known.get(d) == y]) for y in (0, 1)}
    both = np.concatenate((by[1], by[0]))
    model = bt.fit(np.array(sorted(map(tuple, by[1]))), np.array(sorted(map(tuple, by[0]))))
    for r in op5_bradley_terry(spark, sf).collect():
        z = ((x[r["doc_id"]] - both.mean(axis=0)) / model["scale"]) @ model["weights"] - model["threshold"]
        want = 1 / (1 + np.exp(-np.clip(z / model["spread"], -30, 30)))
        assert abs(r["score"] - want) < 0.02 and r["predicted"] == (r["score"] >= 0.5)


def _all_pairs(better, worse, ridge=1e-3):
    """Newton steps over every pair, listed; then the threshold by sorting."""
    both = np.concatenate((better, worse))
    scale = both.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = ((better[:, None, :] - worse[None, :, :]) / scale).reshape(-1, len(bt.NAMES))
    w = np.zeros(len(bt.NAMES))
    for _ in range(25):
        lost = 1 / (1 + np.exp(x @ w))
        w = w - np.linalg.solve((x * (lost * (1 - lost))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), ridge * w - (x * lost[:, None]).mean(axis=0))
    scores = np.sort((both - both.mean(axis=0)) / scale @ w)
    return w, scores[len(worse) - 1 : len(worse) + 1].mean(), scores.std() / 4


def _drawn(n_better, n_worse):
    """Random texts whose classes overlap, with labels, and the features of each class that may be learned from."""
    rng = np.random.default_rng(5)
    words = np.array(["the", "of", "and", "tree", "Stone", "RIVER", "go!!", "##", "42", "a,b", "line\n", "x."])
    ids = [i for i in range(3 * (n_better + n_worse)) if zlib.crc32(str(i).encode()) % 3 != 1][: n_better + n_worse]
    draw = lambda good: " ".join(rng.choice(words, rng.integers(3, 30), p=(lambda p: p / p.sum())(1 + rng.random(12) + good * np.linspace(0.5, 0, 12))))
    rows = [(d, draw(int(i < n_better)), int(i < n_better)) for i, d in enumerate(ids)]
    x = {y: np.array([bt.features(t.encode()) for _, t, q in rows if q == y]) for y in (0, 1)}
    return [r[:2] for r in rows], [(d, q) for d, _, q in rows], x[1], x[0]


def test_every_label_and_every_pair_is_learned_from(spark):
    docs, labels, better, worse = _drawn(30, 4300)
    model = bt.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    weights, threshold, spread = _all_pairs(better, worse)
    assert np.allclose(model["weights"], weights, atol=1e-7)
    assert abs(model["threshold"] - threshold) < 1e-7 and abs(model["spread"] - spread) < 1e-7


def test_parts_change_nothing(spark):
    docs, labels, better, worse = _drawn(170, 110)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    whole, parts = bt.fit(better, worse), bt.learn(*frames, chunk=40)
    assert all(np.allclose(whole[k], parts[k], rtol=1e-9, atol=1e-9) for k in whole)
    again = bt.learn(*frames, chunk=40)
    assert all(np.array_equal(again[k], parts[k]) for k in parts)


def test_fit_with_far_outliers_and_split_classes():
    """Scores over many boxes, and classes that one feature splits."""
    rng = np.random.default_rng(8)
    better, worse = rng.standard_cauchy((90, len(bt.NAMES))), rng.standard_cauchy((70, len(bt.NAMES)))
    better[:, 3], worse[:, 3] = 2 + rng.random(90), rng.random(70)
    better[:, 5] = worse[:, 5] = 0.7
    model = bt.fit(better, worse)
    weights, threshold, spread = _all_pairs(better, worse)
    assert np.allclose(model["weights"], weights, atol=1e-7)
    assert abs(model["threshold"] - threshold) < 1e-6 and abs(model["spread"] - spread) < 1e-7
