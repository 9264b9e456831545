import hashlib
import re

import corpus_pipeline
from lexweave.llm import decontaminate, pii, simhash
from lexweave.llm.queries import model_path
from pyspark.sql import functions as F

from test_quality_rules import brute as counts  # noqa: I001


def test_stages_against_brute_force(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    good = stage[names[0]](spark, docs, sf).cache()
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    for r in docs.collect():
        n = counts(r["text"])
        assert r["doc_id"] not in kept or not (n[0] < 50 or 100 * n[4] > 50 * n[0])

    single = stage[names[1]](spark, good, sf).cache()
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t in kept.items()}
    left = set(prints)
    want = set()
    while left:
        first = min(left)
        group, todo = {first}, [first]
        while todo:
            x = todo.pop()
            near = {y for y in left - group if (prints[x] ^ prints[y]).bit_count() <= 4}
            group |= near
            todo += near
        left -= group
        want.add(first)
    assert {r["doc_id"] for r in single.collect()} == want

    clean = stage[names[2]](spark, single, sf).cache()
    bench = {r["item_id"]: decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    windows = {tuple(w[i : i + 10]) for w in bench.values() for i in range(len(w) - 9)}
    leaks = {d for d in want if any(tuple(w[i : i + 10]) in windows for w in [decontaminate.words_of(kept[d].encode())] for i in range(len(w)))}
    assert {r["doc_id"] for r in clean.collect()} == want - leaks

    hidden = {r["doc_id"]: r for r in stage[names[3]](spark, clean, sf).collect()}
    assert set(hidden) == want - leaks
    for d, r in hidden.items():
        for secret in re.findall(r"[\w.]+@[\w.]+\w|\d+\.\d+\.\d+\.\d+|\b\d{16}\b|\b[0-9a-f]{40}\b|\(\d{3}\) \d{3}-\d{4}", kept[d]):
            assert secret not in r["text"]
        assert r["n_chars"] == len(r["text"])

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    tokens = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(tokens) == set(hidden)
    for d, r in tokens.items():
        ids = sp.encode(hidden[d]["text"], add_eos=True)
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_odd_tables(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    rows = [(None, None, None, None, None, 1), (5, "the word of it " * 40, "en", "s", 3, 2), (5, "the word of it " * 40, "en", "s", 3, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    one = spark.createDataFrame([(None, "the first of all and some of it", None, None, None), (None, "the first of all and some of it", None, None, None), (7, "The first of all and some of it", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        got = stage(spark, odd, sf)
        assert got.count() <= 3
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(got.columns) == corpus_pipeline.COLUMNS
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, one, sf).collect()] == [7]
    assert corpus_pipeline.drop_near_copies(spark, one.where(F.col("doc_id").isNull()), sf).count() == 1
    assert pii.replace(one).count() == 3
