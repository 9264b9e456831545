import random
import re

from lexweave.llm.quality_rules import Rule, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_counts_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b", "the", "é😀", "x#", "|", "\n", "\n\n", "\t", "  ", "\x0b", " ", "of and in"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += [None, "", " \n ", "w " * 30000, " ".join(map(str, range(20000)))]
    rows = [(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)] + [(1, texts[1], "clash")] * 2
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_threshold_table_is_the_verdict(spark):
    df = spark.createDataFrame([(1, "the word " * 2 + " ".join(f"of{i}" for i in range(60)))], "doc_id long, text string")
    assert quality_rules(df, rules=()).first()["kept"]
    assert not quality_rules(df, rules=(Rule("x", "n_words", most=10.0),)).first()["kept"]


def test_keeps_good_and_rejects_bad(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    joined = quality_rules(docs).join(labels, "doc_id").where("not base_failed")
    assert joined.where("quality = 1 and not kept").count() == 0
    assert joined.where("quality = 0 and kept").count() == 0


def test_plan_has_no_shuffle_or_python(spark, sf):
    plan = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
