import random

from lexweave.llm import license_scan as ls


def lcs_in_band(words, template, shift, band):
    best = 0
    table = {}
    for q in range(len(template) - 1, -1, -1):
        for p in range(min(len(words) - 1, q + shift + band), max(0, q + shift - band) - 1, -1):
            skip = max(table.get((q + 1, p), 0) if abs(p - q - 1 - shift) <= band else 0, table.get((q, p + 1), 0))
            take = 1 + table.get((q + 1, p + 1), 0) if words[p] == template[q] else 0
            table[q, p] = max(skip, take)
            best = max(best, table[q, p])
    return best


def test_alignment_is_the_longest_common_sequence_in_the_band():
    rng = random.Random(1)
    for _ in range(150):
        template = [rng.choice(b"abcde".decode()).encode() for _ in range(rng.randint(1, 20))]
        words = [rng.choice("abcdef").encode() for _ in range(rng.randint(1, 40))]
        shift = rng.randint(-3, 30)
        n, first, end = ls.aligned(words, template, shift, 3)
        assert n == lcs_in_band(words, template, shift, 3)
        assert n == 0 or (words[first] in template and words[end - 1] in template and end - first >= n)


def test_finds_whole_changed_and_nested_notices(spark):
    apache = ls.TEMPLATES["Apache-2.0 header"]
    changed = apache.replace("obtain a copy", "get one copy").replace("Unless required", "Unless it is required")
    rows = [
        (1, "x " * 50 + "Released under the MIT License. and more", "c"),
        (2, apache, "c"),
        (3, f"Intro.\n{changed}\nLicensed under CC BY-NC 4.0.", "c"),
        (4, "the software is licensed under no such thing as a license", "c"),
        (5, None, "c"),
        (6, "", "c"),
        (None, "released   UNDER the\nMIT license", "c"),
        (1, "x " * 50 + "Released under the MIT License. and more", "c"),
        (7, "word " * 60000 + ls.TEMPLATES["GPL-3.0 notice"], "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = ls.scan(df).collect()
    found = sorted(((r["doc_id"], r["license"]) for r in got), key=str)
    assert found == sorted([(1, "MIT notice"), (1, "MIT notice"), (2, "Apache-2.0 header"), (3, "Apache-2.0 header"), (3, "CC-BY-NC-4.0 notice"), (None, "MIT notice"), (7, "GPL-3.0 notice")], key=str)
    for r in got:
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        assert text[r["start_char"] : r["end_char"]].lower().startswith(("licensed", "released", "this")) and 0.8 <= r["coverage"] <= 1
        assert r["matched_words"] <= r["template_words"]
    assert ls.scan(df.limit(0)).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = tuple(t for n, t in ls.TEMPLATES.items() if n.endswith("notice"))
    planted = {r["doc_id"] for r in docs.collect() if any(x in (r["text"] or "") for x in lines)}
    assert {r["doc_id"] for r in ls.scan(docs).collect()} == planted


def test_one_change_anywhere_is_found():
    index = ls.Index(ls.TEMPLATES)
    for of, name in enumerate(index.names):
        words = [w.decode() for w in index.words[of]]
        for i in range(len(words)):
            for put in (["zzz"], [], ["zzz", "yyy"]):
                text = " ".join(["intro", *words[:i], *put, *words[i + 1 :], "end"])
                assert any(n == name and k == len(words) - 1 for n, _, k, *_ in index.scan(text)), text
    assert [r[0] for r in index.scan("Released under an MIT License.")] == ["MIT notice"]


def test_every_covered_text_is_found():
    rng = random.Random(4)
    for size in (1, 2, 3, 5, 9, 14, 30, 70):
        words = [rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(size)) for _ in range(size)]
        index = ls.Index({"t": " ".join(words)})
        for _ in range(60):
            changed = list(words)
            for i in rng.sample(range(size), size - index.least[0]):
                changed[i] = "zzz"
            for i in sorted(rng.sample(range(1, size), min(size - 1, 2 * ls.BAND)), reverse=True):
                changed.insert(i, "yyy")
            text = " ".join(["x"] * rng.randrange(9) + changed)
            assert [r[0] for r in index.scan(text)] == ["t"], (size, text)
    assert ls.Index({"e": "", "one": "MIT"}).scan("MIT")[0][:3] == ("one", 1.0, 1)


def test_recall_of_each_template():
    """Random changes, drops and additions that leave the coverage and the band: all must be found with the words a brute-force alignment counts."""
    rng = random.Random(7)
    index = ls.Index(ls.TEMPLATES)
    for of, name in enumerate(index.names):
        words = [w.decode() for w in index.words[of]]
        found = 0
        for _ in range(25):
            changed = list(words)
            for i in rng.sample(range(len(words)), rng.randint(0, len(words) - index.least[of])):
                changed[i] = "zzz"
            text = " ".join([f"w{rng.randrange(99)}" for _ in range(rng.randrange(200))] + changed)
            reports = [r for r in index.scan(text) if r[0] == name]
            want = sum(a == b for a, b in zip(changed, words))
            found += bool(reports) and max(r[2] for r in reports) >= want
        assert found == 25, (name, found)
