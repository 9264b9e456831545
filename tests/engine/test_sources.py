import gzip
import json

import pytest
from lexweave.functions import text as T
from lexweave.operators.store import Store, import_report, insert_edges, upsert_words
from lexweave.sources import dictionary as D
from lexweave.sources import lexicon_csv, specs
from pyspark.sql import functions as F

SPEC = specs.SourceSpec("test", "wiktextract-jsonl", "", "de", "sys")


def parsed(spark, *entries, spec=SPEC):
    rows = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)]
    return D.parse_lines(spark.createDataFrame(rows, "ordinal long, value string"), spec).orderBy("ordinal").collect()


def entry(**more):
    return {"word": "Test", "pos": "noun", "senses": [{"glosses": ["a gloss"]}]} | more


def test_accepts_and_maps(spark):
    [r] = parsed(spark, entry(senses=[{"glosses": ["A trial, or  examination"]}, {"glosses": ["Evidence"]}, {"glosses": ["third"]}], etymology_text="From\n Latin "))
    assert (r["id"], r["word_class"], r["tags"], r["etymology"]) == ("de_Test", "noun", "a trial or examination,evidence", "from latin")
    assert r["accepted"] and r["translit"] is None


def test_rejects(spark):
    bad = [entry(pos="verb"), entry(word="two words"), {"pos": "noun"}, entry(word="x"), entry(word="x" * 31), entry(senses=[]), entry(word=3), "{broken", entry(senses=[{"glosses": ["a surname"]}]), entry(senses=[{"form_of": None, "glosses": ["x"]}]), entry(senses=[{"tags": ["alt-of"], "glosses": ["x"]}])]
    rows = parsed(spark, *bad)
    assert not any(r["accepted"] for r in rows) and [r["valid"] for r in rows].count(False) == 1
    good = parsed(spark, entry(pos="name"), entry(pos=None), entry(pos=5), entry(senses=[{"tags": ["form-of"], "glosses": ["no"]}, {"glosses": ["forest woodland"]}]))
    assert [r["accepted"] for r in good] == [True] * 4 and [r["word_class"] for r in good] == ["proper", None, None, "noun"] and good[3]["tags"] == "forest woodland"
    skip = specs.SourceSpec("t", "wiktextract-jsonl", "", "de", "s", skip_classes=("proper",))
    assert [r["accepted"] for r in parsed(spark, entry(pos="name"), entry(), spec=skip)] == [False, True]
    assert parsed(spark, "", "  ") == []


def test_edges_registers_and_romanization(spark):
    [r] = parsed(
        spark,
        entry(
            word="Spur",
            synonyms=[{"word": "Fährte"}, {"word": "zwei Worte"}, {"word": "spur"}, {"word": 3}],
            forms=[{"form": " ", "tags": ["romanization"]}, {"form": "spuur", "tags": ["x", "romanization"]}],
            senses=[
                {"form_of": [], "glosses": ["skip"], "related": [{"word": "Weg"}], "tags": ["archaic"]},
                {"glosses": ["one"], "tags": ["figuratively", "poetic"], "synonyms": [{"word": "Zeichen"}, {"word": "Fährte"}]},
            ],
        ),
    )
    assert [(e["rel"], e["dst"], e["weight"]) for e in r["edges"]] == [("synonym", "fährte", 0.8), ("synonym", "zeichen", 0.8), ("verwandt", "weg", 0.6)]
    assert r["registers"] == "figurative,poetic" and r["translit"] == "spuur"
    [many] = parsed(spark, entry(derived=[{"word": f"w{i}"} for i in range(20)]))
    assert len(many["edges"]) == 12


def test_stops_at_the_limit(spark, tmp_path):
    path = str(tmp_path / "d.jsonl.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join([json.dumps(entry(word=w)) for w in ("aa", "bb")] + ["{broken"] + [json.dumps(entry(word="cc"))]))
    all_lines = D.parse_lines(D.read_lines(spark, path), SPEC)
    assert [r["word"] for r in D.words_of(D.take_accepted(all_lines, 2)).orderBy("ordinal").collect()] == ["aa", "bb"]
    assert D.take_accepted(all_lines, 0).count() == 1 and D.take_accepted(all_lines, 3).count() == 4 and D.take_accepted(all_lines, 9).count() == 4


def test_mythology(spark):
    spec = specs.SourceSpec("myth-greek", "mythology-json", "", "grc", "myth_greek")
    body = json.dumps([{"name": "Zeus", "category": "Major, god", "description": "King of  the Sky", "greekName": "Ζεύς", "romanName": "Jupiter"}, {"name": "two words"}, {"name": "Hera", "description": "queen"}])
    rows = D.parse_mythology(spark.createDataFrame([(body,)], "value string"), spec).orderBy("ordinal").collect()
    assert [r["accepted"] for r in rows] == [True, False, True]
    assert (rows[0]["tags"], rows[0]["etymology"], rows[0]["seed_weight"], rows[0]["id"]) == ("major god,king of the sky", "griech. Ζεύς, roem. Jupiter", 1.1, "grc_Zeus")
    with pytest.raises(Exception, match="(?i)json|variant|cast"):
        D.parse_mythology(spark.createDataFrame([("{",)], "value string"), spec).collect()


def test_fetch_isolates_a_bad_source(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text("\n".join(json.dumps(entry(word=w, synonyms=[{"word": "syn"}])) for w in ("aa", "bb", "aa")))
    more = [specs.SourceSpec(i, "wiktextract-jsonl", "", "de", "s", max_words=10) for i in ("good", "bad")]
    words, edges, report = D.fetch(spark, more, {"good": str(good), "bad": str(tmp_path / "missing")})
    assert words.count() == 2 and edges.count() == 2
    assert [(r["source"], r["accepted"], r["error"] is None) for r in report] == [("good", 3, True), ("bad", 0, False)]


def test_expansion(spark):
    df = spark.createDataFrame([(json.dumps([{"word": "a b", "score": 1}, {"word": "c"}, {"word": "d"}]),)], "body string")
    get = lambda n: list(df.select(D.expansion_words(F.col("body"), n)).first()[0])
    assert get(5) == ["c", "d"] and get(1) == ["c"]
    assert list(df.select(D.merge_candidates(F.array(F.array(F.lit("Tree"), F.lit("b")), F.array(F.lit("tree"), F.lit("c"))))).first()[0]) == ["Tree", "b", "c"]


def test_expansion_over_every_row(spark, tmp_path):
    from lexweave.plans.queries import QUERIES

    texts = ["a b", None, " ".join(["x\ny"] * 9 + ["in", "out"]), " ".join(map(str, range(30)))]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["words"] for r in QUERIES["sc_expansion_all"](spark, str(tmp_path)).collect()}
    assert got == {0: ["a", "b"], 1: None, 2: ["in"], 3: list("01234")}


def test_csv(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('word,language,class,system,tags,w,src\n a ,la,noun, ,"x,""y""",nope,s\nb,,odd,,,2.5,\n')
    rows = {r["word"]: r for r in lexicon_csv.read(spark, str(path)).collect()}
    assert (rows["a"]["id"], rows["a"]["system"], rows["a"]["tags"], rows["a"]["seed_weight"]) == ("la_a", None, 'x,"y"', 1.0)
    assert (rows["b"]["id"], rows["b"]["language"], rows["b"]["seed_weight"], rows["b"]["registers"]) == ("b", None, 2.5, None)
    report = import_report(lexicon_csv.read(spark, str(path))).first()
    assert (report["imported"], report["unknown_class"]) == (2, 1)
    path.write_text("word,language,class,system,tags,w,src\na,b\n")
    with pytest.raises(Exception):
        lexicon_csv.read(spark, str(path)).collect()


def test_upserts(spark):
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "id string, word string, ingest_seq long")
    old = spark.createDataFrame([("a", "0"), ("c", "9")], "id string, word string")
    assert {r["id"]: r["word"] for r in upsert_words(old, new).collect()} == {"a": "2", "b": "3", "c": "9"}
    e = spark.createDataFrame([("s", "r", "d", 0.5, 2), ("s", "r", "d", 0.1, 1)], "src string, rel string, dst string, weight double, ingest_seq long")
    assert [r["weight"] for r in insert_edges(None, e).collect()] == [0.1]
    assert [r["weight"] for r in insert_edges(insert_edges(None, e), e.withColumn("ingest_seq", F.lit(0))).collect()] == [0.1]


def test_store_bootstraps_and_migrates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.words().count() == 0
    assert store.bootstrap().count() == 77 and store.bootstrap().count() == 77
    store.insert_words(spark.createDataFrame([("la_zeus", "Zeus", 1)], "id string, word string, ingest_seq long"))
    assert store.words().count() == 77 and store.words().where("id = 'la_zeus'").first()["word"] == "Zeus"


def test_streamed_files_equal_a_batch(spark, tmp_path):
    from lexweave.streaming.ingest import ingest_stream

    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps(entry(word=f"w{i}", synonyms=[{"word": f"s{i}"}])) for i in range(6)]
    (folder / "a.jsonl").write_text("\n".join(lines[:4]))
    store = Store(spark, str(tmp_path / "store"))
    ingest_stream(spark, str(folder), store, SPEC, str(tmp_path / "cp")).awaitTermination()
    (folder / "b.jsonl").write_text("\n".join(lines[3:]))
    ingest_stream(spark, str(folder), store, SPEC, str(tmp_path / "cp")).awaitTermination()
    assert store.words().count() == 6 and store.edges().count() == 6


def test_specs_and_config(tmp_path):
    found = specs.built_in()
    assert len(found.sources) == 16 and found.sources[-1].max_words == 2000 and found.query_expansion.max_candidates == 10
    assert found.sources[4].url.endswith("/Ancient%20Greek/kaikki.org-dictionary-AncientGreek.jsonl") and found.sources[4].skip_classes == ("proper",)
    own = specs.parse_sources("sources:\n  - {id: a, backend: mythology-json, url: u, language: l, system: s}\n")
    assert own.sources[0].max_words == 500
    with pytest.raises(ValueError, match="wiktextract-jsonl"):
        specs.parse_sources("sources:\n  - {id: a, backend: nope, url: u, language: l, system: s}\n")
    assert specs.select(found.sources, ["kaikki-la", "zz"], 7)[1] == ["zz"] and specs.select(found.sources, ["kaikki-la"], 7)[0][0].max_words == 7
    assert specs.load_config(str(tmp_path / "none")).count == 1
    with pytest.raises(FileNotFoundError):
        specs.load_config(str(tmp_path / "none"), explicit=True)
    (tmp_path / "c.toml").write_text('[output]\nscript="both"\ncount=0\n[generator]\nfillword="von"\n')
    got = specs.load_config(str(tmp_path / "c.toml"))
    assert (got.script, got.count, got.generator.fillword, got.generator.separator) == ("both", 1, "von", " ")


def test_byte_truncation(spark):
    df = spark.createDataFrame([("äöü" * 40,), ("a" * 79 + "ß",), ("x",), ("😀" * 30,)], "s string")
    for r in df.select("s", T.truncate_bytes(F.col("s"), 80).alias("t")).collect():
        raw = r["s"].encode()[:80]
        assert r["t"] == raw.decode(errors="ignore")


def test_byte_truncation_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n",), (" a  b ",)], "s string")
    got = [tuple(r) for r in df.select(T.truncate_bytes(F.col("s"), 80), T.clean_etymology(F.col("s"))).collect()]
    assert got == [(None, None), ("", None), (" \n", None), (" a  b ", "a b")]


def test_entries_without_an_etymology_or_a_description_have_none(spark):
    assert [r["etymology"] for r in parsed(spark, entry(), entry(etymology_text=" "), entry(etymology_text="From X"))] == [None, None, "from x"]
    spec = specs.SourceSpec("myth-greek", "mythology-json", "", "grc", "myth_greek")
    body = json.dumps([{"name": "Zeus", "category": "god"}, {"name": "Hera"}])
    rows = D.parse_mythology(spark.createDataFrame([(body,)], "value string"), spec).orderBy("ordinal").collect()
    assert [(r["accepted"], r["tags"], r["etymology"]) for r in rows] == [(True, "god", None), (False, None, None)]


def test_etymology_of_blank_texts_equals_its_sql(spark, tmp_path):
    import duckdb
    from lexweave.plans import core_queries  # noqa: F401 registers more queries
    from lexweave.plans.queries import ORACLES, QUERIES

    texts = [None, "", " ", "\n\t", "A  b"]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    oracle = duckdb.connect()
    oracle.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["f_clean_etymology"](spark, str(tmp_path)).collect())
    assert got == sorted(oracle.sql(ORACLES["f_clean_etymology"]).fetchall())
