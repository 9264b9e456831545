"""Batches and compaction of the store, counted CSV imports, postings, fetch reports and the merge of sources."""

import json

import pytest
from lexweave.operators import rank as R
from lexweave.operators import store as S
from lexweave.operators.concepts import build_concepts
from lexweave.sources import dictionary as D
from lexweave.sources import expansion, lexicon_csv, specs
from lexweave.sources.seed import seed_lexicon
from pyspark.sql import functions as F


def words(spark, *rows):
    return spark.createDataFrame(rows, "id string, word string, ingest_seq long")


def test_batches_fold_like_one_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT", 3)
    store = S.Store(spark, str(tmp_path / "store"))
    want = {}
    for k in range(8):
        batch = [(f"w{(k + j) % 6}", f"{k}.{j}", j) for j in range(4)] + [("w0", f"{k}.last", 9)]
        store.insert_words(words(spark, *batch))
        want |= {i: w for i, w, _ in batch}
        assert {r["id"]: r["word"] for r in store.words().collect()} == want
    bases = {b for b, _ in store._written("words")}
    assert max(bases) >= 2 and len(bases) <= 2


def test_edges_keep_the_first_write_over_batches(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    for weight in (0.5, 0.9):
        store.insert_edges(spark.createDataFrame([("a", "r", "b", weight, 1)], "src string, rel string, dst string, weight double, ingest_seq long"))
    assert [r["weight"] for r in store.edges().collect()] == [0.5]


def test_a_batch_that_was_not_written_whole_does_not_count(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    store.insert_words(words(spark, ("a", "1", 1)))
    (tmp_path / "store" / "words-0-1").mkdir()
    assert [r["word"] for r in store.words().collect()] == ["1"]
    store.insert_words(words(spark, ("a", "2", 1)))
    assert [r["word"] for r in store.words().collect()] == ["2"]


def test_old_tables_get_the_new_columns(spark, tmp_path):
    old = [f for f in ("id", "word", "word_class", "language", "system", "tags", "source")]
    spark.createDataFrame([("la_a", "a", "noun", "la", "s", "t", "x", 1.5)], ", ".join(f"{c} string" for c in old) + ", seed_weight double").write.parquet(str(tmp_path / "store" / "words-0-0"))
    row = S.Store(spark, str(tmp_path / "store")).words().first()
    assert (row["id"], row["seed_weight"], row["etymology"], row["translit"], row["registers"]) == ("la_a", 1.5, None, None, None)


def test_import_counts_in_its_own_read(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("word,language,class,system,tags,w,src\na,la,noun,s,t,1,x\na,la,odd,s,t,2,x\nb,,strange,s,t,,x\nc,,,s,t,,x\n")
    store = S.Store(spark, str(tmp_path / "store"))
    assert lexicon_csv.import_file(store, str(path)) == {"imported": 4, "unknown_class": 2}
    assert {r["id"]: r["seed_weight"] for r in store.words().collect()} == {"la_a": 2.0, "b": 1.0, "c": 1.0}


def test_stored_postings_rank_alike(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    assert store.postings() is None
    store.bootstrap()
    store.index_words()
    lex = store.words()
    scores = lambda index: [(r["id"], round(r["score"], 6)) for r in R.ordered(R.rank_semantic(lex, "sky thunder king", lex, index=index)).collect()]
    assert scores(store.postings()) == scores(None) and len(scores(None)) == 3
    store.insert_words(words(spark, ("la_zeus", "Zeus", 1)))
    assert store.postings() is None


def test_fetch_reports_edges_and_bytes(spark, tmp_path):
    lines = [json.dumps({"word": w, "pos": "noun", "senses": [{"glosses": ["g"]}], "synonyms": [{"word": "syn"}, {"word": "ßyn"}]}, ensure_ascii=False) for w in ("aa", "bb", "cc")]
    (tmp_path / "a.jsonl").write_text("\n".join([lines[0], "{broken", *lines[1:]]) + "\n")
    (tmp_path / "m.json").write_text(json.dumps([{"name": "Zeus", "description": "king"}, {"name": "two words"}]))
    some = [specs.SourceSpec("a", "wiktextract-jsonl", "", "de", "s", max_words=2), specs.SourceSpec("none", "wiktextract-jsonl", "", "de", "s"), specs.SourceSpec("m", "mythology-json", "", "grc", "m")]
    found, edges, report = D.fetch(spark, some, {"a": str(tmp_path / "a.jsonl"), "none": str(tmp_path / "missing"), "m": str(tmp_path / "m.json")})
    read = sum(len((x + "\n").encode()) for x in [lines[0], "{broken", lines[1]])
    assert [(r["source"], r["accepted"], r["skipped"], r["edges"]) for r in report] == [("a", 2, 1, 4), ("none", 0, 0, 0), ("m", 1, 1, 0)]
    assert report[0]["bytes"] == read and report[2]["bytes"] == (tmp_path / "m.json").stat().st_size and report[1]["error"]
    assert found.count() == 3 and edges.count() == 4 and D.totals(report) == {"inserted": 3, "edges": 4}


def test_merge_of_sources_is_in_their_order(spark):
    row = lambda word, weight: seed_lexicon(spark).limit(1).select(F.lit("x_w").alias("id"), F.lit(word).alias("word"), *[c for c in seed_lexicon(spark).columns if c not in ("id", "word")])
    parts = [row(w, 1.0).withColumns({"k": F.lit(k), "seq": F.lit(s).cast("long")}) for k, (w, s) in enumerate([("first", 9), ("second", 0)])]
    from lexweave.schema import LEXICON

    assert [r["word"] for r in D.merge(spark, parts, LEXICON).collect()] == ["second"]
    assert D.merge(spark, [], LEXICON).count() == 0


def test_expansion_asks_for_the_whole_and_its_first_tokens(spark, tmp_path):
    class Service:
        asked = []

        def means_like(self, query, most):
            self.asked.append((query, most))
            return json.dumps([{"word": w, "score": 1} for w in ("Grove", "two words", "timber", "grove")])

        def triggered_by(self, token, most):
            self.asked.append((token, most))
            if token == "tree":
                raise OSError("no answer")
            return json.dumps([{"word": w, "score": 1} for w in ("TIMBER", f"{token}y", *"abcdefgh")])

    spec = specs.ExpansionSpec("datamuse-ml", "", 4)
    got = expansion.expand(spark, Service(), spec, "the forest tree sky king")
    assert Service.asked == [("the forest tree sky king", 4), ("forest", 5), ("tree", 5), ("sky", 5)]
    assert got == ("Grove", "timber", "foresty", "a", "b", "c", "skyy")
    folder = expansion.Folder(str(tmp_path))
    with pytest.raises(OSError):
        expansion.expand(spark, folder, spec, "forest")
    (tmp_path / "ml").mkdir()
    (tmp_path / "ml" / "forest.json").write_text('[{"word": "woodland", "score": 2}]')
    assert expansion.expand(spark, folder, spec, "forest") == ("woodland",)
    concepts = build_concepts(spark, "forest", None, expansion.expand(spark, folder, spec, "forest"))
    assert [(c.term, c.kind) for c in concepts] == [("forest", "token"), ("woodland", "online")]


def test_fetch_of_a_folder_goes_by_the_names_of_its_files(spark, tmp_path):
    line = lambda word, gloss, n=1: json.dumps({"word": word, "pos": "noun", "senses": [{"glosses": [gloss]}], "synonyms": [{"word": "syn"}], "pad": "x" * n}) + "\n"
    (tmp_path / "d").mkdir()
    # a scan takes the larger file first
    (tmp_path / "d" / "part-0").write_text(line("aa", "old") + line("bb", "old"))
    (tmp_path / "d" / "part-1").write_text(line("aa", "new", 9999) + line("cc", "new"))
    fetched = lambda most: D.fetch(spark, [specs.SourceSpec("a", "wiktextract-jsonl", "", "de", "s", max_words=most)], {"a": str(tmp_path / "d")})
    found, _, report = fetched(9)
    assert {r["word"]: r["tags"] for r in found.collect()} == {"aa": "new", "bb": "old", "cc": "new"} and report[0]["accepted"] == 4
    assert {r["word"]: r["tags"] for r in fetched(2)[0].collect()} == {"aa": "old", "bb": "old"}


def test_lines_of_the_fetch_query_lie_in_several_ordered_files(spark, tmp_path, monkeypatch):
    from lexweave.plans import core_queries
    from lexweave.plans.queries import QUERIES, json_lines

    sf = "/root/testdata/sf0.001"
    kept = []
    monkeypatch.setattr(core_queries.dictionary, "fetch", lambda spark, some, paths: kept.append(paths["lines"]) or (None, None, [{"source": "lines", "accepted": 0, "skipped": 0, "edges": 0, "error": None}]))
    monkeypatch.setattr(core_queries, "FILE_BYTES", 32 << 10, raising=False)
    QUERIES["ag_fetch_report"](spark, sf)
    got = D.read_lines(spark, kept[0]).orderBy("ordinal").collect()
    assert len({r["ordinal"]["file_path"] for r in got}) > 4
    assert [r["value"] for r in got] == [r["value"] for r in json_lines(spark, sf).orderBy("ordinal").collect()]
