"""Ranking against published expectations."""

import pytest
from lexweave.operators import rank as R
from lexweave.operators.concepts import build_concepts, edge_source_terms, query_tokens
from lexweave.schema import EDGES, LEXICON
from lexweave.sources.seed import seed_lexicon


@pytest.fixture(scope="module")
def seed(spark):
    return seed_lexicon(spark).cache()


def scores(df, k=99):
    return [(r["id"], round(r["score"], 6)) for r in R.top_k(df, k).collect()]


def lexicon(spark, *rows):
    full = [{f: r.get(f) for f in LEXICON.fieldNames()} | {"seed_weight": r.get("seed_weight", 1.0), "id": r.get("id") or f"{r['language']}_{r['word']}" if r.get("language") else r["word"]} for r in rows]
    return spark.createDataFrame([tuple(r[f] for f in LEXICON.fieldNames()) for r in full], LEXICON)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "test") for r in rows], EDGES)


def test_seed_profile(seed):
    assert seed.count() == 77 and seed.select("id").distinct().count() == 77
    assert {r["language"]: r["count"] for r in seed.groupBy("language").count().collect()} == {"en": 36, "la": 23, "de": 18}
    df = {r["token"]: r["df"] for r in R.document_frequency(seed).collect()}
    assert len(df) == 114 and df["fire"] == 6 and df["light"] == 5 and df["tree"] == 3


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("sky thunder king", [("la_zeus", 27.954209), ("la_uranos", 7.947002), ("la_atlas", 7.284751)]),
        ("Werkzeug für Wald und Baum", [("la_silvan", 11.014270), ("en_oak", 3.565962)]),
        ("forest tree", [("la_silvan", 13.877528), ("de_wald", 10.675022), ("en_oak", 5.094232)]),
        ("Wasser Licht", [("la_helios", 4.893515), ("la_aureus", 4.635751), ("en_Radiance", 4.488797), ("en_luminous", 4.136869), ("de_Strahlend", 3.565962), ("en_Dawn", 3.136869), ("en_radiant", 3.136869)]),
        ("Baum", []),
        ("xyzzy quux", []),
    ],
)
def test_seed_goldens(seed, query, want):
    assert scores(R.rank(seed, query)) == want


def test_filters_keep_the_bridge(seed):
    nature = seed.where("system = 'nature'")
    assert scores(R.rank_semantic(nature, "forest tree", seed)) == [("la_silvan", 11.3271), ("de_wald", 8.713154), ("en_oak", 4.113298)]
    assert scores(R.find(seed, "forest tree", 9, systems=["myth_greek"])) == []
    assert scores(R.rank(seed, "light"), 5)[0] == ("la_helios", 6.990736)
    assert [i for i, s in scores(R.rank(seed, "light"), 5)[1:]] == ["en_Dawn", "de_licht", "en_luminous", "en_radiant"]


def test_echo(seed):
    assert scores(R.rank_semantic(seed, "wald", seed, allow_echo=True), 3) == [("de_wald", 13.472515), ("la_silvan", 11.014270), ("en_oak", 3.565962)]
    assert scores(R.rank(seed, "wald"), 3) == [("la_silvan", 11.014270), ("en_oak", 3.565962)]


def test_concepts_in_order(spark, seed):
    got = [(c.term, c.weight, c.via) for c in build_concepts(spark, "Werkzeug für Wald und Baum", seed)]
    assert got == [("werkzeug", 1.0, None), ("wald", 1.0, None), ("baum", 1.0, None), ("forest", 0.7, "wald"), ("tree", 0.7, "wald")]
    assert edge_source_terms(spark, "wald", seed) == ["wald", "forest", "tree"]


def test_caps_are_a_fold_not_a_window(spark):
    e = edges(spark, *[("aaa", "synonym", f"x0{i}x", 0.8) for i in range(8)], ("bbb", "synonym", "x07x", 0.8))
    got = [(c.term, c.via) for c in build_concepts(spark, "aaa bbb", None, edges=e) if c.kind == "assoc"]
    assert got == [(f"x0{i}x", "aaa") for i in range(6)] + [("x07x", "bbb")]


def test_bridge_and_paths(spark):
    words = lexicon(spark, {"word": "Baum", "language": "de", "tags": "tree"}, {"word": "arbor", "language": "la", "tags": "a tree,a mast"})
    [hit] = R.ordered(R.rank(words, "Baum")).collect()
    assert hit["id"] == "la_arbor" and round(hit["score"], 6) == 1.092 and list(hit["matched"]) == ["baum → tree (bruecke)"]


def test_edge_hop(spark):
    words = lexicon(spark, {"word": "Zeichen", "language": "de", "tags": "mark"})
    e = edges(spark, ("track", "verwandt", "zeichen", 0.6))
    assert scores(R.rank_semantic(words, "track", words)) == []
    [hit] = R.rank_semantic(words, "track", words, edges=e).collect()
    assert round(hit["score"], 6) == 2.4 and list(hit["matched"]) == ["track → zeichen (verwandt)"]


def test_factors_and_near_echo(spark):
    words = lexicon(spark, {"word": "Baum", "language": "de", "tags": "tree"}, {"word": "Apfelbaum", "language": "de", "tags": "tree"}, {"word": "arbor", "language": "en", "tags": "tree"})
    assert scores(R.rank(words, "Baum")) == [("en_arbor", 0.84), ("de_Apfelbaum", 0.252)]
    poetic = lexicon(spark, {"word": "a1", "language": "en", "tags": "light", "registers": "poetic"}, {"word": "b1", "language": "en", "tags": "light"})
    assert [s for _, s in scores(R.rank(poetic, "light"))] == [1.38, 1.2]
    origin = lexicon(spark, {"word": "a1", "language": "en", "tags": "forest"}, {"word": "b1", "language": "la", "tags": "forest"})
    assert scores(R.rank(origin, "forest")) == [("la_b1", 1.56), ("en_a1", 1.2)]
    weight = lexicon(spark, {"word": "a1", "language": "en", "tags": "test", "system": "test"}, {"word": "b1", "language": "en", "tags": "test", "system": "test", "seed_weight": 2.0})
    assert scores(R.rank(weight, "test")) == [("en_b1", 6.4), ("en_a1", 3.2)]


def test_precedence_candidates_and_echo_flag(spark):
    words = lexicon(spark, {"word": "zenith", "tags": "top", "system": "x"}, {"word": "peak", "tags": "zenith"}, {"word": "summit", "tags": "height", "etymology": "from zenith"})
    assert scores(R.rank(words, "zenith")) == [("peak", 2.518417), ("summit", 1.0)] or [i for i, _ in scores(R.rank(words, "zenith"))] == ["peak", "summit"]
    some = lexicon(spark, {"word": "zeus", "language": "grc", "tags": "sky"}, {"word": "forest", "language": "en", "tags": "wood"})
    [hit] = R.rank(some, "trees", ("forest", "woodland")).collect()
    assert round(hit["score"], 6) == 2.4 and list(hit["matched"]) == ["forest (semantisch)"]
    one = lexicon(spark, {"word": "zenith", "tags": None})
    assert R.rank(one, "zenith").count() == 0 and R.rank_semantic(one, "zenith", one, allow_echo=True).count() == 1


def test_suggest(spark, seed):
    words = lambda q, n: [r["word"] for r in R.suggest(seed, q, n).collect()]
    assert words("forrge", 5) == ["forge", "forgeheart"] and words("zeuss", 10) == ["zeus"] and words("xyzzy quux", 5) == []
    row = R.no_hit(seed, "wald", ("x",)).first()
    assert row["n_echoes"] == 1 and row["n_candidates"] == 1


def test_suggest_over_the_whole_lexicon(spark, tmp_path):
    from lexweave.plans.queries import QUERIES

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    words = ["théon", "thèön", "erêti", "éréti", "theäter", "theorie", "ereti", "über", "été", "thëöñ", "plain"]
    spark.createDataFrame([(i, w, "fr", "s") for i, w in enumerate(words)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(w for w in words if any(w.startswith(t[:3]) or distance(w, t) <= 2 for t in ("theon", "ereti")))
    assert [r["word"] for r in QUERIES["rt_suggest_all"](spark, str(tmp_path)).collect()] == want and "théon" in want


def test_tokens(spark):
    assert query_tokens(spark, "Eine CLI für die Synchronisation von Logs") == ["cli", "synchronisation", "logs"]


def test_order_of_input_does_not_matter(spark):
    rows = [{"word": w, "language": "en", "tags": "letter"} for w in ("alpha", "beta")]
    assert scores(R.rank(lexicon(spark, *rows), "letter")) == scores(R.rank(lexicon(spark, *rows[::-1]), "letter"))


def test_explanation(spark):
    words = lexicon(spark, {"word": "sophía", "language": "la", "tags": "wisdom", "etymology": "root", "origin_lang": "grc", "system": "s"})
    text = R.explained(R.rank(words, "wisdom")).first()["explanation"]
    assert text == "sophía — root (grc) · System: s · Spur: wisdom (glosse)"
