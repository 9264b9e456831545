import pytest
from lexweave.functions import render, text, translit
from lexweave.operators import namegen
from lexweave.schema import LEXICON
from lexweave.sources.specs import GeneratorConfig
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("word", "language", "want"),
    [("σοφία", "grc", "sophia"), ("λόγος", "grc", "logos"), ("ψυχή", "grc", "psyche"), ("βήτα", "el", "vita"), ("שלום", "he", "shlvm"), ("arbor", "la", None), ("Ψυχή", "grc", "psyche"), ("ж", "ru", "ж")],
)
def test_to_latin(spark, word, language, want):
    assert one(spark, translit.to_latin(F.lit(word), F.lit(language))) == want


def test_folding_and_forms(spark):
    assert [one(spark, translit.fold_diacritics(F.lit(w))) for w in ("lógos", "ἀκακία", "für", "abc")] == ["logos", "ακακια", "fur", "abc"]
    assert one(spark, translit.latin_form(F.lit("שלום"), F.lit(" shalom "), F.lit("he"))) == "shalom"
    both = render.display_word(F.lit("λόγος"), F.lit(None).cast("string"), F.lit("grc"), "both")
    assert one(spark, both) == "logos (λόγος)"
    assert [one(spark, translit.is_latin_script(F.lit(w))) for w in ("abc é ſ1", "ж", "", "ḥ")] == [True, False, True, False]


def test_terms(spark):
    m = lambda a, b: one(spark, text.terms_match(F.lit(a), F.lit(b)))
    assert m("logs", "log") and m("trees", "tree") and m("navigate", "navig") and not m("tree", "treetop") and not m("cat", "cats1")
    s = lambda a, b: one(spark, text.score_text(F.lit(a), F.lit(b), 2.0, 1.5))
    assert [s("a", "a"), s("abc", "abcd"), s("ab", "abc"), s("xabc", "abc")] == [2.0, 1.5, 0.0, 0.0]
    lev = lambda a, b: one(spark, F.levenshtein(F.lit(a), F.lit(b)))
    assert [lev("abc", "abc"), lev("", "abc"), lev("abc", "adc"), lev("abcd", "acd"), lev("kitten", "sitting")] == [0, 3, 1, 1, 3]


def test_rendering(spark):
    assert one(spark, render.meaning_of(F.lit(" a , ,bb,cccc"), 7)) == "a; bb" and one(spark, render.meaning_of(F.lit("abcdefgh"), 5)) == "abcd…"
    assert one(spark, render.meaning_of(F.lit(","), 7)) is None
    spur = F.array(*map(F.lit, ["a", "b", "a", "c", "d", "e"]))
    assert one(spark, render.spur_compact(spur, 4)) == "a · b · c · d · +1" and one(spark, render.spur_compact(spur, 9)) == "a · b · c · d · e"
    none = F.lit(None).cast("string")
    assert one(spark, render.explain(F.lit("w"), none, F.lit("la"), none, F.array(F.lit("x")))) == "w — (la) · Spur: x"
    assert one(spark, render.explain(F.lit("w"), none, none, none, F.array(F.lit("x"), F.lit("y")))) == "w — Spur: x, y"
    block = render.rich_block(F.lit("w"), none, F.lit("la"), F.lit("tree"), none, F.lit("poetic,dated"), F.lit("root"), F.lit("grc"), F.array(F.lit("x")), show_root=True)
    assert one(spark, block) == "w — tree  [la · ? · poetic · dated]\n  Spur..: x\n  Wurzel: root (grc)\n"


def words(spark, **pools):
    rows = [(f"{c}{i}", w, c) for c, some in pools.items() for i, w in enumerate(some)]
    df = spark.createDataFrame(rows, "id string, word string, word_class string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in LEXICON])


def names(df):
    return [r["name"] for r in df.orderBy("n").collect()]


def test_generation(spark):
    sure = GeneratorConfig(0.0, 0.0, 1.0, 1.0, 1.0)
    pool = words(spark, prefix=["Grand"], noun=["Profound"], adj=["luminous"], suffix=["Dawn"])
    assert names(namegen.generate(pool, 1, 7, config=sure)) == ["Profound of the luminous Dawn"]
    assert names(namegen.generate(words(spark, noun=["alpha"]), 1, 1, "{prefix} {word} of {suffix}")) == ["alpha of"]
    two = words(spark, noun=["a", "b"])
    assert sorted(names(namegen.generate(two, 3, 5, config=GeneratorConfig(0, 0, 0, 0, 0)))) == ["a", "b"]
    assert names(namegen.generate(words(spark, adj=["x"]), 2, 5)) == []
    assert names(namegen.generate(two, 3, 5, "fixed}")) == ["fixed}"]
    many = words(spark, noun=[f"n{i}" for i in range(40)], prefix=list("pqr"), suffix=list("xyz"), adj=list("uvw"))
    first = names(namegen.generate(many, 8, 42))
    assert len(set(first)) == 8 and first == names(namegen.generate(many.repartition(7), 8, 42)) and first != names(namegen.generate(many, 8, 43))
    assert names(namegen.generate(many, 5, 42)) == first[:5]
    with pytest.raises(ValueError, match="unknown placeholder"):
        namegen.parse_template("{nope}")
    assert [p.pool or p.literal for p in namegen.parse_template("a{word")] == ["a", "words"]


def test_folding_equals_decomposition(spark):
    import unicodedata

    letters = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    words = ["".join(letters[i : i + 50]) for i in range(0, len(letters), 50)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", translit.fold_diacritics(F.col("w")).alias("f")).collect():
        assert r["f"] == translit.fold(r["w"])
