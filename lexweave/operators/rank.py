"""Reverse lookup: rank the words of a lexicon for a description.

Plan: gloss tokens are taken from the records once, or read from postings made at ingest; only those that begin like a concept are
compared with the concepts, and only those that match are written, counted and joined back to their records, so no other
token is ever shuffled. Records without any evidence leave before the score, which is a fold over the concepts in
order. ``top_k`` ends in TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.render import explain
from ..functions.text import gloss_tokens, idf, origin_factor, register_factor, score_text, singularish, stems_match
from ..functions.translit import fold_diacritics
from ..session import stored
from .concepts import COMPOUND_BYTES, Concept, build_concepts, concept_array, query_tokens

# The parts of a score.
WORD_PARTIAL, SYSTEM_HIT, ETYMOLOGY_HIT = 1.5, 2.0, 1.0
GLOSS_BASE, CONCEPT_WORD_HIT, ECHO_BONUS, NEAR_ECHO = 1.2, 4.0, 5.0, 0.3
SUBSTRING_BYTES = 4

_STATE = "struct<score:double,matched:array<string>,used:array<int>>"


def document_frequency(lexicon: DataFrame) -> DataFrame:
    """(token, df): in how many records a gloss token occurs."""
    return lexicon.select(F.explode(gloss_tokens(F.col("tags"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def postings(lexicon: DataFrame) -> DataFrame:
    """(token, id, pos): the place of every gloss token in its record."""
    return lexicon.select("id", F.posexplode(gloss_tokens(F.col("tags"))).alias("pos", "token")).select("token", "id", "pos")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _label(concept: Column, word_hit: Column) -> Column:
    path = F.concat(concept["via"], F.lit(" → "), concept["term"])
    return (
        F.when(concept["kind"] == "token", F.concat(concept["term"], F.lit(" (glosse)")))
        .when((concept["kind"] == "bridge") & word_hit, F.concat(path, F.lit(" (wort)")))
        .when(concept["kind"] == "bridge", F.concat(path, F.lit(" (bruecke)")))
        .when(concept["kind"] == "online", F.concat(concept["term"], F.lit(" (semantisch)")))
        .otherwise(F.concat(path, F.lit(" ("), concept["rel"], F.lit(")")))
    )


def _direct(tokens: list[str], word: Column, system: Column, etymology: Column) -> Column:
    """Evidence of the tokens themselves as an array of (score, label), in order."""
    nothing = F.lit(0.0)
    parts = []
    for token in tokens:
        t = F.lit(token)
        near = F.when(word != t, score_text(word, t, 0.0, WORD_PARTIAL)).otherwise(nothing)
        of_system = F.coalesce(score_text(system, t, SYSTEM_HIT, SYSTEM_HIT), nothing)
        of_root = F.when(F.contains(etymology, t), F.lit(ETYMOLOGY_HIT)).otherwise(nothing) if len(token.encode()) >= SUBSTRING_BYTES else nothing
        parts += [F.struct(s.alias("s"), F.lit(f"{token} ({name})").alias("m")) for s, name in ((near, "wort~"), (of_system, "system"), (of_root, "etymologie"))]
    made = F.array(*parts) if parts else F.array().cast("array<struct<s:double,m:string>>")
    return F.filter(made, lambda x: x["s"] > 0)


def _fold(concepts: Column, glosses: Column, word: Column, latin: Column, start: Column) -> Column:
    """Evidence of the concepts in order: each counts its better hit, and a gloss token counts once."""

    def step(state: Column, c: Column) -> Column:
        free = F.filter(glosses, lambda g: ~F.array_contains(state["used"], g["pos"]) & stems_match(c["stem"], g["stem"]))
        bound = F.transform(F.array(F.try_element_at(free, F.lit(1))), lambda g: F.struct(g.alias("g"), F.coalesce(F.lit(GLOSS_BASE) * c["weight"] * g["idf"], F.lit(0.0)).alias("by_gloss")))

        def add(x: Column) -> Column:
            names = (word == c["term"]) | F.coalesce(latin == c["term"], F.lit(False))
            by_word = F.when(names & (c["kind"] != "token"), F.lit(CONCEPT_WORD_HIT) * c["weight"]).otherwise(F.lit(0.0))
            best = F.greatest(x["by_gloss"], by_word)
            is_word = by_word >= x["by_gloss"]
            matched = F.concat(state["matched"], F.array(_label(c, is_word)))
            used = F.when(is_word, state["used"]).otherwise(F.concat(state["used"], F.array(x["g"]["pos"])))
            return F.when(best > 0, F.struct((state["score"] + best).alias("score"), matched.alias("matched"), used.alias("used"))).otherwise(state)

        return F.transform(bound, add)[0]

    return F.aggregate(concepts, start, step)


def rank_semantic(
    lexicon: DataFrame,
    query: str,
    bridge: DataFrame | None = None,
    candidates: tuple[str, ...] = (),
    edges: DataFrame | None = None,
    allow_echo: bool = False,
    index: DataFrame | None = None,
) -> DataFrame:
    """The lexicon's columns with ``score`` and ``matched`` for every word with evidence; order with ``ordered`` or ``top_k``.

    ``bridge`` is the vocabulary of the gloss bridge (often the unfiltered lexicon). Document frequencies and the number of
    records are those of ``lexicon``; ``index`` is its postings if they are stored.
    """
    spark = lexicon.sparkSession
    tokens = query_tokens(spark, query)
    concepts = build_concepts(spark, query, bridge, candidates, edges)
    return score_records(lexicon, tokens, concepts, allow_echo, index)


def score_records(lexicon: DataFrame, tokens: list[str], concepts: list[Concept], allow_echo: bool = False, index: DataFrame | None = None) -> DataFrame:
    spark = lexicon.sparkSession
    array = F.transform(concept_array(concepts), lambda c: c.withField("stem", singularish(c["term"])))
    terms = sorted({c.term for c in concepts})
    n = max(1, lexicon.count())
    stems = spark.createDataFrame([(t,) for t in terms], "term string").select(singularish(F.col("term")).alias("y")).distinct()
    at = postings(lexicon) if index is None else index
    begins = _any([F.startswith("token", F.lit(t)) for t in sorted({t[:2] for t in terms})])  # a stem has the first two characters of its term
    alike = (F.left(F.col("stem"), F.lit(2)) == F.left(F.col("y"), F.lit(2))) & stems_match(F.col("stem"), F.col("y"))
    at = at.where(begins).withColumn("stem", singularish(F.col("token")))
    at = stored(at.join(F.broadcast(stems), alike, "left_semi"), "rank-hits")  # a row for each concept, which the caps bound
    weighed = at.groupBy("token").agg(F.count("*").alias("df")).select("token", idf(F.lit(float(n)), F.col("df")).alias("idf"))
    hits = at.join(weighed, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "stem", "idf"))).alias("__glosses"))

    word, latin = F.lower("word"), fold_diacritics(F.lower("translit"))
    at = lexicon.withColumns({"__word": word, "__latin": latin, "__direct": _direct(tokens, word, F.lower("system"), F.lower("etymology"))})
    echo = is_echo(tokens, F.col("__word"), F.col("__latin"))
    near = _any([F.contains("__word", F.lit(t)) for t in tokens if len(t.encode()) >= COMPOUND_BYTES])
    if not allow_echo:
        at = at.where(~echo)
    at = at.join(hits, "id", "left")
    named = sorted({c.term for c in concepts if c.kind != "token"})
    names = (F.col("__word").isin(named) | F.coalesce(F.col("__latin").isin(named), F.lit(False))) if named else F.lit(False)
    at = at.where(F.col("__glosses").isNotNull() | (F.size("__direct") > 0) | names | (echo if allow_echo else F.lit(False)))

    start = F.struct(
        F.aggregate("__direct", F.lit(0.0), lambda s, x: s + x["s"]).alias("score"),
        F.transform("__direct", lambda x: x["m"]).alias("matched"),
        F.array().cast("array<int>").alias("used"),
    ).cast(_STATE)
    none = F.array().cast("array<struct<pos:int,stem:string,idf:double>>")
    state = _fold(array, F.coalesce("__glosses", none), F.col("__word"), F.col("__latin"), start)
    at = at.select("*", F.explode(F.array(state)).alias("__state"))  # a generator: the filter on the score cannot fold twice
    score, matched = F.col("__state.score"), F.col("__state.matched")
    if allow_echo:
        matched = F.when(echo, F.concat(matched, F.array(F.concat("__word", F.lit(" (wort)"))))).otherwise(matched)
        score = F.when(echo, score + ECHO_BONUS).otherwise(score)
    score = score * (F.col("seed_weight") * origin_factor(F.col("language")) * register_factor(F.col("registers")))
    if not allow_echo:
        score = F.when(near, score * NEAR_ECHO).otherwise(score)
    return at.select(*lexicon.columns, score.alias("score"), matched.alias("matched")).where("score > 0")


def is_echo(tokens: list[str], word: Column, latin: Column) -> Column:
    """A word that the description itself names, in its own or in Latin letters; both come in lower case."""
    return _any([(word == t) | F.coalesce(latin == t, F.lit(False)) for t in tokens])


def ordered(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("score"), F.desc("seed_weight"), F.asc("word"), F.asc("id"))


def top_k(matches: DataFrame, k: int) -> DataFrame:
    return ordered(matches).limit(k)


def rank(lexicon: DataFrame, query: str, candidates: tuple[str, ...] = ()) -> DataFrame:
    """Ranking in which the lexicon is its own bridge and no edges count."""
    return rank_semantic(lexicon, query, lexicon, candidates)


def explained(matches: DataFrame, display: Column | None = None) -> DataFrame:
    shown = F.col("word") if display is None else display
    return matches.withColumn("explanation", explain(shown, F.col("etymology"), F.col("origin_lang"), F.col("system"), F.col("matched")))


def suggest(lexicon: DataFrame, query: str, most: int) -> DataFrame:
    """Words near a token: the first ``most`` in order of (token, id), returned in alphabetical order.

    The prefix has three characters (a fixed number of bytes could split one).
    """
    tokens = query_tokens(lexicon.sparkSession, query)
    lowered = F.lower("word")
    found = [F.when(F.startswith(lowered, F.lit(t[:3])) | (F.levenshtein(lowered, F.lit(t)) <= 2), F.lit(i)) for i, t in enumerate(tokens)]
    first = F.coalesce(*found, F.lit(None)) if found else F.lit(None).cast("int")
    at = lexicon.select("word", "id", first.alias("token")).where("token is not null").groupBy("word").agg(F.min(F.struct("token", "id")).alias("at"))
    return at.orderBy("at").limit(most).select("word").orderBy("word")


def find(lexicon: DataFrame, query: str, count: int = 1, systems: list[str] | None = None, register: str | None = None, candidates: tuple[str, ...] = (), edges: DataFrame | None = None, allow_echo: bool = False) -> DataFrame:
    """The whole lookup: filters, bridge (the full lexicon with a system filter), edges, top k, and the mode as a column."""
    from .store import in_register, in_systems

    some = in_register(in_systems(lexicon, systems), register)
    bridge = lexicon if systems else some
    found = top_k(rank_semantic(some, query, bridge, candidates, edges, allow_echo), count)
    return found.withColumn("mode", F.lit("online" if candidates else "lokal"))


def no_hit(lexicon: DataFrame, query: str, candidates: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """Diagnostics for a description without a match: suggestions, echoes that were left out, candidates tried."""
    tokens = query_tokens(lexicon.sparkSession, query)
    near = suggest(lexicon, query, most).agg(F.sort_array(F.collect_list("word")).alias("suggestions"))  # ``most`` words at the most
    n_echoes = lexicon.where(F.lower("word").isin(tokens) if tokens else F.lit(False)).count()
    return near.select("suggestions", F.lit(n_echoes).cast("long").alias("n_echoes"), F.lit(len(candidates)).alias("n_candidates"))
