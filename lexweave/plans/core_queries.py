"""Registered queries of the full lookup, of senses, transliteration, display forms and CSV imports, with their oracles.

The oracles fold in SQL what the engine folds in columns: concepts and evidence by recursion over their order.
"""

from __future__ import annotations

import csv
import os
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import render, text, translit
from ..operators import concepts, rank, sinks
from ..session import shared_folder
from ..sources import dictionary, lexicon_csv, specs
from ..sources.seed import SEED, seed_lexicon
from ..sources.specs import SourceSpec
from .adapters import EDG_SQL, LEX_SQL, first_edges, lexicon, stops_sql, table
from .queries import GLOSS_SQL, JSON_SQL, NOISE, QUERY, SINGULAR, SPEC, TOKENS_SQL, lines_of, query

# the full lookup

WIDE = "the ering " + QUERY
_CONCEPT_WORD = f"(length({{0}}) >= 3 AND {{0}} NOT IN ({stops_sql(NOISE)}))"


def concepts_sql(tokens: list[str], candidates: list[str], bridge: str = "lex") -> str:
    """CTEs that end in ``concept`` (k, term, weight, kind, via, rel): tokens, bridge, edges and candidates in order, with their caps."""
    listed = ", ".join(f"'{t}'" for t in tokens)
    compound = " OR ".join(f"contains(dst, '{t}')" for t in tokens if len(t.encode()) >= 4) or "false"
    said = ", ".join(f"'{c.lower()}'" for c in candidates)
    one = "struct_pack(term := {0}, weight := {1}::DOUBLE, kind := {2}::VARCHAR, via := {3}::VARCHAR, rel := {4}::VARCHAR)"
    empty = f"list_filter([{one.format(repr('x'), 0, repr('x'), repr('x'), repr('x'))}], lambda x: false)"
    return rf"""
q AS (SELECT unnest([{listed}]) AS token, unnest(range(1, {len(tokens) + 1})) AS i),
placed AS (SELECT id, t, min(pos) AS pos FROM (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT id, {TOKENS_SQL.format('tags')} AS w FROM {bridge})) WHERE {_CONCEPT_WORD.format('t')} GROUP BY 1, 2),
met AS (SELECT via, term, id, pos FROM (SELECT b.word AS via, t AS term, placed.id, pos, row_number() OVER (PARTITION BY b.word, t ORDER BY placed.id, pos) AS n FROM placed JOIN {bridge} b USING (id) WHERE b.word IN ({listed})) WHERE n = 1),
told AS (SELECT via, list(term ORDER BY id, pos) AS terms FROM met GROUP BY 1),
bridged AS (SELECT 0::BIGINT AS i, [{listed}] AS seen, {empty} AS made
  UNION ALL SELECT i + 1, list_concat(seen, fresh), list_concat(made, list_transform(fresh, lambda x: {one.format('x', concepts.BRIDGE_WEIGHT, repr('bridge'), 'token', 'NULL')}))
  FROM (SELECT bridged.i, seen, made, token, list_filter(coalesce(terms, []), lambda x: NOT list_contains(seen, x))[1:{concepts.BRIDGE_PER_TOKEN}] AS fresh FROM bridged JOIN q ON q.i = bridged.i + 1 LEFT JOIN told ON via = token)),
based AS (SELECT seen, list_concat([{", ".join(one.format(repr(t), 1.0, repr('token'), 'NULL', 'NULL') for t in tokens)}], made) AS made FROM bridged ORDER BY i DESC LIMIT 1),
sources AS (SELECT x.term AS src, x.weight AS base FROM (SELECT unnest(made) AS x FROM based)),
near AS (SELECT src, dst, min(struct_pack(rel := rel, weight := weight)) AS r FROM edg JOIN sources USING (src) WHERE {_CONCEPT_WORD.format('dst')} AND NOT ({compound}) GROUP BY 1, 2),
hop AS (SELECT src, dst, r.rel AS rel, base * r.weight AS weight, row_number() OVER (ORDER BY src, r.rel, dst) AS n FROM near JOIN sources USING (src)),
walked AS (SELECT 0::BIGINT AS n, seen, {empty} AS made FROM based
  UNION ALL SELECT w.n + 1, CASE WHEN take THEN list_append(seen, dst) ELSE seen END, CASE WHEN take THEN list_append(made, {one.format('dst', 'weight', repr('assoc'), 'src', 'rel')}) ELSE made END
  FROM (SELECT walked.*, hop.* EXCLUDE (n), len(made) < {concepts.ASSOC_TOTAL} AND NOT list_contains(seen, dst) AND len(list_filter(made, lambda x: x.via = src)) < {concepts.ASSOC_PER_SRC} AS take
        FROM walked JOIN hop ON hop.n = walked.n + 1) w),
ended AS (SELECT seen, made FROM walked ORDER BY n DESC LIMIT 1),
online AS (SELECT list_transform(list_filter([{said}]::VARCHAR[], lambda x: {_CONCEPT_WORD.format('x')} AND NOT list_contains(seen, x)), lambda x: {one.format('x', concepts.ONLINE_WEIGHT, repr('online'), 'NULL', 'NULL')}) AS made FROM ended),
concept AS (SELECT k, c.* FROM (SELECT unnest(all_made) AS c, generate_subscripts(all_made, 1) AS k FROM (SELECT list_concat(based.made, ended.made, online.made) AS all_made FROM based, ended, online)))"""


def rank_sql(tokens: list[str], candidates: list[str], where: str = "true") -> str:
    """CTEs that end in ``ranked`` (the lexicon's columns, score, matched): the fold of evidence over the concepts of ``concepts_sql``."""
    same = f"({SINGULAR.format('c.term')} = {SINGULAR.format('g.t')} OR (strlen({SINGULAR.format('c.term')}) >= 5 AND strlen({SINGULAR.format('g.t')}) >= 5 AND (starts_with({SINGULAR.format('c.term')}, {SINGULAR.format('g.t')}) OR starts_with({SINGULAR.format('g.t')}, {SINGULAR.format('c.term')}))))"
    near = lambda a, t: f"(strlen('{t}') >= 3 AND strlen({a}) >= 3 AND (starts_with({a}, '{t}') OR starts_with('{t}', {a})))"
    direct = ", ".join(
        f"struct_pack(s := CASE WHEN word <> '{t}' AND {near('word', t)} THEN 1.5 ELSE 0 END::DOUBLE, m := '{t} (wort~)'), "
        f"struct_pack(s := CASE WHEN lower(system) = '{t}' OR {near('lower(system)', t)} THEN 2.0 ELSE 0 END::DOUBLE, m := '{t} (system)'), "
        f"struct_pack(s := CASE WHEN {'contains(etymology, %r)' % t if len(t.encode()) >= 4 else 'false'} THEN 1.0 ELSE 0 END::DOUBLE, m := '{t} (etymologie)')"
        for t in tokens
    )
    compound = " OR ".join(f"contains(cand.word, '{t}')" for t in tokens if len(t.encode()) >= 4) or "false"
    label = "CASE WHEN kind = 'token' THEN term || ' (glosse)' WHEN kind = 'bridge' AND by_word >= by_gloss THEN via || ' → ' || term || ' (wort)' WHEN kind = 'bridge' THEN via || ' → ' || term || ' (bruecke)' WHEN kind = 'online' THEN term || ' (semantisch)' ELSE via || ' → ' || term || ' (' || rel || ')' END"
    return rf"""
cand AS (SELECT * FROM lex WHERE {where}),
gloss AS (SELECT id, t, min(pos) AS pos FROM (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT id, {TOKENS_SQL.format('tags')} AS w FROM cand)) WHERE {_CONCEPT_WORD.format('t')} GROUP BY 1, 2),
weighed AS (SELECT t, 1 + least(greatest(ln((SELECT greatest(count(*), 1) FROM cand)::DOUBLE / count(*)), 0), 5) AS idf FROM gloss GROUP BY 1),
alike AS (SELECT k, t, idf FROM (SELECT g.t, g.idf, c.k FROM weighed g JOIN concept c ON left(c.term, 2) = left(g.t, 2) AND {same})),
free AS (SELECT id, k, list(struct_pack(pos := pos, idf := idf) ORDER BY pos) AS g FROM gloss JOIN alike USING (t) GROUP BY 1, 2),
begun AS (SELECT id, word, list_filter([{direct}], lambda x: coalesce(x.s, 0) > 0) AS d FROM cand WHERE word NOT IN ({", ".join(f"'{t}'" for t in tokens)})),
folded AS (SELECT id, word, 0::BIGINT AS k, coalesce(list_sum(list_transform(d, lambda x: x.s)), 0)::DOUBLE AS score, list_transform(d, lambda x: x.m) AS matched, []::BIGINT[] AS used FROM begun
  UNION ALL SELECT id, word, k, score + greatest(by_gloss, by_word), CASE WHEN greatest(by_gloss, by_word) > 0 THEN list_append(matched, {label}) ELSE matched END,
    CASE WHEN by_gloss > by_word THEN list_append(used, first.pos) ELSE used END
  FROM (SELECT *, coalesce(1.2 * weight * first.idf, 0)::DOUBLE AS by_gloss, CASE WHEN kind <> 'token' AND word = term THEN 4.0 * weight ELSE 0 END::DOUBLE AS by_word
    FROM (SELECT f.id, f.word, f.score, f.matched, f.used, c.*, list_filter(coalesce(free.g, []), lambda x: NOT list_contains(f.used, x.pos))[1] AS first
      FROM folded f JOIN concept c ON c.k = f.k + 1 LEFT JOIN free ON free.id = f.id AND free.k = c.k))),
ranked AS (SELECT cand.*, round(folded.score * (seed_weight * CASE language WHEN 'la' THEN 1.3 WHEN 'el' THEN 1.15 ELSE 1.0 END::DOUBLE * CASE WHEN contains(registers, 'poetic') OR contains(registers, 'literary') THEN 1.15 ELSE 1.0 END::DOUBLE)
  * CASE WHEN {compound} THEN 0.3 ELSE 1.0 END::DOUBLE, 6) AS score, matched FROM folded JOIN cand USING (id) WHERE k = (SELECT max(k) FROM concept) AND folded.score > 0)"""


_WIDE = WIDE.split()[1:]  # the first is a stop word


@query("SELECT (k - 1)::INT AS pos, term, weight, kind, via, rel FROM concept", LEX_SQL, EDG_SQL, concepts_sql(["erening", *QUERY.split()], ["Heation", "the"]), recursive=True)
def rt_concepts(spark, sf):
    made = concepts.build_concepts(spark, "erening " + QUERY, lexicon(spark, sf), ("Heation", "the"), first_edges(spark, sf))
    return concepts.concept_frame(spark, made)


@query("SELECT id, score, array_to_string(matched, '; ') AS matched FROM ranked", LEX_SQL, EDG_SQL, concepts_sql(_WIDE, ["Heation"]), rank_sql(_WIDE, ["Heation"]), recursive=True)
def rt_rank_full(spark, sf):
    lex = lexicon(spark, sf)
    found = rank.rank_semantic(lex, WIDE, lex, ("Heation",), first_edges(spark, sf))
    return found.select("id", F.round("score", 6).alias("score"), F.array_join("matched", "; ").alias("matched"))


_FOUND = "system IN ('src1', 'src6') AND contains(registers, 'archaic')"


_REASON = "word || ' — ' || array_to_string([etymology, 'System: ' || system, 'Spur: ' || array_to_string(matched, ', ')], ' · ')"
_TOP = "ORDER BY score DESC, seed_weight DESC, word, id LIMIT"


@query(f"SELECT id, score, {_REASON} AS explanation, 'lokal' AS mode FROM ranked {_TOP} 9", LEX_SQL, EDG_SQL, concepts_sql(QUERY.split(), []), rank_sql(QUERY.split(), [], _FOUND), recursive=True)
def rt_find(spark, sf):
    found = rank.find(lexicon(spark, sf), QUERY, 9, systems=["src1", "src6"], register="archaic", edges=first_edges(spark, sf))
    return rank.explained(found).select("id", F.round("score", 6).alias("score"), "explanation", "mode")


@query(f"SELECT via, n::INT AS n, term FROM (SELECT via, term, row_number() OVER (PARTITION BY via ORDER BY id, pos) AS n FROM met) WHERE n <= {concepts.BRIDGE_PER_TOKEN}", LEX_SQL, EDG_SQL, concepts_sql(["the", *QUERY.split()], []), recursive=True)
def jn_bridge_first(spark, sf):
    """The first gloss tokens of the words that each token names."""
    found = concepts._bridge_rows(lexicon(spark, sf), ["the", *QUERY.split()], concepts.BRIDGE_PER_TOKEN)
    rows = [(via, k + 1, term) for via, terms in found.items() for k, term in enumerate(terms)]
    return spark.createDataFrame(rows, "via string, n int, term string")


_MEANING = r"""list_filter(list_transform(string_split(tags, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_FITS = "array_to_string(p[1:(list_max(list_filter(range(1, least(len(p), 40) + 1), lambda i: i = 1 OR length(array_to_string(p[1:i], '; ')) <= 64)))::BIGINT], '; ')"
_SHORT = lambda value, most: f"CASE WHEN length({value}) <= {most} THEN {value} ELSE left({value}, {most - 1}) || '…' END"


@query(
    f"SELECT {_REASON} AS value FROM top UNION ALL SELECT word || coalesce(' — ' || {_SHORT('m', 64)}, '') || '  [' || language || ' · ' || system || coalesce(' · ' || replace(registers, ',', ' · '), '') || ']' || chr(10) || "
    f"'  Spur..: ' || array_to_string(u[1:4], ' · ') || CASE WHEN len(u) > 4 THEN ' · +' || (len(u) - 4) ELSE '' END || chr(10) || '  Wurzel: ' || {_SHORT('etymology', 110)} || chr(10) "
    "FROM (SELECT *, list_filter(matched, lambda x, i: list_position(matched, x) = i) AS u, CASE WHEN len(p) > 0 THEN fits END AS m FROM (SELECT *, " + _FITS + " AS fits FROM (SELECT *, " + _MEANING + " AS p FROM top)))",
    LEX_SQL, GLOSS_SQL, "concept AS (SELECT i AS k, token AS term, 1.0::DOUBLE AS weight, 'token' AS kind, NULL::VARCHAR AS via, NULL::VARCHAR AS rel FROM (SELECT unnest([" + ", ".join(f"'{t}'" for t in QUERY.split()) + f"]) AS token, unnest(range(1, {len(QUERY.split()) + 1})) AS i))",
    rank_sql(QUERY.split(), []), f"top AS (SELECT * FROM ranked {_TOP} 20)", recursive=True,
)
def sk_text(spark, sf):
    found = rank.top_k(rank.rank_semantic(lexicon(spark, sf), QUERY), 20)
    return sinks.text_lines(found, with_reason=True).unionByName(sinks.rich_blocks(found, show_root=True))


# glosses, display forms, transliteration

_FOLD = r"lower(trim(regexp_replace(replace(coalesce(text, ''), ',', ''), '\s+', ' ', 'g')))"


def _bytes_sql(value: str, most: int) -> str:
    """The longest prefix of whole characters within so many bytes."""
    return f"left({value}, list_max(list_filter(range(0, {most + 1}), lambda n: strlen(left({value}, n)) <= {most}))::BIGINT)"


_IS_JUNK = f"list_bool_or(list_transform([{', '.join(repr(m) for m in text.JUNK_GLOSSES)}], lambda m: contains(g, m)))"


@query(f"SELECT doc_id, CASE WHEN NOT {_IS_JUNK} THEN {_bytes_sql('g', 80)} END AS gloss FROM (SELECT doc_id, {_FOLD} AS g FROM documents)")
def f_usable_gloss(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_gloss(F.coalesce("text", F.lit(""))).alias("gloss"))


@query(rf"SELECT id, {_bytes_sql('e', 160)} AS etymology FROM (SELECT id, nullif(lower(trim(regexp_replace(etymology, '\s+', ' ', 'g'))), '') AS e FROM lex)", LEX_SQL)
def f_clean_etymology(spark, sf):
    return lexicon(spark, sf).select("id", text.clean_etymology(F.col("etymology")).alias("etymology"))


@query(
    r"""SELECT id, CASE WHEN length(m) <= 64 THEN m ELSE left(m, 63) || '…' END AS meaning FROM (SELECT id, array_to_string(p[1:(list_max(list_filter(range(1, least(len(p), 40) + 1), lambda i: i = 1 OR length(array_to_string(p[1:i], '; ')) <= 64)))::BIGINT], '; ') AS m
FROM (SELECT id, list_filter(list_transform(string_split(tags, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM lex) WHERE len(p) > 0)
UNION ALL SELECT id, NULL FROM lex WHERE len(list_filter(string_split(tags, ','), lambda x: regexp_matches(x, '\S'))) = 0""",
    LEX_SQL,
)
def f_meaning(spark, sf):
    return lexicon(spark, sf).select("id", render.meaning_of(F.col("tags")).alias("meaning"))


@query(
    "SELECT item_id, array_to_string(u[1:4], ' · ') || CASE WHEN len(u) > 4 THEN ' · +' || (len(u) - 4) ELSE '' END AS spur FROM "
    "(SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))"
)
def f_spur(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", render.spur_compact(F.split("text", " ")).alias("spur"))


@query(
    "SELECT p_partkey, p_name || ' — ' || array_to_string(list_filter([CASE WHEN e IS NOT NULL OR o IS NOT NULL THEN array_to_string(list_filter([e, '(' || o || ')'], lambda x: x IS NOT NULL), ' ') END, 'System: ' || s, 'Spur: ' || p_name || ', ' || p_type], lambda x: x IS NOT NULL), ' · ') AS line "
    "FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS e, CASE WHEN p_partkey % 3 = 0 THEN 'la' END AS o, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS s FROM part)"
)
def f_explain(spark, sf):
    some = lambda by, c: F.when(F.expr(by), c)
    made = render.explain(F.col("p_name"), some("p_partkey % 2 = 0", F.col("p_type")), some("p_partkey % 3 = 0", F.lit("la")), some("p_partkey % 5 > 0", F.col("p_brand")), F.array("p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", made.alias("line"))


@query(
    rf"SELECT doc_id, md5(string_agg(t, ' ' ORDER BY pos)) AS tokens FROM (SELECT doc_id, t, min(pos) AS pos FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS w FROM documents)) GROUP BY 1, 2) GROUP BY 1"
)
def f_token_order(spark, sf):
    tokens = text.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens"), F.size(tokens).alias("n")).where("n > 0").drop("n")


# Latin letters to letters of another script, so that the given words become Greek and Hebrew ones.
_GREEK = ("abgdezhjiklmnxoprstyfcqw", "αβγδεζηθικλμνξοπρστυφχψω")
_HEBREW = ("abgdhwzxtyklmnsvpcqr", "אבגדהוזחטיכלמנסעפצקר")
_CLASSIC = dict(zip(_GREEK[1], "a b g d e z e th i k l m n x o p r s t y ph ch ps o".split(), strict=True))
_MODERN = _CLASSIC | {"β": "v", "η": "i", "υ": "i", "φ": "f"}
_SOUNDS = dict(zip(_HEBREW[1], [""] + "v g d h v z ch t y k l m n s".split() + ["", "f", "ts", "k", "r"], strict=True))


def _spelled_sql(value: str, sounds: dict[str, str]) -> str:
    for letter, sound in sounds.items():
        value = f"replace({value}, '{letter}', '{sound}')"
    return value


def _latin_sql(value: str, sounds: dict[str, str]) -> str:
    foreign = rf"regexp_matches(regexp_replace({value}, '[A-Za-zÀ-ɏ]', '', 'g'), '\p{{L}}')"
    return f"CASE WHEN {foreign} THEN {_spelled_sql(f'strip_accents({value})', sounds)} END"


@query(
    f"SELECT id, grc, {_latin_sql('grc', _CLASSIC)} AS classic, {_latin_sql('grc', _MODERN)} AS modern, {_latin_sql('he', _SOUNDS)} AS hebrew, "
    f"coalesce({_latin_sql('grc', _CLASSIC)}, grc) || CASE WHEN coalesce({_latin_sql('grc', _CLASSIC)}, grc) <> grc THEN ' (' || grc || ')' ELSE '' END AS shown "
    f"FROM (SELECT id, translate(word, '{_GREEK[0]}', '{_GREEK[1]}') AS grc, translate(word, '{_HEBREW[0]}', '{_HEBREW[1]}') AS he FROM lex)",
    LEX_SQL,
)
def f_to_latin(spark, sf):
    at = lexicon(spark, sf).select("id", F.translate("word", *_GREEK).alias("grc"), F.translate("word", *_HEBREW).alias("he"))
    none = F.lit(None).cast("string")
    return at.select(
        "id", "grc",
        translit.to_latin(F.col("grc"), F.lit("grc")).alias("classic"),
        translit.to_latin(F.col("grc"), F.lit("el")).alias("modern"),
        translit.to_latin(F.col("he"), F.lit("he")).alias("hebrew"),
        render.display_word(F.col("grc"), none, F.lit("grc"), "both").alias("shown"),
    )


# dictionary lines with several senses

SENSES = SourceSpec("senses", "wiktextract-jsonl", "", "grc", "senses_grc")


def sense_lines(spark, sf):
    """Documents as entries of three senses: tags and fields that only point elsewhere, junk glosses, absent and odd parts of speech, romanizations."""
    docs = table(spark, sf, "documents").withColumn("w", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), text.NOT_ALNUM), lambda w: w != ""))
    i = F.col("doc_id")
    pos = F.get(F.array(*map(F.lit, ["noun", "adj", "name", "verb", None, "five"])), (i % 6).cast("int"))
    said = lambda *parts: F.array(F.concat_ws(" ", *parts))
    none = F.lit(None).cast("string")
    sense = lambda glosses, tags, form_of: F.struct(glosses.alias("glosses"), tags.alias("tags"), form_of.alias("form_of"))
    senses = F.array(
        sense(said(F.array_join(F.slice("w", 1, 3), ", ")), F.when(i % 4 == 0, F.array(F.lit("misspelling"))).otherwise(F.array(F.lit("poetic"), F.lit("figuratively"), F.lit("rare"))), none),
        sense(said(F.array_join(F.slice("w", 4, 40), " ")), F.array(F.lit("archaic")), F.when(i % 3 == 0, F.lit("nil"))),
        sense(F.when(i % 5 == 0, said(F.lit("Surname"), F.get("w", F.lit(0)))).otherwise(said(F.get("w", F.lit(0)), F.lit("End"))), F.array(F.lit("figurative"), F.lit("dated")), none),
    )
    form = lambda f, tags: F.struct(f.alias("form"), F.array(*map(F.lit, tags)).alias("tags"))
    forms = F.array(form(F.lit("plural"), ["plural"]), form(F.when(i % 2 == 0, F.concat(F.lit(" "), F.get("w", F.lit(1)))).otherwise(" "), ["x", "romanization"]))
    line = F.to_json(F.struct(F.get("w", F.lit(0)).alias("word"), pos.alias("pos"), senses.alias("senses"), forms.alias("forms")))
    for old, new in (('"form_of":"nil"', '"form_of":null'), ('"pos":"five"', '"pos":5')):
        line = F.replace(line, F.lit(old), F.lit(new))
    return docs.select(i.alias("ordinal"), F.when(i % 11 == 0, F.lit("{broken")).otherwise(line).alias("value"))


_SENSES_SQL = rf"""
doc AS (SELECT doc_id AS i, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
given AS (SELECT *, w[1] AS word, ['noun', 'adj', 'proper', 'no', 'none', 'none'][(i % 6 + 1)::INT] AS kind,
  [struct_pack(g := array_to_string(w[1:3], ' '), r := ['poetic', 'figurative'], ok := i % 4 <> 0),
   struct_pack(g := array_to_string(w[4:43], ' '), r := ['archaic'], ok := i % 3 <> 0),
   struct_pack(g := concat_ws(' ', CASE WHEN i % 5 = 0 THEN 'surname' END, w[1], CASE WHEN i % 5 <> 0 THEN 'end' END), r := ['figurative', 'dated'], ok := true)] AS s FROM doc),
usable AS (SELECT *, list_filter(s, lambda x: x.ok AND NOT {_IS_JUNK.replace("contains(g, m)", "contains(x.g, m)")})[1:2] AS kept FROM given)"""


@query(
    rf"""SELECT i AS ordinal, i % 11 <> 0 AS valid, accepted,
 CASE WHEN accepted THEN array_to_string(list_transform(kept, lambda x: {_bytes_sql('x.g', 80)}), ',') END AS tags,
 CASE WHEN accepted THEN nullif(array_to_string(list_filter(flatten(list_transform(kept, lambda x: x.r)), lambda x, k: list_position(flatten(list_transform(kept, lambda y: y.r)), x) = k), ','), '') END AS registers,
 CASE WHEN accepted AND kind <> 'none' THEN kind END AS word_class, CASE WHEN accepted AND i % 2 = 0 THEN w[2] END AS translit
 FROM (SELECT *, i % 11 <> 0 AND coalesce(length(word) BETWEEN 2 AND 30, false) AND kind <> 'no' AND len(kept) > 0 AS accepted FROM usable)""",
    _SENSES_SQL,
)
def sc_senses(spark, sf):
    parsed = dictionary.parse_lines(sense_lines(spark, sf), SENSES)
    return parsed.select("ordinal", "valid", "accepted", *[F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("tags", "registers", "word_class", "translit")])


# CSV files

_CSV_SQL = """made AS (SELECT p_partkey, p_name AS word, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language, CASE p_partkey % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'suffix' WHEN 2 THEN 'odd' END AS word_class,
 p_brand AS system, p_type || ',"' || p_size || '"' AS tags, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE p_retailprice END::DOUBLE AS seed_weight, p_type AS source, 'from ' || p_name AS etymology, 'la' AS origin_lang, p_name || '!' AS translit, 'poetic, dated' AS registers FROM part)"""


def _csv(spark, sf, width: int) -> str:
    """Parts as a folder of CSV files with so many columns: blanks, quotes, unknown classes, weights that are no numbers."""
    i = F.col("p_partkey")
    cells = {
        "word": F.concat(F.lit(" "), F.col("p_name")),
        "language": F.when(i % 3 == 0, "en").when(i % 3 == 1, " de ").otherwise("  "),
        "word_class": F.when(i % 4 == 0, "noun").when(i % 4 == 1, "suffix").when(i % 4 == 2, "odd"),
        "system": F.col("p_brand"),
        "tags": F.concat("p_type", F.lit(',"'), F.col("p_size").cast("string"), F.lit('"')),
        "seed_weight": F.when(i % 5 == 0, "heavy").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))),
        "source": F.col("p_type"),
        "etymology": F.concat(F.lit("from "), F.col("p_name")),
        "origin_lang": F.lit("la"),
        "translit": F.concat("p_name", F.lit("! ")),
        "registers": F.lit("poetic, dated"),
    }
    path = f"{shared_folder(spark)}/csv-{width}-{uuid.uuid4().hex}"
    table(spark, sf, "part").select(*[c.alias(f"column {k}") for k, c in enumerate(list(cells.values())[:width])]).write.options(header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return path


def _csv_rows(columns: str) -> str:
    absent = {7: "NULL AS etymology, NULL AS origin_lang, NULL AS translit, NULL AS registers", 9: "etymology, origin_lang, NULL AS translit, NULL AS registers", 11: "etymology, origin_lang, translit, registers"}
    return " UNION ALL ".join(f"SELECT {w} AS width, {columns.replace('ABSENT', absent[w])} FROM made" for w in absent)


@query(_csv_rows("coalesce(language || '_', '') || word AS id, word, word_class, language, system, tags, seed_weight, source, ABSENT"), _CSV_SQL)
def sc_csv(spark, sf):
    parts = [lexicon_csv.read(spark, _csv(spark, sf, w)).withColumn("width", F.lit(w)) for w in (7, 9, 11)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 9 AS width, count(*) AS imported, count(*) FILTER (word_class = 'odd') AS unknown_class, count(DISTINCT coalesce(language || '_', '') || word) AS stored FROM made", _CSV_SQL)
def sc_csv_import(spark, sf):
    """The counters are those of the read that writes the store."""
    from ..operators.store import Store

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    report = lexicon_csv.import_file(store, _csv(spark, sf, 9))
    return store.words().agg(F.count("*").alias("stored")).select(F.lit(9).alias("width"), *[F.lit(report[c]).cast("long").alias(c) for c in ("imported", "unknown_class")], "stored")


# configuration, the seed and a whole fetch

_SOURCES = """
kaikki-de de 0, kaikki-en en 0, kaikki-la la 0, kaikki-el el 0, kaikki-grc grc 1, kaikki-he he 1, kaikki-sa sa 0, kaikki-non non 0, kaikki-got got 0, kaikki-egy egy 0,
kaikki-akk akk 0, kaikki-sux sux 0, kaikki-nci nci 0, kaikki-yua yua 0, kaikki-qu qu 0, myth-greek grc 0""".replace("\n", " ")
_SOURCES_SQL = "spec AS (SELECT split_part(x, ' ', 1) AS id, split_part(x, ' ', 2) AS language, split_part(x, ' ', 3) = '1' AS no_proper, i FROM (SELECT trim(unnest(string_split('" + _SOURCES.strip() + f"', ','))) AS x, unnest(range({_SOURCES.count(',') + 1})) AS i))"
_SPEC = "id string, backend string, language string, system string, max_words int, skips string"


def _spec_rows(chosen) -> list[tuple]:
    return [(s.id, s.backend, s.language, s.system, s.max_words, ",".join(s.skip_classes)) for s in chosen]


@query(
    "SELECT id, CASE WHEN id LIKE 'myth%' THEN 'mythology-json' ELSE 'wiktextract-jsonl' END AS backend, language, CASE WHEN id LIKE 'myth%' THEN 'myth_greek' ELSE 'wiktionary_' || language END AS system, "
    "CASE WHEN id LIKE 'myth%' THEN 2000 ELSE 20000 END::INT AS max_words, CASE WHEN no_proper THEN 'proper' ELSE '' END AS skips FROM spec",
    _SOURCES_SQL,
)
def sc_specs(spark, sf):
    return spark.createDataFrame(_spec_rows(specs.load_sources().sources), _SPEC)


@query("SELECT id, 7 AS max_words, true AS known FROM spec WHERE id IN ('kaikki-la', 'myth-greek') UNION ALL SELECT 'nowhere', 7, false", _SOURCES_SQL)
def pf_sources(spark, sf):
    chosen, unknown = specs.select(specs.load_sources().sources, ["kaikki-la", "nowhere", "myth-greek"], 7)
    return spark.createDataFrame([(s.id, s.max_words, True) for s in chosen] + [(i, 7, False) for i in unknown], "id string, max_words int, known boolean")


@query(
    "SELECT * FROM (VALUES ('default', 0.8::DOUBLE, 0.5::DOUBLE, ' ', 'of', 'latin', 1), ('given', 1.0::DOUBLE, 0.5::DOUBLE, '-', 'von', 'both', 9), ('zero', 0.8::DOUBLE, 0.5::DOUBLE, ' ', 'of', 'native', 1)) t(file, prefix, suffix, separator, fillword, script, count)"
)
def sc_config(spark, sf):
    texts = {"given": '[generator]\nprefix_probability=1.0\nseparator="-"\nfillword="von"\n[output]\nscript="both"\ncount=9\n', "zero": '[output]\nscript="native"\ncount=0\n'}
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        for name in ("default", *texts):
            path = os.path.join(folder, f"{name}.toml")
            if name in texts:
                with open(path, "w") as f:
                    f.write(texts[name])
            c = specs.load_config(path)
            rows.append((name, c.generator.prefix_probability, c.generator.suffix_name_probability, c.generator.separator, c.generator.fillword, c.script, c.count))
    return spark.createDataFrame(rows, "file string, prefix double, suffix double, separator string, fillword string, script string, count int")


def _seed_sql() -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = [f"({', '.join(map(quoted, r))})" for r in csv.reader(SEED.strip().splitlines())]
    names = "word, language, word_class, system, tags, weight, source, etymology, origin_lang"
    return f"SELECT language || '_' || word AS id, word, word_class, language, system, tags, weight::DOUBLE AS seed_weight, source, nullif(etymology, '') AS etymology, nullif(origin_lang, '') AS origin_lang, NULL::VARCHAR AS translit, NULL::VARCHAR AS registers FROM (VALUES {', '.join(rows)}) t({names})"


@query(_seed_sql())
def sc_seed(spark, sf):
    return seed_lexicon(spark)


FILE_BYTES = 16 << 20  # of stored documents that become one file of lines


@query(
    "SELECT 'lines' AS source, least((SELECT count(*) FROM ok), 50) AS accepted, (SELECT count(*) FROM doc WHERE doc_id <= last AND doc_id NOT IN (SELECT doc_id FROM ok)) AS skipped, "
    "(SELECT count(*) FROM (SELECT DISTINCT doc_id, rel, dst FROM (SELECT doc_id, word, 'synonym' AS rel, unnest(w[1:12]) AS dst FROM ok UNION ALL SELECT doc_id, word, 'verwandt', unnest(w[2:4]) FROM ok) WHERE dst <> word AND length(dst) <= 30 AND doc_id <= last)) AS edges, false AS failed "
    "FROM (SELECT CASE WHEN count(*) < 50 THEN (SELECT max(doc_id) FROM doc) ELSE max(doc_id) END AS last FROM (SELECT doc_id FROM ok ORDER BY doc_id LIMIT 50)) UNION ALL SELECT 'missing', 0, 0, 0, true",
    JSON_SQL,
)
def ag_fetch_report(spark, sf):
    """Two sources, one of them without a file; the limit of 50 words is the feature.

    The lines lie in gzip files of bounded size, whose names are in the order of the lines; texts are dealt before they become lines.
    """
    path = f"{shared_folder(spark)}/fetch-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    size = int(str(docs._jdf.queryExecution().analyzed().stats().sizeInBytes()))  # of the files
    parts = min(size // FILE_BYTES + 1, 99_999)  # names of files are in order up to five digits
    lines_of(docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")).select("value").write.option("compression", "gzip").text(path)
    some = [replace(SPEC, id="lines", max_words=50), replace(SPEC, id="missing")]
    report = dictionary.fetch(spark, some, {"lines": path, "missing": f"{path}-nowhere"})[2]
    return spark.createDataFrame([(r["source"], r["accepted"], r["skipped"], r["edges"], r["error"] is not None) for r in report], "source string, accepted long, skipped long, edges long, failed boolean")
