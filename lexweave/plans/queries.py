"""Registered queries of the lexicon engine, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render, text, translit
from ..operators import namegen, rank, sinks, store
from ..schema import LEXICON
from ..sources import dictionary
from ..sources.specs import SourceSpec
from .adapters import EDG_SQL, LEX_SQL, edges, first_edges, lexicon, stops_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

QUERY = "tion ther thon"  # frequent gloss tokens of the given texts
NOISE = text.GLOSS_NOISE
TOKENS_SQL = rf"list_filter(regexp_split_to_array(lower(coalesce({{}}, '')), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda t: t <> '' AND t NOT IN ({stops_sql()}))"
GLOSS_SQL = rf"tok AS (SELECT id, t FROM (SELECT DISTINCT id, unnest({TOKENS_SQL.format('tags')}) AS t FROM lex) WHERE length(t) >= 3 AND t NOT IN ({stops_sql(NOISE)}))"
SINGULAR = "CASE WHEN strlen({0}) > 3 AND ends_with({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"


def query(sql: str | None = None, *needs: str, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(needs) + "\n" if needs else "") + sql
        return f

    return add


# catalogue


@query("SELECT count(*) AS n_words FROM lex", LEX_SQL)
def ag_total(spark, sf):
    return lexicon(spark, sf).agg(F.count("*").alias("n_words"))


@query("SELECT count(*) AS n_edges FROM edg", EDG_SQL)
def ag_edge_count(spark, sf):
    return first_edges(spark, sf).agg(F.count("*").alias("n_edges"))


@query("SELECT language, count(*) AS cnt FROM lex GROUP BY 1", LEX_SQL)
def ag_count_by_language(spark, sf):
    return store.count_by(lexicon(spark, sf), "language")


@query("SELECT system, count(*) AS cnt FROM lex GROUP BY 1", LEX_SQL)
def ag_count_by_system(spark, sf):
    return store.count_by(lexicon(spark, sf), "system")


@query("SELECT word_class, count(*) AS cnt FROM lex GROUP BY 1", LEX_SQL)
def ag_count_by_class(spark, sf):
    return store.count_by(lexicon(spark, sf), "word_class")


@query(
    "SELECT string_agg(language || ' ' || cnt, ' · ' ORDER BY cnt DESC, language) FILTER (n <= 4) || CASE WHEN max(n) > 4 THEN ' · ...' ELSE '' END AS summary FROM "
    "(SELECT *, row_number() OVER (ORDER BY cnt DESC, language) AS n FROM (SELECT language, count(*) AS cnt FROM lex WHERE language IS NOT NULL GROUP BY 1))",
    LEX_SQL,
)
def ag_language_summary(spark, sf):
    return store.language_summary(lexicon(spark, sf))


@query(f"SELECT count(*) AS imported, count(*) FILTER (word_class NOT IN ({', '.join(repr(c) for c in store.WORD_CLASSES)})) AS unknown_class FROM lex", LEX_SQL)
def ag_import_report(spark, sf):
    return store.import_report(lexicon(spark, sf))


@query("SELECT t AS token, count(*) AS df, round(1 + least(greatest(ln((SELECT count(*) FROM lex)::DOUBLE / count(*)), 0), 5), 6) AS idf FROM tok GROUP BY 1", LEX_SQL, GLOSS_SQL)
def ag_document_frequency(spark, sf):
    lex = lexicon(spark, sf)
    n = float(max(1, lex.count()))
    return rank.document_frequency(lex).withColumn("idf", F.round(text.idf(F.lit(n), F.col("df")), 6))


# filters


@query("SELECT id, word, system FROM lex WHERE system IN ('src1', 'src3')", LEX_SQL)
def pf_system_in(spark, sf):
    return store.in_systems(lexicon(spark, sf), ["src1", "src3"]).select("id", "word", "system")


@query("SELECT id, word FROM lex WHERE contains(registers, 'poetic')", LEX_SQL)
def pf_register(spark, sf):
    return store.in_register(lexicon(spark, sf), "POETIC").select("id", "word")


@query("SELECT id, word, language FROM lex WHERE system = 'src2' AND language = 'en'", LEX_SQL)
def pf_list_words(spark, sf):
    return store.list_words(lexicon(spark, sf), "src2", "en").select("id", "word", "language")


@query("SELECT CASE word_class WHEN 'prefix' THEN 'prefixes' WHEN 'adj' THEN 'suffix_adjs' WHEN 'suffix' THEN 'suffix_names' ELSE 'words' END AS pool, id, word FROM lex WHERE word_class <> 'other'", LEX_SQL)
def pf_pools(spark, sf):
    return store.pools(lexicon(spark, sf))


@query(r"SELECT conv_id, turn, coalesce(length(text) BETWEEN 2 AND 30 AND NOT regexp_matches(text, '\s'), false) AS valid FROM conversations")
def pf_word_validity(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", dictionary.valid_word(F.col("text")).alias("valid"))


@query(rf"SELECT t AS token, length(t) >= 3 AND t NOT IN ({stops_sql(NOISE)}) AS concept FROM (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS t FROM documents)")
def pf_concept_tokens(spark, sf):
    tokens = table(spark, sf, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("token")).distinct()
    return tokens.withColumn("concept", text.is_concept_token(F.col("token")))


_FOLD_SQL = r"lower(trim(regexp_replace(replace(coalesce(text, ''), ',', ''), '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, coalesce(list_bool_or(list_transform([{', '.join(repr(m) for m in text.JUNK_GLOSSES)}], lambda m: contains({_FOLD_SQL}, m))), false) AS junk FROM documents")
def pf_gloss_junk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.gloss_is_junk(text.fold_gloss(F.coalesce("text", F.lit("")))).alias("junk"))


# functions


@query(rf"SELECT DISTINCT doc_id, unnest({TOKENS_SQL.format('text')}) AS token FROM documents")
def f_tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.tokenize(F.col("text"))).alias("token")).distinct()


@query("SELECT id, t AS token FROM tok", LEX_SQL, GLOSS_SQL)
def f_gloss_tokens(spark, sf):
    return lexicon(spark, sf).select("id", F.explode(text.gloss_tokens(F.col("tags"))).alias("token"))


_PAIRS_SQL = "pairs AS (SELECT DISTINCT src AS a, dst AS b FROM edg)"


def _pairs(spark, sf):
    return first_edges(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


@query(f"SELECT a, b, {SINGULAR.format('a')} AS singular FROM pairs", EDG_SQL, _PAIRS_SQL)
def f_singularish(spark, sf):
    return _pairs(spark, sf).withColumn("singular", text.singularish(F.col("a")))


@query(
    "SELECT a, b, x = y OR (strlen(x) >= 5 AND strlen(y) >= 5 AND (starts_with(x, y) OR starts_with(y, x))) AS same FROM "
    f"(SELECT *, {SINGULAR.format('a')} AS x, {SINGULAR.format('b')} AS y FROM pairs)",
    EDG_SQL,
    _PAIRS_SQL,
)
def f_terms_match(spark, sf):
    return _pairs(spark, sf).withColumn("same", text.terms_match(F.col("a"), F.col("b")))


@query("SELECT a, b, CASE WHEN a = b THEN 2.0 WHEN strlen(a) >= 3 AND strlen(b) >= 3 AND (starts_with(a, b) OR starts_with(b, a)) THEN 1.5 ELSE 0.0 END::DOUBLE AS score FROM pairs", EDG_SQL, _PAIRS_SQL)
def f_score_text(spark, sf):
    return _pairs(spark, sf).withColumn("score", text.score_text(F.col("a"), F.col("b"), 2.0, 1.5))


@query("SELECT id, CASE WHEN language = 'la' THEN 1.3 WHEN language = 'el' THEN 1.15 ELSE 1.0 END::DOUBLE AS origin, CASE WHEN contains(registers, 'poetic') OR contains(registers, 'literary') THEN 1.15 ELSE 1.0 END::DOUBLE AS register FROM lex", LEX_SQL)
def f_factors(spark, sf):
    return lexicon(spark, sf).select("id", text.origin_factor(F.col("language")).alias("origin"), text.register_factor(F.col("registers")).alias("register"))


@query("SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance FROM part")
def f_levenshtein(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def f_fold_diacritics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(translit.fold_diacritics(F.col("text")).cast("binary")).alias("folded"))


@query(r"SELECT doc_id, NOT regexp_matches(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g'), '\p{L}') AS latin FROM documents")
def f_is_latin(spark, sf):
    return table(spark, sf, "documents").select("doc_id", translit.is_latin_script(F.col("text")).alias("latin"))


@query("SELECT id, word AS latin, word AS shown FROM lex", LEX_SQL)
def f_latin_form(spark, sf):
    at = lexicon(spark, sf)
    names = (F.col("word"), F.col("translit"), F.col("language"))
    return at.select("id", translit.latin_form(*names).alias("latin"), render.display_word(*names, "both").alias("shown"))


@query(r"SELECT page_id, md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS line FROM pages")
def f_norm_ws(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.normalize_whitespace(F.col("html")).cast("binary")).alias("line"))


@query("SELECT doc_id, CASE WHEN length(text) <= 110 THEN text ELSE left(text, 109) || '…' END AS short FROM documents")
def f_truncate_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_chars(F.col("text"), 110).alias("short"))


@query(
    "SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i) FILTER (used <= 80), '') AS cut FROM (SELECT doc_id, c, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS used "
    "FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents)) GROUP BY 1"
)
def f_truncate_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_bytes(F.col("text"), 80).alias("cut"))


@query(f"SELECT doc_id, md5({_FOLD_SQL}) AS gloss FROM documents")
def f_clean_gloss(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold_gloss(F.coalesce("text", F.lit(""))).cast("binary")).alias("gloss"))


@query("SELECT id, list_transform(string_split(registers, ','), lambda x: trim(x)) AS parts FROM lex WHERE registers IS NOT NULL", LEX_SQL)
def f_split_list(spark, sf):
    return lexicon(spark, sf).where("registers is not null").select("id", text.split_list(F.col("registers")).alias("parts"))


# joins


_QUERY_TOKENS = ", ".join(f"'{t}'" for t in QUERY.split())


@query(f"SELECT lex.id, word AS via, t AS term FROM lex JOIN tok ON lex.id = tok.id WHERE word IN ({_QUERY_TOKENS}, 'the')", LEX_SQL, GLOSS_SQL)
def jn_bridge(spark, sf):
    named = lexicon(spark, sf).where(F.lower("word").isin([*QUERY.split(), "the"]))
    return named.select("id", F.lower("word").alias("via"), F.explode(text.gloss_tokens(F.col("tags"))).alias("term"))


@query("SELECT src, rel, dst, weight FROM edg WHERE src IN ('the', 'that', 'th')", EDG_SQL)
def jn_edges_from(spark, sf):
    return store.edges_from(first_edges(spark, sf), ["the", "that", "th"]).select("src", "rel", "dst", "weight")


@query(f"SELECT id, word FROM lex WHERE word NOT IN ({_QUERY_TOKENS}, 'the', 'the', 'les')", LEX_SQL)
def jn_anti_echo(spark, sf):
    at = lexicon(spark, sf)
    latin = translit.fold_diacritics(F.lower("translit"))
    return at.where(~rank.is_echo([*QUERY.split(), "the", "les"], F.lower("word"), latin)).select("id", "word")


@query(
    "SELECT DISTINCT c.term, v.t AS token FROM (SELECT DISTINCT t FROM tok) v JOIN (VALUES ('theation'), ('erening'), ('tion'), ('thans')) c(term) ON "
    f"{SINGULAR.format('c.term')} = {SINGULAR.format('v.t')} OR (strlen({SINGULAR.format('c.term')}) >= 5 AND strlen({SINGULAR.format('v.t')}) >= 5 AND "
    f"(starts_with({SINGULAR.format('c.term')}, {SINGULAR.format('v.t')}) OR starts_with({SINGULAR.format('v.t')}, {SINGULAR.format('c.term')})))",
    LEX_SQL,
    GLOSS_SQL,
)
def jn_fuzzy_terms(spark, sf):
    vocabulary = rank.document_frequency(lexicon(spark, sf)).select("token")
    terms = F.array(*map(F.lit, ["theation", "erening", "tion", "thans"]))
    return vocabulary.select("token", F.explode(F.filter(terms, lambda c: text.terms_match(c, F.col("token")))).alias("term"))


@query(
    "SELECT id, token, (contains(etymology, token))::INT AS in_etymology, (system = token OR (strlen(token) >= 3 AND strlen(system) >= 3 AND (starts_with(system, token) OR starts_with(token, system))))::INT AS in_system "
    "FROM lex, (VALUES ('thon'), ('src1')) q(token)",
    LEX_SQL,
)
def jn_token_texts(spark, sf):
    at = lexicon(spark, sf).select("id", "system", "etymology", F.explode(F.array(F.lit("thon"), F.lit("src1"))).alias("token"))
    of_system = (text.score_text(F.col("system"), F.col("token"), 2.0, 2.0) > 0).cast("int")
    return at.select("id", "token", F.contains("etymology", "token").cast("int").alias("in_etymology"), of_system.alias("in_system"))


# retrieval


_SUGGEST_SQL = """SELECT word FROM (SELECT word, min(struct_pack(a := tok, b := id)) AS k FROM (SELECT word, id, CASE WHEN starts_with(word, 'the') OR levenshtein(word, 'theon') <= 2 THEN 0
 WHEN starts_with(word, 'ere') OR levenshtein(word, 'ereti') <= 2 THEN 1 END AS tok FROM lex_ascii) WHERE tok IS NOT NULL GROUP BY word ORDER BY k LIMIT 12)"""


@query(_SUGGEST_SQL, LEX_SQL, r"lex_ascii AS (SELECT * FROM lex WHERE regexp_full_match(word, '[a-z]*'))")
def rt_suggest(spark, sf):
    return rank.suggest(lexicon(spark, sf).where(F.col("word").rlike("^[a-z]*$")), "theon ereti", 12)


@query()
def rt_suggest_all(spark, sf):
    """The whole lexicon; DuckDB's levenshtein counts bytes, so there is no SQL."""
    return rank.suggest(lexicon(spark, sf), "theon ereti", 12)


def _rank_sql(limit: int | None = None) -> str:
    """Tokens without bridge and edges: they have four bytes, so no two of them can claim the same gloss token."""
    tail = f"ORDER BY score DESC, seed_weight DESC, word, id LIMIT {limit}" if limit else ""
    return f"""
SELECT id, score FROM (SELECT lex.id, seed_weight, word, round(sum(part) * (seed_weight * CASE WHEN contains(registers, 'poetic') OR contains(registers, 'literary') THEN 1.15 ELSE 1.0 END::DOUBLE)
   * CASE WHEN bool_or(contains(word, e.token)) THEN 0.3 ELSE 1.0 END::DOUBLE, 6) AS score
 FROM (SELECT lex.id AS id, q.token, CASE WHEN starts_with(word, q.token) OR (strlen(word) >= 3 AND starts_with(q.token, word)) THEN 1.5 ELSE 0 END::DOUBLE
   + CASE WHEN contains(etymology, q.token) THEN 1.0 ELSE 0 END::DOUBLE + coalesce(1.2 * g.idf, 0)::DOUBLE AS part
   FROM lex CROSS JOIN q LEFT JOIN g ON g.id = lex.id AND g.token = q.token) e
 JOIN lex ON lex.id = e.id WHERE word NOT IN ({_QUERY_TOKENS}) GROUP BY lex.id, seed_weight, word, registers HAVING sum(part) > 0) {tail}"""


_TOKPOS_SQL = rf"""tokpos AS (SELECT id, t, min(pos) AS pos FROM (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT id, {TOKENS_SQL.format('tags')} AS w FROM lex)) GROUP BY 1, 2),
df AS (SELECT t, 1 + least(greatest(ln((SELECT count(*) FROM lex)::DOUBLE / count(*)), 0), 5) AS idf FROM tok GROUP BY 1),
q AS (SELECT unnest([{_QUERY_TOKENS}]) AS token),
g AS (SELECT DISTINCT ON (tokpos.id, q.token) tokpos.id, q.token, idf FROM tokpos JOIN q ON {SINGULAR.format("t")} = q.token JOIN df USING (t) ORDER BY tokpos.id, q.token, tokpos.pos)"""


def _ranked(spark, sf):
    return rank.rank_semantic(lexicon(spark, sf), QUERY)


@query(_rank_sql(), LEX_SQL, GLOSS_SQL, _TOKPOS_SQL)
def rt_rank_tokens(spark, sf):
    return _ranked(spark, sf).select("id", F.round("score", 6).alias("score"))


@query(_rank_sql(20), LEX_SQL, GLOSS_SQL, _TOKPOS_SQL)
def ol_top_k(spark, sf):
    return rank.top_k(_ranked(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


@query()
def rt_no_hit(spark, sf):
    return rank.no_hit(lexicon(spark, sf), "theon ereti")


# writes


@query(
    "SELECT id, word, system, seed_weight FROM (SELECT language || '_' || word AS id, word, system, seed_weight, row_number() OVER (PARTITION BY language, word ORDER BY doc_id DESC) AS n FROM lex) WHERE n = 1",
    LEX_SQL,
)
def sk_upsert_last(spark, sf):
    lex = lexicon(spark, sf)
    keyed = lex.withColumns({"ingest_seq": F.substring_index("id", "_", -1).cast("long"), "id": store.word_id(F.col("language"), F.col("word"))})
    return store.upsert_words(None, keyed).select("id", "word", "system", "seed_weight")


@query("SELECT src, rel, dst, weight, source FROM edg", EDG_SQL)
def sk_edges_first(spark, sf):
    return store.insert_edges(None, edges(spark, sf))


@query("SELECT word, count(*) AS n FROM (SELECT word FROM lex WHERE system = 'src1' UNION ALL SELECT word FROM lex WHERE system = 'src2') GROUP BY 1", LEX_SQL)
def st_union_sources(spark, sf):
    lex = lexicon(spark, sf).withColumn("seq", F.substring_index("id", "_", -1).cast("long"))
    parts = [store.in_systems(lex, [name]).withColumn("k", F.lit(k)) for k, name in enumerate(("src1", "src2"))]
    return dictionary.merge(spark, parts, LEXICON).groupBy("word").agg(F.count("*").alias("n"))


@query()
def sk_json(spark, sf):
    return sinks.json_lines(rank.top_k(_ranked(spark, sf), 20))


# sources


SPEC = SourceSpec("docs", "wiktextract-jsonl", "", "xx", "docs_xx", skip_classes=("adj",))


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(table(spark, sf, "documents"))


def lines_of(docs: DataFrame) -> DataFrame:
    """Documents as dictionary lines: the first word is the headword, all words of the text are senses and links."""
    docs = docs.withColumn("w", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), text.NOT_ALNUM), lambda w: w != ""))
    pos = F.get(F.array(*map(F.lit, ["noun", "adj", "name", "verb"])), (F.col("doc_id") % 4).cast("int"))
    link = lambda words: F.transform(words, lambda w: F.struct(w.alias("word")))
    senses = F.array(F.struct(F.array("text").alias("glosses"), F.array(F.lit("poetic")).alias("tags"), link(F.slice("w", 2, 3)).alias("related")))
    line = F.to_json(F.struct(F.try_element_at("w", F.lit(1)).alias("word"), pos.alias("pos"), senses.alias("senses"), link("w").alias("synonyms"), F.col("text").alias("etymology_text")))
    return docs.select(F.col("doc_id").alias("ordinal"), line.alias("value"))


JSON_SQL = r"""doc AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, ['noun', 'adj', 'name', 'verb'][(doc_id % 4 + 1)::INT] AS pos FROM documents),
ok AS (SELECT *, w[1] AS word FROM doc WHERE length(w[1]) BETWEEN 2 AND 30 AND pos IN ('noun', 'name'))"""


@query("SELECT doc_id AS ordinal, 'xx_' || word AS id, CASE pos WHEN 'name' THEN 'proper' ELSE pos END AS word_class, 'poetic' AS registers FROM ok", JSON_SQL)
def sc_json_lines(spark, sf):
    return dictionary.words_of(dictionary.parse_lines(json_lines(spark, sf), SPEC)).select("ordinal", "id", "word_class", "registers")


@query(
    "SELECT DISTINCT doc_id AS ordinal, word AS src, rel, dst, weight FROM (SELECT doc_id, word, 'synonym' AS rel, 0.8::DOUBLE AS weight, unnest(w[1:12]) AS dst FROM ok "
    "UNION ALL SELECT doc_id, word, 'verwandt', 0.6::DOUBLE, unnest(w[2:4]) FROM ok) WHERE dst <> word AND length(dst) <= 30",
    JSON_SQL,
)
def sc_edges(spark, sf):
    return dictionary.edge_rows(dictionary.parse_lines(json_lines(spark, sf), SPEC)).select("ordinal", "src", "rel", "dst", "weight")


@query("SELECT doc_id AS ordinal, word FROM ok ORDER BY doc_id LIMIT 50", JSON_SQL)
def sc_first_accepted(spark, sf):
    taken = dictionary.take_accepted(dictionary.parse_lines(json_lines(spark, sf), SPEC), 50)
    return dictionary.words_of(taken).select("ordinal", "word")


@query("SELECT 'grc_' || r_name AS id, lower(r_name) || ',' || lower(replace(r_comment, ',', '')) AS tags, 'griech. ' || r_name AS etymology FROM r WHERE length(r_name) BETWEEN 2 AND 30 AND NOT contains(r_name, ' ')", "r AS (SELECT n_name AS r_name, n_name || ' nation' AS r_comment FROM nation)")
def sc_mythology(spark, sf):
    item = F.struct(F.col("n_name").alias("name"), F.col("n_name").alias("category"), F.concat("n_name", F.lit(" nation")).alias("description"), F.col("n_name").alias("greekName"))
    body = table(spark, sf, "nation").agg(F.to_json(F.collect_list(item)).alias("value"))
    spec = SourceSpec("myth", "mythology-json", "", "grc", "myth_greek")
    return dictionary.parse_mythology(body, spec).where("accepted").select("id", "tags", "etymology")


@query("SELECT event_id, json_extract_string(props, '$') IS NOT NULL AS valid FROM events")
def sc_json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"))


@query("SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: NOT regexp_matches(w, '\\s'))[1:5] AS words FROM conversations WHERE len(string_split(text, ' ')) <= 10")
def sc_expansion(spark, sf):
    return _expansion(table(spark, sf, "conversations").where(F.size(F.split("text", " ")) <= 10))


@query(r"SELECT conv_id, turn, list_filter(string_split(text, ' ')[1:10], lambda w: NOT regexp_matches(w, '\s'))[1:5] AS words FROM conversations")
def sc_expansion_all(spark, sf):
    """Every row, so that the cut at the first ten items shows."""
    return _expansion(table(spark, sf, "conversations"))


def _expansion(at: DataFrame) -> DataFrame:
    body = F.to_json(F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("score"))))
    return at.select("conv_id", "turn", dictionary.expansion_words(body, 5).alias("words"))


# names


@query()
def gn_default(spark, sf):
    return namegen.generate(lexicon(spark, sf), 20, seed=42)


@query()
def gn_template(spark, sf):
    return namegen.generate(lexicon(spark, sf), 20, 42, "{prefix} {word} of the {suffix_adj} {suffix}")


@query()
def gn_system(spark, sf):
    """The filter by system is the feature."""
    return namegen.generate(store.in_systems(lexicon(spark, sf), ["src1"]), 3, 42)


@query()
def gn_attempts(spark, sf):
    return namegen.attempts(lexicon(spark, sf), 7, 10)


@query()
def gn_json(spark, sf):
    return sinks.names_json(namegen.generate(lexicon(spark, sf), 5, seed=42))
