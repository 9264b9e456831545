"""Dictionary dumps: JSON lines and one JSON array, read as variants, to lexicon rows and association edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_etymology, clean_gloss, fold_gloss, truncate_bytes
from ..functions.translit import to_latin
from ..operators.store import insert_edges, upsert_words
from ..schema import EDGES, LEXICON, conform
from ..session import stored
from .specs import SourceSpec

# Parts of speech and their classes; tags of senses that only point elsewhere; registers worth keeping;
# link fields with relation and weight.
CLASSES = {"noun": "noun", "adj": "adj", "name": "proper"}
JUNK_TAGS = "misspelling abbreviation initialism acronym alt-of form-of".split()
REGISTERS = "figurative figuratively poetic literary archaic dated".split()
LINKS = {"synonyms": ("synonym", 0.8), "related": ("verwandt", 0.6), "derived": ("ableitung", 0.5), "antonyms": ("gegenteil", 0.4), "coordinate_terms": ("nachbar", 0.5)}
LINKS_PER_FIELD, GLOSSES, MYTH_BYTES = 12, 2, 160

_BLANK = r"(?U)\s"
_EDGE = "array<struct<rel:string,dst:string,weight:double>>"


def _text(v: Column, path: str) -> Column:
    """The string at a path; null if it is absent or of another type."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str) -> Column:
    return F.filter(F.transform(_items(v, path), lambda t: _text(t, "$")), lambda t: t.isNotNull())


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def valid_word(word: Column) -> Column:
    return F.coalesce(F.char_length(word).between(2, 30) & ~word.rlike(_BLANK), F.lit(False))


def sense_is_junk(sense: Column) -> Column:
    """A field ``form_of`` or ``alt_of``, even null, or one of the tags."""
    named = F.try_variant_get(sense, "$.form_of", "variant").isNotNull() | F.try_variant_get(sense, "$.alt_of", "variant").isNotNull()
    return named | F.arrays_overlap(_texts(sense, "$.tags"), F.array(*map(F.lit, JUNK_TAGS)))


def sense_registers(sense: Column) -> Column:
    kept = F.filter(_texts(sense, "$.tags"), lambda t: t.isin(REGISTERS))
    return F.transform(kept, lambda t: F.when(t == "figuratively", "figurative").otherwise(t))


def _links(v: Column, src: Column) -> Column:
    parts = []
    for name, (rel, weight) in LINKS.items():
        # by path, so that an entry's longest lists are never read whole
        words = F.array(*[_text(v, f"$.{name}[{i}].word") for i in range(LINKS_PER_FIELD)])
        usable = F.filter(F.transform(words, _trim), lambda w: w.isNotNull() & (w != "") & ~w.rlike(_BLANK) & (F.char_length(w) <= 30) & (F.lower(w) != src))
        parts.append(_as_edges(usable, rel, weight))
    return F.concat(*parts)


def _as_edges(words: Column, rel: str, weight: float) -> Column:
    return F.transform(words, lambda w: F.struct(F.lit(rel).alias("rel"), F.lower(w).alias("dst"), F.lit(weight).alias("weight"))).cast(_EDGE)


def edges_of(entry: Column, word: Column) -> Column:
    """Links of an entry and of all its senses, each (relation, target) once, in order."""
    src = F.lower(word)
    of_senses = F.flatten(F.transform(_items(entry, "$.senses"), lambda s: _links(s, src)))
    return F.sort_array(F.array_distinct(F.concat(_links(entry, src), of_senses)))


def romanization(entry: Column) -> Column:
    marked = F.filter(_items(entry, "$.forms"), lambda f: F.array_contains(_texts(f, "$.tags"), "romanization") & (F.coalesce(_trim(_text(f, "$.form")), F.lit("")) != ""))
    return _trim(_text(F.try_element_at(marked, F.lit(1)), "$.form"))


def _entry(v: Column, spec: SourceSpec) -> Column:
    """All that is read from one entry, given its variant bound once."""
    word, pos, language = _text(v, "$.word"), _text(v, "$.pos"), F.lit(spec.language)
    kind = F.lit(None).cast("string")
    for name, to in CLASSES.items():
        kind = F.when(pos == name, F.lit(to)).otherwise(kind)
    usable = F.filter(
        F.transform(_items(v, "$.senses"), lambda s: F.struct(F.when(~sense_is_junk(s), clean_gloss(_text(s, "$.glosses[0]"))).alias("gloss"), sense_registers(s).alias("registers"))),
        lambda s: s["gloss"].isNotNull(),
    )
    head = F.struct(word.alias("word"), kind.alias("kind"), (pos.isNull() | kind.isNotNull()).alias("known"), F.slice(usable, 1, GLOSSES).alias("kept"))

    def rest(x: Column) -> Column:
        skipped = F.coalesce(x["kind"].isin(list(spec.skip_classes)), F.lit(False)) if spec.skip_classes else F.lit(False)
        accepted = v.isNotNull() & valid_word(x["word"]) & x["known"] & ~skipped & (F.size(x["kept"]) > 0)
        registers = F.array_distinct(F.flatten(F.transform(x["kept"], lambda s: s["registers"])))
        made = {
            "id": F.concat(language, F.lit("_"), x["word"]),
            "word": x["word"],
            "word_class": x["kind"],
            "language": language,
            "system": F.lit(spec.system),
            "tags": F.array_join(F.transform(x["kept"], lambda s: s["gloss"]), ","),
            "seed_weight": F.lit(1.0),
            "source": F.lit(spec.id),
            "etymology": clean_etymology(_text(v, "$.etymology_text")),
            "origin_lang": F.lit(None).cast("string"),
            "translit": F.coalesce(romanization(v), to_latin(x["word"], language)),
            "registers": F.nullif(F.array_join(registers, ","), F.lit("")),
        }
        edges = F.when(accepted, edges_of(v, x["word"])).otherwise(F.array().cast(_EDGE))
        return F.struct(v.isNotNull().alias("valid"), F.coalesce(accepted, F.lit(False)).alias("accepted"), *[made[c].alias(c) for c in LEXICON.fieldNames()], edges.alias("edges"))

    return F.transform(F.array(head), rest)[0]


def parse_lines(lines: DataFrame, spec: SourceSpec, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, bytes, valid, accepted, lexicon columns, edges) for every line that isn't blank.

    A line is parsed once: its variant is a lambda's variable, and the row comes out of a generator, which later filters
    cannot move into.
    """
    at = lines.where(F.col(value).rlike(r"(?U)\S"))
    made = F.transform(F.array(F.try_parse_json(value)), lambda v: _entry(v, spec))
    size = (F.octet_length(value) + 1).cast("long").alias("bytes")  # with the line feed
    return at.select(ordinal, size, F.explode(made).alias("p")).select(ordinal, "bytes", "p.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): the lines of a text file, gzip or plain, with their order in the file; of a folder, file by file in order of names."""
    raw = spark.read.text(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return raw.select(place.alias("ordinal"), "value")


def take_accepted(parsed: DataFrame, most: int) -> DataFrame:
    """Lines up to the one that reaches ``most`` accepted words; at least one line is always read."""
    if most <= 0:
        return parsed.orderBy("ordinal").limit(1)
    last = parsed.where("accepted").select("ordinal").orderBy("ordinal").limit(most)
    end = last.agg(F.max("ordinal").alias("end"), F.count("*").alias("n")).first()
    if end["n"] < most:
        return parsed
    kind = parsed.schema["ordinal"].dataType.simpleString()
    stop = F.lit(end["end"]) if not hasattr(end["end"], "asDict") else F.struct(*[F.lit(x) for x in end["end"]]).cast(kind)
    return parsed.where(F.col("ordinal") <= stop)


def words_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("accepted").select("ordinal", *LEXICON.fieldNames())


def edge_rows(parsed: DataFrame) -> DataFrame:
    """(ordinal, edges columns): one row for each edge of an accepted line."""
    at = parsed.where("accepted").select("ordinal", F.lower("word").alias("src"), "source", F.posexplode("edges").alias("pos", "e"))
    return at.select("ordinal", "pos", "src", F.col("e.rel").alias("rel"), F.col("e.dst").alias("dst"), F.col("e.weight").alias("weight"), "source")


def parse_mythology(body: DataFrame, spec: SourceSpec, value: str = "value") -> DataFrame:
    """(ordinal, accepted, lexicon columns) for the items of one JSON array; a body that is no array is an error."""
    items = F.variant_get(F.parse_json(value), "$", "array<variant>")
    at = body.select(F.posexplode(items).alias("ordinal", "__v"))
    v = F.col("__v")
    name = _trim(_text(v, "$.name"))
    folded = [F.nullif(fold_gloss(_text(v, "$.category")), F.lit("")), truncate_bytes(F.nullif(fold_gloss(_text(v, "$.description")), F.lit("")), MYTH_BYTES)]
    form = lambda path, label: F.concat(F.lit(label), F.nullif(_trim(_text(v, path)), F.lit("")))
    roots = F.nullif(F.concat_ws(", ", form("$.greekName", "griech. "), form("$.romanName", "roem. ")), F.lit(""))
    language = F.lit(spec.language)
    at = at.withColumns(
        {
            "word": name,
            "tags": F.nullif(F.concat_ws(",", *folded), F.lit("")),
            "id": F.concat(language, F.lit("_"), name),
            "word_class": F.lit("proper"),
            "language": language,
            "system": F.lit(spec.system),
            "seed_weight": F.lit(1.1),
            "source": F.lit(spec.id),
            "etymology": truncate_bytes(roots, MYTH_BYTES),
            "origin_lang": F.lit("grc"),
        }
    ).withColumn("accepted", valid_word(F.col("word")) & F.col("tags").isNotNull())
    full = conform(at, LEXICON)
    return at.select("ordinal", "accepted", *[F.col(c) if c in at.columns else F.lit(None).cast(full.schema[c].dataType).alias(c) for c in LEXICON.fieldNames()])


def fetch(spark: SparkSession, specs: list[SourceSpec], paths: dict[str, str]) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(words, edges, report): every source parsed once, keyed and merged; a source that fails is reported and left out.

    ``paths`` says where the file of each source lies. The report has a row for each source in their order: lines accepted and
    skipped, edges sent, and bytes read (of lines as they are decoded, up to the last one that was read).
    """
    words, edges, report = [], [], []
    for k, spec in enumerate(specs):
        try:
            if spec.backend == "mythology-json":
                body = spark.read.text(paths[spec.id], wholetext=True)
                parsed = stored(parse_mythology(body, spec), f"parsed-{spec.id}")
                some = parsed.where("accepted").orderBy("ordinal").limit(spec.max_words)
                place = F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_block_start"), F.col("ordinal").cast("long").alias("n"))  # as in read_lines
                found, links = some.withColumn("seq", place).drop("ordinal", "accepted"), None
                read = parsed.agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("s")).first()
                size = body.agg(F.sum(F.octet_length("value")).alias("b")).first()["b"]
                counts = {"accepted": min(read["a"], spec.max_words), "skipped": read["s"], "edges": 0, "bytes": size or 0}
            else:
                lines = read_lines(spark, paths[spec.id])
                parsed = stored(parse_lines(lines, spec), f"parsed-{spec.id}")
                taken = take_accepted(parsed, spec.max_words)
                found = words_of(taken).withColumnRenamed("ordinal", "seq")
                links = edge_rows(taken).withColumnRenamed("ordinal", "seq").drop("pos")
                sent = F.sum(F.when(F.col("accepted"), F.size("edges")).otherwise(0))
                read = taken.agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("s"), F.coalesce(sent, F.lit(0)).alias("e"), F.sum("bytes").alias("b")).first()
                counts = {"accepted": read["a"], "skipped": read["s"], "edges": read["e"], "bytes": read["b"] or 0}
            words.append(found.withColumn("k", F.lit(k)))
            if links is not None:
                edges.append(links.withColumn("k", F.lit(k)))
            report.append({"source": spec.id, **counts, "error": None})
        except Exception as why:  # one bad source must not stop the others
            report.append({"source": spec.id, "accepted": 0, "skipped": 0, "edges": 0, "bytes": 0, "error": str(why)[:500]})
    return merge(spark, words, LEXICON), merge(spark, edges, EDGES), report


def totals(report: list[dict]) -> dict[str, int]:
    """What all sources sent: ``inserted`` words and ``edges``, repeated keys included."""
    return {"inserted": sum(r["accepted"] for r in report), "edges": sum(r["edges"] for r in report)}


def merge(spark: SparkSession, parts: list[DataFrame], schema) -> DataFrame:
    """The union of sources in their order, keyed: words by last write, edges by first."""
    if not parts:
        return spark.createDataFrame([], schema)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    ordered = union.withColumn("ingest_seq", F.struct("k", "seq"))
    return upsert_words(None, ordered) if "id" in schema.fieldNames() else insert_edges(None, ordered)


def expansion_words(body: Column, most: int) -> Column:
    """Candidates of an expansion response: of the first ``2 * most`` items the single words, ``most`` at the most."""
    items = F.slice(F.from_json(body, "array<struct<word:string,score:double>>", {"mode": "FAILFAST"}), 1, 2 * most)
    return F.slice(F.filter(F.transform(items, lambda x: x["word"]), lambda w: w.isNotNull() & ~w.rlike(_BLANK)), 1, most)


def merge_candidates(lists: Column) -> Column:
    """Candidates of several responses in order, each once whatever its case."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, w: Column) -> Column:
        new = ~F.array_contains(s["seen"], F.lower(w))
        return F.when(new, F.struct(F.concat(s["out"], F.array(w)).alias("out"), F.concat(s["seen"], F.array(F.lower(w))).alias("seen"))).otherwise(s)

    return F.aggregate(F.flatten(lists), start, step)["out"]
