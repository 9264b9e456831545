"""Personal data: detection and keyed, type-consistent surrogates, all in built-in functions.

One pattern finds entities from left to right; the text between them is kept as it is. Surrogates:

* numbers (phones, cards, social security numbers, IPv4 addresses): a keyed Feistel permutation of the digits, so
  different numbers of one format stay different by construction; layout, country code and a card's check digit hold;
* mail addresses: keyed letters and digits for the mailbox and, separately, for the domain, so that addresses of one domain
  stay together; case does not matter;
* secrets: a keyed Feistel permutation in which every letter and digit stays in its own class (digit, capital, small letter, hexadecimal
  digit of a hexadecimal string), so different secrets of one shape stay different by construction; the name of an assignment, the
  prefix of a typical key and all other characters hold. A secret without any letter or digit becomes a keyed string of its length;
* names after a form of address: a given name of the same gender (or of either, after a title) and script and a surname built from
  syllables, whose first half follows the surname alone. Later in the text, and before, the bare full name and the bare surname
  of such a person are replaced by the same surrogate (of several persons with one surname by the first one's); they are not counted as entities.

The same entity gets the same surrogate everywhere (coreference). Distinctness is checked over the whole corpus: if two
entities share a surrogate, the key moves to its next round for all, until no two do. Only mail addresses, names and
IPv4 addresses beyond 255 can collide at all, each with about 2 ** -60 a pair.

The key is a secret of the user: a parameter or ``spark.lexweave.pii.key``. Without either a random one is drawn for the session.

Defined results: a null text stays null and has no entity; an empty text stays empty; repeated rows and null keys pass
through; whole texts of any length, in one pass each; an empty table gives an empty table; all columns stay, ``text`` is
replaced and ``n_entities`` set.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise

ROUNDS = 6  # of the Feistel permutation
TRIES = 16  # rounds of the key before a collision is an error

# Forms of address by script and gender, and given names to draw from.
ADDRESS = {
    ("latin", "f"): "Mrs Ms Miss Frau Mme Madame Señora Sra",
    ("latin", "m"): "Mr Herr Monsieur Señor Sr",
    ("cyrillic", "f"): "Госпожа г-жа",
    ("cyrillic", "m"): "Господин г-н",
    ("greek", "f"): "Κυρία κα",
    ("greek", "m"): "Κύριος κ",
    ("latin", "any"): "Dr Prof Doctor Professor Doktor",
}
GIVEN = {
    ("latin", "f"): "Ada Berta Clara Dora Elena Frida Greta Hanna",
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь",
    ("greek", "f"): "Άννα Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιόλη Μαρία",
    ("greek", "m"): "Άγγελος Βασίλης Γιώργος Δήμος Ηλίας Θάνος Ίων Μάνος",
    ("latin", "any"): "Alex Chris Kim Lou Noa Robin Sascha Toni",
}
# The classes of characters of a secret, each permuted within itself.
CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœßšž",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒŠŽ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ",
    "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏ",
)
HEXADECIMAL = "0123456789abcdef"
KEY = "spark.lexweave.pii.key"
SYLLABLES = {
    "latin": [c + v for c in "bdklmnrt" for v in "aeio"],
    "cyrillic": [c + v for c in "бдклмнрт" for v in "аеио"],
    "greek": [c + v for c in "βδκλμνρτ" for v in "αειο"],
}

_ADDRESSES = "|".join(sorted((w for words in ADDRESS.values() for w in words.split()), key=lambda w: -len(w)))
# One alternative per type; each begins at a place where it cannot have begun one character earlier.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.+%-])[\p{L}\p{N}_.+%-]++@[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]++)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)(?!\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "secret": r"\b(?i:token|secret|password|passwd|api[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{8,}|\b[0-9a-f]{32,128}\b|\bAKIA[0-9A-Z]{16}\b|\bgh[a-z]_[A-Za-z0-9]{36}\b",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_ADDRESSES})\.? \p{{Lu}}\p{{L}}+(?:[ -]\p{{Lu}}\p{{L}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has a digit, an at sign, a secret's assignment or prefix, a run of hexadecimal letters or a form of address; texts without any are not searched further.
MAYBE = rf"[0-9@]|[:=]\s{{0,3}}[\"']?[^\s\"']{{8}}|AKIA|gh[a-z]_|[a-f]{{32}}|(?:{_ADDRESSES})"


_CLASSED = "[" + "".join(CLASSES) + "]"


def _number(key: Column, *parts: Column | str) -> Column:
    """A keyed number of 60 bits."""
    said = F.concat_ws("|", key, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def _permute(a: Column, b: Column, base_a: Column, base_b: Column, key: Column, kind: str) -> Column:
    """Keyed permutation of the pairs (a, b) with a < base_a and b < base_b."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + F.pmod(_number(key, kind, i, s["b"]), base_a), base_a)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_number(key, kind, i, s["a"]), base_b), base_b)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + F.lit(1), "0").cast("long")


def _digits(digits: Column, key: Column, kind: str) -> Column:
    """Keyed permutation of a string of digits among those of its length."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    part = lambda s, at, n: F.coalesce(s.substr(at, n).try_cast("long"), F.lit(0).cast("long"))
    swapped = _permute(part(digits, F.lit(1), half), part(digits, half + F.lit(1), rest), _ten_to(half), _ten_to(rest), key, kind)
    return let(swapped, lambda s: F.concat(F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(""), F.lpad(s["b"].cast("string"), rest, "0")))


def _luhn(digits: Column) -> Column:
    """Check digit that follows ``digits``."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(each, F.lit(0), lambda t, x: t + x), F.lit(10)), F.lit(10))


def _lay_out(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, digits.substr(s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(text, ""), start, step)["out"]


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _letters(key: Column, kind: str, what: Column, n: int) -> Column:
    """``n`` keyed letters and digits, five bits each, twelve per keyed number."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz234567")

    def spell(count: int):
        return lambda x: F.concat(*[F.substring(alphabet, F.shiftright(x, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(count)])

    return F.concat(*[let(_number(key, kind, str(at), what), spell(min(12, n - at))) for at in range(0, n, 12)])


def _phone(e: Column, key: Column) -> Column:
    """The last ten digits change, so that a number meets itself with and without its country code."""
    return let(_only_digits(e), lambda d: _lay_out(e, F.concat(F.expr("''"), d.substr(F.lit(1), F.greatest(F.length(d) - 10, F.lit(0))), _digits(F.right(d, F.lit(10)), key, "phone"))))


def _card(e: Column, key: Column) -> Column:
    def change(d: Column) -> Column:
        body, last = d.substr(F.lit(1), F.length(d) - 1), F.right(d, F.lit(1)).cast("int")
        return let(_digits(body, key, "card"), lambda new: _lay_out(e, F.concat(new, F.pmod(_luhn(new) + last - _luhn(body), F.lit(10)).cast("string"))))

    return let(_only_digits(e), change)


def _ip(e: Column, key: Column) -> Column:
    def change(p: Column) -> Column:
        octet = [F.least(F.get(p, F.lit(i)).cast("long"), F.lit(999)) for i in range(4)]
        fits = (octet[0] < 256) & (octet[1] < 256) & (octet[2] < 256) & (octet[3] < 256)
        base = F.when(fits, F.lit(256)).otherwise(F.lit(1000)).cast("long")
        swapped = _permute(octet[0] * base + octet[1], octet[2] * base + octet[3], base * base, base * base, key, "ip")
        return let(F.struct(swapped.alias("s"), base.alias("n")), lambda x: F.concat_ws(".", *[f for side in ("a", "b") for f in (F.floor(x["s"][side] / x["n"]), F.pmod(x["s"][side], x["n"]))]))

    return let(F.split(e, r"\."), change)


def _email(e: Column, key: Column) -> Column:
    whole = F.lower(e)
    domain = F.substring_index(whole, "@", -1)
    return F.concat(_letters(key, "mailbox", whole, 14), F.lit("@"), _letters(key, "domain", domain, 10), F.lit(".example"))


def _moved(text: Column, stream: Column, classes: tuple[str, ...]) -> Column:
    """Every character moved within its class by two hexadecimal digits of the stream."""

    def move(i: Column) -> Column:
        by = F.conv(F.substring(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")

        def within(c: Column) -> Column:
            out = c
            for some in classes:
                at = F.position(c, F.lit(some))
                out = F.when(at > 0, F.substring(F.lit(some), F.pmod(at - 1 + by, F.lit(len(some))) + 1, F.lit(1))).otherwise(out)
            return out

        return let(F.substring(text, i, F.lit(1)), within)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), move), "")).otherwise("")


def _shuffled(value: Column, key: Column, kind: str, classes: tuple[str, ...]) -> Column:
    """Keyed permutation of a string among those with its pattern of classes."""

    def stream(i: Column, other: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), b.cast("string"), other), 256)), "")

    def step(s: Column, i: Column) -> Column:  # one side moves by the other, then they change places; after an even number they are back
        return F.struct(s["b"].alias("a"), _moved(s["a"], stream(i, s["b"], F.length(s["a"])), classes).alias("b"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["a"], s["b"]))


def _secret(e: Column, key: Column) -> Column:
    """The value changes; the name of an assignment and the prefix of a typical key stay."""
    before = F.regexp_extract(e, r"^(?:(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)?(?:AKIA(?=[0-9A-Z]{16}$)|gh[a-z]_(?=[A-Za-z0-9]{36}$))?", 0)

    def change(value: Column) -> Column:
        hexed = F.when(value.rlike("^[0-9a-f]{32,128}$"), _shuffled(value, key, "hex", (HEXADECIMAL,))).otherwise(_shuffled(value, key, "secret", CLASSES))
        bare = F.repeat(F.sha2(F.concat_ws("|", key, F.lit("bare"), value), 256), F.ceil(F.length(value) / 64).cast("int")).substr(F.lit(1), F.length(value))
        return F.when(value.rlike(_CLASSED), hexed).otherwise(bare)

    return F.concat(before, let(e.substr(F.length(before) + F.lit(1), F.length(e)), change))


def _person(e: Column) -> Column:
    """The name without its form of address."""
    return F.regexp_replace(e, rf"^(?:{_ADDRESSES})\.? ", "")


def _surname(person: Column) -> Column:
    return F.substring_index(person, " ", -1)


def _name(e: Column, key: Column) -> Column:
    """Form of address, given name, surname of two halves: the first follows the surname alone, the second the whole name."""
    address = F.regexp_extract(e, rf"^(?:{_ADDRESSES})\.?", 0)
    bare = F.regexp_replace(address, r"\.$", "")
    out = F.lit(None).cast("string")
    person = _person(e)

    def family(part: str, of: Column, syllables: Column) -> Column:
        said = lambda x: F.initcap(F.concat(*[F.get(syllables, F.shiftright(x, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(6)]))
        return let(_number(key, "name", part, of), said)

    for (script, gender), forms in ADDRESS.items():
        given, syllables = F.array(*map(F.lit, GIVEN[script, gender].split())), F.array(*map(F.lit, SYLLABLES[script]))
        first = F.get(given, F.pmod(_number(key, "given", person), F.lit(len(GIVEN[script, gender].split()))).cast("int"))
        made = F.concat(address, F.lit(" "), first, F.lit(" "), family("1", _surname(person), syllables), F.lit("-"), family("2", person, syllables))
        out = F.when(bare.isin(forms.split()), made).otherwise(out)
    return out


def kind_of(entity: Column) -> Column:
    """Type of a found entity, in the order of the pattern's alternatives."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def normalised(entity: Column, kind: Column) -> Column:
    """What tells one entity from another: case of a mail address and layout of a phone number do not."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "phone", let(_only_digits(entity), lambda d: F.when(F.length(d) > 10, d).otherwise(F.right(d, F.lit(10)))))
        .when(kind == "name", _person(entity))
        .otherwise(entity)
    )


def surrogate(entity: Column, key: Column) -> Column:
    return let(
        F.struct(entity.alias("e"), kind_of(entity).alias("k")),
        lambda x: F.when(x["k"] == "email", _email(x["e"], key))
        .when(x["k"] == "ip", _ip(x["e"], key))
        .when(x["k"] == "ssn", _lay_out(x["e"], _digits(_only_digits(x["e"]), key, "ssn")))
        .when(x["k"] == "phone", _phone(x["e"], key))
        .when(x["k"] == "card", _card(x["e"], key))
        .when(x["k"] == "secret", _secret(x["e"], key))
        .otherwise(_name(x["e"], key)),
    )


def is_entity(e: Column) -> Column:
    """False for a number in the form of a card whose check digit is wrong: no card has it."""

    def checks(d: Column) -> Column:
        return _luhn(d.substr(F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)).cast("int")

    return F.when(e.rlike(f"^(?:{PATTERNS['card']})$"), let(_only_digits(e), checks)).otherwise(True)


def found_in(text: Column) -> Column:
    """Entities of a text in order."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def collision_free_round(df: DataFrame, text_col: str, key: str) -> int:
    """The first round of the key under which no two entities of the corpus share a surrogate."""
    entities = df.select(F.explode(found_in(F.col(text_col))).alias("e")).distinct()
    entities = materialise(entities, "pii-entities")
    for i in range(TRIES):
        made = entities.select(kind_of(F.col("e")).alias("k"), "e", surrogate(F.col("e"), F.lit(f"{key}#{i}")).alias("s"))
        same = made.select("k", F.xxhash64(normalised(F.col("e"), F.col("k"))).alias("n"), F.when(F.col("k") == "phone", _only_digits(F.col("s"))).when(F.col("k") == "name", _person(F.col("s"))).otherwise(F.col("s")).alias("s"))
        clash = same.groupBy("k", "s").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a <> b")
        if clash.isEmpty():
            return i
    raise ValueError(f"two entities share a surrogate under each of {TRIES} rounds of the key")


def session_key(spark: SparkSession) -> str:
    """The session's key: its setting, or a random one that holds for the session."""
    if not (key := spark.conf.get(KEY, None)):
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def _mentions(found: Column, key: Column) -> Column:
    """(said, surrogate) of the bare mentions that the names found give away: full names first, then each surname's first person."""
    names = F.array_distinct(F.filter(found, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$")))
    people = F.transform(names, lambda e: F.struct(_person(e).alias("said"), _person(_name(e, key)).alias("s")))

    def listed(people: Column) -> Column:
        last = F.transform(people, lambda p: F.struct(_surname(p["said"]).alias("said"), _surname(p["s"]).alias("s")))
        return F.concat(F.filter(people, lambda p: p["said"].contains(" ")), F.filter(last, lambda p: F.length(p["said"]) > 2))

    return let(people, listed)


def _unnamed(piece: Column, mentions: Column) -> Column:
    return F.aggregate(mentions, piece, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), p["said"], F.lit(r"(?![\p{L}\p{N}])")), p["s"]))


def replace(df: DataFrame, text_col: str = "text", key: str | None = None, check_digits: bool = False) -> DataFrame:
    """``df`` with surrogates in ``text_col`` and the number of entities in ``n_entities``; without ``key`` the session's is used.

    With ``check_digits`` numbers of 13 to 19 digits are cards only if their check digit is right, and stay as they are otherwise.
    """
    key = session_key(df.sparkSession) if key is None else key
    used = F.lit(f"{key}#{collision_free_round(df, text_col, key)}")
    text = F.col(text_col)
    at = df.withColumn("__found", F.coalesce(found_in(text), F.array().cast("array<string>")))

    changes = (lambda e: F.when(is_entity(e), surrogate(e, used)).otherwise(e)) if check_digits else (lambda e: surrogate(e, used))

    def put(found: Column) -> Column:
        def joined(mentions: Column) -> Column:
            between = F.split(text, ANY, -1)
            said = lambda p: F.when(F.size(mentions) > 0, _unnamed(p, mentions)).otherwise(p)
            return F.array_join(F.transform(between, lambda p, i: F.concat(said(p), F.when(i < F.size(found), let(F.get(found, i), changes)).otherwise(""))), "")

        return let(_mentions(found, used), joined)

    changed = F.when(F.size("__found") == 0, text).otherwise(put(F.col("__found")))
    n = F.size(F.filter("__found", is_entity)) if check_digits else F.size("__found")
    return at.withColumns({text_col: changed, "n_entities": n.cast("long")}).drop("__found")
