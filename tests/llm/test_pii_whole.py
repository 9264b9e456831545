"""Whole results of the PII operator against an independent fold in Python."""

import hashlib
import math

import regex
from lexweave.llm import pii
from test_pii import MADE, SECRETS

KEY = "k#0"
ANY = regex.compile(pii.ANY)
BEFORE = regex.compile(r"^(?:(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)?(?:AKIA(?=[0-9A-Z]{16}$)|gh[a-z]_(?=[A-Za-z0-9]{36}$))?")
FORMS = {w: k for k, words in pii.ADDRESS.items() for w in words.split()}


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def number(*parts):
    return int(sha(KEY, *parts)[:15], 16)


def permute(a, b, base_a, base_b, kind):
    for i in range(6):
        if i % 2 == 0:
            a = (a + number(kind, i, b) % base_a) % base_a
        else:
            b = (b + number(kind, i, a) % base_b) % base_b
    return a, b


def digits(d, kind):
    half = len(d) // 2
    a, b = permute(int(d[:half] or 0), int(d[half:] or 0), 10**half, 10 ** (len(d) - half), kind)
    return (f"{a:0{half}d}" if half else "") + f"{b:0{len(d) - half}d}"


def laid(entity, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in entity)


def check_digit(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def letters(kind, what, n):
    out = ""
    for at in range(0, n, 12):
        x = number(kind, at, what)
        out += "".join("abcdefghijklmnopqrstuvwxyz234567"[x >> 5 * i & 31] for i in range(min(12, n - at)))
    return out


def shuffled(value, kind, classes):
    half = len(value) // 2
    sides = [value[:half], value[half:]]
    for i in range(6):
        mine, other = sides[i % 2], sides[1 - i % 2]
        stream = "".join(sha(KEY, kind, i, b, other) for b in range(len(mine) // 32 + 1))
        out = ""
        for k, c in enumerate(mine):
            some = next((x for x in classes if c in x), None)
            out += some[(some.index(c) + int(stream[2 * k : 2 * k + 2], 16)) % len(some)] if some else c
        sides[i % 2] = out
    return "".join(sides)


def person(e):
    form = max((f for f in FORMS if e.startswith(f)), key=len)
    rest = e[len(form) :]
    dot = "." if rest.startswith(".") else ""
    return form, dot, rest.removeprefix(".")[1:]


def surrogate(e):
    kind = next((k for k, p in pii.PATTERNS.items() if k != "name" and regex.fullmatch(p, e)), "name")
    d = "".join(c for c in e if c.isascii() and c.isdigit())
    if kind == "email":
        low = e.lower()
        return kind, letters("mailbox", low, 14) + "@" + letters("domain", low.rpartition("@")[2], 10) + ".example"
    if kind == "ip":
        p = [int(x) for x in e.split(".")]
        base = 256 if max(p) < 256 else 1000
        a, b = permute(p[0] * base + p[1], p[2] * base + p[3], base**2, base**2, "ip")
        return kind, f"{a // base}.{a % base}.{b // base}.{b % base}"
    if kind == "ssn":
        return kind, laid(e, digits(d, "ssn"))
    if kind == "phone":
        return kind, laid(e, d[:-10] + digits(d[-10:], "phone"))
    if kind == "card":
        new = digits(d[:-1], "card")
        return kind, laid(e, new + str((check_digit(new) + int(d[-1]) - check_digit(d[:-1])) % 10))
    if kind == "secret":
        before = BEFORE.match(e).group()
        value = e[len(before) :]
        if regex.fullmatch("[0-9a-f]{32,128}", value):
            return kind, before + shuffled(value, "hex", ["0123456789abcdef"])
        if any(c in x for c in value for x in pii.CLASSES):
            return kind, before + shuffled(value, "secret", pii.CLASSES)
        return kind, before + (sha(KEY, "bare", value) * math.ceil(len(value) / 64))[: len(value)]
    form, dot, name = person(e)
    given, sounds = pii.GIVEN[FORMS[form]].split(), pii.SYLLABLES[FORMS[form][0]]
    half = lambda part, of: "".join(sounds[number("name", part, of) >> 5 * i & 31] for i in range(6)).title()
    return kind, f"{form}{dot} {given[number('given', name) % len(given)]} {half('1', name.split(' ')[-1])}-{half('2', name)}"


def replaced(text):
    """(text with surrogates, number of entities)."""
    found = [m.group() for m in ANY.finditer(text)]
    said = []
    for e in dict.fromkeys(found):
        kind, new = surrogate(e)
        if kind == "name":
            said.append((person(e)[2], person(new)[2]))
    mentions = [m for m in said if " " in m[0]] + [(a.split(" ")[-1], b.split(" ")[-1]) for a, b in said if len(a.split(" ")[-1]) > 2]
    out, at = "", 0
    for m in [*ANY.finditer(text), None]:
        piece = text[at : m.start()] if m else text[at:]
        for a, b in mentions:
            piece = regex.sub(rf"(?<![\p{{L}}\p{{N}}]){a}(?![\p{{L}}\p{{N}}])", b, piece)
        out += piece
        if m:
            out += surrogate(m.group())[1]
            at = m.end()
    return out, len(found)


def test_given_documents_and_made_texts(spark, sf):
    import random

    rng = random.Random(11)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    makers = [*MADE.values(), *SECRETS.values()]
    for _ in range(250):
        parts = [rng.choice(makers)(rng) if rng.random() < 0.4 else rng.choice(["word", "Smith", "Jane Doe", "Müller", "7", "a.b", "été,", "\n", "Dr. Lee", "Prof. Ann Lee", "password=!!!!!!!!!!", "999.1.2.3"]) for _ in range(12)]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.collision_free_round(df, "text", "k") == 0
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace(df, key="k").collect()}
    for i, text in enumerate(texts):
        assert got[i] == replaced(text), text
