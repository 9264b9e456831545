"""Generated names against an independent fold in Python."""

import json
import struct

import pytest
import xxhash
from lexweave.operators import namegen, sinks
from lexweave.operators import rank as R
from lexweave.sources.seed import seed_lexicon
from lexweave.sources.specs import GeneratorConfig

POOLS = {"prefixes": ["prefix"], "words": ["noun", "proper"], "suffix_adjs": ["adj"], "suffix_names": ["suffix", "suffix_noun"]}


def hashed(seed, attempt, draw):
    """A chain of XXH64: each part is hashed with the hash before it as seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", attempt), h)
    return xxhash.xxh64_intdigest(draw.encode(), h)


def pools(rows):
    """Words of each pool by (bucket of the id, id, word)."""
    out = {}
    for pool, classes in POOLS.items():
        some = [(r["id"], r["word"]) for r in rows if r["word_class"] in classes]
        signed = lambda i: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(i.encode(), 42))
        out[pool] = [w for _, _, w in sorted((signed(i) % namegen.BUCKETS, i, w) for i, w in some)]
    return out


def picked(pool, seed, attempt, draw):
    if not pool:
        return None
    h = hashed(seed, attempt, draw)
    return pool[(h - (1 << 64) if h >> 63 else h) % len(pool)]


def default_name(p, seed, attempt, c):
    will = lambda draw, chance: (hashed(seed, attempt, draw) >> 11) / (1 << 53) < min(max(chance, 0), 1)
    take = {n: picked(p[pool], seed, attempt, n) for pool, n in (("prefixes", "p"), ("words", "w"), ("suffix_names", "s"), ("suffix_adjs", "a"))}
    if take["w"] is None:
        return None
    out = []
    if take["p"] is not None and will("prefix", c.prefix_probability):
        out += ["The"] * will("The", c.prefix_article_probability) + [take["p"]]
    out.append(take["w"])
    if take["s"] is not None and will("suffix", c.suffix_name_probability):
        out.append(c.fillword)
        out += ["the"] * will("the", c.suffix_article_probability)
        out += [take["a"]] * will("adj", c.suffix_adjectiv_probability)
        out.append(take["s"])
    return c.separator.join(x for x in out if x)


def unique(names, count, most=namegen.ATTEMPTS):
    """The first ``count`` different names; it ends when ``most`` attempts in a row bring nothing new."""
    out, last = [], -1
    for k, name in enumerate(names):
        if k - last > most:
            break
        if name is not None and name not in out:
            out.append(name)
            last = k
        if len(out) == count:
            break
    return out


@pytest.mark.parametrize(("seed", "config"), [(42, GeneratorConfig()), (7, GeneratorConfig(0.9, 2.0, 0.5, 0.5, 1.0, "-", "von")), (1, GeneratorConfig(prefix_probability=-1, suffix_name_probability=0))])
def test_default_names(spark, seed, config):
    lex = seed_lexicon(spark)
    p = pools(lex.collect())
    want = [default_name(p, seed, k, config) for k in range(12 * namegen.ATTEMPTS)]
    got = sorted(namegen.attempts(lex, seed, 12, config=config).collect(), key=lambda r: r["attempt"])
    assert [r["name"] for r in got] == want
    names = [r["name"] for r in sorted(namegen.generate(lex, 12, seed, config=config).collect(), key=lambda r: r["n"])]
    assert names == unique(want, 12)


def test_templates(spark):
    lex = seed_lexicon(spark)
    p = pools(lex.collect())
    got = sorted(namegen.attempts(lex, 3, 1, "{prefix}  {word} of {suffix_adj}{suffix} }").collect(), key=lambda r: r["attempt"])
    for r in got:
        a = r["attempt"]
        parts = [picked(p[pool], 3, a, f"slot{k}") or "" for k, pool in ((0, "prefixes"), (2, "words"), (4, "suffix_adjs"), (5, "suffix_names"))]
        assert r["name"] == " ".join(f"{parts[0]}  {parts[1]} of {parts[2]}{parts[3]} }}".split())
    with pytest.raises(ValueError, match="prefix"):
        namegen.parse_template("{nothing}")
    assert namegen.attempts(lex.where("word_class = 'adj'"), 3, 1, "{word}").where("name is not null").isEmpty()
    assert namegen.generate(lex.where("id = 'en_oak'"), 5, 3, "{word}").count() == 1


def test_seed_is_drawn_and_told(spark):
    lex = seed_lexicon(spark)
    rows = namegen.generate(lex, 2).collect()
    again = namegen.generate(lex, 2, rows[0]["seed"]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_json_and_text_say_what_was_found(spark):
    lex = seed_lexicon(spark)
    top = R.top_k(R.rank(lex, "sky thunder king"), 3)
    rows = R.ordered(top).collect()
    said = {(x := json.loads(r["value"]))["word"]: x for r in sinks.json_lines(top).collect()}
    for r in rows:
        want = {k: r[k] for k in ("word", "translit", "language", "system", "etymology", "origin_lang", "score", "matched") if r[k] is not None}
        assert said[r["word"]] == want | {"display": r["word"]}
    assert {r["value"] for r in sinks.text_lines(top).collect()} == {r["word"] for r in rows}
    block = {r["value"] for r in sinks.rich_blocks(top, show_root=True).collect()}
    zeus = next(b for b in block if b.startswith("zeus"))
    assert zeus == "zeus — sky; thunder; king  [la · myth_greek]\n  Spur..: sky (glosse) · thunder (glosse) · king (glosse)\n  Wurzel: griech. Zeus, idg. *dyeus 'Himmel, Tag' (grc)\n"
    names = namegen.generate(lex, 3, 5)
    told = json.loads(sinks.names_json(names).first()["value"])
    assert told == {"seed": 5, "names": [r["name"] for r in sorted(names.collect(), key=lambda r: r["n"])]}
