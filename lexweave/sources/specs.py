"""Source specifications and configuration, read on the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

BACKENDS = ("wiktextract-jsonl", "mythology-json")
EXPANSION_BACKENDS = ("datamuse-ml",)


@dataclass(frozen=True)
class SourceSpec:
    id: str
    backend: str
    url: str
    language: str
    system: str
    max_words: int = 500
    skip_classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class ExpansionSpec:
    backend: str
    url: str
    max_candidates: int = 10


@dataclass(frozen=True)
class Sources:
    sources: tuple[SourceSpec, ...] = ()
    query_expansion: ExpansionSpec | None = None


# Language code, name in the dump's address, and classes left out; each accepts 20,000 words.
DICTIONARIES = """
de German
en English
la Latin
el Greek
grc Ancient Greek
he Hebrew
sa Sanskrit
non Old Norse
got Gothic
egy Egyptian
akk Akkadian
sux Sumerian
nci Classical Nahuatl
yua Yucatec Maya
qu Quechua
""".strip().splitlines()
NO_PROPER = ("grc", "he")
MYTHOLOGY_URL = "https://raw.githubusercontent.com/kamiranoff/greek-mythology-data/master/data/all.json"
EXPANSION_URL = "https://api.datamuse.com/words"


def built_in() -> Sources:
    """The dictionaries that are fetched when no configuration says otherwise."""
    out = []
    for line in DICTIONARIES:
        code, _, name = line.partition(" ")
        url = f"https://kaikki.org/dictionary/{name.replace(' ', '%20')}/kaikki.org-dictionary-{name.replace(' ', '')}.jsonl"
        out.append(SourceSpec(f"kaikki-{code}", BACKENDS[0], url, code, f"wiktionary_{code}", 20_000, ("proper",) if code in NO_PROPER else ()))
    out.append(SourceSpec("myth-greek", BACKENDS[1], MYTHOLOGY_URL, "grc", "myth_greek", 2_000))
    return Sources(tuple(out), ExpansionSpec(EXPANSION_BACKENDS[0], EXPANSION_URL))


def parse_sources(text: str) -> Sources:
    """Sources of a YAML text; an unknown backend is an error that names the known ones."""
    import yaml

    raw = yaml.safe_load(text) or {}
    specs = []
    for row in raw["sources"]:
        if row.get("backend") not in BACKENDS:
            raise ValueError(f"source {row.get('id')}: backend {row.get('backend')!r} is not one of: {', '.join(BACKENDS)}")
        specs.append(SourceSpec(**{k: tuple(v) if k == "skip_classes" else v for k, v in row.items() if k in {f.name for f in fields(SourceSpec)}}))
    expansion = None
    if given := raw.get("query_expansion"):
        if given.get("backend") not in EXPANSION_BACKENDS:
            raise ValueError(f"expansion backend {given.get('backend')!r} is not one of: {', '.join(EXPANSION_BACKENDS)}")
        expansion = ExpansionSpec(**given)
    return Sources(tuple(specs), expansion)


def load_sources(path: str | None = None) -> Sources:
    """The sources of a file if it can be read, else the built-in ones."""
    try:
        return parse_sources(Path(path).read_text()) if path else built_in()
    except OSError:
        return built_in()


def select(specs: tuple[SourceSpec, ...], only: list[str] | None = None, limit: int | None = None) -> tuple[list[SourceSpec], list[str]]:
    """(chosen sources, unknown ids): ``only`` keeps ids, ``limit`` overrides the number of words."""
    from dataclasses import replace

    known = {s.id for s in specs}
    chosen = [s for s in specs if only is None or s.id in only]
    return [replace(s, max_words=limit) if limit is not None else s for s in chosen], [i for i in only or () if i not in known]


@dataclass(frozen=True)
class GeneratorConfig:
    prefix_article_probability: float = 0.2
    prefix_probability: float = 0.8
    suffix_article_probability: float = 0.3
    suffix_adjectiv_probability: float = 0.5
    suffix_name_probability: float = 0.5
    separator: str = " "
    fillword: str = "of"


@dataclass(frozen=True)
class Config:
    generator: GeneratorConfig = field(default_factory=GeneratorConfig)
    db_path: str = "lexweave-store"
    script: str = "latin"
    count: int = 1


def load_config(path: str, explicit: bool = False) -> Config:
    """A TOML file over the defaults; a missing file is an error only if it was asked for."""
    if not Path(path).exists():
        if explicit:
            raise FileNotFoundError(path)
        return Config()
    raw = tomllib.loads(Path(path).read_text())
    output, default = raw.get("output", {}), Config()
    script = output.get("script", default.script)
    if script not in ("latin", "native", "both"):
        raise ValueError(f"script is latin, native or both, not {script!r}")
    return Config(GeneratorConfig(**raw.get("generator", {})), raw.get("db", {}).get("path") or default.db_path, script, output.get("count", default.count) or 1)
