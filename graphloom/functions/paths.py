"""Scalar functions on paths and nodes, all plain Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PROGRAM = "py pyw js ts tsx jsx mjs cjs go rs java kt c cc cpp h hpp rb php cs swift scala lua ps1 psm1 sh bash bat cmd sql vcl r".split()
DATA = "db sqlite sqlite3 duckdb parquet csv tsv jsonl ndjson".split()
CONFIG = "toml ini cfg conf yaml yml env json xml properties".split()
CONFIG_NAMES = (".gitignore", ".graphloomignore", "dockerfile", "caddyfile", "makefile")
DOC = "md markdown rst txt pdf html htm docx pptx odt".split()
REFERENCE_DOC = "md markdown rst txt html htm".split()
STRUCTURE_NAMES = ("readme", "readme.md", "index.md", "changelog.md", "contributing.md", "license", "license.md", "license.txt", "authors", "notice")
DESIGN = "disegno design piano plan roadmap spec blueprint brief architettura architecture adr decision decisione decisioni".split()
REPORT = "report rapporto collaudo diagnosi revisione readiness analisi analysis audit verifica backtest indagine strumentazione".split()
DATED = r"(?<![0-9])20[0-9]{2}(?:[-_]?[0-9]{2}[-_]?[0-9]{2}|[-_][0-9]{2})(?![0-9])"
COPY = r"(?i)^(.+?)\.(?:bak|orig)(?:[-_.].*)?$"
LOG = r"(?i)\.log(?:\.[0-9]+)?$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ext(name: Column) -> Column:
    """Extension with its dot, in lower case; leading dots don't start one."""
    return F.lower(F.regexp_extract(F.regexp_replace(basename(name), r"^\.+", ""), r"(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    base = basename(name)
    return F.substring(base, F.lit(1), F.length(base) - F.length(ext(name)))


def top_area(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit("(root)"))


def is_copy_or_log(path: Column) -> Column:
    name = basename(path)
    return F.coalesce(name.rlike(COPY) | name.rlike(LOG), F.lit(False))


@dataclass(frozen=True)
class Rules:
    structure_names: tuple[str, ...] = STRUCTURE_NAMES
    design: tuple[str, ...] = tuple(DESIGN)
    report: tuple[str, ...] = tuple(REPORT)
    overrides: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, mode: str = "extend", structure_names=(), design=(), report=(), overrides=None) -> Rules:
        """Extends or replaces the defaults; an empty list never replaces them."""
        d = cls()
        pick = lambda own, std: tuple(own) if mode == "replace" and own else (*std, *own)
        return cls(tuple(s.lower() for s in pick(structure_names, d.structure_names)), pick(design, d.design), pick(report, d.report), dict(overrides or {}))


def keyword_pattern(words: tuple[str, ...]) -> str:
    return "(?i)(?:^|[-_/])(?:" + "|".join(re.escape(w) for w in words) + ")s?(?:[-_/.]|$)"


def classify(path: Column, rules: Rules | None = None) -> Column:
    """The node type of a file, from its path alone."""
    rules = rules or Rules()
    name0 = basename(path)
    original = F.when(name0.rlike(COPY), F.regexp_extract(name0, COPY, 1)).otherwise(name0)
    path = F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(name0)), original)
    name, e = F.lower(original), F.ltrim(ext(original), F.lit("."))
    low = F.lower(path)
    memory = F.exists(F.split(low, "/"), lambda s: s == "memory") & F.contains(low, F.lit("/")) & ~(name == "memory") | name.startswith("memory.")
    return (
        F.when(memory, "memory")
        .when(e.isin(DATA), "data")
        .when(e.isin(PROGRAM), "program")
        .when(e.isin(CONFIG) | name.isin(*CONFIG_NAMES), "config")
        .when(name.isin(*rules.structure_names), "structure")
        .when(
            e.isin(DOC) | (e == ""),
            F.when(path.rlike(keyword_pattern(rules.design)), "design").when(path.rlike(keyword_pattern(rules.report)) | original.rlike(DATED), "report").otherwise("structure"),
        )
        .otherwise("config")
    )


def node_cost(id_: Column, type_: Column, path: Column) -> Column:
    """Tokens that a node's row takes, about four characters each."""
    chars = F.length(id_) + F.length(type_) + F.length(F.coalesce(path, F.lit(""))) + 12
    return F.greatest(F.lit(1), F.bround(chars / 4)).cast("bigint")


def text_cost(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4)).cast("bigint")


def tokens(chars: Column) -> Column:
    return F.bround(chars / 4).cast("bigint")


def human(size: Column) -> Column:
    """Bytes with a unit: whole below 1024, else one decimal."""
    out = F.format_string("%d B", size)
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.format_string("%.1f " + unit, F.bround(size / float(1024**k), 1))).otherwise(out)
    return out


def family(decision: Column) -> Column:
    return F.regexp_replace(decision, "-[0-9]+$", "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("/"), F.lit("--")), "[^a-z0-9-]+", "-"), F.lit("-"))


def agent_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "-")


def timestamp(text: Column) -> Column:
    """ISO date or time; null where it isn't one.  The session's zone (UTC) is taken where none is given."""
    return F.try_to_timestamp(text)


def describe(type_: Column, path: Column, inbound: Column) -> Column:
    area = top_area(path)
    place = F.when(area == "(root)", F.lit("root")).otherwise(F.concat(F.lit("area '"), area, F.lit("'")))
    more = F.when(inbound > 0, F.format_string(" · %d inbound", inbound)).otherwise(F.lit(""))
    return F.concat(type_, F.lit(" · "), place, more)


def normpath(path: Column) -> Column:
    """POSIX normal form of a relative or absolute path, by a fold over its segments."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        climbs = (F.size(done) > 0) & (last != "..")
        up = F.when(climbs, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.array_append(done, F.lit("..")))
        return F.when(s == "..", up).otherwise(F.array_append(done, s))

    # a one-element array binds the fold to a name, so that it is computed once; most paths need none
    joined = F.array(F.array_join(F.aggregate(parts, empty, step), "/"))
    folded = F.get(F.transform(joined, lambda j: F.when(absolute, F.concat(F.lit("/"), j)).when(j == "", F.lit(".")).otherwise(j)), F.lit(0))
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), folded).otherwise(path)


def join_path(folder: Column, target: Column) -> Column:
    """normpath(folder / target); an absolute target stands alone."""
    whole = F.when(target.startswith("/"), target).when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))
    return normpath(whole)


def is_external(target: Column) -> Column:
    """A URL, a drive letter, or an absolute path."""
    return target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("/") | target.startswith("\\")


def looks_like_path(target: Column) -> Column:
    """Its last segment has an extension that begins with a letter."""
    return basename(target).rlike(r"\.[A-Za-z][A-Za-z0-9]*$")


def matches(text: Column, query: str) -> Column:
    """Literal substring, whatever the case."""
    return F.contains(F.lower(text), F.lit(query.strip().lower()))
