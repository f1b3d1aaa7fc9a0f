"""Extraction of references, imports, decisions and terms from text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROSE_EXTENSIONS = "c cc cfg conf cpp cs csv db docx duckdb go h hpp htm html ini java js json jsonl jsx bash markdown md mjs cjs odt parquet pdf php pptx ps1 psm1 py rb rs rst sh sql sqlite toml ts tsv tsx txt vcl xml yaml yml".split()
FENCED = r"(?s)(```|~~~).*?\1"
INLINE = r"(`+)[^\n]{0,2000}?\1"
LINK = r"\]\(\s*<?([^\s\])>]{1,2000})>?(?:\s*(?:'[^']*'|\"[^\"]*\"))?\s*\)"
WIKILINK = r"\[\[\s*([^\[\]|#\n]{1,200})(?:#[^\[\]|\n]{0,200})?(?:\|[^\[\]\n]{0,200})?\]\]"
PROSE = r"(?U)(?<![\w./\\-])([0-9A-Z_a-z][0-9A-Z_a-z./\\-]*\.(?:" + "|".join(PROSE_EXTENSIONS) + r"))\b"
DECISION = r"\b((?:D-[A-Z]{1,8}-[0-9]{1,5}|ADR-[0-9]{1,5}|RFC-[0-9]{1,5}))\b"
JS_IMPORT = r"(?:(?:import|export)\s[^`'\"]*?from\s*|import\s*\(?\s*|require\(\s*)[`'\"](\.[^`'\"]+)[`'\"]"


def tokenize(text: Column) -> Column:
    """Runs of at least two of [a-z0-9], in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) >= 2)


def node_text(id_: Column, label: Column, type_: Column, path: Column, qualname: Column, description: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", id_, label, type_, blank(path), qualname, blank(description))


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, FENCED, " "), INLINE, " ")


def clean_target(target: Column) -> Column:
    """Empty for addresses with a scheme; else without anchor and query, with forward slashes."""
    bare = F.translate(F.split_part(F.split_part(F.replace(target, F.lit("`"), F.lit("")), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "\\", "/")
    return F.when(F.trim(target).rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*://|mailto:)"), F.lit("")).otherwise(F.trim(bare))


def references(text: Column) -> Column:
    """array<struct<target, kind>>: links, wikilinks, then paths in prose; a target counts as what it first was."""
    prose = without_code(text)

    def tagged(found: Column, kind: str) -> Column:
        return F.transform(found, lambda t: F.struct(clean_target(t).alias("target"), F.lit(kind).alias("kind")))

    every = F.concat(
        tagged(F.regexp_extract_all(prose, F.lit(LINK), 1), "link"),
        tagged(F.regexp_extract_all(prose, F.lit(WIKILINK), 1), "wikilink"),
        tagged(F.regexp_extract_all(text, F.lit(PROSE), 1), "path"),
    )
    some = F.filter(every, lambda r: r["target"] != "")

    def first_seen(held: Column) -> Column:
        names = F.transform(held, lambda q: q["target"])
        return F.filter(held, lambda r, i: F.array_position(names, r["target"]) == i + 1)

    # a one-element array binds the findings to a name, so that they are computed once
    return F.get(F.transform(F.array(some), first_seen), F.lit(0))


def decision_ids(text: Column, prefixes: tuple[str, ...] = ()) -> Column:
    pattern = DECISION
    if prefixes:
        own = "|".join(f"{p}-[0-9]{{1,5}}" for p in prefixes)
        pattern = DECISION.replace("((?:", f"((?:{own}|", 1)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def js_imports(source: Column) -> Column:
    """Relative module names that a script imports, in order, each once."""
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(JS_IMPORT), 1))


def absolute_paths(text: Column) -> Column:
    """Absolute paths in prose, Windows or POSIX."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w:/.])((?:[A-Za-z]:[\\/]|/|~/)(?:[\w.-]+[\\/])*[\w.-]+\.\w+)"), 1))


def patch_files(text: Column) -> Column:
    """Files that a patch's headers name."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+?)\s*$"), 1))
