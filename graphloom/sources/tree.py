"""A folder of files as rows: pruned listing, ignore rules, and per-file extraction."""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import REFERENCE_DOC, ext
from graphloom.operators.iterate import cut
from graphloom.sources.config import CONFIG_NAME, IGNORE_NAME

IGNORED_DIRS = frozenset(".git .hg .svn .graphloom .idea .vscode .venv venv env node_modules site-packages dist build .eggs .tox .cache __pycache__ .mypy_cache .pytest_cache .ruff_cache".split())
IGNORED_FILES = frozenset((IGNORE_NAME, CONFIG_NAME, ".DS_Store", "Thumbs.db", "poetry.lock", "package-lock.json", "yarn.lock"))
IGNORED_EXTENSIONS = frozenset("pyc pyd pyo so dll dylib exe bin o a bmp gif ico jpeg jpg png svg webp woff woff2 ttf eot zip tar gz 7z rar lock".split())
JS = ("js", "ts", "tsx", "jsx", "mjs", "cjs")
CAP = 5_000_000
LISTING = "path string, size bigint, mtime_ns bigint"


class GitRule:
    """One line of a .gitignore: the last rule that matches decides."""

    def __init__(self, line: str):
        self.negated = line.startswith("!")
        body = line[1:] if self.negated else line
        self.dirs_only = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        out, i = [], 0
        body = body.lstrip("/")
        while i < len(body):
            if body.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif body.startswith("**", i):
                out.append(".*")
                i += 2
            else:
                out.append({"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])))
                i += 1
        # what lies below a folder that matches is meant too
        self.pattern = re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"(?:/.*)?\Z")

    @classmethod
    def parse(cls, text: str) -> list[GitRule]:
        lines = (x.rstrip() for x in text.lstrip("\ufeff").splitlines())
        return [cls(x) for x in lines if x.strip("!/") and not x.startswith("#")]


def gitignored(path: str, is_dir: bool, rules: list[GitRule]) -> bool:
    hit = False
    for r in rules:
        if (is_dir or not r.dirs_only) and r.pattern.match(path):
            hit = not r.negated
    return hit


def ignored_file(path: str, globs: list[str]) -> bool:
    name = path.rsplit("/", 1)[-1]
    e = os.path.splitext(name)[1][1:].lower()
    return name in IGNORED_FILES or e in IGNORED_EXTENSIONS or any(fnmatch.fnmatchcase(path, g) or fnmatch.fnmatchcase(name, g) for g in globs)


def visible(path: Column) -> Column:
    """As the walk decides by the default lists, for paths that come from elsewhere: no ignored folder, name or extension."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(folders, lambda d: d.isin(*sorted(IGNORED_DIRS)) | d.endswith(".egg-info"))
    return ~(hidden | name.isin(*sorted(IGNORED_FILES)) | F.ltrim(ext(path), F.lit(".")).isin(*sorted(IGNORED_EXTENSIONS)))


def scan(root: str, folder: str, globs: list[str], rules: list[GitRule], pruned: frozenset[str]) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(folders to enter, files as (path, size, mtime_ns)) of one folder; ignored, linked and unreadable folders are left out.

    A link to a folder, or a reparse point that stands for one, is never
    entered.  An entry that exists but can't be followed stays, with size and
    time of zero.
    """
    folders, files = [], []
    try:
        entries = list(os.scandir(os.path.join(root, folder)))
    except OSError:
        return [], []
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        try:
            if (e.is_symlink() or e.is_junction()) and e.is_dir():
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name not in IGNORED_DIRS and not e.name.endswith(".egg-info") and path not in pruned and not gitignored(path, True, rules):
                    folders.append(path)
                continue
        except OSError:
            continue
        if ignored_file(path, globs) or gitignored(path, False, rules):
            continue
        try:
            s = e.stat()
            files.append((path, s.st_size, s.st_mtime_ns))
        except OSError:
            if os.path.lexists(os.path.join(root, path)):
                files.append((path, 0, 0))
    return folders, files


def walk(root: str, globs: list[str] = (), rules: list[GitRule] = (), pruned: frozenset[str] = frozenset(), start: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_ns) of all files below a folder."""
    todo = [start]
    while todo:
        folders, files = scan(root, todo.pop(), globs, rules, pruned)
        todo.extend(folders)
        yield from files


def list_files(spark: SparkSession, root: str, respect_gitignore: bool = False, pruned: frozenset[str] = frozenset(), apart: int = 256) -> DataFrame:
    """The listing as rows.  Only metadata: contents are read by the tasks that need them.

    The driver opens folders from the top until at least ``apart`` are left to
    walk, or none; these are walked by tasks, so that the driver never holds
    the listing of a large tree.
    """

    def lines(name: str) -> str:
        try:
            with open(os.path.join(root, name), encoding="utf-8-sig", errors="ignore") as f:
                return f.read()
        except OSError:
            return ""

    globs = [x.strip() for x in lines(IGNORE_NAME).splitlines() if x.strip() and not x.strip().startswith("#")]
    rules = GitRule.parse(lines(".gitignore")) if respect_gitignore else []
    todo, top = [""], []
    while todo and len(todo) < apart:
        below = []
        for folder in todo:
            folders, files = scan(root, folder, globs, rules, pruned)
            below += folders
            top += files
        todo = below
    listed = spark.createDataFrame(sorted(top), LISTING)
    if not todo:
        return listed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for folder in f["folder"]:
                rows = list(walk(root, globs, rules, pruned, folder))
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["path", "size", "mtime_ns"])

    deep = spark.createDataFrame([(d,) for d in sorted(todo)], "folder string").repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism))
    return listed.union(deep.mapInPandas(run, LISTING))


# -- per file -------------------------------------------------------------------


def python_imports(source: str) -> list[tuple[int, str | None, list[str]]]:
    """(level, module, names) of each import statement, wherever statements can stand; none if it doesn't parse."""
    if "import" not in source:
        return []
    try:
        todo: list[ast.AST] = [ast.parse(source)]
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: list[tuple[int, str | None, list[str]]] = []
    for node in todo:
        if isinstance(node, ast.Import):
            found.extend((0, a.name, []) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            found.append((node.level, node.module, [a.name for a in node.names]))
        for part in ("body", "orelse", "finalbody", "handlers", "cases"):
            below = getattr(node, part, None)
            if isinstance(below, list):
                todo.extend(below)
    return found


def python_symbols(source: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, str]]]:
    """((qualname, kind, line) of definitions, (caller, callee) of calls that are certain within the file)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    defs: list[tuple[str, str, int]] = []
    places: list[tuple[ast.AST, str, str]] = []

    def define(node: ast.AST, prefix: str, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}" if prefix else child.name
                is_class = isinstance(child, ast.ClassDef)
                defs.append((name, "class" if is_class else "method" if owner else "function", child.lineno))
                if not is_class:
                    places.append((child, name, owner))
                define(child, name, name if is_class else "")
            else:
                define(child, prefix, owner)

    define(tree, "", "")
    names = [d[0] for d in defs]
    top = {n for n in names if "." not in n and names.count(n) == 1}
    calls: list[tuple[str, str]] = []
    for node, caller, owner in places:
        todo = list(node.body)
        for x in todo:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name) and f.id in top:
                    calls.append((caller, f.id))
                elif owner and isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self" and f"{owner}.{f.attr}" in names:
                    calls.append((caller, f"{owner}.{f.attr}"))
            todo.extend(ast.iter_child_nodes(x))
    return defs, list(dict.fromkeys(calls))


def signatures(source: str) -> list[tuple[str, int, int]]:
    """(signature, line, depth) of classes and functions in source order."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, int, int]] = []

    def visit(node: ast.AST, depth: int) -> None:
        for x in getattr(node, "body", []):
            if isinstance(x, ast.ClassDef):
                bases = [ast.unparse(b) for b in x.bases] + [f"{k.arg}={ast.unparse(k.value)}" for k in x.keywords]
                out.append((f"class {x.name}" + (f"({', '.join(bases)})" if bases else ""), x.lineno, depth))
                visit(x, depth + 1)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "async def" if isinstance(x, ast.AsyncFunctionDef) else "def"
                out.append((f"{kind} {x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else ""), x.lineno, depth))
                visit(x, depth + 1)

    visit(tree, 0)
    return out


def content_hash(data: bytes) -> str:
    """BLAKE2b; line ends of texts up to 8 MB don't matter."""
    if len(data) <= 8_000_000 and b"\0" not in data[:4096]:
        data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    return hashlib.blake2b(data, digest_size=16).hexdigest()


EXTRACT = "path string, hash string, text string, imports array<struct<level:int,module:string,names:array<string>>>, defs array<struct<qualname:string,kind:string,line:int>>, calls array<struct<caller:string,callee:string>>"
#: Part of the name under which findings are stored: another version of this code never reads them.
EXTRACT_VERSION = "2"


def _read(files: DataFrame, root: str, symbols: bool, cached: DataFrame | None) -> DataFrame:
    """EXTRACT and ``fresh``: one read per file; where its bytes have the hash they had, nothing is parsed."""
    kind = F.ltrim(ext(F.col("path")), F.lit("."))
    wanted = files.where(kind.isin("py", *JS, *REFERENCE_DOC) & (F.col("size") <= CAP)).select("path")
    was = F.lit(None).cast("string")
    if cached is not None:
        wanted, was = wanted.join(cached.select("path", F.col("hash").alias("was")), "path", "left"), F.col("was")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, before in zip(f["path"], f["was"]):
                try:
                    with open(os.path.join(root, path), "rb") as held:
                        data = held.read(CAP + 1)
                except OSError:
                    continue
                if len(data) > CAP:
                    continue
                now = content_hash(data)
                if now == before:
                    rows.append((path, now, None, None, None, None, False))
                    continue
                text, py = data.decode("utf-8", "ignore"), path.lower().endswith(".py")
                defs, calls = python_symbols(text) if py and symbols else ([], [])
                rows.append((path, now, None if py else text, python_imports(text) if py else [], defs, calls, True))
            yield pd.DataFrame(rows, columns=["path", "hash", "text", "imports", "defs", "calls", "fresh"])

    return wanted.select("path", was.alias("was")).mapInPandas(run, EXTRACT + ", fresh boolean")


def extract(files: DataFrame, root: str, symbols: bool = True) -> DataFrame:
    """One read per file: hash, text (of scripts and documents) and Python findings."""
    return _read(files, root, symbols, None).drop("fresh")


def extract_again(files: DataFrame, root: str, cached: DataFrame, symbols: bool = True) -> DataFrame:
    """As ``extract``, with the findings of ``cached`` (those of an earlier build) for files whose bytes are the same.

    Every file is read, and what it was found to hold then is only taken over on
    the evidence of its hash now; so the result is that of extracting anew.
    """
    read = cut(_read(files, root, symbols, cached))
    same = cached.join(read.where("not fresh").select("path"), "path", "left_semi")
    return read.where("fresh").drop("fresh").unionByName(same)


def heads_and_tails(files: DataFrame, root: str, most: int = 2_000_000, tail: int = 65_536) -> DataFrame:
    """(path, size, problem) of files (path, size) that are torn: 16 zero bytes in a row near either end.  Empty ones aren't opened."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            torn = []
            for path, size in zip(f["path"], f["size"]):
                try:
                    with open(os.path.join(root, path), "rb") as held:
                        found = b"\0" * 16 in held.read(most)
                        if not found and size > most:
                            held.seek(-min(tail, size), os.SEEK_END)
                            found = b"\0" * 16 in held.read()
                except OSError:
                    continue
                if found:
                    torn.append((path, size))
            yield pd.DataFrame(torn, columns=["path", "size"])

    return files.where("size > 0").select("path", "size").mapInPandas(run, "path string, size bigint").withColumn("problem", F.lit("truncated"))
