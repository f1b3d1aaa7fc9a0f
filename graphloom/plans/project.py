"""A folder with its stored graph: build it, as a whole or again, keep it fresh, say how it is."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import basename, ext
from graphloom.graph import PropertyGraph
from graphloom.operators import digest
from graphloom.operators.iterate import cut
from graphloom.plans import lock, store
from graphloom.plans.build import build_graph
from graphloom.sources.config import Config, config_signature, load_config
from graphloom.sources.git import commits
from graphloom.sources.tree import extract, extract_again, heads_and_tails, list_files

#: Paths that a health answer lists of each kind.
SHOWN = 50


def integrity(graph: PropertyGraph, root: str) -> DataFrame:
    """(path, problem) of the graph's files: empty ones, and texts with a run of zero bytes near an end.  One open per text."""
    files = graph.files().select("path", F.coalesce("size", F.lit(0)).alias("size"))
    empty = files.where((F.col("size") == 0) & ~basename(F.col("path")).isin(*digest.EMPTY_BY_CUSTOM)).select("path", F.lit("empty").alias("problem"))
    texts = files.where(F.ltrim(ext(F.col("path")), F.lit(".")).isin(*digest.TEXT_EXTENSIONS))
    return empty.union(heads_and_tails(texts, root).select("path", "problem"))


@dataclass
class Project:
    spark: SparkSession
    root: str
    place: str | None = None

    def __post_init__(self) -> None:
        self.place = self.place or os.path.join(self.root, ".graphloom")
        self.name = os.path.basename(os.path.abspath(self.root))

    @property
    def config(self) -> Config:
        return load_config(self.root)

    def files(self) -> DataFrame:
        return cut(list_files(self.spark, self.root, self.config.respect_gitignore))

    def build(self, incremental: bool = True, wait: float = 600.0) -> dict[str, int]:
        """Builds and stores the graph; returns how many files were listed, parsed and taken over.

        The listing, and so the signature, is made before any file is read: one
        that changes meanwhile makes the store stale, never wrongly fresh.
        Needs a place on a mounted file system for its lock.
        """
        with lock.write_lock(self.place, wait):
            config, files = self.config, self.files()
            stamps = cut(store.signature(files, config_signature(self.root)))
            cached = store.load_extract(self.spark, self.place) if incremental else None
            found = cut(extract(files, self.root) if cached is None else extract_again(files, self.root, cached))
            graph = build_graph(self.spark, self.root, config.rules, found=found, project=self.name, files=files, decision_prefixes=config.decision_prefixes, log=commits(self.spark, self.root))
            store.save(graph, store.manifest(files, found), self.place, found, stamps)
            total = found.count()
            kept = 0 if cached is None else found.join(cached.select("path", "hash"), ["path", "hash"], "left_semi").count()
            return {"files": files.count(), "parsed": total - kept, "reused": kept}

    def stale(self) -> bool:
        """Whether size or time of any file, or a setting, is another than when the graph was stored."""
        held = store.load_signature(self.spark, self.place)
        now = store.signature(self.files(), config_signature(self.root))
        return digest.staleness(held, now).collect()[0]["stale"]

    def graph(self, refresh: bool = True) -> PropertyGraph:
        """The stored graph, built first where there is none, or built again where it is stale and no one else does it."""
        held = store.load(self.spark, self.place, self.name)
        if held is None:
            self.build()
        elif refresh and self.stale():
            try:
                self.build(wait=0.0)
            except lock.Busy:
                pass  # another process is at it: the graph before answers meanwhile
        return store.load(self.spark, self.place, self.name)[0]

    def changes(self, deep: bool = False) -> DataFrame | None:
        """(path, change) since the build: by size and time, or with ``deep`` by content; None without a build."""
        files = self.files()
        if deep:
            held = store.load(self.spark, self.place, self.name)
            return None if held is None else digest.manifest_diff(held[1], store.manifest(files, extract(files, self.root, symbols=False)))
        stamps = store.load_signature(self.spark, self.place)
        return None if stamps is None else digest.manifest_diff(stamps, store.signature(files, config_signature(self.root)))

    def health(self, deep: bool = False) -> dict:
        """Broken references, what changed since the build, orphans, and who is building just now."""
        held, diff = store.load(self.spark, self.place, self.name), self.changes(deep)
        if held is None or diff is None:
            return {"status": "no build"}
        graph, diff = held[0], cut(diff)
        broken = digest.broken_references(graph)
        counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
        kinds = ("added", "removed", "changed")
        out = {
            "check": "content" if deep else "stat",
            "broken": [[r["id"], r["target"]] for r in broken.orderBy("id", "target").limit(SHOWN).collect()],
            "broken_count": broken.count(),
            "stale": {k: [r["path"] for r in diff.where(F.col("change") == k).orderBy("path").limit(SHOWN).collect()] for k in kinds},
            "stale_counts": {k: counts.get(k, 0) for k in kinds},
            "orphans": graph.orphans().count(),
        }
        out["ok"] = not out["broken_count"] and not sum(counts.values())
        if who := lock.holder(self.place):
            out["rebuilding"] = who
        return out
