"""Coherent storage of builds: each build in its own folder, a pointer flipped last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import ext
from graphloom.graph import PropertyGraph
from graphloom.operators.digest import manifest_diff
from graphloom.sources.tree import EXTRACT_VERSION

HASHED = "py pyw js ts tsx jsx mjs cjs md markdown rst txt html htm toml yaml yml json ini cfg csv sql sh".split()
HASH_CAP = 1_000_000
POINTER = "_CURRENT"
PARTS = ("nodes", "edges", "manifest")
UNREADABLE = "!unreadable"


def manifest(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(path, hash): content hashes of texts up to 1 MB, else size and time stamps."""
    text = F.ltrim(ext(F.col("path")), F.lit(".")).isin(HASHED) & (F.col("size") <= HASH_CAP)
    stamp = F.format_string("s%d:m%d", "size", "mtime_ns")
    return files.join(hashes.select("path", F.col("hash").alias("content")), "path", "left").select("path", F.when(text & F.col("content").isNotNull(), F.col("content")).otherwise(stamp).alias("hash"))


def stamp_only(held: DataFrame) -> DataFrame:
    """(path) of a manifest's files that are compared by size and time, not by content."""
    return held.where(F.col("hash").rlike(r"^s[0-9]+:m-?[0-9]+$")).select("path")


def signature(files: DataFrame, settings: list[tuple[str, str]] = ()) -> DataFrame:
    """(path, hash) from metadata alone, and the settings' own rows; what can't be read is marked, so that it is looked at again."""
    told = F.when((F.col("size") == 0) & (F.col("mtime_ns") == 0), UNREADABLE).otherwise(F.format_string("%d:%d", "size", "mtime_ns"))
    rows = files.select("path", told.alias("hash"))
    return rows.union(files.sparkSession.createDataFrame(list(settings), "path string, hash string")) if settings else rows


class Place:
    """A folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes under another name, then takes the name in one step from what had it."""
        draft = self.path(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(kind, 1)
        how[0] = kind.getEnumConstants()[1]  # OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self.path(name), how)


def save(graph: PropertyGraph, held: DataFrame, root: str, found: DataFrame | None = None, stamps: DataFrame | None = None) -> str:
    """Writes a build and points to it; readers see the build before or this one, never a mixture.

    found: findings, for the next build to take over; stamps: the signature.
    """
    place, build = Place(graph.nodes.sparkSession, root), uuid.uuid4().hex
    parts = {"nodes": graph.nodes, "edges": graph.edges, "manifest": held, f"extract-{EXTRACT_VERSION}": found, "signature": stamps}
    for name, rows in parts.items():
        if rows is not None:
            rows.write.parquet(f"{place.root}/build={build}/{name}")
    before = place.read(POINTER)
    place.replace(POINTER, build)
    for s in place.fs.listStatus(place.path("")):
        # the build before may still be read; older ones go
        if s.getPath().getName().startswith("build=") and s.getPath().getName() not in (f"build={build}", f"build={(before or '').strip()}"):
            place.fs.delete(s.getPath(), True)
    return build


def _part(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    place = Place(spark, root)
    build = (place.read(POINTER) or "").strip()
    whole = f"build={build}/{name}"
    return spark.read.parquet(f"{place.root}/{whole}") if build and place.exists(f"{whole}/_SUCCESS") else None


def load(spark: SparkSession, root: str, project: str = "project") -> tuple[PropertyGraph, DataFrame] | None:
    """(graph, manifest) of the current build; None where there is none or it isn't whole."""
    parts = [_part(spark, root, name) for name in PARTS]
    if any(p is None for p in parts):
        return None
    return PropertyGraph(parts[0], parts[1], project), parts[2]


def load_extract(spark: SparkSession, root: str) -> DataFrame | None:
    """The current build's findings, if this version of the code made them."""
    return _part(spark, root, f"extract-{EXTRACT_VERSION}")


def load_signature(spark: SparkSession, root: str) -> DataFrame | None:
    return _part(spark, root, "signature")


def stale(held: DataFrame, now: DataFrame) -> DataFrame:
    return manifest_diff(held, now)
