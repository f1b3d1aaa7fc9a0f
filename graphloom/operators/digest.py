"""Digests: areas, totals, orphans, gate, viewer and store summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.paths import tokens, top_area
from graphloom.graph import PropertyGraph
from graphloom.operators.iterate import cut
from graphloom.schema import DOCUMENT_TYPES

TEXT_EXTENSIONS = "c cc cfg cpp cs css csv go h hpp htm html ini java js json jsonl jsx log markdown md php ps1 psm1 py rb rs rst sh sql toml ts tsx txt xml yaml yml".split()
EMPTY_BY_CUSTOM = ("__init__.py", "py.typed")


def area_types(graph: PropertyGraph) -> DataFrame:
    """(area, type, files, size, place): types of each area by bytes."""
    rows = graph.files().groupBy(top_area(F.col("path")).alias("area"), "type").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("size"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("size"), "type")))


def area_rollup(graph: PropertyGraph, top: int = 8) -> DataFrame:
    """(area, files, size, top_types): the largest areas with their three dominant types."""
    rows = area_types(graph).groupBy("area").agg(
        F.sum("files").alias("files"),
        F.sum("size").alias("size"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "type")))), lambda x: x["type"]).alias("top_types"),
    )
    return rows.orderBy(F.desc("size"), "area").limit(top)


def project_digest(graph: PropertyGraph) -> DataFrame:
    """One row: files, areas, links, size, orphans, broken_refs."""
    files = graph.files()
    linked = graph.linked()
    broken = F.sum(F.size(F.coalesce("broken_refs", F.array().cast("array<string>")))) if "broken_refs" in graph.nodes.columns else F.lit(0)
    a = files.agg(F.count("*").alias("files"), F.count_distinct(top_area(F.col("path"))).alias("areas"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    b = graph.edges.agg(F.count("*").alias("links"))
    c = files.join(linked, "id", "left_anti").agg(F.count("*").alias("orphans"))
    d = graph.nodes.agg(broken.cast("bigint").alias("broken_refs"))
    return a.join(b).join(c).join(d)  # each side is one row


def store_summary(graph: PropertyGraph, key_files: int = 10) -> dict:
    """Rollup that a workspace keeps of a project."""
    best = graph.files().join(graph.store_degree(), "id").orderBy(F.desc("degree"), "id").limit(key_files)
    areas = graph.files().select(top_area(F.col("path")).alias("area")).distinct().orderBy("area")
    external = graph.nodes.select(F.explode("external_refs").alias("ref")).distinct().orderBy("ref").limit(1000) if "external_refs" in graph.nodes.columns else None
    return {
        "project": graph.project, "files": graph.files().count(), "links": graph.edges.count(), "areas": [r[0] for r in areas.collect()],
        "key_files": [r["id"] for r in best.collect()], "external_refs": [r[0] for r in external.collect()] if external is not None else [],
    }


def assess(graph: PropertyGraph) -> DataFrame:
    """One row: tokens to list all paths, bytes and tokens of documents, share of orphans."""
    files = graph.files()
    linked = graph.linked()
    a = files.agg(
        F.count("*").alias("files"),
        tokens(F.coalesce(F.sum(F.length("path") + 1), F.lit(0))).alias("tokens_inventory"),
        F.coalesce(F.sum(F.when(F.col("type").isin(*DOCUMENT_TYPES), F.col("size"))), F.lit(0)).alias("docs_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("all_bytes"),
    )
    b = files.join(linked, "id", "left_anti").agg(F.count("*").alias("orphans"))
    out = a.join(b)  # each side is one row
    return out.withColumn("tokens_docs", tokens(F.col("docs_bytes"))).withColumn("orphans_pct", F.round(100.0 * F.col("orphans") / F.greatest("files", F.lit(1)), 6))


def view_legend(graph: PropertyGraph) -> DataFrame:
    """(type, nodes, size) of what the viewer shows."""
    return graph.nodes.where("type <> 'area'").groupBy("type").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def view_nodes(graph: PropertyGraph, hub_share: float = 0.15) -> DataFrame:
    """(id, label, type, degree, radius, hub): the viewer's nodes; radius 10 to 40 by degree."""
    degree = cut(graph.viewer_degree())
    most = degree.agg(F.max("degree")).collect()[0][0] or 1
    rows = graph.nodes.where("type <> 'area'").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.select("id", "label", "type", "degree", F.round(10 + 30.0 * F.col("degree") / most, 1).alias("radius"), (F.col("degree") >= hub_share * most).alias("hub"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two tables (path, hash)."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def staleness(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row: stale, and how many paths differ; without a stored table it is stale."""
    if old is None:
        return new.agg(F.lit(True).alias("stale"), F.count("*").alias("changes"))
    return manifest_diff(old, new).agg((F.count("*") > 0).alias("stale"), F.count("*").alias("changes"))


def gate(graph: PropertyGraph, diff: DataFrame) -> DataFrame:
    """One row: broken, stale, orphans and whether the gate is passed."""
    broken = graph.nodes.agg(F.coalesce(F.sum(F.size(F.coalesce("broken_refs", F.array().cast("array<string>")))), F.lit(0)).cast("bigint").alias("broken"))
    row = broken.join(diff.agg(F.count("*").alias("stale"))).join(graph.orphans().agg(F.count("*").alias("orphans")))  # one row each
    return row.withColumn("ok", (F.col("broken") == 0) & (F.col("stale") == 0))


def broken_references(graph: PropertyGraph) -> DataFrame:
    """(id, target) of references that lead nowhere."""
    if "broken_refs" not in graph.nodes.columns:
        return graph.nodes.select("id", F.lit(None).cast("string").alias("target")).limit(0)
    return graph.nodes.select("id", F.explode("broken_refs").alias("target"))


def gate_details(graph: PropertyGraph, diff: DataFrame, stamps: DataFrame | None = None) -> DataFrame:
    """(kind, path, target): what the gate counts, one row each, and files that are compared by stamps only (path)."""
    none = F.lit(None).cast("string").alias("target")
    rows = broken_references(graph).select(F.lit("broken").alias("kind"), F.col("id").alias("path"), "target")
    rows = rows.union(diff.select("change", "path", none)).union(graph.orphans().select(F.lit("orphan"), "id", none))
    return rows if stamps is None else rows.union(stamps.select(F.lit("stamp-only"), "path", none))


def integrity(files: DataFrame) -> DataFrame:
    """(path, problem) of (path, size, head, tail): empty files, and texts with 16 zero bytes in a row."""
    from graphloom.functions.paths import basename, ext

    text = F.ltrim(ext(F.col("path")), F.lit(".")).isin(TEXT_EXTENSIONS)
    zeros = F.unhex(F.lit("00" * 16))
    empty = (F.col("size") == 0) & ~basename(F.col("path")).isin(*EMPTY_BY_CUSTOM)
    torn = text & (F.contains(F.col("head"), zeros) | F.contains(F.col("tail"), zeros))
    return files.select("path", F.when(empty, "empty").when(torn, "truncated").alias("problem")).where("problem is not null")


def decision_families(graph: PropertyGraph) -> DataFrame:
    from graphloom.functions.paths import family

    return graph.nodes.where("type = 'decision'").groupBy(family(F.col("label")).alias("family")).agg(F.count("*").alias("n"))
