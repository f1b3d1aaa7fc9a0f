"""From a folder to a property graph; an incremental build passes in what it found before, resolution is always of everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import REFERENCE_DOC, Rules, basename, classify, describe, ext, top_area
from graphloom.functions.text import decision_ids, js_imports, references
from graphloom.graph import PropertyGraph, first_by
from graphloom.operators.iterate import cut
from graphloom.operators.resolve import reference_lists, resolve_js, resolve_python, resolve_references
from graphloom.sources.git import sessions
from graphloom.sources.tree import IGNORED_DIRS, JS, extract, list_files


def build_graph(spark: SparkSession, root: str, rules: Rules | None = None, respect_gitignore: bool = False, found: DataFrame | None = None, project: str = "project", files: DataFrame | None = None, decision_prefixes: tuple[str, ...] = (), log: DataFrame | None = None) -> PropertyGraph:
    """Nodes per file, area, symbol, decision and session; edges resolved against the whole listing.

    files, found: the listing and findings, where the caller has them already;
    log: commits, which become sessions.
    """
    rules = rules or Rules()
    files = cut(list_files(spark, root, respect_gitignore) if files is None else files)
    found = cut(extract(files, root) if found is None else found)
    forced = spark.createDataFrame(sorted(rules.overrides.items()), "path string, forced string")
    kind = F.coalesce("forced", classify(F.col("path"), rules))
    none = lambda t: F.lit(None).cast(t)
    nodes = files.join(forced, "path", "left").select(F.col("path").alias("id"), kind.alias("type"), basename(F.col("path")).alias("label"), "path", "size")

    py = found.select(F.col("path").alias("source"), F.explode("imports").alias("i")).select("source", "i.level", "i.module", "i.names")
    e = F.ltrim(ext(F.col("path")), F.lit("."))
    js = found.where(e.isin(*JS)).select(F.col("path").alias("source"), F.explode(js_imports(F.col("text"))).alias("spec"))
    docs = found.where(e.isin(*REFERENCE_DOC))
    refs = docs.select(F.col("path").alias("source"), F.explode(references(F.col("text"))).alias("r")).select("source", "r.target", "r.kind")
    resolved = cut(resolve_references(refs, files, ignored=tuple(IGNORED_DIRS)))
    imports = resolve_python(py, files).union(resolve_js(js, files)).distinct()
    links = resolved.where("status = 'ok'").select("source", F.col("hit").alias("target")).distinct()
    mentions = docs.select(F.col("path").alias("source"), F.explode(decision_ids(F.col("text"), decision_prefixes)).alias("d")).select("source", F.concat(F.lit("decision:"), "d").alias("target"))
    symbol = lambda c: F.concat("path", F.lit("::"), F.col(c))
    defs = found.select("path", F.explode("defs").alias("d")).select("path", "d.*")
    calls = found.select("path", F.explode("calls").alias("c")).select("path", "c.*")
    edge = lambda d, t, k: d.select("source", "target", F.lit(t).alias("type"), F.lit(k).cast("bigint").alias("ord"))
    edges = (
        edge(files.select(F.col("path").alias("source"), F.concat(F.lit("area:"), top_area(F.col("path"))).alias("target")), "belongs_to", 0)
        .union(edge(imports, "imports", 1))
        .union(edge(links, "references", 1))
        .union(edge(defs.select(F.col("path").alias("source"), symbol("qualname").alias("target")), "defines", 2))
        .union(edge(calls.select(symbol("caller").alias("source"), symbol("callee").alias("target")), "calls", 2))
        .union(edge(mentions, "mentions", 3))
    )
    if log is not None:
        commits, touched = sessions(log, files)
        edges = edges.union(edge(touched, "touches", 4))
    edges = cut(first_by(edges, ("source", "target", "type"), ("ord",)))
    inbound = edges.where("type in ('imports', 'references')").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("inbound"))
    nodes = nodes.join(inbound, "id", "left").join(reference_lists(resolved), "id", "left")
    told = describe(F.col("type"), F.col("path"), F.coalesce("inbound", F.lit(0)))
    shape = lambda d: d.select("id", "type", "label", "description", "path", "size", none("string").alias("date"), "broken_refs", "external_refs", "extra")
    nodes = shape(nodes.withColumn("description", told).withColumn("extra", none("map<string,string>")))

    def plain(d: DataFrame, type_: str) -> DataFrame:
        d = d.withColumn("type", F.lit(type_)).withColumn("description", F.lit(type_)).withColumn("path", none("string")).withColumn("size", none("bigint"))
        d = d.withColumn("broken_refs", none("array<string>")).withColumn("external_refs", none("array<string>"))
        return shape(d if "extra" in d.columns else d.withColumn("extra", none("map<string,string>")))

    areas = plain(files.select(top_area(F.col("path")).alias("label")).distinct().withColumn("id", F.concat(F.lit("area:"), "label")), "area")
    decisions = plain(mentions.select(F.col("target").alias("id"), F.expr("substring(target, 10)").alias("label")).distinct(), "decision")
    extra = F.create_map(F.lit("file"), "path", F.lit("line"), F.col("line").cast("string"), F.lit("kind"), "kind", F.lit("qualname"), "qualname")
    symbols = plain(defs.select(symbol("qualname").alias("id"), F.col("qualname").alias("label"), extra.alias("extra")).dropDuplicates(["id"]), "symbol")
    nodes = nodes.union(areas).union(decisions).union(symbols)
    if log is not None:
        dated = plain(commits.select("id", "label", "extra"), "session").drop("description", "date").join(commits.select("id", "description", "date"), "id")
        nodes = nodes.unionByName(dated)
    return PropertyGraph(cut(nodes), edges, project)


def save(graph: PropertyGraph, path: str) -> None:
    """Parquet folders ``nodes`` and ``edges``."""
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.write.parquet(f"{path}/edges")


def load(spark: SparkSession, path: str, project: str = "project") -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), project)
