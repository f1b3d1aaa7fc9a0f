"""Resolution of raw findings to edges: equi-joins with ordered fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import REFERENCE_DOC, basename, dirname, ext, is_external, join_path, looks_like_path, stem
from graphloom.operators.iterate import cut

JS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")


def module_map(files: DataFrame) -> DataFrame:
    """(dotted, path) of Python files; of a module and a package of one name the package counts."""
    py = files.where(ext(F.col("path")) == ".py").select("path")
    bare = F.regexp_replace("path", r"\.py$", "")
    package = bare.rlike(r"(^|/)__init__$")
    dotted = F.replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))
    return py.select(dotted.alias("dotted"), "path", package.alias("package")).where("dotted <> ''").groupBy("dotted").agg(F.max(F.struct("package", "path"))["path"].alias("path"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target) from (source, level, module, names): the module and its members that are modules.

    A relative import starts at the source's package, one level up for each
    further dot; oneself and the unknown are dropped.
    """
    own = F.split(F.regexp_replace("source", r"\.py$", ""), "/")
    kept = F.size(own) - F.col("level")
    package = F.when(F.col("level") > 0, F.array_join(F.slice(own, F.lit(1), F.greatest(kept, F.lit(0))), "."))
    module = F.coalesce("module", F.lit(""))
    base = F.when(F.col("level") == 0, module).when(module == "", package).when(package == "", module).otherwise(F.concat(package, F.lit("."), module))
    rows = imports.withColumn("base", base)
    members = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.when(F.col("base") == "", n).otherwise(F.concat("base", F.lit("."), n)))
    wanted = rows.where((F.col("level") == 0) | (kept >= 0)).select("source", F.explode(F.array_distinct(F.concat(F.array("base"), members))).alias("dotted"))
    hits = wanted.join(module_map(files), "dotted").select("source", F.col("path").alias("target"))
    return hits.where("source <> target").distinct()


def resolve_js(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target) from (source, spec): the first suffix that makes a known file other than oneself."""
    base = join_path(dirname(F.col("source")), F.col("spec"))
    tries = imports.withColumn("base", base).select("source", "spec", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in JS_SUFFIXES])).alias("pos", "target"))
    hits = tries.join(files.select(F.col("path").alias("target")), "target", "left_semi").where("source <> target")
    return hits.groupBy("source", "spec").agg(F.min_by("target", "pos").alias("target")).select("source", "target").distinct()


def _unique(keys: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(source, target, hit) where exactly one file other than the source has the key.

    Files are counted per key first, so a name that thousands of folders have is
    one row and is never joined with itself.
    """
    held = keys.groupBy(key).agg(F.count("*").alias("n"), F.min("path").alias("lo"), F.max("path").alias("hi")).where("n <= 2")
    lone = F.when((F.col("n") == 1) & (F.col("lo") != F.col("source")), F.col("lo"))
    other = F.when((F.col("n") == 2) & (F.col("lo") == F.col("source")), F.col("hi")).when((F.col("n") == 2) & (F.col("hi") == F.col("source")), F.col("lo"))
    return wanted.join(held, key).select("source", "target", F.coalesce(lone, other).alias("hit")).where("hit is not null")


def resolve_references(refs: DataFrame, files: DataFrame, listed: DataFrame | None = None, ignored: tuple[str, ...] = (), pruned: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, kind, hit, status) of raw references (source, target, kind).

    The first of: a file at the path relative to the source, one at the path
    from the root, the only other file with that name, the only other file with
    that stem.  An exact hit on oneself ends the search without an edge.
    status: ok, self, broken, external or ignored.  ``listed`` has all present
    paths, indexed or not; folders in ``pruned`` belong to other projects.
    """
    known = files.select("path")
    rows = refs.select("source", "target", "kind").distinct()
    rows = rows.withColumn("relative", join_path(dirname(F.col("source")), F.col("target"))).withColumn("rooted", join_path(F.lit(""), F.col("target")))
    a = known.select(F.col("path").alias("relative"), F.col("path").alias("hit_relative"))
    b = known.select(F.col("path").alias("rooted"), F.col("path").alias("hit_rooted"))
    rows = cut(rows.join(a, "relative", "left").join(b, "rooted", "left"))
    open_ = rows.where("hit_relative is null and hit_rooted is null")
    named = _unique(known.select(basename(F.col("path")).alias("name"), "path"), open_.select("source", "target", basename(F.col("target")).alias("name")).where("name <> ''").distinct(), "name")
    docs = known.where(F.ltrim(ext(F.col("path")), F.lit(".")).isin(REFERENCE_DOC))
    bare = open_.where(ext(F.col("target")) == "").select("source", "target", basename(F.col("target")).alias("stem")).where("stem <> ''").distinct()
    stemmed = _unique(docs.select(stem(F.col("path")).alias("stem"), "path"), bare, "stem")
    # only what has no exact hit takes part in the further joins
    told = rows.where("hit_relative is not null or hit_rooted is not null").withColumns({"hit_name": F.lit(None).cast("string"), "hit_stem": F.lit(None).cast("string")})
    rows = open_.join(named.withColumnRenamed("hit", "hit_name"), ["source", "target"], "left").join(stemmed.withColumnRenamed("hit", "hit_stem"), ["source", "target"], "left")
    rows = told.unionByName(rows)
    if listed is None:
        rows = rows.withColumn("there", F.col("hit_relative").isNotNull())
    else:
        rows = rows.join(listed.select(F.col("path").alias("relative"), F.lit(True).alias("there")).distinct(), "relative", "left")
    exact = F.coalesce("hit_relative", "hit_rooted")
    hit = F.coalesce(exact, F.col("hit_name"), F.col("hit_stem"))
    first = F.split_part(F.col("relative"), F.lit("/"), F.lit(1))
    leaves = F.col("relative").startswith("..") | F.col("target").startswith("/") | first.isin(*pruned, "")
    skipped = (F.col("kind") == "path") | first.isin(*ignored, "") | F.coalesce("there", F.lit(False)) | ((F.col("kind") == "wikilink") & ~F.contains("target", F.lit("/"))) | ~looks_like_path(F.col("target"))
    status = (
        F.when(exact == F.col("source"), "self").when(hit.isNotNull(), "ok").when(leaves, "external").when(is_external(F.col("target")) | skipped, "ignored").otherwise("broken")
    )
    return rows.select("source", "target", "kind", F.when(status == "ok", hit).alias("hit"), status.alias("status"))


def reference_lists(resolved: DataFrame) -> DataFrame:
    """(id, broken_refs, external_refs) as sorted lists."""
    some = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("target"))))
    return resolved.groupBy(F.col("source").alias("id")).agg(some("broken").alias("broken_refs"), some("external").alias("external_refs"))


def link_absolute(paths: DataFrame, projects: DataFrame, path: str = "target") -> DataFrame:
    """Deepest project root that holds an absolute path: ancestors are exploded and joined by equality."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = paths.withColumn("root", F.explode(ancestors)).join(projects.select("project", "root"), "root")
    keys = [c for c in paths.columns]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.length("root").alias("n"), "root", "project")).alias("best"))
    return best.select(*keys, F.col("best.project").alias("project"), F.expr(f"substring({path}, best.n + 2)").alias("relative"))


def enrich_from_code_graph(nodes: DataFrame, links: DataFrame, files: DataFrame, made: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, counters) from a foreign code graph: nodes (id, source_file), links (source, target, relation, confidence).

    Links between two different known files become imports or references;
    files (path, mtime) changed after the graph was ``made`` make a link stale.
    """
    relation = F.create_map(*[F.lit(x) for r in ("calls", "imports", "implements", "inherits", "uses", "extends", "imports_from") for x in (r, "imports")], F.lit("references"), F.lit("references"))
    clean = F.regexp_replace(F.translate("source_file", "\\", "/"), r"^\./", "")
    owner = nodes.select("id", clean.alias("path"))
    mtime = F.col("mtime") if "mtime" in files.columns else F.lit(None).cast("bigint")
    known = files.select("path", mtime.alias("m"))
    side = lambda x: owner.join(known, "path", "left").select(F.col("id").alias(x), F.col("path").alias(f"{x}_path"), F.col("m").alias(f"{x}_m"))
    inside = known.select(F.col("path"), F.lit(True).alias("known"))
    rows = links.withColumn("type", relation[F.col("relation")]).where("type is not null").join(side("source"), "source").join(side("target"), "target").where("source_path <> target_path")
    for x in ("source", "target"):
        rows = rows.join(inside.select(F.col("path").alias(f"{x}_path"), F.col("known").alias(f"{x}_known")), f"{x}_path", "left")
    stale = F.lit(False) if made is None else F.coalesce((F.col("source_m") > made) | (F.col("target_m") > made), F.lit(False))
    fate = F.when(F.col("source_known").isNull() | F.col("target_known").isNull(), "outside").when(stale, "stale").otherwise("added")
    rows = rows.withColumn("fate", fate)
    edges = rows.where("fate = 'added'").groupBy(F.col("source_path").alias("source"), F.col("target_path").alias("target"), "type").agg(F.min(F.struct("relation", F.col("confidence").cast("string").alias("confidence"))).alias("m"))
    meta = F.create_map(F.lit("via"), F.lit("code-graph"), F.lit("relation"), F.col("m.relation"), F.lit("confidence"), F.coalesce("m.confidence", F.lit("")))
    return edges.select("source", "target", "type", F.lit(None).cast("bigint").alias("ord"), meta.alias("meta")), rows.groupBy("fate").agg(F.count("*").alias("n"))
