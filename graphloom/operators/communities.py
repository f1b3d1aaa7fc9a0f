"""Communities by sequential label propagation, exact: small components in a task each, large graphs by stages."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.paths import top_area
from graphloom.graph import PropertyGraph
from graphloom.operators.iterate import cut, discard, numbered
from graphloom.schema import KNOWLEDGE

PASSES = 12
#: Edges that one task propagates over.
ONE_TASK = 500_000
#: Levels after which nodes are taken by ranges.
LEVELS = 16
#: Labels up to which a stage's are sent to all tasks.
BROADCAST_LABELS = 1_500_000
BROADCAST_NAMES = 200_000
#: Rows that a partition is meant to have.
TASK_ROWS = 1_000_000
WIDE = 1 << 31


def _parts(rows: int) -> int:
    """Partitions for rows of numbers, by their count: those made from sizes in bytes would hold many of what compresses well."""
    return max(1, math.ceil(2 * rows / TASK_ROWS))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, component) of every end of (a, b); the component is its smallest id.

    Labels move to the smallest among neighbours, then jump to their label's
    label, until a digest of all labels stays the same.  Rows are sent to so many
    partitions that none has more than about ``TASK_ROWS``, and are aggregated there:
    beforehand a task's memory would grow with its split.
    """
    links = cut(pairs.select("a", "b").where("a <> b"))
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * links.count() / TASK_ROWS))
    both = cut(links.union(links.select("b", "a")).repartition(parts, "a", "b").distinct())
    discard(links)
    labels = cut(both.repartition(parts, "a").groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    before = None
    while True:
        now = labels.agg(F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).collect()[0][0]
        if now == before:
            return labels.withColumnRenamed("label", "component")
        before = now
        told = labels.select(F.col("id").alias("b"), "label").repartition(parts, "b")
        near = both.repartition(parts, "b").join(told, "b").select(F.col("a").alias("id"), "label").repartition(parts, "id").groupBy("id").agg(F.min("label").alias("near"))
        step = cut(labels.repartition(parts, "id").join(near, "id").select("id", F.least("label", "near").alias("label")))
        # what labels lead to; there are few of them, or none, once components are large
        used = step.select("label").repartition(parts, "label").distinct()
        jump = cut(step.select(F.col("id").alias("label"), F.col("label").alias("beyond")).where("label <> beyond").repartition(parts, "label").join(used, "label"))
        size = jump.count()
        if size:
            by = step.join(F.broadcast(jump), "label", "left") if size <= BROADCAST_NAMES else step.repartition(parts, "label").join(jump.repartition(parts, "label"), "label", "left")
            step = cut(by.select("id", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels = step


def propagate(pairs: list[tuple[str, str]], passes: int = PASSES) -> dict[str, str]:
    """Label propagation in place over sorted ids; majority label of the neighbours, then the smallest."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    ids = sorted(near)
    labels = {i: i for i in ids}
    for _ in range(max(1, passes)):
        changed = False
        for i in ids:
            tally = Counter(labels[j] for j in near[i])
            most = max(tally.values())
            best = min(x for x, n in tally.items() if n == most)
            changed |= best != labels[i]
            labels[i] = best
        if not changed:
            break
    return labels


def _by_component(pairs: DataFrame, group: DataFrame, passes: int, kind: str) -> DataFrame:
    """(n, label) by one task for each component; ids are of the SQL type ``kind``."""
    owned = pairs.join(group.select(F.col("id").alias("a"), "component"), "a")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        told = propagate(list(zip(g["a"], g["b"])), passes)
        return pd.DataFrame({"n": list(told), "label": list(told.values())})

    return owned.groupBy("component").applyInPandas(run, f"n {kind}, label {kind}")


def _levels(pairs: DataFrame, most: int) -> tuple[DataFrame, int, DataFrame]:
    """((n, stage), stages, (n) of the rest) of (a, b) with a < b: a node's stage is one beyond its smaller neighbours' last.

    Nodes of a stage aren't linked.  Nodes that are beyond ``most`` stages are the rest.
    """
    k = _parts(pairs.count())
    blocked = pairs.select(F.col("b").alias("n")).repartition(k, "n").distinct()
    roots = cut(pairs.select(F.col("a").alias("n")).repartition(k, "n").distinct().join(blocked, "n", "left_anti"))
    found, stages, left, before = roots.select("n", F.lit(0).alias("stage")), 1, pairs, None
    while stages < most and left.take(1):
        marked = cut(left.repartition(k, "a").join(roots.select(F.col("n").alias("a"), F.lit(True).alias("free")).repartition(k, "a"), "a", "left").select("a", "b", F.coalesce("free", F.lit(False)).alias("free")))
        discard(*[before] * (before is not None))
        before, left = marked, marked.where("not free").select("a", "b")
        roots = cut(marked.select(F.col("b").alias("n"), "free").repartition(k, "n").groupBy("n").agg(F.min("free").alias("free")).where("free").select("n"))
        if roots.take(1):
            found = found.union(roots.select("n", F.lit(stages).alias("stage")))
            stages += 1
    rest = left.select(F.explode(F.array("a", "b")).alias("n")).repartition(k, "n").distinct().join(roots.repartition(k, "n"), "n", "left_anti")
    return cut(found), stages, cut(rest)


def _ranges(pairs: DataFrame, rest: DataFrame, first: int, held: int) -> tuple[DataFrame, list[int]]:
    """((n, stage), stages) of the rest: ranges of numbers, each of about ``held`` links at its nodes."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("n")).join(rest, "n", "left_semi"))
    parts = max(1, math.ceil(ends.count() / held))
    bounds = sorted(set(ends.approxQuantile("n", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    beyond = F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds]).cast("array<int>"), lambda x: x < F.col("n")))
    rows = cut(rest.select("n", (F.lit(first) + beyond).alias("stage")))
    return rows, sorted(r[0] for r in rows.select("stage").distinct().collect())


def _in_sequence(g: pd.DataFrame) -> pd.DataFrame:
    """A range's nodes one by one: ``other`` is a neighbour within the range, else ``label`` has ``times`` neighbours without."""
    own, near, tally = {}, defaultdict(list), defaultdict(Counter)
    for n, other, label, times, mine in zip(g["n"], g["other"], g["label"], g["times"], g["mine"]):
        if mine >= 0:
            own[n] = mine
        elif other >= 0:
            near[n].append(other)
        else:
            tally[n][label] += times
    before = dict(own)
    for n in sorted(own):
        told = tally.pop(n, Counter())
        told.update(own[j] for j in near[n])
        most = max(told.values())
        own[n] = min(x for x, c in told.items() if c == most)
    return pd.DataFrame({"n": list(own), "label": list(own.values()), "changed": [own[n] != before[n] for n in own]})


def propagate_staged(pairs: DataFrame, levels: tuple[DataFrame, int, DataFrame], passes: int = PASSES, held: int = ONE_TASK) -> DataFrame:
    """(n, label) as ``propagate`` has it, of distinct (a, b) with a < b (numbers), without a task that holds a component.

    A node needs its smaller neighbours' new labels and its larger ones' old ones.
    So nodes are taken by stages that ascend along every link: first by levels,
    whose nodes don't touch and are all taken at once by joins (``levels`` is
    what ``_levels`` found); the rest by ranges of numbers, one task a range.  A
    stage none of whose neighbours changed is passed over.
    """
    placed, flat, rest = levels
    stages = list(range(flat))
    if rest.take(1):
        deep, more = _ranges(pairs, rest, flat, held)
        placed, stages = placed.union(deep), stages + more
    k = _parts(pairs.count())
    at = lambda end: placed.select(F.col("n").alias(end), F.col("stage").alias(f"at_{end}")).repartition(k, end)
    way = lambda x, y: F.struct(F.col(x).alias("n"), F.col(y).alias("other"), F.col(f"at_{x}").alias("stage"), F.col(f"at_{y}").alias("beyond"))
    both = pairs.repartition(k, "a").join(at("a"), "a").repartition(k, "b").join(at("b"), "b").select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    near = cut(both.repartition(2 * k, "n").sortWithinPartitions("stage", "beyond", "n"), "stage")
    beside: dict[int, dict[int, int]] = defaultdict(dict)
    for r in near.groupBy("stage", "beyond").agg(F.count("*").alias("links")).collect():
        beside[r["stage"]][r["beyond"]] = r["links"]
    sizes = {r[0]: r[1] for r in placed.groupBy("stage").count().collect()}
    labels = {s: placed.where(F.col("stage") == s).select("n", F.col("n").alias("label"), F.lit(False).alias("changed")) for s in stages}
    seen = dict.fromkeys(stages, -1)  # when a stage was last taken, and when its labels last changed
    moved = dict.fromkeys(stages, 0)
    clock = 0
    for _ in range(max(1, passes)):
        any_ = False
        for s in stages:
            # a range looks at itself, too
            if all(moved[m] <= seen[s] for m in beside[s]):
                continue
            clock += 1
            here = near.where(F.col("stage") == s)
            own = labels[s].select("n", "label")
            rows = []
            for m in beside[s]:
                if m != s:
                    far, links = labels[m].select(F.col("n").alias("other"), "label"), here.where(F.col("beyond") == m)
                    if sizes[m] > BROADCAST_LABELS:
                        k = _parts(max(beside[s][m], sizes[m]))
                        links, far = links.repartition(k, "other"), far.repartition(k, "other").hint("merge")
                    else:
                        far = F.broadcast(far)
                    rows.append(links.join(far, "other").select("n", "label", F.lit(1).alias("one"), F.lit(-1).alias("mine")))
            rows.append(own.select("n", "label", F.lit(0), F.col("label")))
            whole = rows[0]
            for r in rows[1:]:
                whole = whole.union(r)
            tally = whole.repartition(_parts(sum(beside[s].values()) + sizes[s]), "n").groupBy("n", "label").agg(F.sum("one").alias("times"), F.max("mine").alias("mine"))
            if s < flat:
                # the most frequent, then the smallest: one number, so that it is aggregated by hash
                best = tally.groupBy("n").agg(F.max(F.col("times") * WIDE + (WIDE - 1 - F.col("label"))).alias("best"), F.max("mine").alias("mine"))
                new = best.select("n", (WIDE - 1 - F.col("best") % WIDE).cast("int").alias("label"), "mine").select("n", "label", (F.col("label") != F.col("mine")).alias("changed"))
            else:
                none = F.lit(-1)
                outer = tally.where("times > 0").select("n", none.alias("other"), "label", "times", none.alias("mine"))
                inner = here.where(F.col("beyond") == s).select("n", "other", none, F.lit(0).cast("bigint"), none)
                new = outer.union(inner).union(own.select("n", none, none, F.lit(0).cast("bigint"), "label")).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_sequence, "n int, label int, changed boolean")
            old, labels[s] = labels[s], cut(new)
            discard(old)
            seen[s] = clock
            if labels[s].where("changed").take(1):
                moved[s], any_ = clock, True
                if s >= flat:
                    seen[s] = clock - 1  # its own nodes are neighbours
        if not any_:
            break
    out = labels[stages[0]].select("n", "label")
    for s in stages[1:]:
        out = out.union(labels[s].select("n", "label"))
    return out


def _numbered_labels(graph: PropertyGraph, relations: tuple[str, ...], passes: int) -> DataFrame:
    """(id, label) of every end of an edge; ids are numbered in their order, and labels are numbers till the end."""
    ids = cut(numbered(graph.nodes.select("id").repartition("id").distinct(), [F.col("id")], "n"))
    edges = graph.of_types(relations).where("source <> target").select("source", "target")
    k = _parts(edges.count())
    end = lambda x: ids.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")).repartition(k, x)
    edges = edges.repartition(k, "source").join(end("source"), "source").repartition(k, "target").join(end("target"), "target")
    pairs = cut(edges.select(F.least("n_source", "n_target").alias("a"), F.greatest("n_source", "n_target").alias("b")).repartition(k, "a", "b").distinct())
    levels = _levels(pairs, LEVELS)
    if not levels[2].take(1):
        told = propagate_staged(pairs, levels, passes)
    else:
        # deep: small components are a task's work each, only large ones are taken by stages
        group = connected_components(pairs)
        size = pairs.join(group.withColumnRenamed("id", "a"), "a").groupBy("component").count()
        large = cut(group.join(size.where(F.col("count") > ONE_TASK), "component", "left_semi").select("id", "component"))
        told = _by_component(pairs, group.join(large, "id", "left_anti"), passes, "int")
        if large.take(1):
            some = cut(pairs.join(large.withColumnRenamed("id", "a"), "a", "left_semi"))
            told = told.union(propagate_staged(some, _levels(some, LEVELS), passes))
    told = cut(told)
    used = cut(told.select(F.col("label").alias("n")).distinct().join(ids, "n").select(F.col("n").alias("label"), F.col("id").alias("named")))
    # a label may have most of the nodes
    used = F.broadcast(used) if used.count() <= BROADCAST_NAMES else used
    return told.join(ids, "n").join(used, "label").select("id", F.col("named").alias("label"))


def detect(graph: PropertyGraph, relations: tuple[str, ...] = KNOWLEDGE, passes: int = PASSES) -> DataFrame:
    """(id, label) of every node with a path that isn't an area, decision or session.

    Without an edge the label is ``area:<top folder>``.  The propagation is
    sequential, and what happens in one component doesn't affect another; so each
    component of up to ``ONE_TASK`` edges is one group's work.  Graphs with more edges
    go by stages (``propagate_staged``).
    """
    if graph.of_types(relations).count() > ONE_TASK:
        labels = _numbered_labels(graph, relations, passes)
    else:
        ids = graph.nodes.select("id")
        edges = graph.of_types(relations).select(F.col("source").alias("a"), F.col("target").alias("b"))
        edges = cut(edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").where("a <> b").select("a", "b").distinct())
        labels = _by_component(edges, connected_components(edges), passes, "string").withColumnRenamed("n", "id")
    files = graph.nodes.where("path is not null and type not in ('area', 'decision', 'session')").select("id", "path")
    return files.join(labels, "id", "left").select("id", F.coalesce("label", F.concat(F.lit("area:"), top_area(F.col("path")))).alias("label"))


def names(comm: DataFrame) -> DataFrame:
    """(label, size, name): ``Cluster 1`` is the largest; ties by label."""
    sizes = comm.groupBy("label").agg(F.count("*").alias("size"))
    told = numbered(sizes, [F.desc("size"), F.col("label")], "place")
    return told.select("label", "size", F.concat(F.lit("Cluster "), F.col("place").cast("string")).alias("name"))


def summarize(graph: PropertyGraph, comm: DataFrame, relations: tuple[str, ...] = KNOWLEDGE, key_files: int = 5) -> DataFrame:
    """(name, label, size, key_files, dominant_types, internal_edges, boundary_edges, cohesion) per community."""
    edges = graph.of_types(relations).where("source <> target").select("source", "target")
    side = lambda x: comm.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    placed = edges.join(side("source"), "source", "left").join(side("target"), "target", "left").select("lsource", "ltarget")
    inside = F.col("lsource") == F.col("ltarget")
    ends = F.when(inside, F.array("lsource")).otherwise(F.array("lsource", "ltarget"))
    told = placed.where("lsource is not null or ltarget is not null").select(F.explode(ends).alias("label"), F.coalesce(inside, F.lit(False)).alias("inside")).where("label is not null")
    held = told.groupBy("label").agg(F.count_if("inside").alias("internal_edges"), F.count_if(~F.col("inside")).alias("boundary_edges"))
    types = comm.join(graph.nodes.select("id", "type"), "id").groupBy("label", "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    types = types.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "type"))).where("k <= 3")
    types = types.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "type"))), lambda x: x["type"]).alias("dominant_types"))
    files = comm.join(graph.community_degree(relations), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    files = files.withColumn("k", F.row_number().over(w.orderBy(F.desc("degree"), "id"))).where(F.col("k") <= key_files)
    files = files.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("key_files"))
    rows = names(comm).join(files, "label").join(types, "label", "left").join(held, "label", "left").fillna(0, ["internal_edges", "boundary_edges"])
    total = F.col("internal_edges") + F.col("boundary_edges")
    cohesion = F.when(total > 0, F.bround(F.col("internal_edges") / total, 2)).otherwise(F.lit(0.0))
    return rows.select("name", "label", "size", "key_files", "dominant_types", "internal_edges", "boundary_edges", cohesion.alias("cohesion"))


def surprising_edges(graph: PropertyGraph, comm: DataFrame, relations: tuple[str, ...] = KNOWLEDGE, top: int = 10) -> DataFrame:
    """Edges between communities whose ends are best connected."""
    named = comm.join(names(comm).select("label", "name"), "label")
    degree = graph.community_degree(relations)
    side = lambda x: named.join(degree, "id", "left").select(F.col("id").alias(x), F.col("name").alias(f"{x}_community"), F.coalesce("degree", F.lit(0)).alias(f"d{x}"))
    rows = graph.of_types(relations).select("source", "target", "type").join(side("source"), "source").join(side("target"), "target")
    rows = rows.where("source_community <> target_community").withColumn("weight", F.col("dsource") + F.col("dtarget"))
    return rows.orderBy(F.desc("weight"), "source", "target", "type").limit(max(0, top)).select("source", "target", "type", "source_community", "target_community", "weight")


def community_summary(graph: PropertyGraph, key_files: int = 5, surprising: int = 10, limit: int = 0) -> dict:
    """{communities, surprising, count}: the largest first, ``limit`` of them if positive."""
    comm = cut(detect(graph))
    rows = summarize(graph, comm, key_files=key_files).orderBy(F.desc("size"), "label")
    return {"count": comm.select("label").distinct().count(), "communities": rows.limit(limit) if limit > 0 else rows, "surprising": surprising_edges(graph, comm, top=surprising)}
