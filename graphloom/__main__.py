"""Command line: build a folder's graph and ask it."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import communities, digest, focus, recency, traverse
from graphloom.operators.iterate import cut
from graphloom.plans import export, lock, report, store
from graphloom.plans.project import Project, integrity
from graphloom.sources.git import working_changes
from graphloom.streaming.works import Registry, works


def show(rows: DataFrame, *order: str) -> None:
    for r in rows.orderBy(*order).toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def registry(project: Project, a: argparse.Namespace) -> int:
    """Who works on what: begin (files), may-write (file), close, works."""
    held = store.load(project.spark, project.place, project.name)
    own = Registry(project.spark, os.path.join(project.place, "works"), project.name, held and held[0])
    if a.command == "begin":
        print(json.dumps(own.begin(a.agent, files=tuple(a.rest)), ensure_ascii=False))
    elif a.command == "may-write":
        told = own.may_write(a.agent, a.rest[0])
        print(told)
        return 1 if told == "block" else 0
    elif a.command == "close":
        print(json.dumps(own.close(a.agent), ensure_ascii=False))
    else:
        show(works(own.events(), F.current_timestamp()), "agent", "project")
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("root", help="folder of the project")
    p.add_argument("command", choices=("build", "gate", "health", "stats", "map", "assess", "find", "neighbors", "subgraph", "impact", "diff", "why", "focus", "communities", "churn", "decisions", "orphans", "broken", "integrity", "report", "graphml", "json", "begin", "may-write", "close", "works"))
    p.add_argument("rest", nargs="*")
    p.add_argument("--store", help="folder of the stored builds (default: .graphloom below the root)")
    p.add_argument("--budget", type=int, default=2000)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--full", action="store_true", help="build: take over nothing from the build before")
    p.add_argument("--deep", action="store_true", help="health: compare contents, not sizes and times")
    p.add_argument("--recency", type=float, default=0.0)
    p.add_argument("--signatures", action="store_true", help="focus: add the definitions of Python files")
    p.add_argument("--agent", default=lock.agent())
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project = Project(spark, a.root, a.store)
    if a.command in ("begin", "may-write", "close", "works"):
        return registry(project, a)
    if a.command == "build":
        print(json.dumps(project.build(incremental=not a.full)))
    elif a.command == "gate":
        diff = project.changes(deep=True)
        if diff is None:
            project.build()
            diff = project.changes(deep=True)
        graph, kept = store.load(spark, project.place, project.name)
        diff = cut(diff)
        row = digest.gate(graph, diff).collect()[0]
        print(json.dumps(row.asDict()))
        show(digest.gate_details(graph, diff, store.stamp_only(kept)), "kind", "path", "target")
        return 0 if row["ok"] else 1
    elif a.command == "health":
        told = project.health(a.deep)
        print(json.dumps(told, indent=2, ensure_ascii=False))
        return 0 if told.get("ok") else 1
    graph = project.graph()
    if a.command in ("build", "stats"):
        for rows in graph.counts():
            show(rows, "type")
    elif a.command == "map":
        show(digest.project_digest(graph))
        show(digest.area_rollup(graph), F.desc("size"), "area")
        show(graph.most_connected(), F.desc("degree"), "id")
    elif a.command == "find":
        show(graph.find(" ".join(a.rest), 50), "id")
    elif a.command == "neighbors":
        for way in ("out", "in"):
            show(graph.neighbours(a.rest[0], way), "id", "edge")
    elif a.command == "impact":
        got = traverse.impact(graph, a.rest[0], max_depth=a.depth)
        for way in ("upstream", "downstream"):
            if way in got:
                show(got[way], "depth", "id")
        return 0 if got["exists"] else 2
    elif a.command == "why":
        show(traverse.why(graph, a.rest[0], a.rest[1]), "step")
    elif a.command == "focus":
        told = focus.focus(graph, " ".join(a.rest), a.budget, recency=a.recency)
        told = focus.attach_signatures(graph, a.root, told) if a.signatures else told
        print(json.dumps(told, indent=2, ensure_ascii=False))
    elif a.command == "communities":
        show(communities.community_summary(graph)["communities"], F.desc("size"), "label")
    elif a.command == "assess":
        show(digest.assess(graph))
    elif a.command == "subgraph":
        show(traverse.subgraph(graph, a.rest[0], a.depth).edges.select("source", "target", "type"), "source", "target", "type")
    elif a.command == "diff":
        got = traverse.impact_diff(graph, working_changes(spark, a.root), max_depth=a.depth)
        for way in ("upstream", "downstream"):
            show(got[way], "depth", "id")
    elif a.command == "churn":
        show(recency.churn(graph), F.desc("touches"), "id")
    elif a.command == "decisions":
        show(digest.decision_families(graph), F.desc("n"), "family")
    elif a.command == "orphans":
        show(graph.orphans(), "id")
    elif a.command == "broken":
        show(digest.broken_references(graph), "id", "target")
    elif a.command == "integrity":
        show(integrity(graph, a.root), "problem", "path")
    elif a.command == "json":
        sys.stdout.write(export.to_json(graph))
    elif a.command == "report":
        print(report.render(graph))
    else:
        sys.stdout.write(export.to_graphml(graph))
    return 0


if __name__ == "__main__":
    sys.exit(main())
