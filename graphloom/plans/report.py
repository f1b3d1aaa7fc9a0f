"""A Markdown report of a graph: a driver-side template over small results."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import communities, digest, rank, recency
from graphloom.operators.iterate import cut


def render(graph: PropertyGraph, top: int = 10, key_files: int = 4, bridges: int = 8) -> str:
    """Sections: scale, most important files, churn, communities, bridges, decisions, problems."""
    scale = digest.project_digest(graph).collect()[0]
    lines = [f"# {graph.project}", "", "## Scale", "", f"{scale['files']} files in {scale['areas']} areas, {scale['links']} links, {scale['size']} bytes", ""]

    def section(title: str, rows: list[str]) -> None:
        if rows:
            lines.extend([f"## {title}", "", *[f"- {r}" for r in rows], ""])

    gods = rank.god_nodes(graph, rank.pagerank(graph), top)
    section("Most important files", [f"{r['id']} ({r['type']}, {r['score']:.6f})" for r in gods.orderBy(F.desc("score"), "id").collect()])
    section("Most often touched", [f"{r['id']}: {r['touches']}" for r in recency.churn(graph, top).collect()])
    comm = cut(communities.detect(graph))
    held = communities.summarize(graph, comm, key_files=key_files).orderBy(F.desc("size"), "label").limit(top)
    section("Communities", [f"{r['name']}: {r['size']} files, cohesion {round(r['cohesion'], 2)}, {', '.join(r['key_files'])}" for r in held.collect()])
    section("Surprising links", [f"{r['source']} -> {r['target']} ({r['type']}; {r['source_community']} to {r['target_community']})" for r in communities.surprising_edges(graph, comm, top=bridges).collect()])
    section("Decisions", [f"{r['family']}: {r['n']}" for r in digest.decision_families(graph).orderBy(F.desc("n"), "family").collect()])
    section("Problems", [f"{scale['orphans']} files without a link", f"{scale['broken_refs']} broken references"])
    return "\n".join(lines)
