"""GraphML, JSON and Markdown outputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="ntype" for="node" attr.name="type" attr.type="string"/>
<key id="nlabel" for="node" attr.name="label" attr.type="string"/>
<key id="npath" for="node" attr.name="path" attr.type="string"/>
<key id="etype" for="edge" attr.name="type" attr.type="string"/>
<graph edgedefault="directed">"""
TAIL = "</graph>\n</graphml>"


def escape(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_nodes(graph: PropertyGraph) -> DataFrame:
    line = F.format_string('<node id="%s"><data key="ntype">%s</data><data key="nlabel">%s</data><data key="npath">%s</data></node>', *[escape(F.col(c)) for c in ("id", "type", "label", "path")])
    return graph.nodes.select("id", line.alias("line"))


def graphml_edges(graph: PropertyGraph) -> DataFrame:
    line = F.format_string('<edge source="%s" target="%s"><data key="etype">%s</data></edge>', *[escape(F.col(c)) for c in ("source", "target", "type")])
    return graph.edges.select("source", "target", "type", line.alias("line"))


def write_graphml(graph: PropertyGraph, path: str) -> None:
    """Folders ``nodes`` and ``edges`` of sorted lines below ``path``; ``cat`` head, nodes, edges and tail for one file."""
    graphml_nodes(graph).orderBy("id").select("line").write.text(f"{path}/nodes")
    graphml_edges(graph).orderBy("source", "target", "type").select("line").write.text(f"{path}/edges")


def to_graphml(graph: PropertyGraph) -> str:
    """One document, for graphs that fit on the driver."""
    nodes = [r["line"] for r in graphml_nodes(graph).orderBy("id").toLocalIterator()]
    edges = [r["line"] for r in graphml_edges(graph).orderBy("source", "target", "type").toLocalIterator()]
    return "\n".join([HEAD, *nodes, *edges, TAIL]) + "\n"


def to_json(graph: PropertyGraph) -> str:
    """Sorted nodes and edges with a schema version, for graphs that fit on the driver."""
    keep = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if v is not None and k != "ord"}
    nodes = [keep(r) for r in graph.nodes.orderBy("id").toLocalIterator()]
    edges = [keep(r) for r in graph.edges.orderBy("source", "target", "type").toLocalIterator()]
    return json.dumps({"schema_version": 1, "project": graph.project, "nodes": nodes, "edges": edges}, ensure_ascii=False, indent=1)
