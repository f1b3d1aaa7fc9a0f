"""The part of a graph that matters for a task, within a token budget."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import is_copy_or_log, node_cost
from graphloom.graph import PropertyGraph
from graphloom.operators.bm25 import focus_seeds
from graphloom.operators.budget import fit
from graphloom.operators.iterate import cut
from graphloom.operators.rank import by_rank, pagerank
from graphloom.operators.recency import blend, recency_scores
from graphloom.sources.tree import signatures

SEEDS_SHOWN = 20


def ranked(graph: PropertyGraph, task: str, damping: float = 0.85, recency: float = 0.0, half_life_days: float = 30.0, max_iter: int = 100, tol: float = 1e-9) -> DataFrame:
    """(id, type, path, score, seed, noise) of every node but areas: PageRank that restarts at what the task's words hit."""
    seeds = cut(focus_seeds(graph, task))
    scores = pagerank(graph, damping=damping, max_iter=max_iter, tol=tol, personalization=seeds if seeds.take(1) else None)
    if recency > 0:
        recent = recency_scores(graph, half_life_days)
        if recent.take(1):
            scores = blend(scores, recent, recency)
    marked = seeds.select("id", F.lit(True).alias("seed"))
    rows = graph.nodes.where("type <> 'area'").select("id", "type", "path").join(scores, "id").join(marked, "id", "left")
    return rows.withColumn("seed", F.coalesce("seed", F.lit(False))).withColumn("noise", is_copy_or_log(F.coalesce("path", "id")))


def fitting(rows: DataFrame, budget_tokens: int) -> DataFrame:
    """Of ranked rows those that fit: seeds first, then by rank, backups and logs last."""
    order = [F.col("noise"), F.when(F.col("noise"), F.lit(False)).otherwise(~F.col("seed")), by_rank(), F.col("id")]
    kept = fit(rows, node_cost(F.col("id"), F.col("type"), F.col("path")), budget_tokens, order, unlimited_below_one=False)
    return kept.drop("noise").withColumn("score", F.round("score", 6))


def focus_nodes(graph: PropertyGraph, task: str, budget_tokens: int = 2000, damping: float = 0.85, recency: float = 0.0, half_life_days: float = 30.0, max_iter: int = 100, tol: float = 1e-9) -> DataFrame:
    """(id, type, path, score, seed, cost, spent) of the nodes that fit the budget."""
    return fitting(ranked(graph, task, damping, recency, half_life_days, max_iter, tol), budget_tokens)


def focus(graph: PropertyGraph, task: str, budget_tokens: int = 2000, recency: float = 0.0, **options) -> dict:
    """Nodes, the knowledge edges among them and the best ranked seeds; the whole answer fits the budget."""
    rows = cut(ranked(graph, task, recency=recency, **options))
    seeds = rows.where("seed")
    nodes = cut(fitting(rows, budget_tokens))
    edges = PropertyGraph(graph.nodes, graph.knowledge).induced(nodes).select("source", "target", "type").orderBy("source", "target", "type")
    kept = [r.asDict() for r in nodes.orderBy("spent").collect()]
    best = [r["id"] for r in seeds.orderBy("noise", by_rank(), "id").limit(SEEDS_SHOWN).collect()]
    total = seeds.count()
    result = {
        "task": task, "seeds": best, "seeds_total": total, "fallback": not total, "recency": max(0.0, recency), "budget_tokens": budget_tokens, "token_estimate": kept[-1]["spent"] if kept else 0,
        "nodes": [{k: r[k] for k in ("id", "type", "path", "score", "seed")} for r in kept], "edges": [r.asDict() for r in edges.collect()],
    }
    return fit_result(result, budget_tokens)


def fit_result(result: dict, budget_tokens: int) -> dict:
    """Takes edges, then nodes (with what edges they have), from the end until the indented JSON fits; one node stays."""
    cost = lambda: max(1, round(len(json.dumps(result, indent=2, ensure_ascii=False)) / 4))
    while budget_tokens > 0 and cost() > budget_tokens and (result["edges"] or len(result["nodes"]) > 1):
        if result["edges"]:
            result["edges"].pop()
        else:
            result["nodes"].pop()
        result["truncated"] = True
    result["token_estimate"] = cost()
    return result


def attach_signatures(graph: PropertyGraph, root: str, result: dict, budget_tokens: int = 600, per_file: int = 8) -> dict:
    """Adds ``signatures``: the first definitions of the answer's Python files, in rank order, while they fit their own budget.

    Reads the few files of an answer, on the driver.
    """
    wanted = [n["id"] for n in result["nodes"] if n["type"] == "program" and (n["path"] or "").endswith(".py")]
    told: dict[str, list[dict]] = {}
    spent = 0
    for id_ in wanted:
        if budget_tokens > 0 and spent >= budget_tokens:
            break
        try:
            with open(os.path.join(root, id_), encoding="utf-8", errors="ignore") as f:
                found = signatures(f.read())
        except OSError:
            continue
        rows = []
        for text, line, depth in found[:per_file]:
            cost = max(1, round(len(text) / 4))
            if budget_tokens > 0 and (told or rows) and spent + cost > budget_tokens:
                break
            rows.append({"signature": text, "line": line, "kind": "class" if text.startswith("class ") else "function", "depth": depth})
            spent += cost
        if rows:
            told[id_] = rows
    return result | {"signatures": told}
