"""Graph operators on small graphs, and a build from a folder."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.graph import PropertyGraph
from graphloom.operators import communities, rank, traverse


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, t, i.split("/")[-1], i if t not in ("area", "session", "decision") else None, 1, None) for i, t in nodes], "id string, type string, label string, path string, size bigint, date string")
    e = spark.createDataFrame([(s, t, k, o) for o, (s, t, k) in enumerate(edges)], "source string, target string, type string, ord bigint")
    return PropertyGraph(n, e)


def naive_pagerank(ids, edges, rounds, d=0.85):
    n = len(ids)
    out = {i: [t for s, t in edges if s == i] for i in ids}
    r = {i: 1 / n for i in ids}
    for _ in range(rounds):
        lost = sum(r[i] for i in ids if not out[i])
        new = {i: (1 - d) / n + d * lost / n for i in ids}
        for i in ids:
            for t in out[i]:
                new[t] += d * r[i] / len(out[i])
        r = new
    return r


def test_ranks_labels_and_degrees(spark):
    rng = random.Random(0)
    ids = [f"n{i:02d}" for i in range(30)]
    edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(50)})
    g = graph(spark, [(i, "program") for i in ids], [(s, t, "imports") for s, t in edges] + [("n00", "gone", "references")])
    got = {r["id"]: r["score"] for r in rank.pagerank(g, max_iter=6, tol=0).collect()}
    want = naive_pagerank(ids, edges, 6)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in ids)
    labels = {r["id"]: r["label"] for r in communities.detect(g).collect()}
    whole = communities.propagate(edges)
    assert labels == {i: whole.get(i, "area:(root)") for i in ids}
    degree = {r["id"]: r["degree"] for r in g.knowledge_degree().collect()}
    assert degree["gone"] == 1 and all(degree.get(i, 0) == sum((s == i) + (t == i) for s, t in edges) + (i == "n00") for i in ids)


def test_walks(spark):
    hub = [("hub", "program")] + [(f"dep{i}", "program") for i in range(6)] + [("far", "program")]
    g = graph(spark, hub, [(f"dep{i}", "hub", "imports") for i in range(6)] + [("far", "dep0", "imports"), ("far", "dep5", "mentions")])
    up = traverse.impact(g, "hub", "up", cap=3)
    rows = up["upstream"].collect()
    assert up["truncated"] and sorted(r["id"] for r in rows) == ["dep0", "dep1", "dep2", "far"]
    assert next(r for r in rows if r["id"] == "far")["via"] == "dep0"
    assert traverse.impact(g, "nobody") == {"id": "nobody", "exists": False}
    with pytest.raises(ValueError):
        traverse.impact(g, "hub", "sideways")
    walk = [r["id"] for r in traverse.why(g, "dep5", "dep1").orderBy("step").collect()]
    assert walk == ["dep5", "hub", "dep1"]
    assert traverse.why(g, "dep5", "nobody").count() == 0


def test_path_functions(spark):
    rng = random.Random(1)
    some = ["", ".", "..", "a/../..", "/", "/../a", "a//b/./c/", "../x/../y"] + ["/".join(rng.choice(["a", "b", "..", ".", ""]) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    some = [p for p in some if not p.startswith("//")]
    got = [r["n"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(some)], "i int, p string").orderBy("i").select(paths.normpath(F.col("p")).alias("n")).collect()]
    assert got == [posixpath.normpath(p) for p in some]
    kinds = {"src/a.py": "program", "docs/plan.md": "design", "notes/report-2026-01-01.md": "report", "memory/x.md": "memory", "a.csv": "data", "a.toml": "config", "README.md": "structure", "x/y.py.bak": "program", "LICENSE": "structure", "p.png": "config"}
    rows = spark.createDataFrame([(p,) for p in kinds], "p string").select("p", paths.classify(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in rows} == kinds


def test_references_skip_code(spark):
    t = "a [x](b.md#q) `[no](c.zz)` [[Wiki|w]] and src/app.py [x](b.md)\n```\n[no](d.zz)\n```\n[u](https://e.example/x)"
    got = spark.createDataFrame([(t,)], "t string").select(text.references(F.col("t")).alias("r")).collect()[0]["r"]
    assert [(r["target"], r["kind"]) for r in got][:3] == [("b.md", "link"), ("Wiki", "wikilink"), ("src/app.py", "path")]


def test_build_from_folder(spark, tmp_path):
    from graphloom.plans.build import build_graph, load, save
    from graphloom.plans.export import to_graphml, to_json

    tree = {
        "README.md": "see [guide](docs/guide.md), src/app.py, [gone](notes/missing.md) per D-DEMO-1",
        "docs/guide.md": "back to [[README]]",
        "src/__init__.py": "",
        "src/app.py": "from src.util import helper\n\ndef main():\n    return helper()\n\nclass A:\n    def f(self):\n        return self.g()\n    def g(self):\n        return main()\n",
        "src/util.py": "def helper():\n    return 1\n",
        "data/t.csv": "a,b",
        "node_modules/x.js": "import './y'",
        "skip/me.md": "x",
        ".gitignore": "skip/\n",
    }
    for name, body in tree.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(body)
    g = build_graph(spark, str(tmp_path / "t"), respect_gitignore=True)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    edges = {(r["source"], r["target"], r["type"]) for r in g.edges.collect()}
    assert nodes["README.md"]["broken_refs"] == ["notes/missing.md"] and "skip/me.md" not in nodes and "node_modules/x.js" not in nodes
    assert {("README.md", "docs/guide.md", "references"), ("README.md", "src/app.py", "references"), ("docs/guide.md", "README.md", "references"), ("src/app.py", "src/util.py", "imports"), ("README.md", "decision:D-DEMO-1", "mentions")} <= edges
    assert ("src/app.py", "src/__init__.py", "imports") not in edges
    assert {("src/app.py::A.f", "src/app.py::A.g", "calls"), ("src/app.py::A.g", "src/app.py::main", "calls"), ("src/util.py", "src/util.py::helper", "defines")} <= edges
    save(g, str(tmp_path / "store"))
    assert load(spark, str(tmp_path / "store")).edges.count() == len(edges)
    assert to_json(g).count('"source"') == len(edges) and "<graphml" in to_graphml(g)


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main

    (tmp_path / "a.md").write_text("see [b](b.md)")
    (tmp_path / "b.md").write_text("text")
    assert main([str(tmp_path), "build"], spark) == 0
    assert main([str(tmp_path), "gate"], spark) == 0
    assert main([str(tmp_path), "impact", "b.md"], spark) == 0
    assert '"id": "a.md"' in capsys.readouterr().out
    (tmp_path / "b.md").write_text("changed")
    assert main([str(tmp_path), "gate"], spark) == 1
