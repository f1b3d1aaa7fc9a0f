"""A folder's stored graph: settings, incremental builds, freshness, registry, lock, git."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "t"
    files = {
        "README.md": "see [guide](docs/guide.md) and [gone](notes/missing.md) per D-DEMO-1, ACME-7",
        "docs/guide.md": "back to [[README]], `[no](x.md)` and conf/a.conf",
        "src/app.py": "from src.util import helper\n\nclass A(object):\n    def f(self, x: int) -> int:\n        return x\n",
        "src/util.py": "def helper():\n    return 1\n",
        "src/__init__.py": "",
        "conf/a.conf": "x",
        "empty.md": "",
        "torn.md": "x\0" + "\0" * 20,
        "lib/site-packages/p.py": "import os",
        "target/kept.md": "x",
        "a/b/c/d/deep.md": "[up](../../../../README.md)",
    }
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_listing_by_driver_and_tasks(spark, tree):
    from graphloom.sources.tree import list_files, visible, walk

    (tree / ".graphloomignore").write_text("# no\nconf/*\n")
    (tree / "docs" / "link").symlink_to(tree / "src")
    (tree / "docs" / "dangling.md").symlink_to(tree / "nowhere.md")
    want = sorted(p for p, *_ in walk(str(tree), ["conf/*"]))
    assert "conf/a.conf" not in want and "target/kept.md" in want and "docs/dangling.md" in want
    assert not any(p.startswith(("lib/site-packages", "docs/link/")) for p in want)
    for apart in (1, 3, 256):
        assert sorted(r["path"] for r in list_files(spark, str(tree), apart=apart).collect()) == want
    some = spark.createDataFrame([(p,) for p in ("a/dist/x.py", "dist", "x.PNG", "poetry.lock", "p/Thumbs.db", "a.egg-info/x", "coverage/a.md", "x.jar", ".graphloom/y", "m.pyd")], "p string")
    assert [r["v"] for r in some.select(visible(F.col("p")).alias("v")).collect()] == [False, True, False, False, False, False, True, True, False, False]


def test_gitignore_rules():
    from graphloom.sources.tree import GitRule, gitignored

    rules = GitRule.parse("﻿# c\nbuild/\n*.log\n!keep.log\n/top.txt\ndoc/**/x.md\n\n!\n")
    for path, is_dir, want in (("build", True, True), ("a/build", True, True), ("build", False, False), ("x.log", False, True), ("a/keep.log", False, False), ("top.txt", False, True), ("a/top.txt", False, False), ("doc/x.md", False, True), ("doc/a/b/x.md", False, True)):
        assert gitignored(path, is_dir, rules) is want, path


def test_settings(tmp_path):
    from graphloom.sources.config import Config, config_signature, load_config

    assert load_config(str(tmp_path)) == Config()
    before = config_signature(str(tmp_path))
    held = {"respect_gitignore": True, "classify": {"mode": "replace", "keywords": {"design": ["vision", ""], "report": 3}, "decision_id_prefixes": ["ACME"], "type_overrides": {"./a\\b.md": "Report", "x": "area", "y": "nonsense", "z": 1}}}
    (tmp_path / ".graphloom.json").write_text("﻿" + json.dumps(held))
    got = load_config(str(tmp_path))
    assert got.respect_gitignore and got.rules.design == ("vision",) and got.decision_prefixes == ("ACME",)
    assert got.rules.overrides == {"a/b.md": "report"} and "report" in got.rules.report
    assert config_signature(str(tmp_path)) != before
    (tmp_path / ".graphloom.json").write_text("[")
    assert load_config(str(tmp_path)) == Config()


def test_incremental_build_equals_a_whole_one(spark, tree):
    from graphloom.plans import store
    from graphloom.plans.project import Project

    (tree / ".graphloom.json").write_text(json.dumps({"classify": {"decision_id_prefixes": ["ACME"], "type_overrides": {"empty.md": "design"}}}))
    p = Project(spark, str(tree))
    first = p.build()
    assert first["reused"] == 0 and not p.stale() and p.health()["broken"] == [["README.md", "notes/missing.md"]]
    assert p.build() == {"files": first["files"], "parsed": 0, "reused": first["parsed"]}
    (tree / "src" / "util.py").write_text("import src.app\n\ndef helper():\n    return 2\n")
    (tree / "notes").mkdir()
    (tree / "notes" / "missing.md").write_text("found [c](../conf/a.conf)")
    (tree / "docs" / "guide.md").unlink()
    assert p.stale() and p.health()["stale_counts"] == {"added": 1, "removed": 1, "changed": 1}
    again = p.build()
    assert (again["parsed"], again["reused"]) == (2, first["parsed"] - 2)
    graph, manifest = store.load(spark, p.place, p.name)
    part = lambda g: (rows(g.nodes.select("id", "type", "label", "description", "size", "broken_refs")), rows(g.edges.select("source", "target", "type")))
    incremental, held = part(graph), rows(manifest)
    p.build(incremental=False)
    graph, manifest = store.load(spark, p.place, p.name)
    assert part(graph) == incremental and rows(manifest) == held
    assert ("README.md", "decision:ACME-7", "mentions") in incremental[1] and ("src/util.py", "src/app.py", "imports") in incremental[1]
    assert [x[1] for x in incremental[0] if x[0] == "empty.md"] == ["design"]
    assert p.health(deep=True)["ok"] is False  # README still has a broken link to the guide


def test_integrity_of_files(spark, tree):
    from graphloom.plans.project import Project, integrity

    p = Project(spark, str(tree))
    assert rows(integrity(p.graph(), str(tree))) == [("empty.md", "empty"), ("torn.md", "truncated")]


def test_one_writer(tmp_path):
    from graphloom.plans.lock import Busy, holder, write_lock

    with write_lock(str(tmp_path)):
        assert holder(str(tmp_path))["pid"]
        with pytest.raises(Busy), write_lock(str(tmp_path)):
            pass
    assert holder(str(tmp_path)) is None
    with write_lock(str(tmp_path)):
        pass


def test_commits_become_sessions(spark, tree):
    from graphloom.operators.recency import churn, recency_scores
    from graphloom.plans.project import Project
    from graphloom.sources.git import parse_log, parse_status, working_changes

    assert parse_log("\x01ab\x1fmsg\x1f2024-01-02T00:00:00Z\x1fme\n\nx.py\ny.md\n\x01cd\x1fm\n") == [("ab", "msg", "2024-01-02T00:00:00Z", "me", ["x.py", "y.md"]), ("cd", "m", "", "", [])]
    assert parse_status(' M a.py\nR  old.md -> new.md\n?? "é x.md"\n?? .graphloom/x\n') == ["a.py", "new.md", "é x.md"]
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "README.md", "src/app.py")
    git("commit", "-qm", "first " + "x" * 100)
    p = Project(spark, str(tree))
    g = p.graph()
    session = g.nodes.where("type = 'session'").collect()
    assert len(session) == 1 and len(session[0]["label"]) == 80 and session[0]["extra"]["author"] == "n"
    assert {r["id"] for r in churn(g).collect()} == {"README.md", "src/app.py"} == {r["id"] for r in recency_scores(g).collect()}
    changed = [r["path"] for r in working_changes(spark, str(tree)).collect()]
    assert "docs/" in changed and "README.md" not in changed and not any(c.startswith(".graphloom/") for c in changed)


def test_registry_of_works(spark, tree):
    from graphloom.plans.project import Project
    from graphloom.streaming.works import Registry, owners, works

    p = Project(spark, str(tree))
    r = Registry(spark, str(tree / ".graphloom" / "works"), "t", p.graph())
    assert r.begin("a", "tidy", ("src/util.py",)) == {"project": "t", "others": [], "contested": []}
    assert r.may_write("b", "src/util.py") == "block"
    assert r.may_write("b", "src/app.py") == "warn"  # imports what a works on
    assert r.may_write("b", "conf/a.conf") == "ok"
    r.after_write("b", "conf/a.conf", "1:1")
    assert r.may_write("b", "conf/a.conf", "1:1") == "ok" and r.may_write("b", "conf/a.conf", "2:2") == "warn"
    assert r.begin("c", "", ("conf/a.conf",))["contested"] == ["conf/a.conf"]
    now = F.current_timestamp()
    assert {(x["file"], tuple(x["agents"])) for x in owners(r.events(), now).collect()} >= {("src/util.py", ("a",)), ("conf/a.conf", ("b", "c"))}
    assert [x["intent"] for x in works(r.events(), now).where("agent = 'a'").collect()] == ["tidy"]
    assert r.close("b") == ["conf/a.conf", "src/app.py"] and r.close("b") is None
    assert works(r.events(), now).where("agent = 'b'").count() == 0
    assert r.close("a") == [] and r.may_write("b", "src/util.py") == "ok"


def test_focus_answer(spark, tree):
    from graphloom.operators import focus
    from graphloom.plans.project import Project

    g = Project(spark, str(tree)).graph()
    told = focus.focus(g, "app util", 900)
    assert set(told["seeds"]) >= {"src/app.py", "src/util.py"} and told["recency"] == 0.0
    ranks = {n["id"]: n["score"] for n in told["nodes"]}
    files = [s for s in told["seeds"] if s in ranks]
    assert [ranks[s] for s in files] == sorted((ranks[s] for s in files), reverse=True)
    assert 0 < told["token_estimate"] <= 900
    small = focus.focus(g, "app util", 60)
    assert small["truncated"] and len(small["nodes"]) == 1
    signed = focus.attach_signatures(g, str(tree), told)["signatures"]
    assert [s["signature"] for s in signed["src/app.py"]] == ["class A(object)", "def f(self, x: int) -> int"]
    assert focus.focus(g, "zzz nothing", 400)["fallback"]


def test_reference_patterns(spark):
    from graphloom.functions import text

    def found(t):
        return [(r["target"], r["kind"]) for r in spark.createDataFrame([(t,)], "t string").select(text.references(F.col("t")).alias("r")).collect()[0]["r"]]

    assert found("[a](x(1.md) and [b](<y.md> 'title')")[:2] == [("x(1.md", "link"), ("y.md", "link")]
    assert all(kind != "link" for _, kind in found("[c](z].md)"))
    assert ("report.docx", "path") in found("see report.docx and a/b.duckdb") and ("a/b.duckdb", "path") in found("see report.docx and a/b.duckdb")
    assert found("[w]( mailto:a@b.example ) [[ https://e.x/y ]] [[Name#part|alias]]") == [("Name", "wikilink")]
    code = "import a from `./t`; /* import b from './no' */ export * from \"./e\" // import c from './no2'\nrequire('./r'); import('x'); import './s'"
    got = spark.createDataFrame([(code,)], "c string").select(text.js_imports(F.col("c")).alias("r")).collect()[0]["r"]
    assert got == ["./t", "./e", "./r", "./s"]
