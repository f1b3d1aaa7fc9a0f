"""What keeps queries within limits on large tables: the same results by fewer or smaller steps."""

from graphloom.operators import rank
from tests.test_graph import graph, naive_pagerank


def test_ranks_without_circles_take_few_steps(spark, monkeypatch):
    """Links that form no circle: further rounds are arithmetic, not passes over the links."""
    ids = [f"n{i}" for i in range(8)]
    edges = [("n0", "n3"), ("n1", "n3"), ("n2", "n4"), ("n3", "n5"), ("n4", "n5"), ("n5", "n6")]
    g = graph(spark, [(i, "program") for i in ids], [(s, t, "imports") for s, t in edges])
    made = []
    whole = rank.cut
    monkeypatch.setattr(rank, "cut", lambda df: made.append(1) or whole(df))
    got = {r["id"]: r["score"] for r in rank.pagerank(g, max_iter=40, tol=0.0).collect()}
    want = naive_pagerank(ids, edges, 40)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in ids) and len(made) < 20


def test_ranks_with_circles_go_on_after_the_series(spark, monkeypatch):
    monkeypatch.setattr(rank, "STEPS", 2)
    ids = ["a", "b", "c", "d"]
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")]
    g = graph(spark, [(i, "program") for i in ids], [(s, t, "imports") for s, t in edges])
    got = {r["id"]: r["score"] for r in rank.pagerank(g, max_iter=5, tol=0.0).collect()}
    want = naive_pagerank(ids, edges, 5)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in ids)


def odd_graph(spark):
    ids = [("a", "program"), ("b", "program"), ("c", "report"), ("area:x", "area")]
    return graph(spark, ids, [("a", "b", "imports"), ("a", "a", "references"), ("b", "gone", "imports"), ("c", "area:x", "belongs_to"), ("c", "area:x", "mentions"), ("c", "a", "references")])


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_degrees_of_dangling_ends_and_loops(spark):
    g = odd_graph(spark)
    told = lambda df: {r["id"]: r["degree"] for r in df.collect()}
    assert told(g.viewer_degree()) == {"a": 4, "b": 1, "c": 1}
    assert told(g.community_degree()) == {"a": 2, "b": 2, "c": 1}
    assert told(g.degree()) == {"a": 3, "b": 2, "gone": 1, "c": 3, "area:x": 2}
    assert told(g.degree_of(g.nodes.where("id in ('a', 'c')"))) == {"a": 3, "c": 3}


def test_degrees_are_counted_after_ids_are_brought_together(spark):
    """Else a task's counts grow with the edges of its split, whatever the number of partitions."""
    g = odd_graph(spark)
    for df in (g.degree(), g.store_degree(), g.knowledge_degree(), g.linked()):
        assert "RepartitionByExpression [id" in plan(df)


def test_impact_counts_only_the_degrees_of_what_it_found(spark):
    from graphloom.operators import traverse

    walked = traverse.impact(odd_graph(spark), "a", "up")["upstream"]
    assert {(r["id"], r["degree"]) for r in walked.collect()} == {("c", 3)}
    assert plan(walked).count("strategy=broadcast") >= 2


def test_five_degrees_at_once(spark):
    g = odd_graph(spark)
    told = {}
    for r in g.degree_kinds().collect():
        told.setdefault(r["kind"], {})[r["id"]] = r["degree"]
    one = {"all": g.degree(), "knowledge": g.knowledge_degree(), "community": g.community_degree(), "store": g.store_degree(), "viewer": g.viewer_degree()}
    assert told == {k: {r["id"]: r["degree"] for r in d.collect()} for k, d in one.items()}


def test_integrity_of_odd_texts(spark, tmp_path):
    """The SQL goes by doc_id: a null or empty text, or one that holds zero bytes, is no problem by itself."""
    from graphloom.plans.catalog_queries import queries

    rows = [(0, "x"), (1, ""), (2, None), (3, None), (4, "a" + "\0" * 16 + "b"), (5, ""), (13, ""), (23, "x"), (10, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["path"], r["problem"]) for r in queries()["integrity_scan"](spark, str(tmp_path)).collect()}
    assert got == {("d0.md", "empty"), ("d10.md", "empty"), ("d3.md", "truncated"), ("d13.md", "truncated"), ("d23.md", "truncated")}


def test_references_are_joined_no_more_than_needed(spark):
    """Files that are listed only as files need no join of their own, and exact hits none by name."""
    from graphloom.operators import resolve

    refs = spark.createDataFrame([("a/x.md", "../b/y.md", "link"), ("a/x.md", "y", "wikilink"), ("a/x.md", "gone/z.md", "link"), ("a/x.md", "../../o/z.md", "link"), ("a/x.md", "x.md", "link")], "source string, target string, kind string")
    files = spark.createDataFrame([("a/x.md",), ("b/y.md",)], "path string")
    told = resolve.resolve_references(refs, files)
    got = {r["target"]: (r["hit"], r["status"]) for r in told.collect()}
    assert got == {"../b/y.md": ("b/y.md", "ok"), "y": ("b/y.md", "ok"), "gone/z.md": (None, "broken"), "../../o/z.md": (None, "external"), "x.md": (None, "self")}
    assert plan(told).count("Join LeftOuter") <= 2
