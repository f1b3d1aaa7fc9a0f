"""Components in bounded partitions; queries that make only the part of the catalog graph they ask for."""

import random

import pytest

from graphloom.operators import communities
from graphloom.plans.catalog_queries import queries
from graphloom.sources import catalog
from tests.test_scale import plan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sent", [0, 1000])
def test_components_are_aggregated_within_bounded_partitions(spark, monkeypatch, sent):
    monkeypatch.setattr(communities, "TASK_ROWS", 20)
    monkeypatch.setattr(communities, "BROADCAST_NAMES", sent)
    made, whole = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda df: made.append(plan(df)) or whole(df))
    rng = random.Random(1)
    ids = [f"n{i:02d}" for i in range(60)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(40)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)] + [("q", "q")]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in communities.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == root
    parts = -(-2 * sum(a != b for a, b in pairs) // 20)
    grouped = [p for p in made if "Aggregate" in p]
    assert grouped and all(f", {parts}" in line for p in grouped for line in p.splitlines() if "RepartitionByExpression" in line)
    assert all("RepartitionByExpression" in p[p.index("Aggregate") :] for p in grouped)


def unstored(spark, name):
    """A query's rows without the stored graph, and with it."""
    catalog._BUILT.clear()
    first = {tuple(r) for r in queries()[name](spark, SF).collect()}
    assert not catalog._BUILT
    catalog.catalog_graph(spark, SF)
    return first, {tuple(r) for r in queries()[name](spark, SF).collect()}


def test_components_make_the_orders_edges_only(spark):
    first, again = unstored(spark, "components")
    assert first == again and first


def test_community_names_need_no_stored_graph(spark):
    first, again = unstored(spark, "community_names")
    assert first == again and sum(r[1] for r in first) == 25 + spark.read.parquet(f"{SF}/customer.parquet").count()
