"""Label propagation by stages gives what one sequential pass over all ids gives."""

import random

import pytest

from graphloom.operators import communities
from tests.test_graph import graph


def links(rng, kind):
    if kind == "flat":  # orders, customers and parts: few levels
        return {(f"b{rng.randrange(60):02d}", rng.choice((f"a{rng.randrange(9)}", f"c{rng.randrange(25):02d}", f"d{rng.randrange(4)}"))) for _ in range(220)}
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(90)]  # as many levels as nodes
    more = [(f"n{rng.randrange(91):03d}", f"n{rng.randrange(91):03d}") for _ in range(60)]
    return set(path + more + [("x1", "x2"), ("x2", "x3"), ("n001", "n001")])


@pytest.mark.parametrize(("kind", "held"), [("flat", 10), ("deep", 30), ("deep", 1000)])
def test_stages_equal_the_sequence(spark, monkeypatch, kind, held):
    monkeypatch.setattr(communities, "ONE_TASK", held)
    monkeypatch.setattr(communities, "LEVELS", 5)
    monkeypatch.setattr(communities, "BROADCAST_LABELS", 20)
    monkeypatch.setattr(communities.propagate_staged, "__defaults__", (communities.PASSES, held))
    staged, whole = [], communities.propagate_staged
    monkeypatch.setattr(communities, "propagate_staged", lambda *a: staged.append(a[1][2].count()) or whole(*a))
    edges = sorted(links(random.Random(held), kind))
    ids = sorted({x for e in edges for x in e} | {"folder/alone"})
    g = graph(spark, [(i, "program") for i in ids], [(s, t, "imports") for s, t in edges] + [(t, s, "references") for s, t in edges[:9]] + [(ids[0], "gone", "imports")])
    got = {r["id"]: r["label"] for r in communities.detect(g).collect()}
    assert got == communities.propagate(edges) | {"folder/alone": "area:folder"}
    # few levels: no task holds a component; many: ranges, unless a task can hold it
    assert len(staged) == (held < 1000) and all((n > 0) == (kind == "deep") for n in staged)
