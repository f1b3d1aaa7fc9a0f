"""Neighbours where many vectors are equal."""

import numpy as np
import pytest


@pytest.mark.parametrize("scale", [1.0, -0.0])
def test_neighbours_with_a_third_of_equal_vectors(spark, scale, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.llm import ann

    monkeypatch.setattr(ann, "SHARD", 2000)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(6000, 16))
    x[:, 3] = 0.0
    x[rng.permutation(6000)[:2000]] = x[4]
    if scale != 1.0:  # copies that differ in the sign of a zero
        x[::2, 3] = scale
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows + rows[:10] * 20, "vec_id bigint, embedding array<double>")
    asked = np.arange(0, 6000, 100)
    want = ann.brute_force(np.arange(6000), x, asked)
    found = {}
    for r in ann.nearest_neighbours(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hot = [q for q in asked if (x[q] == x[4]).all()]
    copies = np.flatnonzero((x == x[4]).all(axis=1))
    assert len(hot) > 10
    for q in hot:
        assert [found[q][k] for k in range(1, 6)] == [c for c in copies if c != q][:5]
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in found.values()) and found.keys() == want.keys()
    assert np.mean([len(set(found[q].values()) & set(want[q])) / 5 for q in asked if q not in hot]) >= 0.9
