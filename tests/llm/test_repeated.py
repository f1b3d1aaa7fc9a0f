"""Repeated rows, hot arrivals, lost writers, shared ids."""

import random

import numpy as np
import pytest


def test_many_equal_rows_are_split(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.llm.sharding import ShardedTable

    rows = spark.range(10_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("x" * 84).alias("text"), F.lit("en").alias("lang"))
    t = ShardedTable(spark, str(tmp_path / "t"), target=100_000, fan_in=4)
    held = t.append(rows, F.col("doc_id"))
    assert len(held.shards) == 10 and sum(s.rows for s in held.shards) == 10_000 and max(s.bytes for s in held.shards) < 130_000
    t.append(rows.limit(10), F.lit(None))
    assert t.compact().version >= 2 and t.read().count() == 10_010
    assert set(t.read().columns) == {"doc_id", "text", "lang", "__arrival", "__shard"}


def test_lost_writer_blocks_nobody(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.llm.sharding import ShardedTable

    t = ShardedTable(spark, str(tmp_path / "t"), target=10_000)
    docs = spark.createDataFrame([(i, "text") for i in range(20)], "doc_id bigint, text string")
    t.append(docs, F.col("doc_id"))

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ShardedTable, "_publish", lost)
        with pytest.raises(KeyboardInterrupt):
            t.append(docs, F.col("doc_id"))
    assert t.versions() == [1] and t.read().count() == 20
    assert t.append(docs, F.col("doc_id")).version == 2 and t.read().count() == 40
    assert t.vacuum() >= 1 and t.read().count() == 40
    stale = t.manifest(1)
    with pytest.raises(RuntimeError):
        t._commit(stale, stale.shards)
    assert t.versions() == [1, 2] and not [p for p in (tmp_path / "t" / "_manifest").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_rows_of_one_id_are_one_neighbour(spark):
    from pyspark.sql import functions as F

    from graphloom.llm.ann import nearest_neighbours

    rng = np.random.default_rng(30)
    query = np.ones(8)
    rows = [(0, query.tolist())] + [(7, (query + rng.normal(0, 0.01, 8)).tolist()) for _ in range(6)] + [(i, (query + rng.normal(0, 0.5, 8)).tolist()) for i in range(10, 19)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest_neighbours(table, F.col("vec_id") == 0).orderBy("rank").collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2), float(unit(v) @ unit(query)))
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    assert [r["vec_id"] for r in got] == want and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert np.allclose([r["score"] for r in got], [best[i] for i in want])


def test_pipeline_with_odd_ids_resumes(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choice(["the", "an", "re", "ti", "on"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    item = words(30)
    texts = [words(50) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, words(20) + " " + item, "en", "s", 1), (None, words(40), "en", "s", 1), (3, words(20) + " " + item, "en", "s", 1)]
    where = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(where / "benchmark.parquet"))
    kept = str(tmp_path / "stages")
    first = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_tokens"]) for r in pipeline.run(spark, str(where), kept).collect())
    assert [i for i, _ in first].count(-1) == 1 and len(first) == 21
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "stages").iterdir()}
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_tokens"]) for r in pipeline.run(spark, str(where), kept).collect()) == first
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "stages").iterdir()} == before


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_leaks_in_several_blocks(spark):
    from graphloom.llm.decontaminate import find_leaks, without_leaks

    rng = random.Random(32)
    words = lambda n: " ".join("".join(rng.choice(["the", "an", "re", "ti", "on"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    items = [(i, words(12)) for i in range(9)]
    docs = spark.createDataFrame([(i, words(8) + " " + items[i % 12][1] + " " + words(5) if i % 12 < 9 else words(20)) for i in range(36)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(tuple(r) for r in find_leaks(docs, bench).collect())
    assert len({(r[0], r[1]) for r in whole}) >= 27
    assert sorted(tuple(r) for r in find_leaks(docs, bench, block_chars=100).collect()) == whole
    assert {r["doc_id"] for r in without_leaks(docs, bench, block_chars=100).collect()} == set(range(36)) - {r[0] for r in whole}
