"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table.  A row is represented by the order in which
its ``PREFIX`` nearest pivots follow one another, and posted with its rank in
those pivots' inverted files.  A query fetches the files of its own nearest
pivots.  Of two orders a and b, cut after PREFIX, the footrule distance with
absent pivots at rank PREFIX is PREFIX * (PREFIX + 1) minus twice the sum over
shared pivots of PREFIX - max(rank in a, rank in b); so adding up that term
over the files ranks all rows.  The nearest share ``RERANK`` of each shard by
footrule, and whatever ties with the last of it, is reranked by the exact
cosine on the vectors as given.

Equal vectors are one entry of the index: each stands with its k + 1 smallest
ids, of which k are left whatever the query's own id, and an entry that is found
is replaced by them.  So copies neither crowd out other rows nor one another,
however many there are.

Rows are split by a hash of the vector into shards, queries into blocks, both of
about ``VALUES`` numbers (and a shard of ``SHARD`` rows), whatever the vectors' length; each (shard, block) is
one task's work, and the best k of every shard meet per query: k rows a shard,
never all pairs.  Each row is sent once to each block of queries and each query
once to each shard, so the blocks are as large as a worker's memory allows.  Pivots are ``PIVOTS`` vectors of different directions with the smallest
hashes: a bounded sample; every row is indexed.

The rerank is a share of all rows, not a fixed number, so that recall doesn't
decline as the table grows.  Recall against brute force on the 64-dimensional
test vectors is in the README.

Defined results: a null, empty, zero or non-finite vector (and one with a null
component) takes no part, as query or candidate; a null id neither; only
vectors of the query's length are candidates; rows that share an id are one
candidate, as near as the nearest of them, and queries that share an id are
answered together; no row of the query's own id is a candidate; ties go to the
smaller id; with fewer candidates than k all are returned; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS = 256
PREFIX = 64
RERANK = 0.25
#: At least so many rows of a shard are reranked: in small tables more than the share, never fewer.
LEAST = 200
#: Rows of a shard or a block of queries, and the numbers that their vectors hold together, at most about.
SHARD, VALUES = 65_536, 1 << 21
#: Rows whose distances to all pivots are held at once.
STEP = 4_096


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(rows, prefix) numbers of the nearest pivots by cosine, nearest first."""
    out = np.zeros((len(vectors), min(prefix, len(pivots))), dtype=np.int32)
    for i in range(0, len(vectors), STEP):
        cosine = vectors[i : i + STEP] @ pivots.T
        out[i : i + STEP] = np.argsort(-cosine, axis=1, kind="stable")[:, :prefix]
    return out


class Shard:
    """Pivot inverted files over the rows of one shard."""

    def __init__(self, unit: np.ndarray, pivots: np.ndarray, prefix: int):
        self.size, self.prefix = len(unit), min(prefix, len(pivots))
        order = nearest_pivots(unit, pivots, self.prefix)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        cut = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        self.rows = [(by[a:b] // self.prefix).astype(np.int32) for a, b in zip(cut, cut[1:])]
        self.ranks = [(by[a:b] % self.prefix).astype(np.int32) for a, b in zip(cut, cut[1:])]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of a query's pivot order to every row's."""
        shared = np.zeros(self.size, dtype=np.int32)
        for rank, pivot in enumerate(order):
            shared[self.rows[pivot]] += self.prefix - np.maximum(self.ranks[pivot], np.int32(rank))
        return self.prefix * (self.prefix + 1) - 2 * shared


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which leaves cosines as they are, so that no square overflows or vanishes."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _entries(ids: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each distinct vector, ids, their entries): of each distinct vector the k + 1 smallest ids."""
    numbers: dict[bytes, int] = {}
    entry = np.array([numbers.setdefault(r.tobytes(), len(numbers)) for r in raw + 0.0])  # -0.0 equals 0.0
    rows = np.unique(entry, return_index=True)[1]
    by = np.lexsort((ids, entry))
    own, of = ids[by], entry[by]
    new = np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1]))
    own, of = own[new], of[new]
    kept = np.arange(len(of)) - np.searchsorted(of, of) <= k
    return rows, own[kept], of[kept]


def search(ids: np.ndarray, raw: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, rerank: float = RERANK) -> pd.DataFrame:
    """The best k rows of one shard for each query: query_id, vec_id, score."""
    raw, queries = _scaled(raw), _scaled(queries)
    rows, ids, entry = _entries(ids, raw, k)
    raw = raw[rows]
    norm, query_norm = np.linalg.norm(raw, axis=1), np.linalg.norm(queries, axis=1)
    shard = Shard(raw / norm[:, None], pivots, PREFIX)
    orders = nearest_pivots(queries / query_norm[:, None], pivots, shard.prefix)
    take = min(len(raw), max(LEAST, int(np.ceil(rerank * len(raw)))))
    out = []
    for q, own, order, length in zip(query_ids, queries, orders, query_norm):
        far = shard.footrule(order)
        near = far <= np.partition(far, take - 1)[take - 1]
        score = np.full(len(raw), -np.inf)
        score[near] = (raw[near] @ own) / (norm[near] * length)
        found = np.flatnonzero(near[entry] & (ids != q))
        found = found[np.lexsort((ids[found], -score[entry[found]]))]
        best = found[np.sort(np.unique(ids[found], return_index=True)[1])[:k]]  # of rows that share an id the nearest
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": score[entry[best]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows by cosine of every row where ``queries`` holds."""
    wide = F.col(vector).cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(wide, lambda x: x != 0)
    rows = table.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("bigint").alias("vec_id"), wide.alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("query").cast("bigint")).alias("q")).collect()
    largest = F.array_max(F.transform("v", F.abs))
    direction = F.transform("v", lambda x: F.rint(x / largest * 1e6).cast("bigint"))
    chosen = rows.withColumn("h", F.xxhash64(direction, F.lit(42))).withColumn("dim", F.size("v"))
    pivots: dict[int, np.ndarray] = {}
    for r in sizes:  # usually a single length
        own = chosen.where(F.col("dim") == r["dim"])
        least = [x["h"] for x in own.select("h").distinct().orderBy("h").limit(PIVOTS).collect()]
        p = np.array([x["v"] for x in own.where(F.col("h").isin(least)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()])
        p = _scaled(p)
        pivots[r["dim"]] = p / np.linalg.norm(p, axis=1, keepdims=True)
    tasks = table.sparkSession.sparkContext.defaultParallelism

    def parts(rows: int, dim: int) -> int:
        """Shards of at most about VALUES; where they would be few, smaller ones, so that all cores have work."""
        most = max(1, min(SHARD, VALUES // max(1, dim)))
        return max(-(-rows // most), min(tasks, -(-rows * 16 // most)))

    plan = {r["dim"]: (parts(r["n"], r["dim"]), -(-(r["q"] or 0) * max(1, r["dim"]) // VALUES)) for r in sizes}

    def count(which: int) -> Column:
        c = F.lit(1)
        for d, p in plan.items():
            c = F.when(F.size("v") == d, F.lit(max(1, p[which]))).otherwise(c)
        return c

    mine = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # of equal vectors the k + 1 smallest ids, cut before they are shuffled
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    few = rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1)
    shards = few.select("vec_id", "v", F.size("v").alias("dim"), mine("v", count(0)).alias("shard"), every(count(1)).alias("block"))
    blocks = rows.where("query").select("vec_id", "v", F.size("v").alias("dim"), mine("vec_id", count(1)).alias("block"), every(count(0)).alias("shard"))
    shared = table.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def work(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search(left["vec_id"].to_numpy(), np.stack(left["v"]), right["vec_id"].to_numpy(), np.stack(right["v"]), shared.value[group[0]], k, rerank)

    keys = ("dim", "shard", "block")
    found = shards.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(work, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(ids: np.ndarray, raw: np.ndarray, query_ids: np.ndarray, k: int = 5) -> dict[int, list[int]]:
    """The exact answer, for measuring recall."""
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    out = {}
    for q in query_ids:
        score = unit @ unit[np.flatnonzero(ids == q)[0]]
        other = ids != q
        out[int(q)] = ids[other][np.lexsort((ids[other], -score[other]))[:k]].tolist()
    return out
