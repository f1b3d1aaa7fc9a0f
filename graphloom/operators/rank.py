"""PageRank, global and personalised."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators.iterate import cut, discard
from graphloom.schema import KNOWLEDGE


#: Bytes of ranks (two numbers a node) up to which each round sends them to all tasks instead of shuffling.
BROADCAST_BYTES = 32 << 20
#: Steps of the series after which the rounds go on one by one: links that run in circles never use them up.
STEPS = 12


def pagerank(graph: PropertyGraph, relations: tuple[str, ...] = KNOWLEDGE, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-9, personalization: DataFrame | None = None) -> DataFrame:
    """(id, score) of all nodes.

    personalization: (id, weight), the restart distribution; weights of unknown
    ids are ignored, negative ones count as none, and without any it is uniform.
    Edges need both ends; parallel edges of different types weigh twice.

    A round is r' = c p + M r: M moves ranks along the links, p is the restart
    and c one number, which depends on the rank that ends nowhere.  So the k-th
    ranks are the sum of c[k-j] M^j p for j < k, and M^k of the first ranks.
    The vectors M^j p are made one by one, each from the links that leave what
    the one before reached.  Where links form no circle they soon are empty, and
    then all further rounds, with their change, are arithmetic on those there
    are.  Where links form circles, rounds go on as such after ``STEPS``.
    """
    numbered = cut(graph.nodes.select("id").withColumn("n", F.monotonically_increasing_id()))
    n = numbered.count()
    if not n or max_iter < 1:
        return numbered.select("id", F.lit(1.0 / max(n, 1)).alias("score"))
    number = lambda c: numbered.select(F.col("id").alias(c), F.col("n").alias(c[0])).hint("shuffle_hash")
    edges = cut(graph.of_types(relations).select("source", "target").join(number("target"), "target").select("source", "t").join(number("source"), "source").select("s", "t"))
    own, shares = None, []
    if personalization is not None:
        w = personalization.groupBy("id").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("w")).where("w > 0")
        w = cut(w.join(numbered, "id").select("n", "w"))
        total = w.agg(F.sum("w")).collect()[0][0] or 0.0
        own = w.select("n", (F.col("w") / total).alias("v")) if total > 0 else None
        shares = [w]
    out = cut(edges.groupBy(F.col("s").alias("n")).agg(F.count("*").alias("d")))
    # v: M^j p; w: M^j of the first ranks, which are uniform; without weights they are the same
    names = ("v",) if own is None else ("v", "w")
    sums = [(1.0, 1.0)]
    reached: list[DataFrame] = []
    live, held, closed = edges, [edges, numbered, out, *shares], False
    now = numbered.select("n", F.lit(1.0 / n).alias("v")) if own is None else numbered.join(own, "n", "left").select("n", F.coalesce("v", F.lit(0.0)).alias("v"), F.lit(1.0 / n).alias("w"))
    for j in range(1, min(max_iter, STEPS) + 1):
        given = now.join(out, "n").select(F.col("n").alias("s"), *[(F.col(x) * damping / F.col("d")).alias(x) for x in names])
        moved = live.join(given.hint("shuffle_hash"), "s")
        if j > 1:
            live = cut(moved)
            held.append(live)
            moved = live
        step = moved.groupBy(F.col("t").alias("n")).agg(*[F.sum(x).alias(x) for x in names])
        seen = Observation()
        now = cut(step.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in names]))
        held.append(now)
        told = seen.get
        sums.append((told["v"], told[names[-1]]))
        live = live.select("s", "t")
        if not told["rows"]:
            closed = True
            break
        reached.append(now)
    last = len(sums) - 1  # M^last is none if closed

    # the numbers c[1], c[2] and so on, as far as the vectors tell
    kept = lambda j, x: sums[j][x] - (sums[j + 1][x] if j < last else 0.0) / damping if damping else sums[j][x]
    c = [0.0]
    rounds = max_iter if closed else last
    for k in range(1, rounds + 1):
        lost = sum(c[k - 1 - j] * kept(j, 0) for j in range(min(k - 1, last))) + (kept(k - 1, 1) if k - 1 < last else 0.0)
        c.append(1 - damping + damping * lost)

    def factors(k: int) -> tuple[list[float], list[float]]:
        """Of M^j p and of M^j of the first ranks in the k-th ranks."""
        return [c[k - j] if j < k else 0.0 for j in range(last + 1)], [float(j == k) for j in range(last + 1)]

    def combined(v: list[float], w: list[float]) -> Column:
        zero, first = F.col("v0") * v[0] + F.lit(w[0] / n), F.lit(0.0)
        terms = [F.col(f"v{j}") * v[j] + (F.col(f"w{j}") * w[j]) for j in range(1, len(reached) + 1)]
        return reduce(lambda a, b: a + b, terms, first) + zero

    parts = [now.select("n", F.lit(j).alias("j"), *names) for j, now in enumerate(reached, 1)]
    if own is not None:
        parts.append(own.select("n", F.lit(0).alias("j"), "v", F.lit(0.0).alias("w")))
    rest = F.lit(1.0 / n if own is None else 0.0)
    if parts:
        cell = lambda x, j: F.coalesce(F.sum(F.when(F.col("j") == j, F.col(x))), F.lit(0.0))
        cells = [cell(x if x in names else "v", j).alias(f"{x}{j}") for j in range(1, len(reached) + 1) for x in ("v", "w")]
        table = cut(reduce(DataFrame.union, parts).groupBy("n").agg((rest if own is None else cell("v", 0)).alias("v0"), *cells))
        size = table.count()
    else:
        table, size = numbered.select("n", rest.alias("v0")).limit(0), 0

    def change(k: int) -> float:
        (v, w), (v1, w1) = factors(k), factors(k - 1)
        v, w = [a - b for a, b in zip(v, v1)], [a - b for a, b in zip(w, w1)]
        moved = table.agg(F.sum(F.abs(combined(v, w)))).collect()[0][0] or 0.0
        return moved + (n - size) * abs(v[0] * (1.0 / n if own is None else 0.0) + w[0] / n)

    # a round's change is at most damping times the one before: the first below tol is found by halving
    low, high, settled = 1, rounds, tol > 0 and change(rounds) < tol
    while settled and low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if change(middle) < tol else (middle + 1, high)
    v, w = factors(high)
    filled = numbered.join(table, "n", "left")
    filled = filled.fillna(0.0, [x for x in table.columns if x not in ("n", "v0")]).withColumn("v0", F.coalesce("v0", rest))
    score = combined(v, w).alias("score")
    if closed or settled or max_iter <= rounds:
        result = cut(filled.select("id", score))
    else:
        result = _continued(numbered, n, edges, out, filled.select("n", "v0", score), damping, max_iter - rounds, tol)
    discard(*held)
    if parts:
        discard(table)
    return result


def _continued(numbered: DataFrame, n: int, edges: DataFrame, out: DataFrame, start: DataFrame, damping: float, max_iter: int, tol: float) -> DataFrame:
    """Further rounds from ranks (n, v0, score), v0 being the restart.

    While all ranks take at most ``BROADCAST_BYTES`` they are sent to the links,
    which lie partitioned by target, and a round shuffles nothing; beyond that
    the links lie partitioned by source and a round shuffles ranks and partial
    sums.  A round is one job: its ranks are written, and the dangling mass and
    change observed meanwhile.
    """
    small = n * 16 <= BROADCAST_BYTES
    links = edges.join(out.withColumnRenamed("n", "s"), "s").groupBy("s", "t").agg(F.sum(F.lit(damping) / F.col("d")).alias("share"))
    links = links.repartition("t" if small else "s").persist()
    base = start.join(out.select("n", F.lit(False).alias("dangling")), "n", "left")
    ranks = cut(base.select("n", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.col("v0").alias("p"), "score"))
    lost = ranks.where("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).collect()[0][0]
    for _ in range(max_iter):
        now = ranks.select(F.col("n").alias("s"), F.col("score").alias("given"))
        gain = links.join(F.broadcast(now) if small else now, "s").groupBy(F.col("t").alias("n")).agg(F.sum(F.col("share") * F.col("given")).alias("gain"))
        score = F.col("p") * (1 - damping + damping * lost) + F.coalesce("gain", F.lit(0.0))
        moved = ranks.join(gain, "n", "left").select("n", "dangling", "p", score.alias("score"), F.abs(score - F.col("score")).alias("change"))
        seen = Observation()
        before, ranks = ranks, cut(moved.observe(seen, F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("lost"), F.sum("change").alias("change")))
        discard(before)
        lost, change = seen.get["lost"], seen.get["change"]
        if change < tol:
            break
    result = cut(ranks.join(numbered, "n").select("id", "score"))
    discard(ranks)
    links.unpersist()
    return result


def personalised(graph: PropertyGraph, seeds: Mapping[str, float] | Iterable[str] | DataFrame, **options) -> DataFrame:
    """PageRank that restarts at the seeds: a map of weights, a collection of ids, or a frame (id, weight)."""
    if not isinstance(seeds, DataFrame):
        rows = list(seeds.items()) if isinstance(seeds, Mapping) else [(s, 1.0) for s in seeds]
        if not rows:
            return pagerank(graph, **options)
        seeds = graph.nodes.sparkSession.createDataFrame([(i, float(w)) for i, w in rows], "id string, weight double")
    return pagerank(graph, personalization=seeds, **options)


def by_rank(score: str = "score") -> Column:
    """Best first.  Scores that differ by less than about 1e-9 of their size tie: the order of summing leaves no more."""
    return F.round(F.log(score), 9).desc_nulls_last()


def top(graph: PropertyGraph, scores: DataFrame, k: int, predicate: Column | None = None) -> DataFrame:
    """The k best present nodes for which the predicate holds; ties by id."""
    rows = scores.join(graph.nodes, "id")
    rows = rows if predicate is None else rows.where(predicate)
    return rows.orderBy(by_rank(), "id").limit(k)


def god_nodes(graph: PropertyGraph, scores: DataFrame, k: int = 10) -> DataFrame:
    keep = F.col("path").isNotNull() & ~F.col("type").isin("area", "session", "decision")
    return top(graph, scores, k, keep).select("id", "type", "score")
