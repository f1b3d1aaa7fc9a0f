"""Time-decayed touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import timestamp
from graphloom.graph import PropertyGraph


def recency_scores(graph: PropertyGraph, half_life_days: float = 30.0) -> DataFrame:
    """(id, recency) of present nodes that dated sessions touched; the best has 1."""
    half = half_life_days if half_life_days and half_life_days > 0 else 30.0
    dated = graph.nodes.where("type = 'session'").select(F.col("id").alias("source"), timestamp(F.col("date")).alias("at")).where("at is not null")
    anchor = dated.agg(F.max("at")).collect()[0][0]
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(anchor).cast("timestamp")) - F.unix_micros("at")) / 86_400_000_000.0)
    touch = graph.of_types(("touches",)).select("source", F.col("target").alias("id")).join(dated, "source").join(graph.nodes.select("id"), "id", "left_semi")
    raw = touch.groupBy("id").agg(F.sum(F.pow(F.lit(0.5), age / half)).alias("raw"))
    top = raw.agg(F.max("raw")).collect()[0][0]
    if not top:
        return raw.select("id", F.lit(0.0).alias("recency")).limit(0)
    return raw.select("id", (F.col("raw") / top).alias("recency"))


def blend(base: DataFrame, recency: DataFrame, weight: float) -> DataFrame:
    """(id, score): min-max scaled base and recency, mixed; weight 0 leaves the base as it is."""
    w = min(1.0, max(0.0, weight))
    if w == 0:
        return base
    lo, hi = base.agg(F.min("score"), F.max("score")).collect()[0]
    scaled = (F.col("score") - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0)
    return base.join(recency, "id", "left").select("id", ((1 - w) * scaled + w * F.coalesce("recency", F.lit(0.0))).alias("score"))


def churn(graph: PropertyGraph, top: int = 10) -> DataFrame:
    """(id, touches): what is touched most."""
    return graph.of_types(("touches",)).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("touches")).orderBy(F.desc("touches"), "id").limit(top)
