"""Who works on what: a registry with heartbeats, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.schema import REGISTRY

ALIVE = "30 minutes"


def active(touches: DataFrame, alive: str = ALIVE) -> DataFrame:
    """(agent, project, heartbeat, touched): works whose last touch is less than ``alive`` before the newest of all."""
    works = touches.groupBy("agent", "project").agg(F.max("ts").alias("heartbeat"), F.count("*").alias("touched"))
    now = touches.agg(F.max("ts").alias("now"))
    return works.join(now).where(F.expr(f"now - heartbeat < interval {alive}")).drop("now")  # now is one row


def contested(touches: DataFrame, within: str = ALIVE) -> DataFrame:
    """(project, file, agents): files that several agents touched lately."""
    now = touches.agg(F.max("ts").alias("now"))
    recent = touches.join(now).where(F.expr(f"now - ts < interval {within}")).select("agent", "project", "file").distinct()  # now is one row
    return recent.groupBy("project", "file").agg(F.count("*").alias("agents")).where("agents > 1")


def neighbours(graph: PropertyGraph, files: DataFrame) -> DataFrame:
    """(file): one step from ``files`` (file) over imports, references and calls, without themselves."""
    e = graph.of_types(REGISTRY)
    out = e.join(files.select(F.col("file").alias("source")), "source", "left_semi").select(F.col("target").alias("file"))
    into = e.join(files.select(F.col("file").alias("target")), "target", "left_semi").select(F.col("source").alias("file"))
    return out.union(into).distinct().join(files.select("file"), "file", "left_anti")


def verdicts(asked: DataFrame, held: DataFrame, graph: PropertyGraph, moved: DataFrame | None = None) -> DataFrame:
    """(agent, file, verdict) of (agent, file): ``block`` where a live other agent holds the file, ``warn``
    where it is next to files that others hold or its signature moved, else ``ok``."""
    mine, theirs = asked.select("agent", "file").distinct(), held.select(F.col("agent").alias("other"), "file").distinct()
    blocked = mine.join(theirs, "file").where("agent <> other").select("agent", "file").distinct().withColumn("b", F.lit(True))
    e = graph.of_types(REGISTRY).select("source", "target")
    near = e.union(e.select("target", "source")).toDF("file", "near")
    beside = mine.join(near, "file").join(theirs.withColumnRenamed("file", "near"), "near").where("agent <> other").select("agent", "file").distinct().withColumn("n", F.lit(True))
    rows = mine.join(blocked, ["agent", "file"], "left").join(beside, ["agent", "file"], "left")
    rows = rows.withColumn("m", F.lit(None).cast("boolean")) if moved is None else rows.join(moved.select("agent", "file", F.lit(True).alias("m")).distinct(), ["agent", "file"], "left")
    return rows.select("agent", "file", F.when(F.col("b"), "block").when(F.coalesce("n", "m"), "warn").otherwise("ok").alias("verdict"))


def sessions(touches: DataFrame, gap: str = ALIVE, late: str = "10 minutes") -> DataFrame:
    """(agent, project, begun, ended, touched): bursts of work with no pause of ``gap``; on a stream, with a watermark."""
    rows = touches.withWatermark("ts", late) if touches.isStreaming else touches
    found = rows.groupBy("agent", "project", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("touched"))
    return found.select("agent", "project", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "touched")
