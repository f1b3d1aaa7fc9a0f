"""The registry of works as a log: every call appends an event, the state is what the events add up to.

An event is (agent, project, file, action, intent, signature, ts).  Actions:
begin, declare (file), touch (file), wrote (file, its signature then), close.
A work is what an agent did on a project since it last closed it; it is live
while its last event is less than ``ALIVE`` old.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.plans.lock import write_lock
from graphloom.streaming.registry import verdicts

EVENT = "agent string, project string, file string, action string, intent string, signature string, ts timestamp"
ALIVE = "30 minutes"


def live(events: DataFrame, now: F.Column | None = None, alive: str = ALIVE) -> DataFrame:
    """Events of works that are live at ``now`` (by default the newest event's time), without those before a close."""
    last = events.groupBy("agent", "project").agg(F.max(F.when(F.col("action") == "close", F.col("ts"))).alias("closed"), F.max("ts").alias("heartbeat"))
    if now is None:
        last = last.join(events.agg(F.max("ts").alias("now")))  # one row
    else:
        last = last.withColumn("now", now)
    last = last.where((F.col("closed").isNull() | (F.col("heartbeat") > F.col("closed"))) & F.expr(f"now - heartbeat < interval {alive}"))
    rows = events.join(last.select("agent", "project", "closed", "heartbeat"), ["agent", "project"])
    return rows.where((F.col("closed").isNull() | (F.col("ts") > F.col("closed"))) & (F.col("action") != "close")).drop("closed")


def works(events: DataFrame, now: F.Column | None = None, alive: str = ALIVE) -> DataFrame:
    """(agent, project, since, heartbeat, intent, files) of live works."""
    rows = live(events, now, alive).groupBy("agent", "project", "heartbeat")
    intent = F.max_by(F.when(F.col("intent") != "", F.col("intent")), F.when(F.col("intent") != "", F.col("ts")))
    return rows.agg(F.min("ts").alias("since"), F.coalesce(intent, F.lit("")).alias("intent"), F.array_sort(F.collect_set("file")).alias("files"))


def owners(events: DataFrame, now: F.Column | None = None, alive: str = ALIVE) -> DataFrame:
    """(project, file, agents): who works on what just now."""
    rows = live(events, now, alive).where("file is not null")
    return rows.groupBy("project", "file").agg(F.array_sort(F.collect_set("agent")).alias("agents"))


class Registry:
    """The log in a folder; calls that decide and then write hold its lock, so it needs a mounted file system."""

    def __init__(self, spark: SparkSession, place: str, project: str, graph: PropertyGraph | None = None):
        self.spark, self.place, self.project, self.graph = spark, place.rstrip("/"), project, graph

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{self.place}/event=*") if self._any() else self.spark.createDataFrame([], EVENT)

    def _any(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.place)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.getPath().getName().startswith("event=") for s in fs.listStatus(path))

    def _add(self, agent: str, *rows: tuple[str | None, str, str, str]) -> None:
        """rows: (file, action, intent, signature); all at one time."""
        at = F.timestamp_micros(F.lit(time.time_ns() // 1000))
        held = self.spark.createDataFrame([(agent, self.project, *r) for r in rows], EVENT.rpartition(",")[0]).withColumn("ts", at)
        held.coalesce(1).write.parquet(f"{self.place}/event={time.time_ns():020d}-{uuid.uuid4().hex}")

    def _now(self) -> F.Column:
        return F.timestamp_micros(F.lit(time.time_ns() // 1000))

    def _own(self) -> DataFrame:
        return live(self.events(), self._now()).where(F.col("project") == self.project)

    def begin(self, agent: str, intent: str = "", files: tuple[str, ...] = ()) -> dict:
        """Registers or refreshes an agent's work; who else is at work, and which declared files they have too."""
        with write_lock(self.place, 30.0):
            self._add(agent, (None, "begin", intent, ""), *[(f, "declare", intent, "") for f in dict.fromkeys(files)])
            others = self._own().where(F.col("agent") != agent)
            mine = self._own().where((F.col("agent") == agent) & (F.col("action") == "declare")).select("file")
            taken = others.select("file").join(mine, "file", "left_semi").distinct()
            return {"project": self.project, "others": [r["agent"] for r in others.select("agent").distinct().orderBy("agent").collect()], "contested": [r["file"] for r in taken.orderBy("file").collect()]}

    def may_write(self, agent: str, file: str, signature: str = "") -> str:
        """block, warn or ok; unless it blocks, the file counts as touched.  signature: the file's just now."""
        with write_lock(self.place, 30.0):
            rows = self._own().where("file is not null")
            asked = self.spark.createDataFrame([(agent, file)], "agent string, file string")
            last = rows.where((F.col("agent") == agent) & (F.col("action") == "wrote")).groupBy("agent", "file").agg(F.max_by("signature", "ts").alias("s"))
            moved = last.where((F.col("s") != "") & (F.lit(signature) != "") & (F.col("s") != signature)).select("agent", "file")
            graph = self.graph or PropertyGraph(asked.select(F.col("file").alias("id")), self.spark.createDataFrame([], "source string, target string, type string"))
            told = verdicts(asked, rows.select("agent", "file"), graph, moved).collect()[0]["verdict"]
            if told != "block":
                self._add(agent, (file, "touch", "", ""))
            return told

    def after_write(self, agent: str, file: str, signature: str) -> None:
        """Notes the file's signature after an agent's own write, so that a later change by others is told."""
        with write_lock(self.place, 30.0):
            if self._own().where(F.col("agent") == agent).take(1):
                self._add(agent, (file, "wrote", "", signature))

    def close(self, agent: str) -> list[str] | None:
        """Ends a work; the files it touched, None where there was none."""
        with write_lock(self.place, 30.0):
            mine = self._own().where(F.col("agent") == agent)
            if not mine.take(1):
                return None
            touched = [r["file"] for r in mine.where("action in ('touch', 'wrote')").select("file").distinct().orderBy("file").collect()]
            self._add(agent, (None, "close", "", ""))
            return touched
