"""Size-tiered compaction of document shards under a versioned manifest.

``append`` writes arrivals as small immutable shards, ``compact`` merges runs
of similarly sized ones into files of about the target size, and either commits
by writing the next version of the manifest, complete, under a temporary name
and giving it its final name in one step that fails where the name is taken: a
version exists as a whole or not at all, and of two writers one fails and plans
anew.  A writer lost at any point leaves nothing that others wait for.  (The step
is a hard link on ``file:`` paths, elsewhere a rename that doesn't replace, as
HDFS has it.)  Readers take the highest version and never see a half-written or
half-merged state.  Files that no manifest names (of tasks or jobs that failed,
or merged away) are removed by ``vacuum``.

A shard's size is its logical one: the UTF-8 bytes of its texts plus
``ROW_BYTES`` a row.  Its tier is floor(log(size / target) / log(fan_in)),
counted down from the target; ``fan_in`` shards of one tier are merged, the
oldest first, and so on until no tier below the target has as many.  Sizes add
up, so the whole cascade is planned on the manifest and every row is rewritten
at most once per compaction, without a shuffle: a run's new files are written
by the tasks that read its shards, ``WAVE`` runs a job, and what they hold is
known from the manifest; only row counts are compared, by the files' footers.
An arrival larger than the target is split into several shards by its rows'
numbers in the scan, so neither a hot arrival nor many equal rows are one task's.
A lost task is computed again: rows that don't come from files in a fixed order
have to be written to a table first.

Defined results: null texts and null columns are kept as they are; a null
arrival is an arrival of its own, -1; repeated rows are all kept, also by
appending twice; columns are kept whatever their names, but those that begin with
``__`` are the shards' own and refused; appending an empty table commits a version without new shards;
reading a table without versions is an error.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialise

ROW_BYTES = 16
TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Runs that one compaction job rewrites.
WAVE = 64
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Shard:
    name: str
    path: str
    rows: int
    bytes: int
    first: int  # the oldest arrival in it
    last: int


@dataclass
class Manifest:
    version: int
    shards: list[Shard]


def tier(size: int, target: int, fan_in: int) -> int:
    """0 from the target on, -1 from target / fan_in on, and so on."""
    return min(0, math.floor(math.log(max(1, size) / target, fan_in) + 1e-9))


def plan_merges(shards: list[Shard], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """The groups of present shards that become one run each, after the whole cascade."""
    age = lambda run: (run[1][0].first, run[1][0].name)
    tiers: dict[int, list[tuple[int, list[Shard]]]] = {}
    for s in shards:
        tiers.setdefault(tier(s.bytes, target, fan_in), []).append((s.bytes, [s]))
    planned: list[list[Shard]] = []
    for level in range(min(tiers, default=0), 0):
        own = sorted(tiers.get(level, ()), key=age)
        whole = len(own) - len(own) % fan_in
        for i in range(0, whole, fan_in):
            part = own[i : i + fan_in]
            size = sum(b for b, _ in part)  # of a higher tier than its parts
            tiers.setdefault(tier(size, target, fan_in), []).append((size, [s for _, r in part for s in r]))
        planned += [r for _, r in own[whole:] if len(r) > 1]
    return planned + [r for _, r in sorted(tiers.get(0, ()), key=age) if len(r) > 1]


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifest -----------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        held = self.versions()
        if not held:
            return Manifest(0, [])
        version = held[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/_manifest/v{version:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(found["version"], [Shard(**s) for s in found["shards"]])

    def _commit(self, base: Manifest, shards: list[Shard]) -> Manifest:
        """Publishes the version after ``base``; raises if another writer was faster."""
        new = Manifest(base.version + 1, sorted(shards, key=lambda s: (s.first, s.name)))
        folder = f"{self.root}/_manifest"
        self._fs.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": new.version, "shards": [asdict(s) for s in new.shards]}).encode()))
        out.close()
        try:
            self._publish(draft, self._path(f"{folder}/v{new.version:010d}.json"))
        except Exception as e:
            raise RuntimeError(f"version {new.version} was committed by another writer, or could not be published") from e
        finally:
            self._fs.delete(draft, False)
        return new

    def _publish(self, draft, final) -> None:
        """Names the draft, whole or not at all; raises where the name is taken."""
        jvm = self.spark._jvm
        place = lambda p: jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
        if self._fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(place(final), place(draft))
            return
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        how[0] = kind.getEnumConstants()[0]  # NONE: doesn't replace
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(draft, final, how)

    # -- writing ------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        """Writes rows with ``__shard``, a folder for each; returns the parent folder, new for each try."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.partitionBy("__shard").option("compression", "zstd").parquet(path)
        return path

    def append(self, rows: DataFrame, arrival: Column, text: str = "text") -> Manifest:
        """One shard for each arrival, or several of at most about the target's size."""
        if bad := [c for c in rows.columns if c.startswith("__")]:
            raise ValueError(f"columns beginning with __ are reserved: {bad}")
        base = self.manifest()
        size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + ROW_BYTES
        rows = rows.withColumn("__arrival", F.coalesce(arrival.cast("bigint"), F.lit(-1))).withColumn("__size", size.cast("bigint"))
        sizes = rows.groupBy("__arrival").agg(F.sum("__size").alias("bytes"))
        pieces = F.ceil(F.col("bytes") / self.target).cast("int")
        # there are at most (all bytes / target) arrivals larger than the target: the count is checked
        large = materialise(sizes.where(F.col("bytes") > self.target).select("__arrival", pieces.alias("__pieces")), "shards-large")
        cut = rows.withColumn("__row", F.monotonically_increasing_id())
        cut = cut.join(F.broadcast(large) if large.count() < MOST_BROADCAST else large, "__arrival", "left")
        piece = F.pmod(F.xxhash64("__row"), F.coalesce("__pieces", F.lit(1))).cast("int")
        cut = cut.withColumn("__shard", F.format_string("a%d-%d", "__arrival", piece))
        path = self._write(cut.drop("__pieces", "__row").repartition("__shard"))
        discard(large)
        return self._commit(base, base.shards + self._measure(path))

    def _measure(self, path: str) -> list[Shard]:
        """What the shards in a folder hold, counted from the files themselves."""
        if not self._has_shards(path):
            return []
        held = self.spark.read.parquet(path).groupBy("__shard").agg(F.count("*").alias("n"), F.sum("__size").alias("b"), F.min("__arrival").alias("lo"), F.max("__arrival").alias("hi"))
        return [Shard(r["__shard"], f"{path}/__shard={r['__shard']}", r["n"], r["b"], r["lo"], r["hi"]) for r in held.collect()]

    def _has_shards(self, path: str) -> bool:
        return any(s.isDirectory() for s in self._fs.listStatus(self._path(path)))

    def compact(self) -> Manifest:
        """Merges until no tier below the target has ``fan_in`` runs; a version of its own if anything was merged."""
        base = self.manifest()
        groups = plan_merges(base.shards, self.target, self.fan_in)
        if not groups:
            return base
        added: list[Shard] = []
        for i in range(0, len(groups), WAVE):
            runs, due = [], []
            for g in groups[i : i + WAVE]:
                name, held = f"m{base.version + 1}-{g[0].name}", sum(s.bytes for s in g)
                run = self.spark.read.parquet(*[s.path for s in g]).coalesce(max(1, round(held / self.target)))
                runs.append(run.withColumn("__shard", F.lit(name)))
                due.append(Shard(name, "", sum(s.rows for s in g), held, min(s.first for s in g), max(s.last for s in g)))
            path = self._write(reduce(DataFrame.unionByName, runs))
            found = {r["__shard"]: r["count"] for r in self.spark.read.parquet(path).groupBy("__shard").count().collect()}
            if wrong := [s.name for s in due if found.get(s.name) != s.rows]:
                raise RuntimeError(f"merged shards don't hold their rows: {wrong}")
            added += [replace(s, path=f"{path}/__shard={s.name}") for s in due]
        gone = {s.path for g in groups for s in g}
        return self._commit(base, [s for s in base.shards if s.path not in gone] + added)

    def vacuum(self) -> int:
        """Removes data that the current manifest doesn't name; only when no writer is at work."""
        named = {s.path.rsplit("/", 1)[0] for s in self.manifest().shards}
        live = {s.path for s in self.manifest().shards}
        n = 0
        data = self._path(f"{self.root}/data")
        if not self._fs.exists(data):
            return 0
        for job in self._fs.listStatus(data):
            name = f"{self.root}/data/{job.getPath().getName()}"
            if name not in named:
                n += bool(self._fs.delete(job.getPath(), True))
                continue
            for shard in self._fs.listStatus(job.getPath()):
                if shard.isDirectory() and f"{name}/{shard.getPath().getName()}" not in live:
                    n += bool(self._fs.delete(shard.getPath(), True))
        return n

    # -- reading ------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with ``__shard`` and ``__arrival``."""
        shards = self.manifest(version).shards
        if not shards:
            raise ValueError(f"{self.root} has no shards")
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/__shard=([^/]+)/[^/]*$", 1)
        return self.spark.read.parquet(*[s.path for s in shards]).drop("__size").withColumn("__shard", name)
