"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ORDER_SEED = 42
#: Labelled texts of more characters aren't trained on.
LONGEST_TRAINED = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    The setting is read from the session.  Where it is unset (local tests), a
    folder below the warehouse directory is used, which is local then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*held: DataFrame) -> None:
    """Removes what ``materialise`` wrote, once nothing will read it any more."""
    for df in held:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs pass at most so many rows at once to Python workers: for rows that hold whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives freed memory back to the system at its end: idle workers of an executor add up."""

    def call(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return call


def held_out(col: str, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % mod == rest, F.lit(False))


def sample_by_class(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """At most about ``per_class`` rows of each class, chosen by a hash of ``key``.

    A class's share is per_class / its count, so classes that have fewer rows
    are taken whole.  Only the classes' counts reach the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(ROW_ORDER_SEED)), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_class / n))) for k, n in counts.items()])
    return rows.where(unit < share)


def slices(texts: Iterable[str | None], most_chars: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs with at most ``most_chars`` characters; a longer text forms its own run."""
    run: list[str] = []
    first = total = 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and total + len(t) > most_chars:
            yield first, run
            run, first, total = [], i, 0
        run.append(t)
        total += len(t)
    if run:
        yield first, run


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for each segment; empty segments give 0.  Segments ascend and don't overlap."""
    out = np.zeros((len(starts), *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        # reduceat runs to the next start: put each segment's end between
        edges = np.stack([starts[full], ends[full]], 1).ravel()
        padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), dtype=values.dtype)])
        out[full] = np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, use: Column, key: str, text: str, per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most about ``per_class`` labelled rows of each class, and all classes' counts.

    Null labels and keys are left out; of a key that is labelled more than once
    the smallest label counts, and of rows that share a key the smallest text.
    The chosen keys are broadcast: their number is bounded by ``per_class``.
    """
    rows = labels.where(use & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__label"))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("__label").count().collect()}
    chosen = sample_by_class(rows, "__label", key, per_class).select(F.col(key).alias("__key"), "__label")
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    # rows that share an id count once; very long texts train nothing, so that a sample's size has a bound
    own = own.where(F.coalesce(F.length("__text"), F.lit(0)) <= LONGEST_TRAINED)
    found = own.join(F.broadcast(chosen), "__key").groupBy("__key").agg(F.min("__text").alias("t"), F.min("__label").alias("l")).select("t", "l").collect()
    return sorted((r[0] or "", int(r[1])) for r in found), counts
