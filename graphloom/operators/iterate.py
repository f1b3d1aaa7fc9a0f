"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Writes to the folder that executors share, in folders by the columns ``by``, and reads it back.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset
    (local tests) it is one below the warehouse.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/loop-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*held: DataFrame) -> None:
    """Removes what ``cut`` wrote, once nothing reads it any more; other frames are left alone."""
    for df in held:
        if path := getattr(df, "scratch", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order, without a task that holds them all.

    Rows are sorted by ranges and written with their range's number; each range is
    numbered by itself, from where the ranges before it end (counts that reach
    the driver: one a range).
    """
    held = cut(rows.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    counts = sorted(held.groupBy("__range").count().collect())
    before, sums = 0, []
    for r in counts:
        sums.append((r[0], before))
        before += r[1]
    if not sums:
        return held.withColumn(name, F.lit(0)).drop("__range")
    start = F.create_map(*[F.lit(x) for pair in sums for x in pair])
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return held.withColumn(name, (place + start[F.col("__range")]).cast("int")).drop("__range")
