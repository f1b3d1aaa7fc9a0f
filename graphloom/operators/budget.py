"""Greedy fit to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fit(rows: DataFrame, cost: Column, budget: int, order: list[Column], unlimited_below_one: bool = True) -> DataFrame:
    """Rows in ``order`` while their summed cost fits; the first always, none after the first that doesn't.

    Costs are at least 1, so no more than ``budget`` + 1 rows can matter: the
    running sum is taken over that many, not over the whole table in one task.
    """
    rows = rows.withColumn("cost", cost)
    if budget <= 0 and unlimited_below_one:
        return rows.withColumn("spent", F.lit(None).cast("bigint"))
    head = rows.orderBy(*order).limit(max(1, budget + 1))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    head = head.withColumn("spent", F.sum("cost").over(w)).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return head.where((F.col("spent") <= budget) | (F.col("place") == 1)).drop("place")
