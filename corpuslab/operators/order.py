"""Global order without a one-task window: positions, ordered splits, early stops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Rows of a bucket of neighbouring order values, which is ranked in one task.
BUCKET_ROWS = 200_000


def _bucket(order: str, borders: list[float]) -> Column:
    """How many of the sorted borders are at most the order value."""
    if not borders:
        return F.lit(0).cast("long")
    at = np.array(borders)

    @pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, x.to_numpy(), "right"))

    return place(F.col(order).cast("double"))


def with_position(df: DataFrame, order: str, name: str = "position", weight: Column | None = None, by: str | None = None) -> DataFrame:
    """name: the 0-based rank of each row by the integer column `order`, or the sum of `weight` of the rows before it; within
    the rows of equal `by` (null is a value) if that is given.

    Rows are cut at quantiles of the order values, wherever these lie; the buckets' totals (a few numbers
    each) are summed up, and each bucket is ranked by itself. Equal order values share a bucket.
    """
    n = df.count()
    count = min(-(-n // BUCKET_ROWS), 100_000)
    cuts = sorted(set(df.approxQuantile(order, [i / count for i in range(1, count)], 0.2 / count))) if count > 1 else []
    weight = F.lit(1).cast("long") if weight is None else weight
    rows = df.withColumn("_b", _bucket(order, cuts)).withColumn("_w", weight).withColumn("_g", F.lit(None).cast("string") if by is None else F.col(by).cast("string"))
    totals = rows.groupBy("_g", "_b").agg(F.sum("_w").alias("_t"))
    before = totals.select(F.col("_g").alias("_h"), F.col("_b").alias("_c"), (F.sum("_t").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = F.sum("_w").over(Window.partitionBy("_g", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")
    joined = rows.withColumn("_i", inside).join(before, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_w", "_i", "_before", "_g", "_h", "_c")


def take_until(df: DataFrame, valid: Column, order: str, n: int) -> DataFrame:
    """Rows up to the n-th valid one by order: what an ordered scan has seen when it stops there."""
    last = df.filter(valid).select(order).orderBy(order).limit(n).agg(F.max(order).alias("m"), F.count(F.lit(1)).alias("c")).first()
    return df if last["c"] < n else df.filter(F.col(order) <= F.lit(last["m"]))


def ordered_splits(df: DataFrame, order: str, sizes: dict[str, int], name: str = "split") -> DataFrame:
    """Consecutive slices of the given sizes by order; rows beyond them have no split."""
    ranked = with_position(df, order, "_pos")
    expr, end = F.lit(None).cast("string"), sum(sizes.values())
    for split, size in reversed(list(sizes.items())):
        end -= size
        expr = F.when((F.col("_pos") >= end) & (F.col("_pos") < end + size), F.lit(split)).otherwise(expr)
    return ranked.withColumn(name, expr).drop("_pos")
