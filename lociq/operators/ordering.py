"""Places of rows in an order of all of them, without a task that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.scratch import stored


def numbered(rows: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds ``place``, from 0 in the order of ``keys`` among the rows with the same ``within``, and ``among``, their number.

    Rows are dealt out by ranges and written once. Each range is numbered by itself; the rows in the ranges before it are a
    sum over one row for each range. Rows of equal keys have any order among themselves. Null is a value like any other, the first.
    """
    within = within or []
    ranged = stored(rows.repartitionByRange(*within, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range", *within).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*within)
    before = F.coalesce(F.sum("n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("__range").alias("__at"), *[F.col(c).alias(f"__at_{c}") for c in within], before.alias("__before"), F.sum("n").over(group).alias("among"))
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__range", *within).orderBy(*keys)))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__at_{c}")), within, F.col("__range") == F.col("__at"))
    return own.join(starts, same).select(*rows.columns, (F.col("__before") + F.col("__own") - 1).alias("place"), "among")
