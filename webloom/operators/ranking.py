"""Exact ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.lineage import keep


def count_before(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: str, out: str) -> DataFrame:
    """Add to each row the sum of n over the rows of its group that come before it.

    Rows must be distinct in (keys, order); order is ascending, nulls first. A group may hold most of
    all rows: they are range partitioned by keys and order, sums run inside one part of a group at a time, and
    only groups that cross a partition border get an offset (at most one row per border, hence broadcast).
    An empty table gives an empty result.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = keep(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "_part").agg(F.sum(n).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.sum("_sum").over(earlier)).filter("_offset > 0").drop("_sum")
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_part"]]
    counted = parts.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0)))
    joined = counted.alias("r").join(F.broadcast(offsets).alias("o"), same, "left")
    value = (F.col("r._within") + F.coalesce(F.col("o._offset"), F.lit(0))).alias(out)
    return joined.select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns], value)
