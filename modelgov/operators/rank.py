"""Numbering rows inside groups, and listing group members, without unbounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def number_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 1..n inside each group, in ``order``.

    Rows are range-partitioned by (group, order), numbered inside each (group, partition) slice
    and shifted by the sizes of earlier slices of the same group, so no task sorts a whole large
    group.  The input is written first, since range bounds come from a sample of it; the slices
    are written too, since a second reading of the sample could cut them elsewhere.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    sliced = materialise(
        materialise(df).repartitionByRange(parts, *group, *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # A range boundary cuts at most one group, so fewer rows than slices carry a shift.
    shifts = sizes.withColumn("_shift", F.sum("_n").over(earlier)).filter("_shift > 0").drop("_n")
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in [*group, "_slice"]]
    local = sliced.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*order)).cast("long")
    )
    return local.alias("r").join(F.broadcast(shifts).alias("s"), same, "left").select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("r._local") + F.coalesce(F.col("s._shift"), F.lit(0))).alias(name),
    )


def listed(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct members of each group, one row each: (group, ``value``, position), in order of ``value``."""
    return number_within(df.select(*group, value).distinct(), group, [value], "position")
