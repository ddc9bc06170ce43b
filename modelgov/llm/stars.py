"""Connected components by alternating small and large stars; only edges move, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def components(edges: DataFrame, work: Work, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (the smallest node it reaches) of every node that has an edge.

    Nulls and loops are left out.  Each round is a written table, so a lost executor costs a round.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where(F.col("u") != F.col("v")).distinct()

    now = work.keep(tidy(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull())))
    sign = None
    while True:
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = tidy(now.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v"))
        small = work.keep(small)
        both = small.union(small.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = work.keep(tidy(both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))))
        new = large.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(now, small)
        now = large
        if tuple(new) == sign:
            break
        sign = tuple(new)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return work.keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
