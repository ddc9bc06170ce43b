"""Star-schema jobs of the kind a model declares: loads, spines, joins and visual queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

# Declared type names and the engine types behind them.
DECLARED_TYPES = {
    "text": "string", "int64": "bigint", "datetime": "timestamp", "currency": "decimal(19,4)",
    "percentage": "double", "number": "double", "logical": "boolean",
}


def typed_load(df: DataFrame, **declared: str) -> DataFrame:
    """Cast columns to declared types; unlisted columns are dropped (the scan reads only these)."""
    return df.select(*[F.col(c).cast(DECLARED_TYPES[t]).alias(c) for c, t in declared.items()])


def fact_union(first: DataFrame, second: DataFrame, date_column: str, name: str = "date") -> DataFrame:
    """Combine two facts by column name and add the calculated date."""
    return first.unionByName(second).withColumn(name, F.to_date(date_column))


def date_spine(df: DataFrame, date_column: str) -> DataFrame:
    """All days from Jan 1 of the first year to Dec 31 of the last.

    Minimum and maximum are one row; the days are produced by Spark from it.
    """
    return (
        df.agg(F.min(F.year(date_column)).alias("lo"), F.max(F.year(date_column)).alias("hi"))
        .select(F.explode(F.sequence(F.make_date("lo", F.lit(1), F.lit(1)), F.make_date("hi", F.lit(12), F.lit(31)))).alias("date"))
    )


def calendar_columns(spine: DataFrame) -> DataFrame:
    month = F.month("date")
    quarter = F.floor((month + 2) / 3).cast("int")
    return spine.select(
        "date", F.year("date").alias("year"), month.alias("month_no"), F.date_format("date", "MMMM").alias("month"),
        quarter.alias("quarter_no"), F.concat(F.lit("Qtr "), quarter.cast("string")).alias("quarter"),
        F.dayofmonth("date").alias("day"),
    )


def measure(kind: str, column: Column | str) -> Column:
    """sum / avg / counta (rows where the column is not blank)."""
    return {"sum": F.sum, "avg": F.avg, "counta": F.count}[kind](column)


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins along many-to-one relationships: (dimension, fact key, dimension key).

    No side is forced to broadcast: the optimizer does it below its size threshold and
    otherwise sorts and merges, splitting skewed keys.
    """
    out = fact
    for dim, fact_key, dim_key in dimensions:
        out = out.join(dim, out[fact_key] == dim[dim_key], "left")
    return out


def date_join(fact: DataFrame, calendar: DataFrame, timestamp: str) -> DataFrame:
    """Join a timestamp to the calendar on its date part only."""
    return fact.withColumn("_d", F.to_date(timestamp)).join(calendar, F.col("_d") == calendar["date"], "left").drop("_d")


def grouped(df: DataFrame, by: Sequence[str], **measures: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])


def category_bar(df: DataFrame, by: Sequence[str], name: str, value: Column) -> DataFrame:
    """Grouped measure, largest first."""
    return grouped(df, by, **{name: value}).orderBy(F.desc(name), *by)


def combo(df: DataFrame, label: str, sort_by: str, **measures: Column) -> DataFrame:
    """Measures per label, ordered by the label's sort-by column."""
    return grouped(df, [label, sort_by], **measures).orderBy(sort_by)


def card(df: DataFrame, exclude: tuple[str, Sequence] | None = None, **measures: Column) -> DataFrame:
    """Totals, optionally under a "not in" filter (blanks stay, as in an inverted selection)."""
    if exclude:
        column, values = exclude
        df = df.filter(~F.col(column).isin(list(values)) | F.col(column).isNull())
    return df.agg(*[m.alias(n) for n, m in measures.items()])


def drillthrough(df: DataFrame, **selected: Sequence) -> DataFrame:
    """Page filter: every named column must be one of its selected values."""
    for column, values in selected.items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def matrix(df: DataFrame, rows: Sequence[str], **measures: Column) -> DataFrame:
    """Row levels with subtotals; ``level`` counts the row levels that are rolled up."""
    depth = F.bit_count(F.grouping_id()).cast("int")
    return df.rollup(*rows).agg(depth.alias("level"), *[m.alias(n) for n, m in measures.items()])


def slicer_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def shares(df: DataFrame, by: Sequence[str], name: str, value: Column) -> DataFrame:
    """Grouped measure with its share of the total.

    The groups are written once; the total is a scalar subquery over them, not over the fact.
    """
    groups = materialise(grouped(df, by, **{name: value}))
    return groups.withColumn("share", F.col(name) / groups.agg(F.sum(name)).scalar())


def date_drill(df: DataFrame, date_column: str, **measures: Column) -> DataFrame:
    """Year > quarter > month > day with subtotals at every level."""
    month = F.month(date_column)
    parts = df.withColumns({
        "year": F.year(date_column), "quarter": F.concat(F.lit("Qtr "), F.floor((month + 2) / 3).cast("string")),
        "month": month, "day": F.dayofmonth(date_column),
    })
    return matrix(parts, ["year", "quarter", "month", "day"], **measures)
