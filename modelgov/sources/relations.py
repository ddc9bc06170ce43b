"""Tabular inputs: catalog relations, usage, protection lists, exported metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import build_key, clean_text, normalize_key


def require_columns(df: DataFrame, *names: str, what: str = "input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; found {df.columns}")
    return df


def with_typed_nulls(df: DataFrame, **types: str) -> DataFrame:
    """Add every missing column as a typed NULL (older exports lack some)."""
    absent = {n: F.lit(None).cast(t) for n, t in types.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def read_relation(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", "true").csv(path)
    return spark.read.format(fmt).load(path)


def read_catalog(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, relations) as written by ``sinks.write_catalog``."""
    return tuple(spark.read.parquet(f"{root}/{n}") for n in ("tables", "columns", "relations"))


def security_set(manual: DataFrame | None, detected: DataFrame | None) -> DataFrame:
    """Distinct (model_id, table_norm) from the manual list and the detected roles."""
    parts = [d for d in (manual, detected) if d is not None]
    if not parts:
        raise ValueError("neither a manual nor a detected security list was given")
    out = None
    for part in parts:
        require_columns(part, "model_id", "table_name", what="security list")
        rows = part.select("model_id", normalize_key("table_name").alias("table_norm"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.col("table_norm") != "").distinct()


def view_set(views: DataFrame) -> DataFrame:
    """Distinct (model_id, key_norm) of columns used by database views; blanks are dropped."""
    require_columns(views, "model_id", "table_name", "column_name", what="view list")
    return (
        views.filter((clean_text("table_name") != "") & (clean_text("column_name") != ""))
        .select("model_id", normalize_key(build_key("table_name", "column_name")).alias("key_norm"))
        .distinct()
    )
