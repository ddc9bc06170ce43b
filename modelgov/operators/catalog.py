"""Catalog relations: ids, relationship resolution and the column universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACE, build_key, key_place, normalize_key
from ..session import dealt
from .rank import number_within

MEASURE_SOURCE = "[Measure]"


def column_kind(source_column: Column) -> Column:
    """measure / calculated / imported, from the source column's fixed encodings."""
    src = F.trim(F.coalesce(source_column, F.lit("")))
    return F.when(src == MEASURE_SOURCE, "measure").when(src == "", "calculated").otherwise("imported")


def catalog_tables(tables: DataFrame) -> DataFrame:
    """(model_id, path, table_name) -> plus table_id 1..n in path order."""
    return number_within(tables.select("model_id", "path", "table_name"), ["model_id"], ["path"], "table_id")


def catalog_columns(columns: DataFrame, measures: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Columns then measures of each table, numbered 1..n per model in path order."""
    cols = columns.select(
        "model_id", "path", "table_name", "block_no", "column_name", "source_column", F.lit(0).alias("is_measure")
    )
    meas = measures.select(
        "model_id", "path", "table_name", "block_no", F.col("measure").alias("column_name"),
        F.lit(MEASURE_SOURCE).alias("source_column"), F.lit(1).alias("is_measure"),
    )
    out = number_within(
        cols.unionByName(meas), ["model_id"], ["path", "is_measure", "block_no"], "column_id"
    ).drop("block_no", "is_measure")
    if tables is not None:
        out = out.join(tables.select("model_id", "path", "table_id"), ["model_id", "path"], "left")
    return out


def resolve_relations(relations: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationship names -> ids; ``missing`` is an array of the ends that could not be resolved."""
    t = tables.groupBy("model_id", "table_name").agg(F.max("table_id").alias("table_id"))
    c = columns.groupBy("model_id", "table_name", "column_name").agg(F.max("column_id").alias("column_id"))
    out = relations
    for side in ("from", "to"):
        names = c.select(
            "model_id", F.col("table_name").alias(f"{side}_table"), F.col("column_name").alias(f"{side}_column"),
            F.col("column_id").alias(f"{side}_column_id"),
        )
        ids = t.select(
            "model_id", F.col("table_name").alias(f"{side}_table"), F.col("table_id").alias(f"{side}_table_id")
        )
        out = out.join(ids, ["model_id", f"{side}_table"], "left")
        out = out.join(names, ["model_id", f"{side}_table", f"{side}_column"], "left")

    sides = [F.when(F.col(f"{side}_id").isNull(), F.lit(side)) for side in ("from_table", "from_column", "to_table", "to_column")]
    return out.withColumn("missing", F.array_compact(F.array(*sides)))


RELATION_COLUMNS = [
    "model_id", "from_table_id", "from_column_id", "to_table_id", "to_column_id", "cross_filter", "is_active",
]


def catalog_relations(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.size("missing") == 0).select(*RELATION_COLUMNS)


def unresolved_relations(resolved: DataFrame) -> DataFrame:
    """Relationships with an end that the catalog lacks: which ends, and the names as they stand."""
    return resolved.filter(F.size("missing") > 0).select(
        "model_id", "relationship", "missing", "from_table", "from_column", "to_table", "to_column"
    )


def semantic_master(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Column universe with keys.  A column without a table raises when rows are read.

    ``columns``: model_id, column_id, column_name, source_column, table_id.  Tables marked by
    ``decide.secured_tables`` hand their mark to their columns.
    """
    names = tables.select("model_id", "table_id", "table_name", *(["secured"] if "secured" in tables.columns else []))
    orphan = F.raise_error(F.concat(F.lit("column without table: "), F.col("column_id").cast("string")))
    return _with_keys(
        columns.select("model_id", "column_id", "column_name", "source_column", "table_id")
        .join(names, ["model_id", "table_id"], "left")
        .withColumn("table_name", F.coalesce("table_name", orphan.cast("string")))
    )


def _with_keys(master: DataFrame) -> DataFrame:
    return (
        master.withColumn("kind", column_kind(F.col("source_column")))
        .withColumn("key", build_key("table_name", "column_name"))
        .withColumn("key_norm", normalize_key("key"))
    )


def dealt_master(master: DataFrame) -> DataFrame:
    """The master dealt by the place of its keys (column ``_place``); what follows from names is made behind the shuffle."""
    place = key_place(normalize_key(build_key("table_name", "column_name")))
    rows = master.drop("kind", "key", "key_norm").repartition("model_id", place)
    return _with_keys(rows).withColumn(PLACE, key_place("key_norm")).select(*master.columns, PLACE)


def written_master(master: DataFrame) -> DataFrame:
    """``dealt_master`` as a written table, for queries that read it several times; keys are made where it is read."""
    rows = dealt(dealt_master(master).drop("kind", "key", "key_norm"), "model_id", PLACE)
    return _with_keys(rows).select(*master.columns, PLACE)


def relation_names(relations: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationship ids -> names; an unknown id raises when rows are read."""
    t = tables.select("model_id", "table_id", "table_name")
    c = columns.select("model_id", "table_id", "column_id", "column_name")
    out = relations
    for side in ("from", "to"):
        out = out.join(
            t.select("model_id", F.col("table_id").alias(f"{side}_table_id"), F.col("table_name").alias(f"{side}_table")),
            ["model_id", f"{side}_table_id"], "left",
        ).join(
            c.select("model_id", F.col("table_id").alias(f"{side}_table_id"), F.col("column_id").alias(f"{side}_column_id"),
                     F.col("column_name").alias(f"{side}_column")),
            ["model_id", f"{side}_table_id", f"{side}_column_id"], "left",
        )
    fields = []
    for name in ("from_table", "from_column", "to_table", "to_column"):
        problem = F.raise_error(F.lit(f"relationship id without {name}"))
        fields.append(F.coalesce(F.col(name), problem.cast("string")).alias(name))
    return out.select("model_id", *fields)


def all_names(names: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Ends of all relationships by name: the resolved ones of ``relation_names`` and those the catalog lacks."""
    return names.unionByName(unresolved.select(*names.columns))
