"""Usage analytics: how often and where each field of a model is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    blank_to_null, build_key, clean_text, key_column, key_columns, normalize_key, placed,
)
from ..session import materialise

FLAGS = ["slicer", "visual", "filter", "measure"]


def _names_column(usage: DataFrame) -> str:
    """``column_name`` in long rows (one name each), ``column_names`` in comma lists."""
    return "column_name" if "column_name" in usage.columns else "column_names"


def kept_uses(usage: DataFrame) -> DataFrame:
    """Uses whose reference stands; those ``validate_refs`` dropped are left out."""
    return usage.filter(F.col("status") != "dropped")


def distinct_uses(usage: DataFrame) -> DataFrame:
    """Equal usage rows as one row with a count (``n_uses``).

    Reports repeat the same reference many times; text work and shuffles after this step see
    each form once, however popular a field is.
    """
    return usage.groupBy(
        "model_id", "table_name", _names_column(usage), "ui_field", "usage_label",
        F.when(blank_to_null(F.col("formula")).isNotNull(), "formula").alias("formula"),
    ).agg(F.count("*").alias("n_uses"))


def usage_explode(usage: DataFrame) -> DataFrame:
    """One row per used name: comma lists are split, measure rows also name their field.

    ``usage``: model_id, table_name, column_names (a comma list) or column_name (one name, which
    may hold commas and is not split), ui_field, usage_label, formula, and n_uses after
    ``distinct_uses``.  Both steps happen in one generator, so usage is read once.
    """
    weight = ["n_uses"] if "n_uses" in usage.columns else []
    has_formula = blank_to_null(F.col("formula")).isNotNull()
    given = _names_column(usage)
    text = F.coalesce(given, F.lit(""))
    several = F.array(text) if given == "column_name" else F.split(text, ",")
    names = F.filter(F.transform(several, clean_text), lambda n: n != "")
    doubled = F.flatten(F.transform(names, lambda n: F.array(n, clean_text("ui_field"))))
    return (
        usage.select(
            "model_id", clean_text("table_name").alias("table_name"),
            F.explode(F.when(has_formula, doubled).otherwise(names)).alias("column_name"),
            clean_text("usage_label").alias("usage_label"), has_formula.alias("has_formula"), *weight,
        ).filter(F.col("column_name") != "")
    )


def usage_classify(exploded: DataFrame) -> DataFrame:
    """Slicer / visual / filter by word, measure by tag or formula (0/1)."""
    label = F.lower("usage_label")
    words = {w: label.rlike(rf"\b{w}\b").cast("int") for w in ("slicer", "visual", "filter")}
    tagged = (label.contains("(measure)") | F.col("has_formula")).cast("int")
    return exploded.withColumns({**words, "measure": tagged}).drop("has_formula")


def field_usage_counts(classified: DataFrame) -> DataFrame:
    """Counts per (model, table, column), total frequency and key.

    Partial sums before the shuffle keep a very popular field cheap.
    """
    n = F.col("n_uses") if "n_uses" in classified.columns else F.lit(1)
    sums = [F.sum(F.col(f) * n).alias(f) for f in FLAGS]
    return (
        classified.groupBy("model_id", "table_name", "column_name").agg(*sums)
        .withColumn("frequency", F.col("slicer") + F.col("visual") + F.col("filter") + F.col("measure"))
        .withColumn("key", F.concat("table_name", F.lit("$$"), "column_name"))
    )


def ordered_counts(counts: DataFrame) -> DataFrame:
    """Report order inside each model: most used first, then table and column."""
    return counts.orderBy("model_id", F.desc("frequency"), "table_name", "column_name")


def top_fields(counts: DataFrame, k: int) -> DataFrame:
    """The k most used fields of each model; the rank limit is applied before the shuffle."""
    order = Window.partitionBy("model_id").orderBy(F.desc("frequency"), "table_name", "column_name")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def used_keys(counts: DataFrame) -> DataFrame:
    """Distinct (model_id, key_norm, name_norm) of used fields."""
    return (
        counts.select("model_id", normalize_key("key").alias("key_norm"))
        .distinct()
        .withColumn("name_norm", F.trim(key_column("key_norm")))
    )


def used_in_report(master: DataFrame, counts: DataFrame, as_int: bool = True, measures: DataFrame | None = None) -> DataFrame:
    """Flag columns whose key is used; measures also match by name alone.

    Names are looked up for the keys of measures only, and full rows are joined once, by key:
    both ways of being used arrive there as one mark per key.  A key can stand for measures of
    several names if names hold the key's separator, so a mark lists the names found.  ``measures``:
    the same rows, or their measures, where a dealt master would be shuffled to read them.
    """
    used = materialise(used_keys(counts))
    name = normalize_key("column_name")
    by_name = (
        (master if measures is None else measures).filter(F.col("kind") == "measure").select("model_id", "key_norm", name.alias("name_norm"))
        .join(used.select("model_id", "name_norm").distinct(), ["model_id", "name_norm"], "left_semi")
        .select("model_id", "key_norm", F.lit(False).alias("_key"), "name_norm")
    )
    by_key = used.select("model_id", "key_norm", F.lit(True).alias("_key"), F.lit(None).cast("string").alias("name_norm"))
    key = key_columns(master)
    marks = placed(by_key.unionByName(by_name), master).groupBy(*key).agg(F.max("_key").alias("_by_key"), F.collect_set("name_norm").alias("_names"))
    named = (F.col("kind") == "measure") & F.array_contains("_names", name)
    flag = F.coalesce("_by_key", F.lit(False)) | F.coalesce(named, F.lit(False))
    return (
        master.join(marks, key, "left")
        .withColumn("used_in_report", flag.cast("int") if as_int else F.when(flag, "Yes").otherwise("No"))
        .drop("_by_key", "_names")
    )


def unmatched_usage(master: DataFrame, counts: DataFrame) -> DataFrame:
    """Used keys the catalog does not know: true mismatch or display alias."""
    model_keys = master.select("model_id", "key_norm").distinct()
    names = master.groupBy("model_id", normalize_key("column_name").alias("name_norm")).agg(
        F.max(F.col("kind") == "measure").alias("is_measure")
    )
    return (
        counts.select("model_id", "key", normalize_key("key").alias("key_norm"))
        .distinct()
        .join(model_keys, ["model_id", "key_norm"], "left_anti")
        .withColumn("name_norm", F.trim(key_column("key_norm")))
        .join(names, ["model_id", "name_norm"], "left")
        .filter(~F.coalesce("is_measure", F.lit(False)))
        .select("model_id", "key", F.when(F.col("is_measure").isNotNull(), "true mismatch").otherwise("display alias").alias("class"))
    )


def relation_endpoints(names: DataFrame) -> DataFrame:
    """Distinct endpoint keys of resolved relationships: (model_id, key, key_norm)."""
    sides = F.array(build_key("from_table", "from_column"), build_key("to_table", "to_column"))
    return (
        names.select("model_id", F.explode(sides).alias("key")).distinct()
        .withColumn("key_norm", normalize_key("key"))
    )


def used_in_relationship(master: DataFrame, names: DataFrame, as_int: bool = True) -> DataFrame:
    """Flag columns that are an end of any relationship, active or not."""
    key = key_columns(master)
    ends = placed(relation_endpoints(names).select("model_id", "key_norm"), master)
    ends = ends.distinct().withColumn("_end", F.lit(True))
    flag = F.coalesce("_end", F.lit(False))
    return (
        master.join(ends, key, "left")
        .withColumn("used_in_relationship", flag.cast("int") if as_int else F.when(flag, "Yes").otherwise("No"))
        .drop("_end")
    )


def unmatched_endpoints(master: DataFrame, names: DataFrame) -> DataFrame:
    return (
        relation_endpoints(names)
        .join(master.select("model_id", "key_norm").distinct(), ["model_id", "key_norm"], "left_anti")
        .select("model_id", "key")
    )
