"""Removal decisions: base rule, protections, table roll-up and generated statements.

``decisions`` rows: model_id, table_name, column_name, source_column, kind, key_norm,
used_in_report, used_in_relationship, remove_column ('Yes'/'No'), protected (reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLACE, key_columns, key_place, norm_pair, normalize_key, placed, sql_identifier
from ..session import dealt, materialise
from .graph import reachable_from


def base_decisions(flagged: DataFrame) -> DataFrame:
    """Remove what neither a report nor a relationship uses."""
    unused = (F.col("used_in_report") == 0) & (F.col("used_in_relationship") == 0)
    return flagged.withColumn("remove_column", F.when(unused, "Yes").otherwise("No"))


def column_decisions(in_report: DataFrame, in_relationship: DataFrame) -> DataFrame:
    """Put both flags together by column id; a column missing on the right raises.

    Where both come from one dealt master, a column has one place, and its rows meet there.
    """
    ids = ["model_id", *([PLACE] if PLACE in in_report.columns and PLACE in in_relationship.columns else []), "table_id", "column_id"]
    gap = F.raise_error(F.concat(F.lit("no relationship flag for column "), F.col("column_id").cast("string")))
    right = in_relationship.select(*ids, "used_in_relationship")
    return base_decisions(
        in_report.join(right, ids, "left").withColumn(
            "used_in_relationship", F.coalesce("used_in_relationship", gap.cast("int"))
        )
    )


def secured_tables(tables: DataFrame, security: DataFrame) -> DataFrame:
    """Tables with ``secured``: the security list is met once per table, not once per column."""
    marks = security.select("model_id", "table_norm").distinct().withColumn("secured", F.lit(True))
    return (
        tables.withColumn("table_norm", normalize_key("table_name"))
        .join(marks, ["model_id", "table_norm"], "left")
        .withColumn("secured", F.coalesce("secured", F.lit(False)))
        .drop("table_norm")
    )


def protect_lists(decisions: DataFrame, security: DataFrame | None = None, views: DataFrame | None = None) -> DataFrame:
    """Security tables and view columns override removal; adds ``protected`` Yes/No.

    ``security``: model_id, table_norm; without it, decisions that carry ``secured`` (see
    ``secured_tables``) are protected by it.  ``views``: model_id, key_norm.
    """
    marked = security is None and "secured" in decisions.columns
    out = decisions.withColumnRenamed("secured", "_hit") if marked else decisions.withColumn("_hit", F.lit(False))
    if views is not None:
        marks = placed(views.select("model_id", "key_norm").distinct(), out).withColumn("_view", F.lit(True))
        out = out.join(marks, key_columns(out), "left").withColumn(
            "_hit", F.col("_hit") | F.coalesce("_view", F.lit(False))
        ).drop("_view")
    if security is not None:
        marks = security.select("model_id", "table_norm").distinct().withColumn("_sec", F.lit(True))
        out = out.withColumn("table_norm", normalize_key("table_name")).join(
            marks, ["model_id", "table_norm"], "left"
        ).withColumn("_hit", F.col("_hit") | F.coalesce("_sec", F.lit(False))).drop("_sec", "table_norm")
    return (
        out.withColumn("protected", F.when(F.col("_hit"), "Yes").otherwise("No"))
        .withColumn("remove_column", F.when(F.col("_hit"), "No").otherwise(F.col("remove_column")))
        .drop("_hit")
    )


def written(decisions: DataFrame) -> DataFrame:
    """Decisions as a written table, dealt by the place of their keys if they come so."""
    return dealt(decisions, "model_id", PLACE) if PLACE in decisions.columns else materialise(decisions)


def kept_keys(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("remove_column") == "No").select(*key_columns(decisions))


def removal_keys(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("remove_column") == "Yes").select(*key_columns(decisions))


def mark_protected(decisions: DataFrame, targets: DataFrame, reason: str) -> DataFrame:
    """Turn removals whose key is a target into kept columns with a reason; ``decisions`` is a written table."""
    marks = placed(targets.select("model_id", "key_norm").distinct(), decisions)
    return give_reasons(decisions, marks.withColumn("_reason", F.lit(reason)))


def give_reasons(decisions: DataFrame, marks: DataFrame) -> DataFrame:
    """Decisions with the reasons of ``marks`` (model_id, key_norm, _reason; one per key).

    ``decisions`` is a written table: only its removals are joined, all other rows stay where they are.  Dealt
    decisions stay where they are anyhow.
    """
    removed = F.col("remove_column") == "Yes"
    hit = F.col("_reason").isNotNull()
    if PLACE in decisions.columns:
        hit &= removed
        return (
            decisions.join(marks, key_columns(decisions), "left")
            .withColumns({"protected": F.when(hit, F.col("_reason")).otherwise(F.col("protected")),
                          "remove_column": F.when(hit, "No").otherwise(F.col("remove_column"))})
            .drop("_reason")
        )
    found = (
        decisions.filter(removed).join(marks, ["model_id", "key_norm"], "left")
        .withColumn("protected", F.when(hit, F.col("_reason")).otherwise(F.col("protected")))
        .withColumn("remove_column", F.when(hit, "No").otherwise(F.col("remove_column")))
        .drop("_reason")
    )
    return decisions.filter(~F.coalesce(removed, F.lit(False))).unionByName(found)


def _meeting(keys: DataFrame) -> tuple[DataFrame, list[str], str]:
    """What keeps the rows that meet ``keys``, as arguments of a join.

    A semi-join would be planned below the dealing of those rows, and move the dealt keys instead: distinct keys keep the same.
    """
    key = key_columns(keys)
    return (keys.select(*key).distinct(), key, "inner") if PLACE in key else (keys, key, "left_semi")


def link_targets(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Keys that links of kept columns point to."""
    return (
        placed(links.select(
            "model_id", norm_pair("table_name", "column_name").alias("key_norm"),
            norm_pair("target_table", "target_column").alias("target"),
        ), kept)
        .join(*_meeting(kept))
        .select("model_id", F.col("target").alias("key_norm"))
        .distinct()
    )


def formula_targets(owner_refs: DataFrame, kept_owners: DataFrame) -> DataFrame:
    """Keys that formulas of kept calculated columns and measures mention."""
    return (
        placed(owner_refs.select(
            "model_id", norm_pair("table_name", "name").alias("key_norm"),
            norm_pair("ref_table", "ref_column").alias("target"),
        ), kept_owners)
        .join(*_meeting(kept_owners))
        .select("model_id", F.col("target").alias("key_norm"))
        .distinct()
    )


def sibling_targets(levels: DataFrame, kept: DataFrame) -> DataFrame:
    """All level keys of hierarchies with at least one kept level.

    One flag per hierarchy is aggregated and joined back; level pairs are never formed.  Levels dealt as their
    keys are have whole hierarchies in one place.
    """
    if PLACE in kept.columns:
        keyed = dealt_levels(levels)
        hierarchy = ["model_id", PLACE, "table_name", "hierarchy"]
        alive = keyed.join(kept, key_columns(kept), "left_semi").select(*hierarchy).distinct()
        return keyed.join(alive, hierarchy, "left_semi").select(*key_columns(kept)).distinct()
    keyed = levels.select("model_id", "table_name", "hierarchy", norm_pair("table_name", "column_name").alias("key_norm"))
    alive = keyed.join(kept, ["model_id", "key_norm"], "left_semi").select("model_id", "table_name", "hierarchy").distinct()
    return keyed.join(alive, ["model_id", "table_name", "hierarchy"], "left_semi").select("model_id", "key_norm").distinct()


def dealt_levels(levels: DataFrame) -> DataFrame:
    """Levels with their keys, dealt by the keys' places.  A level without a table or column names no key."""
    key = norm_pair("table_name", "column_name")
    rows = levels.filter(F.col("table_name").isNotNull() & F.col("column_name").isNotNull())
    return (
        rows.select("model_id", "table_name", "hierarchy", "column_name").repartition("model_id", key_place(key))
        .withColumn("key_norm", key).withColumn(PLACE, key_place("key_norm")).drop("column_name")
    )


def formula_owners(decisions: DataFrame) -> DataFrame:
    return decisions.filter((F.col("remove_column") == "No") & F.col("kind").isin("calculated", "measure")).select(*key_columns(decisions))


def protect_links(decisions: DataFrame, links: DataFrame) -> DataFrame:
    decisions = written(decisions)
    return mark_protected(decisions, link_targets(links, kept_keys(decisions)), "SemanticLink")


def protect_dax(decisions: DataFrame, owner_refs: DataFrame) -> DataFrame:
    decisions = written(decisions)
    return mark_protected(decisions, formula_targets(owner_refs, formula_owners(decisions)), "DAXReference")


def protect_siblings(decisions: DataFrame, levels: DataFrame) -> DataFrame:
    decisions = written(decisions)
    return mark_protected(decisions, sibling_targets(levels, kept_keys(decisions)), "HierarchyLevel")


def protect_structure(
    decisions: DataFrame,
    links: DataFrame | None = None,
    owner_refs: DataFrame | None = None,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Links, then formulas, then sibling levels, each once and in that order.

    The steps exchange keys only: each adds the keys it saves to those kept before.  Full rows are
    written once and get their reasons in one join at the end; dealt rows take each step's reasons where they lie.
    """
    rows = written(decisions)
    key = key_columns(rows)
    steps = [
        (relation, reason, targets) for relation, reason, targets in (
            (links, "SemanticLink", lambda found, alive: link_targets(found, alive)),
            (owner_refs, "DAXReference", lambda found, alive: formula_targets(found, alive.filter(F.col("kind").isin("calculated", "measure")))),
            (levels, "HierarchyLevel", lambda found, alive: sibling_targets(found, alive)),
        ) if relation is not None
    ]
    if PLACE in key:
        for relation, reason, targets in steps:
            alive = rows.filter(F.col("remove_column") == "No").select(*key, "kind")
            saved = written(_among(removal_keys(rows).distinct(), targets(relation, alive)))
            rows = give_reasons(rows, saved.withColumn("_reason", F.lit(reason)))
        return rows
    keys = rows.select(*key, "kind", "remove_column")
    kept = keys.filter(F.col("remove_column") == "No").drop("remove_column")
    removed = keys.filter(F.col("remove_column") == "Yes").drop("remove_column").distinct()
    marks = None
    for relation, reason, targets in steps:
        saved = written(_among(removed, targets(relation, kept)))
        removed, kept = removed.join(saved, key, "left_anti"), kept.unionByName(saved)
        reasons = saved.select(*key, F.lit(reason).alias("_reason")).distinct()
        marks = reasons if marks is None else marks.unionByName(reasons)
    if marks is None:
        return rows
    return give_reasons(rows, marks)


def _among(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys that are targets."""
    return keys.join(targets if PLACE in targets.columns else placed(targets, keys), key_columns(keys), "left_semi")


def dependency_edges(
    links: DataFrame | None = None,
    owner_refs: DataFrame | None = None,
    levels: DataFrame | None = None,
    variations: DataFrame | None = None,
    sort_by: DataFrame | None = None,
) -> DataFrame:
    """All "keeping src needs dst" edges over key nodes.

    A hierarchy is a node of its own, so a hierarchy of n levels gives 2n edges, not n*n.
    """
    hierarchy = F.concat(F.lit("\u0001hierarchy "), norm_pair("table_name", "hierarchy"))
    parts = []
    if links is not None:
        parts.append(links.select("model_id", norm_pair("table_name", "column_name").alias("src"), norm_pair("target_table", "target_column").alias("dst")))
    if owner_refs is not None:
        parts.append(owner_refs.select("model_id", norm_pair("table_name", "name").alias("src"), norm_pair("ref_table", "ref_column").alias("dst")))
    if levels is not None:
        level = norm_pair("table_name", "column_name")
        parts.append(
            levels.select("model_id", F.explode(F.array(
                F.struct(level.alias("src"), hierarchy.alias("dst")), F.struct(hierarchy.alias("src"), level.alias("dst"))
            )).alias("e")).select("model_id", "e.src", "e.dst")
        )
    if variations is not None:
        target = F.concat(F.lit("\u0001hierarchy "), norm_pair("hier_table", "hierarchy"))
        parts.append(variations.select("model_id", norm_pair("table_name", "column_name").alias("src"), target.alias("dst")))
    if sort_by is not None:
        parts.append(sort_by.select("model_id", norm_pair("table_name", "column_name").alias("src"), norm_pair("table_name", "sort_column").alias("dst")))
    if not parts:
        raise ValueError("no dependency relation was given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def protect_fixpoint(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep everything a kept column needs, directly or not."""
    start = kept_keys(decisions).select("model_id", F.col("key_norm").alias("node"))
    alive = reachable_from(start, edges).select("model_id", F.col("node").alias("key_norm"))
    return mark_protected(decisions, alive, "Dependency")


def variation_targets(variations: DataFrame, levels: DataFrame, removed: DataFrame) -> DataFrame:
    """Level keys of hierarchies opened by variations on columns that are not removed."""
    alive = (
        placed(variations.withColumn("key_norm", norm_pair("table_name", "column_name")), removed)
        .join(removed, key_columns(removed), "left_anti")
        .select("model_id", norm_pair("hier_table", "hierarchy").alias("hier_norm"))
        .distinct()
    )
    return (
        levels.select("model_id", norm_pair("table_name", "hierarchy").alias("hier_norm"), norm_pair("table_name", "column_name").alias("key_norm"))
        .join(alive, ["model_id", "hier_norm"], "left_semi")
        .select("model_id", "key_norm")
        .distinct()
    )


def sort_targets(sort_by: DataFrame, removed: DataFrame, protected: DataFrame) -> DataFrame:
    """Sort columns of columns that stay: not removed, or protected after all."""
    key = key_columns(removed)
    gone = removed.join(placed(protected, removed), key, "left_anti")
    return (
        placed(sort_by.withColumn("key_norm", norm_pair("table_name", "column_name")), removed)
        .join(gone, key, "left_anti")
        .select("model_id", norm_pair("table_name", "sort_column").alias("key_norm"))
        .distinct()
    )


def table_decisions(decisions: DataFrame, security: DataFrame | None = None) -> DataFrame:
    """Per table: columns, columns to remove, remove the whole table or not."""
    gone = F.col("remove_column") == "Yes"
    out = decisions.groupBy("model_id", "table_name").agg(
        F.count("*").alias("total_columns"), F.count_if(gone).alias("columns_to_remove"),
        F.bool_and(gone).alias("_all"),
    )
    if security is not None:
        marks = security.select("model_id", "table_norm").distinct().withColumn("_sec", F.lit(True))
        out = out.withColumn("table_norm", normalize_key("table_name")).join(marks, ["model_id", "table_norm"], "left")
        out = out.withColumn("_all", F.col("_all") & F.col("_sec").isNull()).drop("_sec", "table_norm")
    return out.select(
        "model_id", "table_name", "total_columns", "columns_to_remove",
        F.when(F.col("_all"), "Yes").otherwise("No").alias("remove_table"),
    )


def kept_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(F.col("remove_table") == "No").select("model_id", "table_name")


def _table_name(schema: str, table: Column) -> Column:
    return F.concat(sql_identifier(F.lit(schema)), F.lit("."), sql_identifier(table))


def drop_tables(tables: DataFrame, schema: str = "dbo") -> DataFrame:
    sql = F.concat(F.lit("DROP TABLE "), _table_name(schema, F.col("table_name")), F.lit(";"))
    return tables.filter(F.col("remove_table") == "Yes").select("model_id", "table_name", sql.alias("drop_sql"))


def _removals_in(decisions: DataFrame, tables: DataFrame | None) -> DataFrame:
    gone = decisions.filter(F.col("remove_column") == "Yes")
    return gone if tables is None else gone.join(kept_tables(tables), ["model_id", "table_name"], "left_semi")


def drop_columns(decisions: DataFrame, tables: DataFrame | None = None, schema: str = "dbo") -> DataFrame:
    """Imported columns to drop from kept tables, under their database name."""
    sql = F.concat(
        F.lit("ALTER TABLE "), _table_name(schema, F.col("table_name")), F.lit(" DROP COLUMN "),
        sql_identifier(F.trim("source_column")), F.lit(";"),
    )
    return _removals_in(decisions, tables).filter(F.col("kind") == "imported").select(
        "model_id", "table_name", "column_name", sql.alias("drop_sql")
    )


def model_cleanup(decisions: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Unused measures and calculated columns of kept tables, with their file."""
    return _removals_in(decisions, tables).filter(F.col("kind") != "imported").select(
        "model_id", "table_name", "column_name",
        F.when(F.col("kind") == "measure", "Measure").otherwise("Calculated Column").alias("type"),
        F.concat(F.trim("table_name"), F.lit(".tmdl")).alias("file"),
    )


def drop_conflicts(
    dropped: DataFrame, decisions: DataFrame, variations: DataFrame, levels: DataFrame, sort_by: DataFrame
) -> DataFrame:
    """DROP COLUMN rows whose column the cleanup would refuse to remove."""
    removed = removal_keys(decisions)
    by_variation = variation_targets(variations, levels, removed)
    by_sort = sort_targets(sort_by, removed, by_variation)
    why = by_variation.withColumn("reason", F.lit("variation")).unionByName(by_sort.withColumn("reason", F.lit("sort by")))
    why = why.groupBy("model_id", "key_norm").agg(F.max("reason").alias("reason"))
    return (
        dropped.withColumn("key_norm", norm_pair("table_name", "column_name"))
        .join(why, ["model_id", "key_norm"])
        .select("model_id", "table_name", "column_name", "drop_sql", "reason")
    )


def run_summary(drop_t: DataFrame, drop_c: DataFrame, cleanup: DataFrame) -> DataFrame:
    """Per model: tables, database columns and model items flagged."""
    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("model_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name))

    rows = tally(drop_t, "tables").unionByName(tally(drop_c, "columns")).unionByName(tally(cleanup, "items"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0))

    return rows.groupBy("model_id").agg(
        total("tables").alias("tables_to_drop"), total("columns").alias("columns_to_drop"),
        total("items").alias("model_items"),
    )
