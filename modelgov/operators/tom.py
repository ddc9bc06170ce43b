"""Exported object-model tables -> the relations the rest of the engine reads.

Inputs are one DataFrame per metadata table, keyed by model_id.  Older exports lack columns;
those come in as typed nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import data_type_name, summarize_by_name
from ..functions.text import safe_bool, safe_int, safe_str
from ..sources.relations import with_typed_nulls

# Annotation object codes.
OBJECT_TYPES = {3: "table", 4: "column", 9: "measure", 10: "hierarchy"}


def tom_tables(tables: DataFrame) -> DataFrame:
    """User tables with flags; date templates are private by name."""
    has_flags = "SystemFlags" in tables.columns
    t = with_typed_nulls(tables, IsHidden="int", ShowAsVariationsOnly="int", LineageTag="string")
    if has_flags:
        t = t.filter(F.col("SystemFlags").isin(0, 2))
    return t.select(
        "model_id", F.col("ID").alias("table_id"), F.col("Name").alias("table_name"),
        safe_bool("IsHidden").alias("is_hidden"), F.col("Name").contains("DateTableTemplate").alias("is_private"),
        safe_bool("ShowAsVariationsOnly").alias("variations_only"), safe_str("LineageTag").alias("lineage_tag"),
    )


def _typed_columns(columns: DataFrame) -> DataFrame:
    return with_typed_nulls(
        columns, ExplicitName="string", InferredName="string", IsNameInferred="int", SourceColumn="string",
        Expression="string", FormatString="string", IsHidden="int", SummarizeBy="int", DataCategory="string",
        LineageTag="string", SortByColumnID="bigint", ExplicitDataType="int",
    )


def column_display_name(c: Column | None = None) -> Column:
    """Inferred name when flagged, else the explicit name, else the inferred one."""
    explicit = F.nullif(safe_str("ExplicitName"), F.lit(""))
    inferred = F.nullif(safe_str("InferredName"), F.lit(""))
    return F.when(safe_bool("IsNameInferred"), F.coalesce(inferred, explicit)).otherwise(F.coalesce(explicit, inferred))


def tom_columns(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of user tables without row-number columns and nameless artefacts."""
    c = _typed_columns(columns)
    # A name that sorts another column may belong to any table, so it is taken before filtering.
    sort_names = c.select("model_id", F.col("ID").alias("SortByColumnID"), F.col("ExplicitName").alias("sort_by"))
    kind_code = safe_int("Type", 1)
    name = column_display_name()
    source = (
        F.when(kind_code == 1, F.coalesce(F.nullif(safe_str("SourceColumn"), F.lit("")), F.col("column_name")))
        .when(kind_code == 4, F.concat(F.lit("["), F.col("column_name"), F.lit("]")))
        .otherwise("")
    )
    # Columns without a sort column stay out of the self join: no pile of null keys.
    user = tables.select("model_id", F.col("table_id").alias("TableID"))
    kept = (
        c.filter((F.col("Type") != 3))
        .join(user, ["model_id", "TableID"], "left_semi")
        .withColumn("column_name", name)
        .filter(F.col("column_name").isNotNull())
    )
    sorted_rows = kept.filter(F.col("SortByColumnID").isNotNull()).join(sort_names, ["model_id", "SortByColumnID"], "left")
    plain = kept.filter(F.col("SortByColumnID").isNull()).withColumn("sort_by", F.lit(None).cast("string"))
    return sorted_rows.unionByName(plain).select(
        "model_id", F.col("TableID").alias("table_id"), F.col("ID").alias("column_id"), "column_name",
        kind_code.alias("type_code"), source.alias("source_column"),
        F.when(kind_code.isin(1, 4), data_type_name(F.col("ExplicitDataType"))).alias("data_type"),
        safe_bool("IsHidden").alias("is_hidden"), safe_str("FormatString").alias("format_string"),
        safe_str("LineageTag").alias("lineage_tag"), safe_str("DataCategory").alias("data_category"),
        summarize_by_name(F.col("SummarizeBy")).alias("summarize_by"), safe_bool("IsNameInferred").alias("name_inferred"),
        safe_str("Expression").alias("expression"), safe_str("sort_by").alias("sort_by"),
    )


def tom_measures(measures: DataFrame, tables: DataFrame) -> DataFrame:
    m = with_typed_nulls(measures, FormatString="string", IsHidden="int", DisplayFolder="string", Description="string", LineageTag="string")
    user = tables.select("model_id", F.col("table_id").alias("TableID"))
    return m.join(user, ["model_id", "TableID"], "left_semi").select(
        "model_id", F.col("TableID").alias("table_id"), F.col("ID").alias("measure_id"), F.col("Name").alias("measure"),
        safe_str("Expression").alias("expression"), safe_str("FormatString").alias("format_string"),
        safe_bool("IsHidden").alias("is_hidden"), safe_str("DisplayFolder").alias("display_folder"),
        safe_str("LineageTag").alias("lineage_tag"),
    )


def tom_hierarchies(hierarchies: DataFrame, levels: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Hierarchy rows, one per level; a hierarchy without levels keeps one row."""
    h = with_typed_nulls(hierarchies, IsHidden="int", LineageTag="string")
    lv = with_typed_nulls(levels, LineageTag="string")
    user = tables.select("model_id", F.col("table_id").alias("TableID"))
    names = columns.select("model_id", F.col("ID").alias("ColumnID"), F.col("ExplicitName").alias("column_name"))
    return (
        h.join(user, ["model_id", "TableID"], "left_semi")
        .select("model_id", F.col("TableID").alias("table_id"), F.col("ID").alias("HierarchyID"), F.col("Name").alias("hierarchy"),
                safe_str("LineageTag").alias("hierarchy_tag"))
        .join(lv.select("model_id", "HierarchyID", F.col("Ordinal").alias("ordinal"), F.col("Name").alias("level"), "ColumnID", safe_str("LineageTag").alias("level_tag")),
              ["model_id", "HierarchyID"], "left")
        .join(names, ["model_id", "ColumnID"], "left")
        .select("model_id", "table_id", F.col("HierarchyID").alias("hierarchy_id"), "hierarchy", "hierarchy_tag", "ordinal", "level", "level_tag", "column_name")
    )


def tom_variations(
    variations: DataFrame, columns: DataFrame, relationships: DataFrame, hierarchies: DataFrame, tables: DataFrame
) -> DataFrame:
    """Variation with owner column, relationship and default hierarchy by name.

    ``tables`` are the raw tables: a default hierarchy may sit in any of them.
    """
    c = columns.select("model_id", F.col("ID").alias("ColumnID"), "TableID", F.col("ExplicitName").alias("owner_column"))
    r = with_typed_nulls(relationships, Name="string").select("model_id", F.col("ID").alias("RelationshipID"), F.col("Name").alias("relationship"))
    h = hierarchies.select("model_id", F.col("ID").alias("DefaultHierarchyID"), F.col("Name").alias("hierarchy"), F.col("TableID").alias("hier_table_id"))
    t = tables.select("model_id", F.col("ID").alias("hier_table_id"), F.col("Name").alias("hier_table"))
    v = with_typed_nulls(variations, IsDefault="int")
    return (
        v.select("model_id", F.col("ID").alias("variation_id"), "ColumnID", F.col("Name").alias("variation"), safe_bool("IsDefault").alias("is_default"), "RelationshipID", "DefaultHierarchyID")
        .join(c, ["model_id", "ColumnID"])
        .join(r, ["model_id", "RelationshipID"], "left")
        .join(h, ["model_id", "DefaultHierarchyID"], "left")
        .join(t, ["model_id", "hier_table_id"], "left")
        .select("model_id", "variation_id", F.col("TableID").alias("table_id"), F.col("ColumnID").alias("column_id"), "owner_column", "variation", "is_default", "relationship", "hierarchy", "hier_table")
    )


def tom_relations(relationships: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationships by name; codes become their text form (missing codes are defaults)."""
    rel = with_typed_nulls(relationships, Name="string", JoinOnDateBehavior="int", CrossFilteringBehavior="int", IsActive="int")
    t = tables.select("model_id", "ID", "Name")
    c = with_typed_nulls(columns, InferredName="string").select("model_id", "ID", F.coalesce("ExplicitName", "InferredName").alias("name"))
    out = rel
    for side, fk in (("from", "From"), ("to", "To")):
        out = out.join(t.select("model_id", F.col("ID").alias(f"{fk}TableID"), F.col("Name").alias(f"{side}_table")), ["model_id", f"{fk}TableID"], "left")
        out = out.join(c.select("model_id", F.col("ID").alias(f"{fk}ColumnID"), F.col("name").alias(f"{side}_column")), ["model_id", f"{fk}ColumnID"], "left")
    return out.select(
        "model_id", F.col("ID").alias("relationship_id"),
        F.coalesce(F.nullif(safe_str("Name"), F.lit("")), F.col("ID").cast("string")).alias("relationship"),
        "from_table", "from_column", "to_table", "to_column",
        (F.col("IsActive").isNull() | safe_bool("IsActive")).alias("is_active"),
        F.when(safe_int("CrossFilteringBehavior") == 2, "bothDirections").otherwise("oneDirection").alias("cross_filter"),
        F.coalesce(safe_int("JoinOnDateBehavior") == 2, F.lit(False)).alias("date_part_only"),
    )


def tom_partitions(partitions: DataFrame, tables: DataFrame) -> DataFrame:
    """Calculated (2) and query (4) partitions of user tables."""
    p = with_typed_nulls(partitions, Name="string", Mode="int", QueryDefinition="string")
    user = tables.select("model_id", F.col("table_id").alias("TableID"))
    named = F.coalesce(F.nullif(safe_str("Name"), F.lit("")), F.sha1(F.concat_ws("|", "model_id", "TableID", "ID")))
    return p.filter(F.col("Type").isin(2, 4)).join(user, ["model_id", "TableID"], "left_semi").select(
        "model_id", F.col("TableID").alias("table_id"), F.col("ID").alias("partition_id"), named.alias("partition"),
        F.when(F.col("Type") == 2, "calculated").otherwise("m").alias("kind"),
        F.when(safe_int("Mode", 0) == 1, "directQuery").otherwise("import").alias("mode"),
        safe_str("QueryDefinition").alias("source"),
    )


def tom_roles(permissions: DataFrame, roles: DataFrame, tables: DataFrame) -> DataFrame:
    r = with_typed_nulls(roles, Description="string")
    return (
        permissions.join(r.select("model_id", F.col("ID").alias("RoleID"), F.col("Name").alias("role"), safe_str("Description").alias("description")), ["model_id", "RoleID"])
        .join(tables.select("model_id", F.col("ID").alias("TableID"), F.col("Name").alias("table_name")), ["model_id", "TableID"])
        .select("model_id", "role", "description", "table_name", safe_str("FilterExpression").alias("filter_expression"))
    )


def tom_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with their object kind; other kinds keep a null kind."""
    from ..functions.labels import lookup

    code, oid = safe_int("ObjectType"), F.col("ObjectID").try_cast("bigint")
    return annotations.select(
        "model_id", lookup(OBJECT_TYPES, code).alias("object_kind"), code.alias("object_type"), oid.alias("object_id"),
        safe_str("Name").alias("name"), safe_str("Value").alias("value"),
    ).filter(F.col("object_type").isNotNull() & F.col("object_id").isNotNull())


def annotation_lists(annotations: DataFrame) -> DataFrame:
    """Name and value of every annotation of every kind of object, equal ones kept, with its position by name and value."""
    from .rank import number_within

    rows = annotations.select("model_id", "object_kind", "object_type", "object_id", "name", "value")
    return number_within(rows, ["model_id", "object_type", "object_id"], ["name", "value"], "position")
