"""Report JSON -> field usage.

Documents are read with one typed schema, so only the named branches are decoded.  Role names
are data and arrive as a map.  Everything up to measure expansion is narrow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import DECORATIVE_TYPES, aggregation_name, usage_label, visual_type_name
from ..functions.text import normalize_key, strip
from .rank import number_within
from .textparse import column_lookup

_REF = "Expression:struct<SourceRef:struct<Entity:string,Source:string>>"
_COLUMN = f"struct<{_REF},Property:string>"
FIELD_TYPE = (
    f"Column:{_COLUMN},Measure:{_COLUMN},"
    f"Aggregation:struct<Expression:struct<Column:{_COLUMN}>,Function:int>,"
    "HierarchyLevel:struct<Level:string,Expression:struct<Hierarchy:struct<Hierarchy:string,"
    f"Expression:struct<SourceRef:struct<Entity:string,Source:string>,PropertyVariationSource:{_COLUMN}>>>>"
)
FIELD = f"struct<{FIELD_TYPE}>"
FILTERS = f"filterConfig struct<filters:array<struct<field:{FIELD}>>>"
VISUAL_SCHEMA = (
    "visual struct<visualType:string,query:struct<queryState:map<string,struct<projections:"
    f"array<struct<field:{FIELD},queryRef:string,displayName:string>>>>>,"
    "visualContainerObjects:struct<title:array<struct<properties:struct<text:struct<expr:struct<"
    f"Literal:struct<Value:string>>>>>>>>, {FILTERS}"
)
PAGE_SCHEMA = f"name string, displayName string, {FILTERS}"

ROW = [
    "model_id", "report_id", "page_name", "visual_label", "visual_type", "ui_field", "usage_label",
    "formula", "table_name", "column_name",
]


def entity_of(node: Column) -> Column:
    """Table named by a field node, '' when there is none."""
    return F.coalesce(node["Expression"]["SourceRef"]["Entity"], F.lit(""))


def decode_field(field: Column, entity: Callable[[Column], Column] = entity_of) -> Column:
    """struct<entity, property, field_type> of a field; null for other shapes.

    Column, Measure, Aggregation and HierarchyLevel are tried in that order; a present branch
    decides even when what it holds is incomplete.
    """
    def row(table: Column, prop: Column, kind: Column | str) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            table.alias("entity"), F.coalesce(prop, F.lit("")).alias("property"), kind.alias("field_type")
        )

    column, measure = field["Column"], field["Measure"]
    agg, level = field["Aggregation"], field["HierarchyLevel"]
    agg_column = agg["Expression"]["Column"]
    hier = level["Expression"]["Hierarchy"]
    source = hier["Expression"]["PropertyVariationSource"]
    hier_table = entity(hier)
    level_name = F.coalesce(F.nullif(level["Level"], F.lit("")), hier["Hierarchy"], F.lit(""))
    from_source = (hier_table == "") & source.isNotNull()
    return (
        F.when(column.isNotNull(), row(entity(column), column["Property"], "Column"))
        .when(measure.isNotNull(), row(entity(measure), measure["Property"], "Measure"))
        .when(
            agg.isNotNull(),
            F.when(
                agg_column.isNotNull(),
                row(entity(agg_column), agg_column["Property"],
                    F.concat(F.lit("Aggregation ("), aggregation_name(agg["Function"]), F.lit(")"))),
            ),
        )
        .when(
            hier.isNotNull(),
            row(
                F.when(from_source, entity(source)).otherwise(hier_table),
                F.when(from_source, F.coalesce(source["Property"], level_name)).otherwise(level_name),
                "HierarchyLevel",
            ),
        )
    )


def page_documents(pages: DataFrame) -> DataFrame:
    """(model_id, report_id, page_id, content) -> page name and filters."""
    return pages.withColumn("doc", F.from_json("content", PAGE_SCHEMA)).select(
        "model_id", "report_id", "page_id",
        F.coalesce("doc.displayName", "page_id").alias("page_name"),
        F.col("doc.filterConfig.filters").alias("filters"),
    )


def visual_documents(visuals: DataFrame) -> DataFrame:
    """(model_id, report_id, page_id, visual_id, content) -> type, title, roles and filters."""
    titles = F.filter(
        F.transform(
            F.col("doc.visual.visualContainerObjects.title"),
            lambda t: F.trim(t["properties"]["text"]["expr"]["Literal"]["Value"], F.lit("'")),
        ),
        lambda v: v.isNotNull() & (v != ""),
    )
    return visuals.withColumn("doc", F.from_json("content", VISUAL_SCHEMA)).select(
        "model_id", "report_id", "page_id", "visual_id",
        F.coalesce("doc.visual.visualType", F.lit("unknown")).alias("visual_type"),
        F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("title"),
        F.col("doc.visual.query.queryState").alias("roles"),
        F.col("doc.filterConfig.filters").alias("filters"),
    )


def page_visuals(pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """Visuals with their page name; visuals of folders without a page file are left out."""
    names = pages.select("model_id", "report_id", "page_id", "page_name")
    return visuals.join(names, ["model_id", "report_id", "page_id"])


def visual_labels(visuals: DataFrame) -> DataFrame:
    """Data visuals with a label: the title, else the type name numbered per page and type.

    Only the keys of untitled visuals are numbered; the documents stay where they are until the numbers are joined.
    """
    page, key = ["model_id", "report_id", "page_id"], ["model_id", "report_id", "page_id", "visual_id"]
    data = visuals.filter(~F.col("visual_type").isin(DECORATIVE_TYPES))
    keys = data.filter("title = ''").select(*key, "visual_type").distinct()
    numbers = number_within(keys, [*page, "visual_type"], ["visual_id"], "_n").select(*key, "visual_type", "_n")
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*key, "visual_type"]]
    numbered = data.alias("v").join(numbers.alias("n"), same, "left").select("v.*", "n._n")
    name = visual_type_name(F.col("visual_type"))
    counted = F.when(F.col("_n") == 1, name).otherwise(F.concat(name, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return numbered.withColumn("visual_label", F.when(F.col("title") != "", F.col("title")).otherwise(counted)).drop("_n")


def visual_fields(labelled: DataFrame) -> DataFrame:
    """One row per decoded projection of a visual, with its role and usage label."""
    # Outer generators get no inferred size filter, which would parse the document again.
    role = F.explode_outer(F.col("roles")).alias("role", "state")
    return (
        labelled.select("model_id", "report_id", "page_id", "page_name", "visual_id", "visual_type", "visual_label", role)
        .select("*", F.posexplode_outer("state.projections").alias("pos", "p"))
        .filter(F.col("p").isNotNull())
        .withColumn("f", decode_field(F.col("p.field")))
        .filter(F.col("f").isNotNull())
        .select(
            "model_id", "report_id", "page_id", "page_name", "visual_id", "visual_type", "visual_label", "role", "pos",
            F.col("f.entity").alias("table_name"), F.col("f.property").alias("column_name"),
            F.col("f.field_type").alias("field_type"),
            F.coalesce(F.nullif("p.displayName", F.lit("")), "f.property").alias("ui_field"),
            usage_label(F.col("visual_type"), F.col("role"), F.col("f.field_type") == "Measure").alias("usage_label"),
        )
    )


def filter_fields(docs: DataFrame, label: str) -> DataFrame:
    """Decoded filters of a document relation; measures get a tagged label."""
    keep = [c for c in docs.columns if c != "filters"]
    return (
        docs.select(*keep, F.explode_outer("filters").alias("flt"))
        .filter(F.col("flt").isNotNull())
        .withColumn("f", decode_field(F.col("flt.field")))
        .filter(F.col("f").isNotNull())
        .select(
            *keep, F.col("f.entity").alias("table_name"), F.col("f.property").alias("column_name"),
            F.col("f.field_type").alias("field_type"), F.col("f.property").alias("ui_field"),
            F.when(F.col("f.field_type") == "Measure", f"{label} (Measure)").otherwise(label).alias("usage_label"),
        )
    )


def page_filters(pages: DataFrame) -> DataFrame:
    return filter_fields(pages, "Page Filter").withColumns(
        {"visual_label": F.lit("Page Filters"), "visual_type": F.lit("pageFilter")}
    )


def report_filters(reports: DataFrame) -> DataFrame:
    """(model_id, report_id, content) -> report-level filters, valid on all pages."""
    docs = reports.withColumn("doc", F.from_json("content", FILTERS)).select(
        "model_id", "report_id", F.lit("(All Pages)").alias("page_name"), F.col("doc.filterConfig.filters").alias("filters")
    )
    return filter_fields(docs, "Report Filter").withColumns(
        {"visual_label": F.lit("Report Filters"), "visual_type": F.lit("reportFilter")}
    )


def expand_measures(rows: DataFrame, formulas: DataFrame, closure: DataFrame) -> DataFrame:
    """Give measure uses their formula and one row per dependency.

    Measures without formula, and all other fields, stay one row.  The join reads a private
    measure key, so rows that are no measures neither match nor gather on one null key.
    """
    known = formulas.filter(F.col("formula") != "").select("model_id", "table_name", "measure", "formula")
    deps = known.join(closure, ["model_id", "table_name", "measure"], "left").select(
        "model_id", "table_name", F.col("measure").alias("_measure"), F.col("formula"),
        F.coalesce("dep_table", "table_name").alias("dep_table"), F.coalesce("dep_column", "measure").alias("dep_column"),
    )
    private = F.when(F.col("field_type") == "Measure", F.col("column_name")).otherwise(
        F.concat(F.lit("\u0001"), "column_name")
    )
    return (
        rows.withColumn("_measure", private)
        .join(deps, ["model_id", "table_name", "_measure"], "left")
        .withColumn("formula", F.coalesce("formula", F.lit("")))
        .withColumn("table_name", F.coalesce("dep_table", "table_name"))
        .withColumn("column_name", F.coalesce("dep_column", "column_name"))
        .drop("_measure", "dep_table", "dep_column")
    )


def visual_filters(labelled: DataFrame, expanded_fields: DataFrame) -> DataFrame:
    """Visual-level filters except fields the same visual already shows."""
    keys = ["model_id", "report_id", "page_id", "visual_id", "table_name", "column_name"]
    docs = labelled.select(
        "model_id", "report_id", "page_id", "page_name", "visual_id", "visual_type", "visual_label", "filters"
    )
    return filter_fields(docs, "Filter").join(expanded_fields.select(*keys).distinct(), keys, "left_anti")


def validate_refs(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Check (table_name, column_name) against the catalog; adds ``status``.

    valid: known pair; remapped: the name exists elsewhere, first table by path; dropped:
    unknown name (row kept with its status so that callers can audit it); unchecked: an empty
    side.  Distinct references are resolved first, so a field used in many rows is looked up
    once.
    """
    # A reference with an empty side finds no partner and passes as unchecked.
    ref = [
        normalize_key(F.col("table_name")).alias("_t"), normalize_key(F.col("column_name")).alias("_n"),
    ]
    keyed = rows.withColumns({"_t": ref[0], "_n": ref[1]})
    pairs = columns.select("model_id", normalize_key("table_name").alias("_t"), normalize_key("column_name").alias("_n")).distinct()
    first = column_lookup(columns).select("model_id", F.col("name_norm").alias("_n"), "first_table")
    status = (
        F.when((F.col("_t") == "") | (F.col("_n") == ""), "unchecked")
        .when(F.col("_known"), "valid")
        .when(F.col("first_table").isNotNull(), "remapped")
        .otherwise("dropped")
    )
    resolved = (
        keyed.select("model_id", "_t", "_n").distinct()
        .join(pairs.withColumn("_known", F.lit(True)), ["model_id", "_t", "_n"], "left")
        .join(first, ["model_id", "_n"], "left")
        .select("model_id", "_t", "_n", status.alias("status"), "first_table")
    )
    return (
        keyed.join(resolved, ["model_id", "_t", "_n"])
        .withColumn("table_name", F.when(F.col("status") == "remapped", F.col("first_table")).otherwise(F.col("table_name")))
        .drop("_t", "_n", "first_table")
    )


def field_usage(parts: list[DataFrame]) -> DataFrame:
    """Union of all usage rows, in the shared ten-column form (long: one reference per row)."""
    out = None
    for part in parts:
        rows = part.select(*ROW, "field_type")
        out = rows if out is None else out.unionByName(rows)
    return out


def grouped_dependencies(closure: DataFrame) -> DataFrame:
    """Presentation: dependencies of a measure per table, one row each with its position: the measure itself, then by name."""
    group = ["model_id", "table_name", "measure", "dep_table"]
    other = (F.col("dep_table") != F.col("table_name")) | (F.col("dep_column") != F.col("measure"))
    rows = closure.select(*group, "dep_column", other.alias("_other")).distinct()
    return number_within(rows, group, ["_other", "dep_column"], "position").drop("_other")


def usage_summary(usage: DataFrame) -> DataFrame:
    """Per model: rows, pages and labelled visuals."""
    return usage.groupBy("model_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("page_name").alias("n_pages"),
        F.countDistinct("visual_label").alias("n_visuals"),
    )
