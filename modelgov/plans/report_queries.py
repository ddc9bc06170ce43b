"""Queries over report documents and field usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators import report as rp
from ..operators import textparse as tp
from ..session import materialise
from . import catalog_queries as cq
from .registry import query
from .text_queries import BASE_FORMULA, K, TOTAL_FORMULA

VTYPE = ("CASE priority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'pivotTable' WHEN '3-MEDIUM' THEN 'slicer' "
         "WHEN '4-NOT SPECIFIED' THEN 'customTreeMap' ELSE 'textbox' END")
TYPE_NAME = "CASE priority WHEN '1-URGENT' THEN 'Card' WHEN '2-HIGH' THEN 'Matrix' WHEN '3-MEDIUM' THEN 'Slicer' ELSE 'Custom Tree Map' END"
PAGE = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'P' || CAST(c_custkey AS STRING) ELSE c_name END"

# Visuals with page and label; decorative ones are marked by a null label.
VISUALS = f"""
    SELECT v.*, v.model_id AS report_id, 'P' || CAST(v.model_id AS STRING) AS page_id, 'V' || {K} AS visual_id, {PAGE} AS page_name,
        {VTYPE} AS visual_type, CASE WHEN status = 'F' THEN 'Sales ' || {K} ELSE '' END AS title,
        CASE WHEN priority = '5-LOW' THEN NULL WHEN status = 'F' THEN 'Sales ' || {K}
            WHEN n = 1 THEN {TYPE_NAME} ELSE {TYPE_NAME} || ' (' || CAST(n AS STRING) || ')' END AS visual_label
    FROM (SELECT *, row_number() OVER (PARTITION BY model_id, priority, status = 'F' ORDER BY 'V' || {K}) AS n FROM lens_sources) v
    JOIN customer ON c_custkey = v.model_id"""
IDS = "model_id, report_id, page_id"
SHOWN = f"CASE WHEN status = 'O' THEN 'Shown ' || {K} ELSE 'Total ' || {K} END"
# role, pos, table, column, field type, field name shown
FIELDS = f"""
    SELECT v.*, f.role, f.pos,
        CASE f.no WHEN 5 THEN 'Wrong ' || {K} ELSE table_name END AS ref_table,
        CASE f.no WHEN 1 THEN 'Total ' || {K} WHEN 2 THEN 'Price' WHEN 3 THEN 'Sort Key' WHEN 4 THEN 'Price' WHEN 5 THEN 'SORT KEY' ELSE 'Missing ' || {K} END AS ref_column,
        f.field_type,
        CASE f.no WHEN 1 THEN {SHOWN} WHEN 2 THEN 'Price' WHEN 3 THEN 'Sort Key' WHEN 4 THEN 'Price' WHEN 5 THEN 'SORT KEY' ELSE 'Missing ' || {K} END AS ui_field,
        CASE f.role WHEN 'Values' THEN CASE WHEN visual_type = 'slicer' THEN 'Slicer' ELSE 'Visual Value' END WHEN 'Rows' THEN 'Visual Row'
            WHEN 'Category' THEN 'Visual Column' ELSE 'Visual Extra' END || CASE WHEN f.no = 1 THEN ', Filter (Measure)' ELSE '' END AS usage_label
    FROM ({VISUALS}) v CROSS JOIN (VALUES (1, 'Values', 0, 'Measure'), (2, 'Values', 1, 'Aggregation (Avg)'), (3, 'Rows', 0, 'HierarchyLevel'),
        (4, 'Rows', 1, 'HierarchyLevel'), (5, 'Category', 0, 'Column'), (6, 'Extra', 0, 'Column')) f(no, role, pos, field_type)"""


def pages(ctx):
    return rp.page_documents(ctx.lens("lens_page_files"))


def visuals(ctx):
    return rp.page_visuals(pages(ctx), rp.visual_documents(ctx.lens("lens_visual_files")))


def labelled(ctx):
    """Labelled visuals; documents are read once and written, for they are read again below."""
    return rp.visual_labels(materialise(visuals(ctx)))


@query("page_visuals", f"SELECT {IDS}, page_name, visual_id, visual_type, title FROM ({VISUALS}) v")
def _page_visuals(ctx):
    return visuals(ctx).select("model_id", "report_id", "page_id", "page_name", "visual_id", "visual_type", "title")


@query("visual_labels", f"SELECT {IDS}, page_name, visual_id, visual_type, visual_label FROM ({VISUALS}) v WHERE visual_label IS NOT NULL")
def _labels(ctx):
    return labelled(ctx).select("model_id", "report_id", "page_id", "page_name", "visual_id", "visual_type", "visual_label")


@query("field_decode", f"""
    SELECT model_id, visual_id, role, pos, ref_table AS entity, ref_column AS property, field_type FROM ({FIELDS}) f""")
def _decode(ctx):
    docs = rp.visual_documents(ctx.lens("lens_visual_files"))
    return (
        docs.select("model_id", "visual_id", F.explode_outer("roles").alias("role", "state"))
        .select("model_id", "visual_id", "role", F.posexplode_outer("state.projections").alias("pos", "p"))
        .filter(F.col("p").isNotNull())
        .select("model_id", "visual_id", "role", "pos", rp.decode_field(F.col("p.field")).alias("f"))
        .filter("f IS NOT NULL")
        .select("model_id", "visual_id", "role", "pos", "f.entity", "f.property", "f.field_type")
    )


FIELD_ROWS = f"""SELECT {IDS}, page_name, visual_id, visual_type, visual_label, role, pos, ref_table AS table_name, ref_column AS column_name,
    field_type, ui_field, usage_label FROM ({FIELDS}) f WHERE visual_label IS NOT NULL"""


@query("visual_fields", FIELD_ROWS)
def _fields(ctx):
    return rp.visual_fields(labelled(ctx))


@query("usage_labels", f"""
    SELECT visual_type, role, field_type = 'Measure' AS is_measure, usage_label, count(*) AS n FROM ({FIELD_ROWS}) f
    GROUP BY visual_type, role, field_type = 'Measure', usage_label""")
def _usage_labels(ctx):
    rows = rp.visual_fields(labelled(ctx)).withColumn("is_measure", F.col("field_type") == "Measure")
    return rows.groupBy("visual_type", "role", "is_measure", "usage_label").agg(F.count("*").alias("n"))


PAGES = f"""SELECT c_custkey AS model_id, c_custkey AS report_id, 'P' || CAST(c_custkey AS STRING) AS page_id, {PAGE} AS page_name,
    coalesce(hub_name, 'none') AS hub, CAST(coalesce(hub_id, -1) AS STRING) AS hub_key, c_mktsegment FROM customer LEFT JOIN lens_hubs h ON h.model_id = c_custkey"""
PAGE_FILTERS = f"""
    SELECT {IDS}, page_name, hub AS table_name, 'Price' AS column_name, 'Column' AS field_type, 'Price' AS ui_field, 'Page Filter' AS usage_label,
        'Page Filters' AS visual_label, 'pageFilter' AS visual_type FROM ({PAGES}) p
    UNION ALL SELECT {IDS}, page_name, hub, 'Base ' || hub_key, 'Measure', 'Base ' || hub_key, 'Page Filter (Measure)', 'Page Filters', 'pageFilter' FROM ({PAGES}) p"""
REPORT_FILTERS = f"""
    SELECT model_id, report_id, '(All Pages)' AS page_name, hub AS table_name, 'Sort Key' AS column_name, 'Column' AS field_type, 'Sort Key' AS ui_field,
        'Report Filter' AS usage_label, 'Report Filters' AS visual_label, 'reportFilter' AS visual_type FROM ({PAGES}) p
    UNION ALL SELECT model_id, report_id, '(All Pages)', c_mktsegment, 'Price', 'Aggregation (Func9)', 'Price', 'Report Filter', 'Report Filters', 'reportFilter' FROM ({PAGES}) p"""


@query("page_filters", PAGE_FILTERS)
def _page_filters(ctx):
    return rp.page_filters(pages(ctx))


@query("report_filters", REPORT_FILTERS)
def _report_filters(ctx):
    return rp.report_filters(ctx.lens("lens_report_files"))


def expanded_fields(ctx, closure):
    return rp.expand_measures(rp.visual_fields(labelled(ctx)), cq.formulas(ctx), closure)


# One row per dependency of a used measure; other fields stay as they are.
EXPANDED = f"""
    SELECT {IDS}, page_name, visual_id, visual_type, visual_label, field_type, ui_field, usage_label,
        CASE WHEN d.no = 4 THEN 'Facts' ELSE f.ref_table END AS table_name,
        CASE WHEN d.no = 2 THEN 'Price' WHEN d.no = 3 THEN 'Base ' || {K} WHEN d.no = 4 THEN 'Qty' ELSE f.ref_column END AS column_name,
        CASE WHEN field_type = 'Measure' THEN {TOTAL_FORMULA} ELSE '' END AS formula, table_name AS own_table, hub_name
    FROM ({FIELDS}) f JOIN (VALUES (1), (2), (3), (4)) d(no) ON field_type = 'Measure' OR d.no = 1 WHERE visual_label IS NOT NULL"""


@query("measure_usage", f"""
    SELECT model_id, visual_id, ui_field, usage_label, formula, table_name, column_name FROM ({EXPANDED}) x WHERE field_type = 'Measure'""")
def _measure_usage(ctx):
    rows = expanded_fields(ctx, cq.closure(ctx)).filter(F.col("field_type") == "Measure")
    return rows.select("model_id", "visual_id", "ui_field", "usage_label", "formula", "table_name", "column_name")


@query("measure_dependencies", f"""
    SELECT model_id, table_name, measure, dep_table, dep_column,
        row_number() OVER (PARTITION BY model_id, table_name, measure, dep_table ORDER BY dep_table <> table_name OR dep_column <> measure, dep_column) AS position
    FROM (SELECT DISTINCT model_id, table_name, measure, dep_table, dep_column FROM ({cq.CLOSURE}) c) d""")
def _dependencies(ctx):
    return rp.grouped_dependencies(cq.closure(ctx))


VISUAL_FILTERS = f"""
    SELECT {IDS}, page_name, visual_id, visual_type, visual_label, hub_name AS table_name, 'Sort Key' AS column_name, 'Column' AS field_type,
        'Sort Key' AS ui_field, 'Filter' AS usage_label FROM ({VISUALS}) v WHERE visual_label IS NOT NULL AND hub_name <> table_name"""


@query("visual_filters", VISUAL_FILTERS)
def _visual_filters(ctx):
    lab = materialise(labelled(ctx))
    return rp.visual_filters(lab, rp.expand_measures(rp.visual_fields(lab), cq.formulas(ctx), cq.closure(ctx)))


# References are checked against the catalog: Facts.Qty and Missing are unknown, Wrong.SORT KEY is
# found in the first table of the model, everything else is valid.
FIRST = "(SELECT model_id AS m, arg_min(table_name, 'tables/' || table_name || '.tmdl') AS first_table FROM lens_sources GROUP BY model_id) ft"


def checked(rows: str) -> str:
    return f"""
    SELECT x.* EXCLUDE (table_name), CASE WHEN table_name LIKE 'Wrong%' THEN first_table ELSE table_name END AS table_name,
        CASE WHEN table_name LIKE 'Wrong%' THEN 'remapped' WHEN table_name = 'Facts' OR column_name LIKE 'Missing%' THEN 'dropped' ELSE 'valid' END AS status
    FROM ({rows}) x JOIN {FIRST} ON ft.m = x.model_id"""


@query("validate_refs", f"SELECT model_id, visual_id, ui_field, usage_label, table_name, column_name, status FROM ({checked(EXPANDED)}) c")
def _validate(ctx):
    rows = rp.validate_refs(expanded_fields(ctx, cq.closure(ctx)), cq.catalog_columns(ctx))
    return rows.select("model_id", "visual_id", "ui_field", "usage_label", "table_name", "column_name", "status")


def usage(ctx):
    """All usage rows of all reports, checked against the catalog."""
    f = cq.formulas(ctx)
    c = materialise(graph.measure_closure(f, tp.measure_refs(f)))
    lab = materialise(labelled(ctx))
    fields = materialise(rp.expand_measures(rp.visual_fields(lab), f, c))
    parts = [
        rp.expand_measures(rp.report_filters(ctx.lens("lens_report_files")), f, c),
        rp.expand_measures(rp.page_filters(pages(ctx)), f, c),
        fields,
        rp.expand_measures(rp.visual_filters(lab, fields), f, c),
    ]
    names = tp.parse_columns(ctx.declared).select("model_id", "path", "table_name", "column_name").unionByName(
        f.select("model_id", "path", "table_name", F.col("measure").alias("column_name"))
    )
    return rp.validate_refs(rp.field_usage(parts), materialise(names)).filter(F.col("status") != "dropped").drop("status", "field_type")


USAGE_COLS = "model_id, report_id, page_name, visual_label, visual_type, ui_field, usage_label, formula, table_name, column_name"
BASE_TEXT = BASE_FORMULA
# Filters on none (customers without orders) and on segments name unknown tables; Price and Sort
# Key are found in the first table, if the model has any.
FIELD_USAGE = f"""
    WITH rf AS (SELECT r.*, '' AS formula FROM ({REPORT_FILTERS}) r),
    pf AS (SELECT p.* EXCLUDE (table_name, column_name), CASE WHEN d.no = 2 THEN 'Facts' ELSE table_name END AS table_name,
              CASE WHEN d.no = 2 THEN 'Qty' ELSE column_name END AS column_name, CASE WHEN field_type = 'Measure' AND table_name <> 'none' THEN {BASE_TEXT} ELSE '' END AS formula
           FROM ({PAGE_FILTERS}) p JOIN (VALUES (1), (2)) d(no) ON d.no = 1 OR (field_type = 'Measure' AND table_name <> 'none')),
    vf AS (SELECT v.*, '' AS formula FROM ({VISUAL_FILTERS}) v),
    every AS (SELECT {USAGE_COLS} FROM rf UNION ALL SELECT {USAGE_COLS} FROM pf UNION ALL SELECT {USAGE_COLS} FROM ({EXPANDED}) x UNION ALL SELECT {USAGE_COLS} FROM vf)
    SELECT e.* EXCLUDE (table_name), CASE WHEN t.table_name IS NULL THEN first_table ELSE e.table_name END AS table_name
    FROM every e LEFT JOIN {FIRST} ON ft.m = e.model_id LEFT JOIN lens_tables t ON t.model_id = e.model_id AND t.table_name = e.table_name
    WHERE first_table IS NOT NULL AND e.table_name <> 'Facts' AND e.column_name NOT LIKE 'Missing%'"""


@query("field_usage", FIELD_USAGE)
def _usage(ctx):
    return usage(ctx)


@query("usage_summary", f"""
    SELECT model_id, count(*) AS n_rows, count(DISTINCT page_name) AS n_pages, count(DISTINCT visual_label) AS n_visuals
    FROM ({FIELD_USAGE}) u GROUP BY model_id""")
def _summary(ctx):
    return rp.usage_summary(usage(ctx))
