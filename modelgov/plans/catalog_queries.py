"""Queries over the catalog, the filter graph and measure dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, graph
from ..operators import textparse as tp
from .registry import query
from .text_queries import K

PATH = "'tables/' || table_name || '.tmdl'"
CATALOG_COLUMNS = f"""
    SELECT model_id, path, table_name, column_name, source_column, row_number() OVER (PARTITION BY model_id ORDER BY path, no) AS column_id
    FROM (SELECT model_id, {PATH} AS path, table_name, 1 AS no, 'Price' AS column_name, 'price_' || status AS source_column FROM lens_sources
          UNION ALL SELECT model_id, {PATH}, table_name, 2, 'Sort Key', 'Sort Key' FROM lens_sources
          UNION ALL SELECT model_id, {PATH}, table_name, 3, 'It''s ' || {K}, '' FROM lens_sources
          UNION ALL SELECT model_id, {PATH}, table_name, 4, 'Total ' || {K}, '[Measure]' FROM lens_sources
          UNION ALL SELECT model_id, {PATH}, table_name, 5, 'Base ' || {K}, '[Measure]' FROM lens_sources) c"""
CATALOG_TABLES = f"SELECT model_id, {PATH} AS path, table_name, row_number() OVER (PARTITION BY model_id ORDER BY {PATH}) AS table_id FROM lens_sources"


@query("catalog_tables", CATALOG_TABLES)
def _tables(ctx):
    return catalog.catalog_tables(tp.parse_tables(ctx.files))


def catalog_columns(ctx):
    return catalog.catalog_columns(tp.parse_columns(ctx.declared), tp.parse_measures(ctx.declared))


@query("catalog_columns", CATALOG_COLUMNS)
def _columns(ctx):
    return catalog_columns(ctx)


def resolved_relations(ctx):
    tables = catalog.catalog_tables(tp.parse_tables(ctx.files))
    return catalog.resolve_relations(tp.parse_relations(ctx.lens("lens_relation_files")), tables, catalog_columns(ctx))


@query("catalog_relations", f"""
    WITH t AS ({CATALOG_TABLES}), c AS ({CATALOG_COLUMNS})
    SELECT r.model_id, ft.table_id AS from_table_id, fc.column_id AS from_column_id, tt.table_id AS to_table_id, tc.column_id AS to_column_id,
        CASE WHEN r.status = 'F' THEN 'bothDirections' ELSE 'oneDirection' END AS cross_filter, TRUE AS is_active
    FROM lens_sources r
    JOIN t ft ON ft.model_id = r.model_id AND ft.table_name = r.table_name
    JOIN t tt ON tt.model_id = r.model_id AND tt.table_name = r.hub_name
    JOIN c fc ON fc.model_id = r.model_id AND fc.table_name = r.table_name AND fc.column_name = 'Sort Key'
    JOIN c tc ON tc.model_id = r.model_id AND tc.table_name = r.hub_name AND tc.column_name = 'Price'""")
def _catalog_relations(ctx):
    return catalog.catalog_relations(resolved_relations(ctx))


@query("unresolved_relations", f"""
    SELECT model_id, 'r2-' || {K} AS relationship, ['to_table', 'to_column'] AS missing,
        table_name AS from_table, 'Price' AS from_column, 'Facts_' || {K} AS to_table, 'Some Key' AS to_column
    FROM lens_sources""")
def _unresolved(ctx):
    return catalog.unresolved_relations(resolved_relations(ctx))


def master(ctx):
    return catalog.semantic_master(ctx.lens("lens_columns"), ctx.lens("lens_tables"))


KIND = "CASE source_column WHEN '[Measure]' THEN 'measure' WHEN '' THEN 'calculated' ELSE 'imported' END"
MASTER = f"""
    SELECT model_id, column_id, column_name, source_column, table_id, table_name, {KIND} AS kind,
        table_name || '$$' || column_name AS key, lower(table_name || '$$' || column_name) AS key_norm
    FROM lens_columns"""


@query("semantic_master", MASTER)
def _master(ctx):
    return master(ctx)


def names(ctx):
    return catalog.relation_names(ctx.lens("lens_relations"), ctx.lens("lens_tables"), ctx.lens("lens_columns"))


@query("relation_names", "SELECT model_id, from_table, from_column, to_table, to_column FROM lens_relation_names")
def _names(ctx):
    return names(ctx)


def edges(ctx):
    return graph.filter_edges(ctx.lens("lens_relations"), ctx.lens("lens_tables"))


EDGES = """
    SELECT DISTINCT r.model_id, t.table_name AS src, f.table_name AS dst FROM lens_relations r
    JOIN lens_tables f ON f.model_id = r.model_id AND f.table_id = r.from_table_id
    JOIN lens_tables t ON t.model_id = r.model_id AND t.table_id = r.to_table_id WHERE r.is_active
    UNION SELECT r.model_id, f.table_name, t.table_name FROM lens_relations r
    JOIN lens_tables f ON f.model_id = r.model_id AND f.table_id = r.from_table_id
    JOIN lens_tables t ON t.model_id = r.model_id AND t.table_id = r.to_table_id
    WHERE r.is_active AND r.cross_filter = 'bothDirections'"""
# The links of the lens form two-level trees, so no shortest path has more than four hops.
LINEAGE = f"""
    e AS ({EDGES}),
    walk(model_id, src, dst, hops) AS (
        SELECT model_id, src, dst, 1 FROM e
        UNION SELECT w.model_id, w.src, e.dst, w.hops + 1 FROM walk w JOIN e ON e.model_id = w.model_id AND e.src = w.dst
        WHERE w.hops < 5),
    pairs AS (SELECT model_id, src, dst, min(hops) AS hops FROM walk WHERE src <> dst GROUP BY model_id, src, dst),
    lineage AS (
        SELECT t.model_id, t.table_name, coalesce(p.src, '(none)') AS filtered_by, coalesce(p.hops, -1) AS hops
        FROM lens_tables t LEFT JOIN pairs p ON p.model_id = t.model_id AND p.dst = t.table_name)"""


@query("filter_edges", EDGES)
def _edges(ctx):
    return edges(ctx)


def lineage(ctx):
    return graph.filter_lineage(edges(ctx), ctx.lens("lens_tables"))


@query("filter_lineage", f"WITH RECURSIVE {LINEAGE} SELECT model_id, table_name, filtered_by, hops FROM lineage")
def _lineage(ctx):
    return lineage(ctx)


@query("measure_lineage", f"""
    WITH RECURSIVE {LINEAGE}
    SELECT c.model_id, c.column_name AS measure, c.table_name AS home_table, l.filtered_by, l.hops
    FROM lens_columns c JOIN lineage l ON l.model_id = c.model_id AND l.table_name = c.table_name WHERE c.source_column = '[Measure]'""")
def _measure_lineage(ctx):
    return graph.measure_lineage(lineage(ctx), master(ctx))


@query("lineage_summary", f"""
    WITH RECURSIVE {LINEAGE}
    SELECT l.model_id, coalesce(max(x.n), 0) AS n_edges, count(*) FILTER (WHERE hops > 0) AS n_pairs, count(*) FILTER (WHERE hops = -1) AS n_isolated
    FROM lineage l LEFT JOIN (SELECT model_id, count(*) AS n FROM e GROUP BY model_id) x ON x.model_id = l.model_id GROUP BY l.model_id""")
def _lineage_summary(ctx):
    e = edges(ctx)
    return graph.lineage_summary(e, graph.filter_lineage(e, ctx.lens("lens_tables")))


def formulas(ctx):
    return tp.measure_formulas(ctx.declared)


def closure(ctx):
    f = formulas(ctx)
    return graph.measure_closure(f, tp.measure_refs(f))


CLOSURE = f"""
    SELECT model_id, table_name, 'Total ' || {K} AS measure, table_name AS dep_table, v.c AS dep_column FROM lens_sources
        CROSS JOIN (VALUES ('Price')) v(c)
    UNION ALL SELECT model_id, table_name, 'Total ' || {K}, table_name, 'Total ' || {K} FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Total ' || {K}, table_name, 'Base ' || {K} FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Total ' || {K}, 'Facts', 'Qty' FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Base ' || {K}, table_name, 'Base ' || {K} FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Base ' || {K}, 'Facts', 'Qty' FROM lens_sources"""


@query("measure_closure", CLOSURE)
def _closure(ctx):
    return closure(ctx)
