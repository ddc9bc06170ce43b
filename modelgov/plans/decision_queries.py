"""Queries over usage counts, removal decisions, protections and cleanup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PLACE, build_key
from ..operators import catalog, cleanup, decide, usage
from ..operators import textparse as tp
from ..session import materialise
from ..sources.relations import security_set, view_set
from . import catalog_queries as cq
from .lenses import BASE_BLOCK, CALC_BLOCK, LEVELS_BLOCK, PRICE_BLOCK, SLOTS, TAIL_BLOCKS, text
from .registry import query
from .text_queries import K

# ---- usage counts ----

CLEAN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
EXPLODED = f"""
    WITH parts AS (
        SELECT model_id, table_name, ui_field, usage_label, nullif(trim(formula), '') IS NOT NULL AS has_formula,
            {CLEAN.format('unnest(string_split(column_names, chr(44)))')} AS column_name FROM lens_usage WHERE status <> 'dropped')
    SELECT model_id, table_name, column_name, usage_label, has_formula FROM parts WHERE column_name <> ''
    UNION ALL SELECT model_id, table_name, ui_field, usage_label, has_formula FROM parts WHERE column_name <> '' AND has_formula"""
CLASSIFIED = f"""
    SELECT model_id, table_name, column_name, usage_label,
        CAST(usage_label LIKE '%Slicer%' AS INT) AS slicer, CAST(usage_label LIKE '%Visual%' AS INT) AS visual,
        CAST(usage_label LIKE '%Filter%' AS INT) AS filter, CAST(usage_label LIKE '%(Measure)%' OR has_formula AS INT) AS measure
    FROM ({EXPLODED}) x"""
COUNTS = f"""
    SELECT *, slicer + visual + filter + measure AS frequency, table_name || '$$' || column_name AS key
    FROM (SELECT model_id, table_name, column_name, CAST(sum(slicer) AS BIGINT) AS slicer, CAST(sum(visual) AS BIGINT) AS visual,
              CAST(sum(filter) AS BIGINT) AS filter, CAST(sum(measure) AS BIGINT) AS measure
          FROM ({CLASSIFIED}) c GROUP BY model_id, table_name, column_name) s"""


def uses(ctx):
    return usage.kept_uses(ctx.lens("lens_usage"))


def classified(ctx):
    return usage.usage_classify(usage.usage_explode(uses(ctx)))


def counts(ctx):
    return usage.field_usage_counts(usage.usage_classify(usage.usage_explode(usage.distinct_uses(uses(ctx)))))


@query("usage_explode", EXPLODED)
def _explode(ctx):
    return usage.usage_explode(uses(ctx))


@query("usage_classify", CLASSIFIED)
def _classify(ctx):
    return classified(ctx)


@query("field_usage_counts", COUNTS)
def _counts(ctx):
    return usage.ordered_counts(counts(ctx))


@query("top_fields", f"""
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model_id ORDER BY frequency DESC, table_name, column_name) AS INT) AS rank FROM ({COUNTS}) c) r
    WHERE rank <= 3""")
def _top(ctx):
    return usage.top_fields(counts(ctx), 3)


# ---- flags ----

NORM = r"regexp_replace(lower(key), '\s*\?\s*$', '')"
USED = f"SELECT DISTINCT model_id, {NORM} AS key_norm, trim(split_part({NORM}, '$$', 2)) AS name_norm FROM ({COUNTS}) c"
FLAGGED = f"""
    SELECT m.*, CAST(EXISTS (SELECT 1 FROM used u WHERE u.model_id = m.model_id AND u.key_norm = m.key_norm)
        OR (kind = 'measure' AND EXISTS (SELECT 1 FROM used u WHERE u.model_id = m.model_id AND u.name_norm = lower(m.column_name))) AS INT) AS used_in_report,
        CAST(EXISTS (SELECT 1 FROM ends e WHERE e.model_id = m.model_id AND e.key_norm = m.key_norm) AS INT) AS used_in_relationship
    FROM master m"""
BASE_CTES = f"""
    used AS ({USED}),
    ends AS (SELECT DISTINCT model_id, key, lower(key) AS key_norm FROM (
        SELECT model_id, from_table || '$$' || from_column AS key FROM lens_relation_names
        UNION ALL SELECT model_id, to_table || '$$' || to_column FROM lens_relation_names) k),
    master AS ({cq.MASTER}),
    flagged AS ({FLAGGED}),
    base AS (SELECT *, CASE WHEN used_in_report = 0 AND used_in_relationship = 0 THEN 'Yes' ELSE 'No' END AS remove_column FROM flagged)"""


def in_report(ctx):
    return usage.used_in_report(cq.master(ctx), counts(ctx))


def in_relationship(ctx):
    return usage.used_in_relationship(cq.master(ctx), cq.names(ctx))


def flagged(ctx):
    """Both flags along one master, whose tables carry the security marks; same rows as joining the two flagged relations by id.

    The master is dealt by the place of its keys (``_place``), so that all that follows meets it there.
    """
    ctx.deal(lens_named="table_id", lens_columns="table_id", lens_tables="table_id")
    tables = decide.secured_tables(ctx.lens("lens_tables"), security(ctx))
    by_table = catalog.semantic_master(ctx.lens("lens_columns"), tables)
    master = catalog.dealt_master(by_table)
    reported = usage.used_in_report(master, counts(ctx), measures=by_table)
    return decide.base_decisions(usage.used_in_relationship(reported, cq.names(ctx)))


MASTER_COLS = "model_id, column_id, column_name, source_column, table_id, table_name, kind, key, key_norm"


@query("used_in_report", f"WITH {BASE_CTES} SELECT {MASTER_COLS}, used_in_report FROM flagged")
def _used_in_report(ctx):
    return in_report(ctx)


@query("used_in_relationship", f"WITH {BASE_CTES} SELECT {MASTER_COLS}, used_in_relationship FROM flagged")
def _used_in_relationship(ctx):
    return in_relationship(ctx)


@query("unmatched_usage", f"""
    WITH {BASE_CTES}, c AS (SELECT DISTINCT model_id, key, {NORM} AS key_norm, trim(split_part({NORM}, '$$', 2)) AS name_norm FROM ({COUNTS}) c)
    SELECT model_id, key, CASE WHEN EXISTS (SELECT 1 FROM master m WHERE m.model_id = c.model_id AND lower(m.column_name) = c.name_norm)
        THEN 'true mismatch' ELSE 'display alias' END AS class
    FROM c WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.model_id = c.model_id AND m.key_norm = c.key_norm)
      AND NOT EXISTS (SELECT 1 FROM master m WHERE m.model_id = c.model_id AND m.kind = 'measure' AND lower(m.column_name) = c.name_norm)""")
def _unmatched(ctx):
    return usage.unmatched_usage(cq.master(ctx), counts(ctx))


@query("unmatched_endpoints", f"""
    WITH {BASE_CTES}, loose AS (
        SELECT model_id, table_name || '$$Price' AS key FROM lens_sources UNION SELECT model_id, 'Facts_' || {K} || '$$Some Key' FROM lens_sources),
    every AS (SELECT model_id, key, key_norm FROM ends UNION SELECT model_id, key, lower(key) FROM loose)
    SELECT model_id, key FROM every e WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.model_id = e.model_id AND m.key_norm = e.key_norm)""")
def _unmatched_ends(ctx):
    loose = catalog.unresolved_relations(cq.resolved_relations(ctx))
    return usage.unmatched_endpoints(cq.master(ctx), catalog.all_names(cq.names(ctx), loose))


DECISION_COLS = f"{MASTER_COLS}, used_in_report, used_in_relationship, remove_column"


@query("column_decisions", f"WITH {BASE_CTES} SELECT {DECISION_COLS} FROM base")
def _decisions(ctx):
    """Both flags over one master, written dealt by the place of its keys, where the flags meet again."""
    ctx.deal(lens_columns="table_id", lens_tables="table_id")
    by_table = cq.master(ctx)
    master = catalog.written_master(by_table)
    reported = usage.used_in_report(master, counts(ctx), measures=by_table)
    return decide.column_decisions(reported, usage.used_in_relationship(master, cq.names(ctx))).drop(PLACE)


# ---- protections ----

LIST_CTES = f"""{BASE_CTES},
    security AS (SELECT DISTINCT model_id, lower(trim(table_name)) AS table_norm FROM lens_security
                 UNION SELECT model_id, lower(table_name) FROM lens_detected),
    views AS (SELECT DISTINCT model_id, lower(table_name || '$$' || trim(column_name)) AS key_norm FROM lens_views WHERE table_name IS NOT NULL),
    listed AS MATERIALIZED (SELECT b.* EXCLUDE (remove_column), CASE WHEN hit THEN 'No' ELSE remove_column END AS remove_column, CASE WHEN hit THEN 'Yes' ELSE 'No' END AS protected
        FROM (SELECT b.*, s.table_norm IS NOT NULL OR v.key_norm IS NOT NULL AS hit FROM base b
              LEFT JOIN security s ON s.model_id = b.model_id AND s.table_norm = lower(b.table_name)
              LEFT JOIN views v ON v.model_id = b.model_id AND v.key_norm = b.key_norm) b)"""


def target_step(name: str, before: str, targets: str, reason: str) -> str:
    """Protect the keys of ``targets`` among the removals of ``before``."""
    return f"""
    {name}_t AS MATERIALIZED (SELECT DISTINCT model_id, key_norm FROM ({targets}) x),
    {name} AS MATERIALIZED (SELECT d.* EXCLUDE (remove_column, protected),
        CASE WHEN remove_column = 'Yes' AND t.key_norm IS NOT NULL THEN 'No' ELSE remove_column END AS remove_column,
        CASE WHEN remove_column = 'Yes' AND t.key_norm IS NOT NULL THEN '{reason}' ELSE protected END AS protected
        FROM {before} d LEFT JOIN {name}_t t ON t.model_id = d.model_id AND t.key_norm = d.key_norm)"""


def key(table: str, column: str) -> str:
    return f"lower({table} || '$$' || {column})"


LINKS = target_step("linked", "listed", f"""
    SELECT l.model_id, {key('l.target_table', 'l.target_column')} AS key_norm FROM lens_links l
    JOIN listed k ON k.model_id = l.model_id AND k.key_norm = {key('l.table_name', 'l.column_name')} AND k.remove_column = 'No'""", "SemanticLink")


def dax_targets(source: str) -> str:
    return f"""
    SELECT r.model_id, {key('r.ref_table', 'r.ref_column')} AS key_norm FROM lens_owner_refs r
    JOIN {source} k ON k.model_id = r.model_id AND k.key_norm = {key('r.table_name', 'r.name')} AND k.remove_column = 'No' AND k.kind IN ('calculated', 'measure')"""


def sibling_targets(source: str) -> str:
    return f"""
    SELECT a.model_id, {key('a.table_name', 'a.column_name')} AS key_norm FROM lens_levels a
    JOIN (SELECT DISTINCT b.model_id, b.table_name, b.hierarchy FROM lens_levels b
          JOIN {source} k ON k.model_id = b.model_id AND k.key_norm = {key('b.table_name', 'b.column_name')} AND k.remove_column = 'No') h
    ON h.model_id = a.model_id AND h.table_name = a.table_name AND h.hierarchy = a.hierarchy"""


DAX = target_step("formulas", "linked", dax_targets("linked"), "DAXReference")
SIBLINGS = target_step("final", "formulas", sibling_targets("formulas"), "HierarchyLevel")
FINAL_CTES = f"{LIST_CTES}, {LINKS}, {DAX}, {SIBLINGS}"
PROTECTED_COLS = f"{DECISION_COLS}, protected"


def security(ctx):
    return security_set(ctx.lens("lens_security"), ctx.lens("lens_detected"))


def views(ctx):
    return view_set(ctx.lens("lens_views"))


def listed(ctx):
    return decide.protect_lists(flagged(ctx), views=views(ctx)).drop("key")


def whole(decisions):
    """Decisions without the place they were dealt by, with the key that their names make."""
    return decisions.withColumn("key", build_key("table_name", "column_name")).drop(PLACE)


def final(ctx):
    return decide.protect_structure(listed(ctx), ctx.lens("lens_links"), ctx.lens("lens_owner_refs"), ctx.lens("lens_levels"))


@query("protection_sets", f"""
    WITH {LIST_CTES} SELECT model_id, 'security' AS list, table_norm AS entry FROM security UNION ALL SELECT model_id, 'view', key_norm FROM views""")
def _sets(ctx):
    return security(ctx).select("model_id", F.lit("security").alias("list"), F.col("table_norm").alias("entry")).unionByName(
        views(ctx).select("model_id", F.lit("view").alias("list"), F.col("key_norm").alias("entry"))
    )


@query("protect_lists", f"WITH {LIST_CTES} SELECT {PROTECTED_COLS} FROM listed")
def _lists(ctx):
    return whole(listed(ctx))


@query("protect_links", f"WITH {LIST_CTES}, {LINKS} SELECT {PROTECTED_COLS} FROM linked")
def _links(ctx):
    return whole(decide.protect_links(listed(ctx), ctx.lens("lens_links")))


@query("protect_dax", f"""
    WITH {LIST_CTES}, {target_step('f', 'listed', dax_targets('listed'), 'DAXReference')} SELECT {PROTECTED_COLS} FROM f""")
def _dax(ctx):
    return whole(decide.protect_dax(listed(ctx), ctx.lens("lens_owner_refs")))


@query("protect_siblings", f"""
    WITH {LIST_CTES}, {target_step('sib', 'listed', sibling_targets('listed'), 'HierarchyLevel')} SELECT {PROTECTED_COLS} FROM sib""")
def _siblings(ctx):
    return whole(decide.protect_siblings(listed(ctx), ctx.lens("lens_levels")))


@query("protect_structure", f"WITH {FINAL_CTES} SELECT {PROTECTED_COLS} FROM final")
def _structure(ctx):
    return whole(final(ctx))


@query("protect_fixpoint", f"""
    WITH RECURSIVE {LIST_CTES},
    edge AS (
        SELECT model_id, {key('table_name', 'column_name')} AS src, {key('target_table', 'target_column')} AS dst FROM lens_links
        UNION SELECT model_id, {key('table_name', 'name')}, {key('ref_table', 'ref_column')} FROM lens_owner_refs
        UNION SELECT model_id, {key('table_name', 'column_name')}, 'H ' || {key('table_name', 'hierarchy')} FROM lens_levels
        UNION SELECT model_id, 'H ' || {key('table_name', 'hierarchy')}, {key('table_name', 'column_name')} FROM lens_levels
        UNION SELECT model_id, {key('table_name', 'column_name')}, 'H ' || {key('hier_table', 'hierarchy')} FROM lens_variations
        UNION SELECT model_id, {key('table_name', 'column_name')}, {key('table_name', 'sort_column')} FROM lens_sort_by),
    alive(model_id, node) AS (
        SELECT model_id, key_norm FROM listed WHERE remove_column = 'No'
        UNION SELECT e.model_id, e.dst FROM alive a JOIN edge e ON e.model_id = a.model_id AND e.src = a.node)
    SELECT d.* EXCLUDE (hit, remove_column, protected), CASE WHEN a.node IS NOT NULL THEN 'No' ELSE remove_column END AS remove_column,
        CASE WHEN a.node IS NOT NULL AND remove_column = 'Yes' THEN 'Dependency' ELSE protected END AS protected
    FROM listed d LEFT JOIN (SELECT DISTINCT model_id, node FROM alive) a ON a.model_id = d.model_id AND a.node = d.key_norm""")
def _fixpoint(ctx):
    decisions = decide.written(listed(ctx))
    edges = decide.dependency_edges(
        ctx.lens("lens_links"), ctx.lens("lens_owner_refs"), ctx.lens("lens_levels"),
        ctx.lens("lens_variations"), ctx.lens("lens_sort_by"),
    )
    return whole(decide.protect_fixpoint(decisions, edges))


VARIATION_T = f"""
    SELECT DISTINCT l.model_id, {key('l.table_name', 'l.column_name')} AS key_norm FROM lens_levels l
    JOIN lens_variations v ON v.model_id = l.model_id AND lower(v.hier_table) = lower(l.table_name) AND lower(v.hierarchy) = lower(l.hierarchy)
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.model_id = v.model_id AND g.key_norm = {key('v.table_name', 'v.column_name')})"""
SORT_T = f"""
    SELECT DISTINCT s.model_id, {key('s.table_name', 's.sort_column')} AS key_norm FROM lens_sort_by s
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.model_id = s.model_id AND g.key_norm = {key('s.table_name', 's.column_name')}
                      AND NOT EXISTS (SELECT 1 FROM var_t p WHERE p.model_id = g.model_id AND p.key_norm = g.key_norm))"""
GONE = "gone AS (SELECT model_id, key_norm FROM final WHERE remove_column = 'Yes')"


@query("protect_variations", f"WITH {FINAL_CTES}, {GONE} {VARIATION_T}")
def _variations(ctx):
    return decide.variation_targets(ctx.lens("lens_variations"), ctx.lens("lens_levels"), decide.removal_keys(final(ctx)))


@query("protect_sort_by", f"WITH {FINAL_CTES}, {GONE}, var_t AS ({VARIATION_T}) {SORT_T}")
def _sort_by(ctx):
    removed = decide.written(decide.removal_keys(final(ctx)))
    by_variation = decide.variation_targets(ctx.lens("lens_variations"), ctx.lens("lens_levels"), removed)
    return decide.sort_targets(ctx.lens("lens_sort_by"), removed, by_variation)


TABLES_CTE = """tables AS (
    SELECT model_id, table_name, count(*) AS total_columns, count(*) FILTER (WHERE remove_column = 'Yes') AS columns_to_remove,
        CASE WHEN bool_and(remove_column = 'Yes') AND NOT EXISTS (SELECT 1 FROM security s WHERE s.model_id = f.model_id AND s.table_norm = lower(f.table_name))
            THEN 'Yes' ELSE 'No' END AS remove_table
    FROM final f GROUP BY model_id, table_name)"""


def tables_of(ctx, decisions):
    return decide.table_decisions(decisions, security(ctx))


@query("table_decisions", f"WITH {FINAL_CTES}, {TABLES_CTE} SELECT * FROM tables")
def _tables(ctx):
    return tables_of(ctx, final(ctx))


@query("drop_tables", f"""
    WITH {FINAL_CTES}, {TABLES_CTE}
    SELECT model_id, table_name, 'DROP TABLE [dbo].[' || table_name || '];' AS drop_sql FROM tables WHERE remove_table = 'Yes'""")
def _drop_tables(ctx):
    return decide.drop_tables(tables_of(ctx, final(ctx)))


DROP_COLUMNS = """
    SELECT f.model_id, f.table_name, f.column_name, 'ALTER TABLE [dbo].[' || f.table_name || '] DROP COLUMN [' || f.source_column || '];' AS drop_sql
    FROM final f JOIN tables t ON t.model_id = f.model_id AND t.table_name = f.table_name AND t.remove_table = 'No'
    WHERE f.remove_column = 'Yes' AND f.kind = 'imported'"""


@query("drop_columns", f"WITH {FINAL_CTES}, {TABLES_CTE} {DROP_COLUMNS}")
def _drop_columns(ctx):
    decisions = final(ctx)
    return decide.drop_columns(decisions, tables_of(ctx, decisions))


MODEL_ITEMS = """
    SELECT f.model_id, f.table_name, f.column_name, CASE f.kind WHEN 'measure' THEN 'Measure' ELSE 'Calculated Column' END AS type, f.table_name || '.tmdl' AS file
    FROM final f JOIN tables t ON t.model_id = f.model_id AND t.table_name = f.table_name AND t.remove_table = 'No'
    WHERE f.remove_column = 'Yes' AND f.kind <> 'imported'"""


@query("model_cleanup", f"WITH {FINAL_CTES}, {TABLES_CTE} {MODEL_ITEMS}")
def _model_cleanup(ctx):
    decisions = final(ctx)
    return decide.model_cleanup(decisions, tables_of(ctx, decisions))


@query("drop_conflicts", f"""
    WITH {FINAL_CTES}, {TABLES_CTE}, {GONE}, var_t AS ({VARIATION_T}), sort_t AS ({SORT_T}), dropped AS ({DROP_COLUMNS}),
    why AS (SELECT model_id, key_norm, max(reason) AS reason FROM (SELECT *, 'variation' AS reason FROM var_t UNION ALL SELECT *, 'sort by' FROM sort_t) w GROUP BY model_id, key_norm)
    SELECT d.model_id, d.table_name, d.column_name, d.drop_sql, w.reason FROM dropped d
    JOIN why w ON w.model_id = d.model_id AND w.key_norm = {key('d.table_name', 'd.column_name')}""")
def _conflicts(ctx):
    decisions = final(ctx)
    dropped = decide.drop_columns(decisions, tables_of(ctx, decisions))
    return decide.drop_conflicts(dropped, decisions, ctx.lens("lens_variations"), ctx.lens("lens_levels"), ctx.lens("lens_sort_by"))


@query("run_summary", f"""
    WITH {FINAL_CTES}, {TABLES_CTE}, tally AS (
        SELECT model_id, 't' AS w FROM tables WHERE remove_table = 'Yes' UNION ALL SELECT model_id, 'c' FROM ({DROP_COLUMNS}) d UNION ALL SELECT model_id, 'i' FROM ({MODEL_ITEMS}) i)
    SELECT model_id, count(*) FILTER (WHERE w = 't') AS tables_to_drop, count(*) FILTER (WHERE w = 'c') AS columns_to_drop, count(*) FILTER (WHERE w = 'i') AS model_items
    FROM tally GROUP BY model_id""")
def _run_summary(ctx):
    decisions = final(ctx)
    tables = tables_of(ctx, decisions)
    return decide.run_summary(decide.drop_tables(tables), decide.drop_columns(decisions, tables), decide.model_cleanup(decisions, tables))


# ---- cleanup: plan over the relations ----

SKIP_RANK = f"""
    cand AS (SELECT * FROM final WHERE remove_column = 'Yes' AND kind <> 'imported'),
    gone AS (SELECT model_id, key_norm FROM cand),
    var_t AS ({VARIATION_T}), sort_t AS ({SORT_T}),
    found AS (
        SELECT *, 0 AS rank FROM ({dax_targets('final')}) a
        UNION ALL SELECT model_id, {key('target_table', 'target_column')}, 1 FROM lens_links l
            WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.model_id = l.model_id AND g.key_norm = {key('l.table_name', 'l.column_name')})
        UNION ALL SELECT a.model_id, {key('a.table_name', 'a.column_name')}, 2 FROM lens_levels a
            WHERE EXISTS (SELECT 1 FROM lens_levels b WHERE b.model_id = a.model_id AND b.table_name = a.table_name AND b.hierarchy = a.hierarchy
                AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.model_id = b.model_id AND g.key_norm = {key('b.table_name', 'b.column_name')}))
        UNION ALL SELECT *, 3 FROM var_t UNION ALL SELECT *, 3 FROM sort_t),
    reasons AS (SELECT f.model_id, f.key_norm, min(rank) AS rank FROM found f JOIN gone g ON g.model_id = f.model_id AND g.key_norm = f.key_norm GROUP BY f.model_id, f.key_norm)"""
REASON = (f"CASE rank WHEN 0 THEN '{cleanup.REASON_DAX}' WHEN 1 THEN '{cleanup.REASON_LINK}' "
          f"WHEN 2 THEN '{cleanup.REASON_SIBLING}' WHEN 3 THEN '{cleanup.REASON_DATE}' END")
ITEM = "CASE kind WHEN 'measure' THEN 'Measure' WHEN 'calculated' THEN 'Calculated Column' ELSE 'Imported Column' END"


def lens_reasons(ctx, decisions, mode):
    cands = materialise(cleanup.candidates(decisions, mode))
    reasons = cleanup.protection_reasons(
        cands, decisions, ctx.lens("lens_links"), ctx.lens("lens_owner_refs"), ctx.lens("lens_levels"),
        ctx.lens("lens_variations"), ctx.lens("lens_sort_by"),
    )
    return cands, reasons


@query("cleanup_reasons", f"""
    WITH {FINAL_CTES}, {SKIP_RANK}
    SELECT c.model_id, c.table_name, c.column_name AS item_name, {ITEM} AS item_type, {REASON} AS reason
    FROM cand c LEFT JOIN reasons r ON r.model_id = c.model_id AND r.key_norm = c.key_norm""")
def _reasons(ctx):
    cands, reasons = lens_reasons(ctx, final(ctx), "tmdl_only")
    return cands.join(reasons, ["model_id", "key_norm"], "left").select(
        "model_id", "table_name", F.col("column_name").alias("item_name"), cleanup.item_type(F.col("kind")).alias("item_type"), "reason"
    )


@query("not_deletable", f"""
    WITH {FINAL_CTES}, {SKIP_RANK}
    SELECT model_id, reason, table_name, item_name, row_number() OVER (PARTITION BY model_id, reason, table_name ORDER BY item_name) AS position
    FROM (SELECT DISTINCT c.model_id, c.table_name, c.column_name AS item_name, {REASON} AS reason FROM cand c JOIN reasons r ON r.model_id = c.model_id AND r.key_norm = c.key_norm) s""")
def _not_deletable(ctx):
    cands, reasons = lens_reasons(ctx, final(ctx), "tmdl_only")
    return cleanup.not_deletable(cands.join(reasons, ["model_id", "key_norm"]).withColumnRenamed("column_name", "item_name"))


# ---- cleanup of text: decisions by order status ----
# Orders with status F lose Price, Total and the calculated column; status O loses the Sort Key
# and a measure that no file declares; a third table has no file at all.  Totals of cheap
# orders are protected by a reason of their own.

PLAN_SQL = f"""
    SELECT model_id, table_name, 'Price' AS column_name, 'imported' AS kind FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT model_id, table_name, 'Total ' || {K}, 'measure' FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT model_id, table_name, 'It''s ' || {K}, 'calculated' FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT model_id, table_name, 'Sort Key', 'imported' FROM lens_sources WHERE status = 'O'
    UNION ALL SELECT model_id, table_name, 'Nowhere', 'measure' FROM lens_sources WHERE status = 'O'
    UNION ALL SELECT model_id, 'No File ' || {K}, 'Price', 'imported' FROM lens_sources WHERE status = 'P'
    UNION ALL SELECT model_id, table_name, v.n, v.k FROM lens_sources CROSS JOIN (VALUES ('Price', 'imported'), ('Sort Key', 'imported'),
        ('It''s ', 'calculated'), ('Total ', 'measure'), ('Base ', 'measure')) v(n, k) WHERE status = 'P' AND price < 100000"""
WIPED = "status = 'P' AND price < 100000"
PATH = "'tables/' || table_name || '.tmdl'"


def text_candidates(ctx):
    """Candidates for the rendered files, as the statement above lists them."""
    src = ctx.lens("lens_sources").withColumn("k", F.col("table_id").cast("string"))
    cheap = (F.col("status") == "P") & (F.col("price") < 100000)

    def item(name, kind):
        return F.struct(F.col("table_name").alias("table_name"), name.alias("column_name"), F.lit(kind).alias("kind"))

    total, base, calc = (F.concat(F.lit(p), F.col("k")) for p in ("Total ", "Base ", "It's "))
    price, sort = F.lit("Price"), F.lit("Sort Key")
    empty = F.array().cast("array<struct<table_name:string,column_name:string,kind:string>>")
    no_file = F.struct(F.concat(F.lit("No File "), F.col("k")).alias("table_name"), price.alias("column_name"), F.lit("imported").alias("kind"))
    items = F.concat(
        F.when(F.col("status") == "F", F.array(item(price, "imported"), item(total, "measure"), item(calc, "calculated"))).otherwise(empty),
        F.when(F.col("status") == "O", F.array(item(sort, "imported"), item(F.lit("Nowhere"), "measure"))).otherwise(empty),
        F.when(F.col("status") == "P", F.array(no_file)).otherwise(empty),
        F.when(cheap, F.array(item(price, "imported"), item(sort, "imported"), item(calc, "calculated"), item(total, "measure"), item(base, "measure"))).otherwise(empty),
    )
    key_norm = F.lower(F.concat("i.table_name", F.lit("$$"), "i.column_name"))
    return src.select("model_id", "price", F.explode(items).alias("i")).select("model_id", "price", "i.*", key_norm.alias("key_norm"))


def text_plan(ctx):
    cands = text_candidates(ctx)
    protected = cands.filter((F.col("kind") == "measure") & (F.col("price") > 400000)).select(
        "model_id", "key_norm", F.lit(cleanup.REASON_DAX).alias("reason")
    )
    return cleanup.cleanup_plan(cands.drop("price"), protected, ctx.blocks, tp.parse_tables(ctx.files))


REMOVED_F = "CASE WHEN price > 400000 THEN 'skipped' ELSE 'removed' END"
PLAN_ROWS = f"""
    SELECT model_id, table_name, 'Price' AS item_name, 'Imported Column' AS item_type, 'removed' AS action, NULL AS reason, 3 AS block_no FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT model_id, table_name, 'It''s ' || {K}, 'Calculated Column', 'removed', NULL, 5 FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT model_id, table_name, 'Total ' || {K}, 'Measure', {REMOVED_F}, CASE WHEN price > 400000 THEN '{cleanup.REASON_DAX}' END, 1 FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT model_id, table_name, 'Sort Key', 'Imported Column', 'removed', NULL, 4 FROM lens_sources WHERE status = 'O'
    UNION ALL SELECT model_id, table_name, 'Nowhere', 'Measure', 'skipped', CASE WHEN price > 400000 THEN '{cleanup.REASON_DAX}' ELSE '{cleanup.REASON_NO_BLOCK}' END, NULL FROM lens_sources WHERE status = 'O'
    UNION ALL SELECT model_id, 'No File ' || {K}, 'Price', 'Imported Column', 'skipped', '{cleanup.REASON_NO_FILE}', NULL FROM lens_sources WHERE status = 'P'
    UNION ALL SELECT model_id, table_name, v.n || CASE WHEN v.b IN (1, 2, 5) THEN {K} ELSE '' END, v.t, 'removed', NULL, v.b
        FROM lens_sources CROSS JOIN (VALUES ('Price', 'Imported Column', 3), ('Sort Key', 'Imported Column', 4), ('It''s ', 'Calculated Column', 5),
            ('Total ', 'Measure', 1), ('Base ', 'Measure', 2)) v(n, t, b) WHERE {WIPED}"""


@query("cleanup_plan", PLAN_ROWS)
def _plan(ctx):
    return text_plan(ctx).select("model_id", "table_name", "item_name", "item_type", "action", "reason", "block_no")


def edited(ctx):
    return cleanup.cleanup_text(ctx.files, materialise(text_plan(ctx)))


# Hierarchies break in files with status F (Price gone), O (Sort Key gone) and in wiped files.
BROKEN = f"(status IN ('F', 'O') OR ({WIPED}))"
HUB_BROKEN = f"(SELECT model_id AS m, table_name AS hub FROM lens_sources WHERE {BROKEN} AND table_name = hub_name) hb"
CALC_KEPT = f"(status = 'O' OR (status = 'P' AND price >= 100000))"
CASCADE = f"""
    SELECT model_id, table_name, 'Date Levels' AS item_name, 'Hierarchy (cascade)' AS item_type FROM lens_sources WHERE {BROKEN}
    UNION ALL SELECT model_id, table_name, 'Variation', 'Variation (cascade)' FROM lens_sources JOIN {HUB_BROKEN} ON hb.m = model_id WHERE {CALC_KEPT}
    UNION ALL SELECT model_id, table_name, '(entire table)', 'Empty Table Deleted' FROM lens_sources WHERE {WIPED}"""


@query("cleanup_cascade", CASCADE)
def _cascade(ctx):
    return edited(ctx)[1].drop("path")


NO_VARIATION = CALC_BLOCK.replace("""		variation Variation
			isDefault
			defaultHierarchy: '«hub»'.'Date Levels'

""", "")
HEAD_PLAIN = "table '«t»'\n\tlineageTag: tag-«k»\n«only»\n"
# The flag goes from wiped tables (their hierarchy is gone); a wiped table is a target only as a
# hub, and then its variations go with the hierarchy.
AFTER = f"""
    {text(HEAD_PLAIN, **{**SLOTS, 'only': f"CASE WHEN status = 'P' AND NOT ({WIPED}) THEN chr(9) || 'showAsVariationsOnly' || chr(10) ELSE '' END"})}
    || CASE WHEN (status = 'F' AND price <= 400000) OR ({WIPED}) THEN '' ELSE {text('''	measure 'Total «k»' = SUM('«t»'[Price]) + [Base «k»]
		formatString: 0
		lineageTag: m1-«k»

''', **SLOTS)} END
    || CASE WHEN {WIPED} THEN '' ELSE {text(BASE_BLOCK, **SLOTS)} END
    || CASE WHEN status = 'F' OR ({WIPED}) THEN '' ELSE {text(PRICE_BLOCK, **SLOTS)} END
    || CASE WHEN status = 'O' OR ({WIPED}) THEN '' ELSE {text('''	column 'Sort Key'
		dataType: int64
		sourceColumn: Sort Key

''')} END
    || CASE WHEN NOT {CALC_KEPT} THEN '' WHEN hb.m IS NOT NULL THEN {text(NO_VARIATION, **SLOTS)} ELSE {text(CALC_BLOCK, **SLOTS)} END
    || CASE WHEN {BROKEN} THEN '' ELSE {text(LEVELS_BLOCK, **SLOTS)} END
    || {text(TAIL_BLOCKS, **SLOTS)}"""


@query("cleanup_text", f"""
    SELECT model_id, {PATH} AS path, content AS content_before, after AS content_after, after <> content AS changed, {WIPED} AS deleted
    FROM (SELECT s.*, f.content, {AFTER} AS after FROM lens_sources s JOIN lens_files f ON f.model_id = s.model_id AND f.path = 'tables/' || s.table_name || '.tmdl'
          LEFT JOIN {HUB_BROKEN} ON hb.m = s.model_id) x""")
def _text(ctx):
    return edited(ctx)[0].drop("table_name")


@query("cleanup_summary", f"""
    SELECT model_id, 'removed' AS action, item_type AS label, count(*) AS n FROM (SELECT model_id, item_type FROM ({PLAN_ROWS}) p WHERE action = 'removed'
        UNION ALL SELECT model_id, item_type FROM ({CASCADE}) c) r GROUP BY model_id, item_type
    UNION ALL SELECT model_id, 'skipped', reason, count(*) FROM ({PLAN_ROWS}) p WHERE action = 'skipped' GROUP BY model_id, reason""")
def _summary(ctx):
    plan = materialise(text_plan(ctx))
    _, cascade = cleanup.cleanup_text(ctx.files, plan)
    return cleanup.cleanup_summary(cleanup.removed_items(plan, cascade), cleanup.skipped_items(plan))


@query("implicit_value_columns", """
    SELECT DISTINCT model_id, table_name FROM lens_value_columns WHERE trim(column_name) = 'Value' AND trim(source_column) = '[Value]'""")
def _implicit(ctx):
    return cleanup.implicit_value_columns(ctx.lens("lens_value_columns"))
