"""Queries over legacy layouts, exported object-model tables and rendered text."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..file_sink import write_named_files
from ..operators import layout, render, tom
from ..operators import textparse as tp
from ..sources.containers import report_layouts, scan_layouts
from .registry import Context, query
from .text_queries import K
from .waves import in_waves, through_files

# ---- layouts ----


def packer():
    """UDF that puts a layout into a container the way old files carry it.

    Built inside a function, so that it travels to the workers by value.
    """

    def pack(content: str) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("Version", "1")
            archive.writestr("Report/Layout", ("\ufeff" + content).encode("utf-16-le"))
        return buffer.getvalue()

    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(pack)

    return F.pandas_udf(packed, BinaryType())


@query("layout_scan", "SELECT 'r' || CAST(report_id AS VARCHAR) AS path, layout_json FROM lens_layouts")
def _scan(ctx):
    """Containers are written as files once; the scan opens them and reads the layout entry only.

    Layouts are rendered where their sources lie: containers are not shuffled.
    """
    sources = in_waves(ctx, ctx.lens("lens_sources"), "table_id") if ctx.waves > 1 else None

    def write(k: int, root: str) -> None:
        own = Context(ctx.spark, ctx.sf_dir, {"lens_sources": sources(k)}) if sources else ctx
        packed = own.lens("lens_layouts").select(
            F.concat(F.lit("r"), F.col("report_id").cast("string"), F.lit(".pbix")).alias("file"), packer()("layout_json").alias("content")
        )
        write_named_files(packed, root, [], together=True)

    def scan(root: str):
        return report_layouts(scan_layouts(ctx.spark, root)).select(F.replace("report_id", F.lit(".pbix")).alias("path"), "layout_json")

    return through_files(ctx, write, scan)


def docs(ctx):
    return layout.layout_documents(ctx.lens("lens_layouts"))


RID = "table_id AS report_id"


@query("layout_pages", f"""
    SELECT {RID}, 'S1' AS page_id, 'S1' AS page_name, 1 AS page_order, TRUE AS is_active, 'Drillthrough' AS binding_type FROM lens_sources
    UNION ALL SELECT table_id, 'S2', 'Second ' || {K}, 2, FALSE, NULL FROM lens_sources""")
def _pages(ctx):
    return layout.layout_pages(docs(ctx)).drop("filters")


@query("layout_visuals", f"""
    SELECT {RID}, v.p AS page_id, v.i || {K} AS visual_id, v.t AS visual_type, CASE WHEN v.i = 'K' THEN 'G' || {K} END AS parent_group
    FROM lens_sources CROSS JOIN (VALUES ('S2', 'C', 'pivotTable'), ('S2', 'G', 'group'), ('S2', 'K', 'image'), ('S1', 'V', 'card')) v(p, i, t)""")
def _visuals(ctx):
    return layout.layout_visuals(docs(ctx)).select("report_id", "page_id", "visual_id", "visual_type", "parent_group")


@query("layout_fields", f"""
    SELECT {RID}, 'S1' AS page_id, 'V' || {K} AS visual_id, 'projections' AS origin, 0 AS pos, 'Values' AS role, 'f.Amount' AS query_ref, table_name, 'Amount' AS column_name,
        'Measure' AS field_type, 'Amount ' || {K} AS ui_field FROM lens_sources
    UNION ALL SELECT table_id, 'S2', 'C' || {K}, 'commands', 0, 'Rows', 'x.State', table_name, 'State', 'Column', 'State name' FROM lens_sources
    UNION ALL SELECT table_id, 'S2', 'C' || {K}, 'commands', 1, 'Values', 'sum', 'y', 'Price', 'Aggregation (Sum)', 'Price' FROM lens_sources""")
def _fields(ctx):
    return layout.layout_fields(layout.layout_visuals(docs(ctx))).drop("visual_type")


FILTER_ROWS = f"""
    SELECT {RID}, page_id, visual_id, scope, f.no AS filter_no, f.t AS filter_type, f.o AS origin,
        CASE f.no WHEN 0 THEN table_name WHEN 1 THEN 'Stage ' || {K} ELSE '' END AS table_name,
        CASE f.no WHEN 0 THEN 'Region' WHEN 1 THEN 'Sales Stage' ELSE '' END AS column_name, CASE f.no WHEN 2 THEN '' ELSE 'Column' END AS field_type
    FROM (SELECT *, NULL AS page_id, NULL AS visual_id, 'report' AS scope FROM lens_sources
          UNION ALL SELECT *, 'S1', NULL, 'page' FROM lens_sources UNION ALL SELECT *, 'S1', 'V' || {K}, 'visual' FROM lens_sources) s
    CROSS JOIN (VALUES (0, 'Categorical', 'field'), (1, 'Advanced', 'condition'), (2, 'Categorical', 'none')) f(no, t, o)"""


@query("layout_filters", FILTER_ROWS)
def _filters(ctx):
    return layout.layout_filters(docs(ctx))


@query("layout_bookmarks", f"""
    SELECT {RID}, 0 AS pos, 'B' || {K} AS bookmark, 'Mark' AS display_name FROM lens_sources WHERE status = 'F'
    UNION ALL SELECT table_id, v.n, 'T' || CAST(v.n + 1 AS VARCHAR) || '-' || {K}, NULL FROM lens_sources CROSS JOIN (VALUES (0), (1)) v(n) WHERE status = 'O'
    UNION ALL SELECT table_id, 0, 'Q' || {K}, NULL FROM lens_sources WHERE status = 'P'""")
def _bookmarks(ctx):
    return layout.layout_bookmarks(docs(ctx)).select("report_id", "pos", "bookmark", "display_name")


@query("layout_summary", f"""
    SELECT {RID}, 2 AS n_pages, CAST(4 AS BIGINT) AS n_containers, CAST(2 AS BIGINT) AS n_data_visuals, CAST(CASE WHEN status = 'O' THEN 2 ELSE 1 END AS BIGINT) AS n_bookmarks
    FROM lens_sources""")
def _summary(ctx):
    return layout.layout_summary(docs(ctx))


# ---- exported object model ----


def tom_tables(ctx):
    return tom.tom_tables(ctx.lens("lens_tom_tables"))


TOM_TABLES = """
    SELECT model_id, ID AS table_id, Name AS table_name, IsHidden = 1 AS is_hidden, Name LIKE '%DateTableTemplate%' AS is_private,
        coalesce(ShowAsVariationsOnly, 0) = 1 AS variations_only, LineageTag AS lineage_tag FROM lens_tom_tables WHERE SystemFlags IN (0, 2)"""


@query("tom_tables", TOM_TABLES)
def _tom_tables(ctx):
    return tom_tables(ctx)


def tom_columns(ctx):
    return tom.tom_columns(ctx.lens("lens_tom_columns"), tom_tables(ctx))


TOM_COLUMNS = f"""
    SELECT model_id, table_id, column_id, column_name, type_code, CASE type_code WHEN 1 THEN coalesce(nullif(src, ''), column_name) WHEN 4 THEN '[' || column_name || ']' ELSE '' END AS source_column,
        data_type, is_hidden, format_string, lineage_tag, data_category, summarize_by, name_inferred, expression, sort_by
    FROM (SELECT c.model_id, c.TableID AS table_id, c.ID AS column_id, c.Type AS type_code, c.SourceColumn AS src,
            CASE WHEN c.IsNameInferred = 1 THEN coalesce(c.InferredName, c.ExplicitName) ELSE coalesce(c.ExplicitName, c.InferredName) END AS column_name,
            CASE WHEN c.Type IN (1, 4) THEN CASE c.ExplicitDataType WHEN 2 THEN 'string' WHEN 9 THEN 'dateTime' WHEN 10 THEN 'decimal' WHEN 77 THEN 'string' END END AS data_type,
            FALSE AS is_hidden, '' AS format_string, '' AS lineage_tag, '' AS data_category,
            CASE c.SummarizeBy WHEN 2 THEN 'none' WHEN 3 THEN 'sum' WHEN 4 THEN 'min' WHEN 5 THEN 'max' WHEN 6 THEN 'count' WHEN 7 THEN 'average' END AS summarize_by,
            c.IsNameInferred = 1 AS name_inferred, coalesce(c.Expression, '') AS expression, coalesce(s.ExplicitName, '') AS sort_by
          FROM lens_tom_columns c JOIN ({TOM_TABLES}) t ON t.model_id = c.model_id AND t.table_id = c.TableID
          LEFT JOIN lens_tom_columns s ON s.model_id = c.model_id AND s.ID = c.SortByColumnID WHERE c.Type <> 3) x WHERE column_name IS NOT NULL"""


@query("tom_columns", TOM_COLUMNS)
def _tom_columns(ctx):
    return tom_columns(ctx)


def tom_measures(ctx):
    return tom.tom_measures(ctx.lens("lens_tom_measures"), tom_tables(ctx))


TOM_MEASURES = f"""
    SELECT m.model_id, m.TableID AS table_id, m.ID AS measure_id, m.Name AS measure, m.Expression AS expression, coalesce(m.FormatString, '') AS format_string,
        FALSE AS is_hidden, '' AS display_folder, '' AS lineage_tag
    FROM lens_tom_measures m JOIN ({TOM_TABLES}) t ON t.model_id = m.model_id AND t.table_id = m.TableID"""


@query("tom_measures", TOM_MEASURES)
def _tom_measures(ctx):
    return tom_measures(ctx)


def tom_hierarchies(ctx):
    return tom.tom_hierarchies(ctx.lens("lens_tom_hierarchies"), ctx.lens("lens_tom_levels"), ctx.lens("lens_tom_columns"), tom_tables(ctx))


TOM_HIERARCHIES = f"""
    SELECT h.model_id, h.TableID AS table_id, h.ID AS hierarchy_id, h.Name AS hierarchy, h.LineageTag AS hierarchy_tag, l.Ordinal AS ordinal, l.Name AS level,
        CASE WHEN l.Name IS NOT NULL THEN '' END AS level_tag, c.ExplicitName AS column_name
    FROM lens_tom_hierarchies h JOIN ({TOM_TABLES}) t ON t.model_id = h.model_id AND t.table_id = h.TableID
    LEFT JOIN lens_tom_levels l ON l.model_id = h.model_id AND l.HierarchyID = h.ID LEFT JOIN lens_tom_columns c ON c.model_id = h.model_id AND c.ID = l.ColumnID"""


@query("tom_hierarchies", TOM_HIERARCHIES)
def _tom_hierarchies(ctx):
    return tom_hierarchies(ctx)


def tom_variations(ctx):
    return tom.tom_variations(
        ctx.lens("lens_tom_variations"), ctx.lens("lens_tom_columns"), ctx.lens("lens_tom_relationships"),
        ctx.lens("lens_tom_hierarchies"), ctx.lens("lens_tom_tables"),
    )


TOM_VARIATIONS = """
    SELECT v.model_id, v.ID AS variation_id, c.TableID AS table_id, v.ColumnID AS column_id, c.ExplicitName AS owner_column, v.Name AS variation, v.IsDefault = 1 AS is_default,
        r.Name AS relationship, h.Name AS hierarchy, t.Name AS hier_table
    FROM lens_tom_variations v JOIN lens_tom_columns c ON c.model_id = v.model_id AND c.ID = v.ColumnID
    LEFT JOIN lens_tom_relationships r ON r.model_id = v.model_id AND r.ID = v.RelationshipID
    LEFT JOIN lens_tom_hierarchies h ON h.model_id = v.model_id AND h.ID = v.DefaultHierarchyID LEFT JOIN lens_tom_tables t ON t.model_id = h.model_id AND t.ID = h.TableID"""


@query("tom_variations", TOM_VARIATIONS)
def _tom_variations(ctx):
    return tom_variations(ctx)


def tom_relations(ctx):
    return tom.tom_relations(ctx.lens("lens_tom_relationships"), ctx.lens("lens_tom_tables"), ctx.lens("lens_tom_columns"))


TOM_RELATIONS = """
    SELECT r.model_id, r.ID AS relationship_id, coalesce(r.Name, CAST(r.ID AS VARCHAR)) AS relationship, ft.Name AS from_table, coalesce(fc.ExplicitName, fc.InferredName) AS from_column,
        tt.Name AS to_table, coalesce(tc.ExplicitName, tc.InferredName) AS to_column, r.IsActive = 1 AS is_active,
        CASE r.CrossFilteringBehavior WHEN 2 THEN 'bothDirections' ELSE 'oneDirection' END AS cross_filter, FALSE AS date_part_only
    FROM lens_tom_relationships r LEFT JOIN lens_tom_tables ft ON ft.model_id = r.model_id AND ft.ID = r.FromTableID LEFT JOIN lens_tom_columns fc ON fc.model_id = r.model_id AND fc.ID = r.FromColumnID
    LEFT JOIN lens_tom_tables tt ON tt.model_id = r.model_id AND tt.ID = r.ToTableID LEFT JOIN lens_tom_columns tc ON tc.model_id = r.model_id AND tc.ID = r.ToColumnID"""


@query("tom_relations", TOM_RELATIONS)
def _tom_relations(ctx):
    return tom_relations(ctx)


def tom_partitions(ctx):
    return tom.tom_partitions(ctx.lens("lens_tom_partitions"), tom_tables(ctx))


PARTITION_NAME = "coalesce(nullif(p.Name, ''), sha1(CAST(p.model_id AS VARCHAR) || '|' || CAST(p.TableID AS VARCHAR) || '|' || CAST(p.ID AS VARCHAR)))"
TOM_PARTITIONS = f"""
    SELECT p.model_id, p.TableID AS table_id, p.ID AS partition_id, {PARTITION_NAME} AS partition, CASE p.Type WHEN 2 THEN 'calculated' ELSE 'm' END AS kind,
        CASE WHEN p.Mode = 1 THEN 'directQuery' ELSE 'import' END AS mode, p.QueryDefinition AS source
    FROM lens_tom_partitions p JOIN ({TOM_TABLES}) t ON t.model_id = p.model_id AND t.table_id = p.TableID WHERE p.Type IN (2, 4)"""


@query("tom_partitions", TOM_PARTITIONS)
def _tom_partitions(ctx):
    return tom_partitions(ctx)


def tom_roles(ctx):
    return tom.tom_roles(ctx.lens("lens_tom_permissions"), ctx.lens("lens_tom_roles"), ctx.lens("lens_tom_tables"))


TOM_ROLES = """
    SELECT p.model_id, r.Name AS role, r.Description AS description, t.Name AS table_name, p.FilterExpression AS filter_expression FROM lens_tom_permissions p
    JOIN lens_tom_roles r ON r.model_id = p.model_id AND r.ID = p.RoleID JOIN lens_tom_tables t ON t.model_id = p.model_id AND t.ID = p.TableID"""


@query("tom_roles", TOM_ROLES)
def _tom_roles(ctx):
    return tom_roles(ctx)


def annotations(ctx):
    return tom.tom_annotations(ctx.lens("lens_tom_annotations"))


TOM_ANNOTATIONS = """
    SELECT model_id, CASE ObjectType WHEN 3 THEN 'table' WHEN 4 THEN 'column' END AS object_kind, ObjectType AS object_type, CAST(ObjectID AS BIGINT) AS object_id, Name AS name, Value AS value
    FROM lens_tom_annotations"""


@query("tom_annotations", TOM_ANNOTATIONS)
def _tom_annotations(ctx):
    return annotations(ctx)


@query("annotation_lists", f"""
    SELECT model_id, object_kind, object_type, object_id, name, value,
        row_number() OVER (PARTITION BY model_id, object_type, object_id ORDER BY name, value) AS position
    FROM ({TOM_ANNOTATIONS}) a""")
def _annotation_lists(ctx):
    return tom.annotation_lists(annotations(ctx))


# ---- rendered text ----

NL = "chr(10)"


def q(name: str) -> str:
    return f"CASE WHEN {name} LIKE '% %' OR contains({name}, chr(39)) THEN chr(39) || replace({name}, chr(39), chr(39) || chr(39)) || chr(39) ELSE {name} END"


def line(prefix: str, value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{prefix}' || {value} || {NL} ELSE '' END"


def flag(word: str, test: str) -> str:
    return f"CASE WHEN {test} THEN '{word}' || {NL} ELSE '' END"


NOTES_OF = "SELECT model_id, object_id, string_agg({nl} || '\t\tannotation ' || name || ' = ' || value || {nl}, '' ORDER BY name || '=' || value) AS notes FROM (" + TOM_ANNOTATIONS + ") a WHERE object_kind = '{kind}' GROUP BY model_id, object_id"
TABLE_NOTES = f"SELECT model_id, object_id, string_agg('\tannotation ' || name || ' = ' || value || {NL} || {NL}, '' ORDER BY name || '=' || value) AS notes FROM ({TOM_ANNOTATIONS}) a WHERE object_kind = 'table' GROUP BY model_id, object_id"
RENDERED = f"""
    WITH t AS ({TOM_TABLES}),
    m AS (SELECT model_id, table_id, string_agg('\tmeasure ' || {q('measure')} || ' =' || CASE WHEN contains(expression, {NL})
            THEN {NL} || '\t\t```' || {NL} || '\t\t' || replace(expression, {NL}, {NL} || '\t\t') || {NL} || '\t\t```' ELSE ' ' || expression END || {NL}
            || {line('	' + '	' + 'formatString: ', 'format_string')} || {NL}, '' ORDER BY measure_id) AS body FROM ({TOM_MEASURES}) m GROUP BY model_id, table_id),
    v AS (SELECT model_id, column_id, string_agg({NL} || '\t\tvariation ' || variation || {NL} || '\t\t\tisDefault' || {NL} || {line('			relationship: ', 'relationship')}
            || '\t\t\tdefaultHierarchy: ' || {q('hier_table')} || '.' || {q('hierarchy')} || {NL}, '' ORDER BY variation_id) AS body FROM ({TOM_VARIATIONS}) v GROUP BY model_id, column_id),
    cn AS ({NOTES_OF.format(nl=NL, kind='column')}),
    c AS (SELECT c.model_id, c.table_id, string_agg('\tcolumn ' || {q('column_name')} || CASE WHEN type_code = 2 THEN ' = ' || expression ELSE '' END || {NL}
            || {line('		dataType: ', 'data_type')} || {line('		summarizeBy: ', 'summarize_by')} || {flag('		isNameInferred', 'name_inferred')}
            || {line('		sourceColumn: ', 'source_column')} || {line('		sortByColumn: ', 'sort_by')} || coalesce(v.body, '') || coalesce(cn.notes, '') || {NL}, '' ORDER BY c.column_id) AS body
          FROM ({TOM_COLUMNS}) c LEFT JOIN v ON v.model_id = c.model_id AND v.column_id = c.column_id LEFT JOIN cn ON cn.model_id = c.model_id AND cn.object_id = c.column_id
          GROUP BY c.model_id, c.table_id),
    h AS (SELECT model_id, table_id, '\thierarchy ' || {q('max(hierarchy)')} || {NL} || '\t\tlineageTag: ht' || {NL}
            || string_agg(CASE WHEN level IS NULL THEN '' ELSE {NL} || '\t\tlevel ' || {q('level')} || {NL} || CASE WHEN column_name IS NULL THEN '' ELSE '\t\t\tcolumn: ' || {q('column_name')} || {NL} END END, '' ORDER BY ordinal)
            || {NL} AS body FROM ({TOM_HIERARCHIES}) h GROUP BY model_id, table_id, hierarchy_id),
    p AS (SELECT model_id, table_id, '\tpartition ' || partition || ' = ' || kind || {NL} || '\t\tmode: ' || mode || {NL}
            || CASE WHEN kind = 'm' THEN '\t\tsource =' || {NL} || '\t\t\t' ELSE '\t\tsource = ' END || replace(source, {NL}, {NL} || '\t\t\t') || {NL} || {NL} AS body FROM ({TOM_PARTITIONS}) p),
    n AS ({TABLE_NOTES})
    SELECT t.model_id, 'tables/' || t.table_name || '.tmdl' AS path,        'table ' || {q('t.table_name')} || {NL} || {flag('	isHidden', 'is_hidden')} || {flag('	isPrivate', 'is_private')} || {flag('	showAsVariationsOnly', 'variations_only')}
        || '\tlineageTag: ' || lineage_tag || {NL} || {NL} || coalesce(m.body, '') || coalesce(c.body, '') || coalesce(h.body, '') || coalesce(p.body, '') || coalesce(n.notes, '') AS content
    FROM t LEFT JOIN m ON m.model_id = t.model_id AND m.table_id = t.table_id LEFT JOIN c ON c.model_id = t.model_id AND c.table_id = t.table_id
    LEFT JOIN h ON h.model_id = t.model_id AND h.table_id = t.table_id LEFT JOIN p ON p.model_id = t.model_id AND p.table_id = t.table_id
    LEFT JOIN n ON n.model_id = t.model_id AND n.object_id = t.table_id"""


def table_parts(ctx):
    return render.table_file_parts(
        tom_tables(ctx), tom_measures(ctx), tom_columns(ctx), tom_hierarchies(ctx), tom_variations(ctx),
        tom_partitions(ctx), annotations(ctx),
    )


@query("render_model_text", RENDERED)
def _render(ctx):
    return render.assemble(table_parts(ctx))


@query("render_relations_text", f"""
    SELECT model_id, 'relationships.tmdl' AS path, string_agg('relationship ' || relationship || {NL}
        || {flag('	crossFilteringBehavior: bothDirections', "cross_filter = 'bothDirections'")} || {flag('	isActive: false', 'NOT is_active')}
        || CASE WHEN from_column IS NULL THEN '' ELSE '\tfromColumn: ' || {q('from_table')} || '.' || {q('from_column')} || {NL} END
        || CASE WHEN to_column IS NULL THEN '' ELSE '\ttoColumn: ' || {q('to_table')} || '.' || {q('to_column')} || {NL} END || {NL}, '' ORDER BY relationship_id, relationship) AS content
    FROM ({TOM_RELATIONS}) r GROUP BY model_id""")
def _render_relations(ctx):
    return render.assemble(render.relation_parts(tom_relations(ctx)))


@query("render_roles_text", f"""
    SELECT model_id, 'roles/' || role || '.tmdl' AS path, 'role ' || {q('role')} || {NL} || '\tdescription: ' || max(description) || {NL} || {NL}
        || string_agg('\ttablePermission ' || {q('table_name')} || {NL} || '\t\tfilterExpression = ' || filter_expression || {NL} || {NL}, '' ORDER BY table_name) AS content
    FROM ({TOM_ROLES}) r GROUP BY model_id, role""")
def _render_roles(ctx):
    return render.assemble(render.role_parts(tom_roles(ctx)))


@query("render_stubs_text", f"""
    SELECT model_id, 'model.tmdl' AS path, 'model Model' || {NL} || '\tculture: en-US' || {NL} || '\tdefaultPowerBIDataSourceVersion: powerBI_V3' || {NL}
        || '\tsourceQueryCulture: en-US' || {NL} || {NL} || string_agg('ref table ' || {q('table_name')} || {NL}, '' ORDER BY table_id) || {NL} AS content FROM ({TOM_TABLES}) t GROUP BY model_id
    UNION ALL SELECT DISTINCT model_id, 'database.tmdl', 'database' || {NL} || '\tcompatibilityLevel: 1600' || {NL} FROM ({TOM_TABLES}) t""")
def _stubs(ctx):
    return render.assemble(render.model_parts(tom_tables(ctx)))


@query("render_round_trip", f"""
    SELECT model_id, table_name, column_name, CASE WHEN type_code = 2 THEN '' ELSE source_column END AS source_column, type_code = 2 AS calculated
    FROM ({TOM_COLUMNS}) c JOIN (SELECT model_id AS tm, table_id AS ti, table_name FROM ({TOM_TABLES}) x) t ON tm = c.model_id AND ti = c.table_id""")
def _round_trip(ctx):
    files = render.assemble(table_parts(ctx))
    return tp.parse_columns(tp.blocks(files)).select("model_id", "table_name", "column_name", "source_column", "calculated")
