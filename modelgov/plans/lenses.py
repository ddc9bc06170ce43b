"""Lenses: the warehouse tables seen as model and report metadata.

Each lens is portable SQL over whole tables, so that Spark and the checking engine build the
same relation: a customer is a model (and its report), an order is a model table, the parts of
its lines are the table's columns, lines still open are uses of a column in a report.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def text(template: str, **exprs: str) -> str:
    """SQL string expression from a template with «name» slots."""
    out = []
    for i, piece in enumerate(re.split(r"«(\w+)»", template)):
        if i % 2:
            out.append(f"({exprs[piece]})")
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def json_string(expr: str) -> str:
    """SQL expression: ``expr`` escaped for use inside a JSON string."""
    return f"replace(replace({expr}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"


TABLE_NAME = "o_orderpriority || ' ' || CAST(o_orderkey AS STRING)"

# Blocks of a model file; the checks reuse them as text.
TOTAL_BLOCK = """	measure 'Total «k»' = SUM('«t»'[Price]) + [Base «k»]
		formatString: 0
		lineageTag: m1-«k»

"""
BASE_BLOCK = """	measure 'Base «k»' =
			```
			VAR x = SUM(Facts[Qty]) -- Old[Gone]

			RETURN [Price] + x /* Dead[Ref] */ & "[Text]"
			```
		lineageTag: m2-«k»

		annotation PBI_FormatHint = {"isGeneralNumber":true}

"""
PRICE_BLOCK = """	column Price
		dataType: decimal
		sourceColumn: price_«st»
		sortByColumn: 'Sort Key'

"""
SORT_BLOCK = """	column 'Sort Key'
		dataType: int64
		sourceColumn: Sort Key

"""
CALC_BLOCK = """	column 'It''s «k»' = [Price] * Facts[Rate]
		lineageTag: c3-«k»

		variation Variation
			isDefault
			defaultHierarchy: '«hub»'.'Date Levels'

		annotation __PBI_SemanticLinks = «link»

"""
LEVELS_BLOCK = """	hierarchy 'Date Levels'
		lineageTag: h1-«k»

		level Price
			column: Price

		level 'Sort Key'
			column: 'Sort Key'

"""
TAIL_BLOCKS = """	partition p«k» = m
		mode: import
		source = Source

	annotation PBI_Id = «k»
"""
SLOTS = {
    "t": "table_name", "k": s("table_id"), "st": "status", "hub": "hub_name",
    "only": "CASE WHEN status = 'P' THEN chr(9) || 'showAsVariationsOnly' || chr(10) ELSE '' END",
    "link": "CASE status WHEN 'F' THEN "
    + text('[{"LinkTarget":{"TableName":"«hub»","TableItemName":"Price"}},{"Other":1}]', hub="hub_name")
    + " WHEN 'O' THEN "
    + text('{"LinkTarget":{"TableName":"«t»","TableItemName":"Sort Key"}}', t="table_name")
    + " ELSE 'not json' END",
}
HEAD_BLOCK = """table '«t»'
	lineageTag: tag-«k»
«only»
"""
MODEL_FILE = text(
    HEAD_BLOCK + TOTAL_BLOCK + BASE_BLOCK + PRICE_BLOCK + SORT_BLOCK + CALC_BLOCK + LEVELS_BLOCK + TAIL_BLOCKS, **SLOTS
)

RELATIONS_FILE = text(
    """relationship r1-«k»
	joinOnDateBehavior: datePartOnly
«both»	fromColumn: '«t»'.'Sort Key'
	toColumn: '«hub»'.Price

relationship r2-«k»
	isActive: false
	fromColumn: '«t»'.Price
	toColumn: Facts_«k».[Some Key]
""",
    t="table_name", k=s("table_id"), hub="hub_name",
    both="CASE WHEN status = 'F' THEN chr(9) || 'crossFilteringBehavior: bothDirections' || chr(10) ELSE '' END",
)

ROLE_FILE = text(
    """role 'Readers «k»'
	modelPermission: read

	tablePermission '«t»' = [Region] = "East"

	tablePermission Facts_«st»
		filterExpression = [Owner] = USERNAME()

	tablePermission Open_«st»
""",
    t="table_name", k=s("table_id"), st="status",
)


def _column(entity: str, prop: str, key: str = "Column", source: str = "Entity") -> str:
    return f'{{"{key}":{{"Expression":{{"SourceRef":{{"{source}":"{entity}"}}}},"Property":"{prop}"}}}}'


VISUAL_FILE = text(
    '{"name":"V«k»","visual":{"visualType":"«vt»","query":{"queryState":{'
    '"Values":{"projections":[{"field":' + _column("«t»", "Total «k»", "Measure") + ',"queryRef":"T.Total"«shown»},'
    '{"field":{"Aggregation":{"Expression":' + _column("«t»", "Price") + ',"Function":1}},"queryRef":"avg"}]},'
    '"Rows":{"projections":[{"field":{"HierarchyLevel":{"Expression":{"Hierarchy":{"Expression":{"SourceRef":{"Entity":"«t»"}},'
    '"Hierarchy":"Date Levels"}},"Level":"Sort Key"}}},'
    '{"field":{"HierarchyLevel":{"Expression":{"Hierarchy":{"Expression":{"PropertyVariationSource":'
    '{"Expression":{"SourceRef":{"Entity":"«t»"}},"Name":"Variation","Property":"Price"}},"Hierarchy":"Date Levels"}},"Level":"Year"}}}]},'
    '"Category":{"projections":[{"field":' + _column("Wrong «k»", "SORT KEY") + "}]},"
    '"Extra":{"projections":[{"field":' + _column("«t»", "Missing «k»") + '},{"field":{"Unknown":{}}}]}}}«title»},'
    '"filterConfig":{"filters":[{"field":' + _column("«t»", "Price") + '},{"field":' + _column("«t»", "Base «k»", "Measure")
    + '},{"field":' + _column("«hub»", "Sort Key") + "}]}}",
    k=s("table_id"), t="table_name", hub="hub_name",
    vt="CASE priority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'pivotTable' WHEN '3-MEDIUM' THEN 'slicer' "
       "WHEN '4-NOT SPECIFIED' THEN 'customTreeMap' ELSE 'textbox' END",
    shown="CASE WHEN status = 'O' THEN " + text(',"displayName":"Shown «k»"', k=s("table_id")) + " ELSE '' END",
    title="CASE WHEN status = 'F' THEN " + text(
        ',"visualContainerObjects":{"title":[{"properties":{"show":{}}},{"properties":{"text":{"expr":{"Literal":{"Value":"\'Sales «k»\'"}}}}}]}',
        k=s("table_id")) + " ELSE '' END",
)

PAGE_FILE = text(
    '{"name":"P«c»"«shown»,"filterConfig":{"filters":[{"field":' + _column("«hub»", "Price")
    + '},{"field":' + _column("«hub»", "Base «hk»", "Measure") + "}]}}",
    c=s("c_custkey"), hub="coalesce(hub_name, 'none')", hk=s("coalesce(hub_id, -1)"),
    shown="CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE " + text(',"displayName":"«n»"', n="c_name") + " END",
)

REPORT_FILE = text(
    '{"themeCollection":{},"filterConfig":{"filters":[{"field":' + _column("«hub»", "Sort Key")
    + '},{"field":{"Aggregation":{"Expression":' + _column("«seg»", "Price") + ',"Function":9}}}]}}',
    hub="coalesce(hub_name, 'none')", seg="c_mktsegment",
)

# Legacy layout: strings of JSON inside JSON.
_LAYOUT_VISUAL = text(
    '{"name":"V«k»","singleVisual":{"visualType":"card","projections":{"Values":[{"queryRef":"f.Amount","active":true},{"queryRef":"f.Gone"}]},'
    '"prototypeQuery":{"From":[{"Name":"f","Entity":"«t»"}],"Select":[' + _column("f", "Amount", "Measure", "Source")[:-1]
    + ',"Name":"f.Amount","nativeQueryRef":"Amount"}]},"columnProperties":{"f.Amount":{"displayName":"Amount «k»"}}}}',
    k=s("table_id"), t="table_name",
)
_LAYOUT_COMMANDS = text(
    '{"name":"C«k»","singleVisual":{"visualType":"pivotTable","query":{"Commands":[{"SemanticQueryDataShapeCommand":{"Query":'
    '{"From":[{"Name":"x","Entity":"«t»"}],"Select":[' + _column("x", "State", source="Source")[:-1] + ',"Name":"x.State","nativeQueryRef":"State name"},'
    '{"Aggregation":{"Expression":' + _column("y", "Price", source="Source") + ',"Function":0},"Name":"sum"}]}}}]}}}',
    k=s("table_id"), t="table_name",
)
_LAYOUT_CHILD = text('{"name":"K«k»","singleVisual":{"visualType":"image"}}', k=s("table_id"))
_LAYOUT_GROUP = text(
    '{"name":"G«k»","singleVisualGroup":{"displayName":"Group","children":[{"config":"«child»"}]}}',
    k=s("table_id"), child=json_string(_LAYOUT_CHILD),
)
_LAYOUT_FILTERS = text(
    '[{"expression":' + _column("a", "Region", source="Source") + ',"filter":{"From":[{"Name":"a","Entity":"«t»"}]}},'
    '{"filter":{"From":[{"Name":"s","Entity":"Stage «k»"}],"Where":[{"Condition":{"Exists":{}}},{"Condition":{"Not":{"Expression":{"And":{"Left":{"In":{"Expressions":['
    + _column("s", "Sales Stage", source="Source") + ']}},"Right":{}}}}}}]},"type":"Advanced"},{"name":"empty"}]',
    t="table_name", k=s("table_id"),
)
_LAYOUT_CONFIG = text('{"bookmarks":[{"name":"B«k»","displayName":"Mark"}]}', k=s("table_id"))
LAYOUT_FILE = text(
    '{"config":"«config»","filters":"«filters»","bookmarks":«top»,"sections":['
    '{"name":"S2","ordinal":2,"displayName":"Second «k»","config":"{}","visualContainers":[{"config":"«commands»"},{"config":"«group»"},{"config":"broken"}]},'
    '{"name":"S1","config":"«binding»","filters":"«filters»","visualContainers":[{"config":"«visual»","filters":"«filters»"}]}]}',
    k=s("table_id"), config=f"CASE WHEN status = 'F' THEN {json_string(_LAYOUT_CONFIG)} ELSE '{{}}' END",
    filters=json_string(_LAYOUT_FILTERS), commands=json_string(_LAYOUT_COMMANDS), group=json_string(_LAYOUT_GROUP),
    visual=json_string(_LAYOUT_VISUAL), binding=json_string("'{\"pageBinding\":{\"type\":\"Drillthrough\"}}'"),
    top="CASE status WHEN 'O' THEN " + text('[{"name":"T1-«k»"},{"name":"T2-«k»"}]', k=s("table_id"))
        + " WHEN 'P' THEN " + text('"«q»"', q=json_string(text('[{"name":"Q«k»"}]', k=s("table_id")))) + " ELSE 'null' END",
)

LENSES: dict[str, str] = {
    # --- models, tables, columns ---
    "lens_tables": f"SELECT o_custkey AS model_id, o_orderkey AS table_id, {TABLE_NAME} AS table_name FROM orders",
    "lens_columns": f"""
        SELECT o_custkey AS model_id, o_orderkey AS table_id, {TABLE_NAME} AS table_name, p_name AS column_name,
               CAST(o_orderkey AS STRING) || '-' || p_name AS column_id,
               CASE min(p_type) WHEN 'PROMO' THEN '[Measure]' WHEN 'ECONOMY' THEN ''
                    ELSE 'src_' || CAST(min(p_partkey) AS STRING) END AS source_column
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY o_custkey, o_orderkey, o_orderpriority, p_name""",
    # measure-only tables get a generated column; an imported column of that name is another matter
    "lens_value_columns": f"""
        SELECT model_id, table_name, column_name, source_column FROM lens_columns
        UNION ALL SELECT o_custkey, {TABLE_NAME}, CASE WHEN o_orderstatus = 'P' THEN 'Value' ELSE ' Value ' END,
            CASE WHEN o_orderstatus = 'F' THEN 'Value' ELSE '[Value]' END FROM orders""",
    "lens_hub_ids": "SELECT o_custkey AS model_id, min(o_orderkey) AS hub_id FROM orders GROUP BY o_custkey",
    "lens_hubs": """
        SELECT t.model_id, t.table_id AS hub_id, t.table_name AS hub_name
        FROM lens_tables t JOIN lens_hub_ids h ON t.model_id = h.model_id AND t.table_id = h.hub_id""",
    "lens_ends": """
        SELECT model_id, table_id, table_name, min(column_name) AS first_column, max(column_name) AS last_column
        FROM lens_columns GROUP BY model_id, table_id, table_name""",
    "lens_firsts": """
        SELECT o_custkey AS model_id, o_orderpriority AS priority, min(o_orderkey) AS first_id
        FROM orders GROUP BY o_custkey, o_orderpriority""",
    "lens_arrows": """
        SELECT o_custkey AS model_id, o_orderkey AS from_id, first_id AS to_id,
               CASE WHEN o_orderstatus = 'F' THEN 'bothDirections' ELSE 'oneDirection' END AS cross_filter,
               o_orderstatus <> 'P' AS is_active
        FROM orders JOIN lens_firsts f ON o_custkey = f.model_id AND o_orderpriority = f.priority
        WHERE o_orderkey <> first_id
        UNION ALL
        SELECT f.model_id, first_id, hub_id,
               CASE WHEN priority = '1-URGENT' THEN 'bothDirections' ELSE 'oneDirection' END, TRUE
        FROM lens_firsts f JOIN lens_hub_ids h ON f.model_id = h.model_id WHERE first_id <> hub_id""",
    "lens_relations": """
        SELECT a.model_id, a.from_id AS from_table_id, CAST(a.from_id AS STRING) || '-' || f.first_column AS from_column_id,
               a.to_id AS to_table_id, CAST(a.to_id AS STRING) || '-' || t.last_column AS to_column_id, a.cross_filter, a.is_active
        FROM lens_arrows a JOIN lens_ends f ON a.model_id = f.model_id AND a.from_id = f.table_id
        JOIN lens_ends t ON a.model_id = t.model_id AND a.to_id = t.table_id""",
    "lens_relation_names": """
        SELECT a.model_id, f.table_name AS from_table, f.first_column AS from_column, t.table_name AS to_table,
               t.last_column AS to_column
        FROM lens_arrows a JOIN lens_ends f ON a.model_id = f.model_id AND a.from_id = f.table_id
        JOIN lens_ends t ON a.model_id = t.model_id AND a.to_id = t.table_id""",
    # --- uses in reports: open order lines ---
    "lens_usage": f"""
        SELECT o_custkey AS model_id, CAST(year(l_shipdate) AS INT) AS report_id,
               'Page ' || CAST(month(l_shipdate) AS STRING) AS page_name,
               CASE WHEN l_linenumber = 2 THEN hub_name ELSE {TABLE_NAME} END AS table_name,
               CASE l_linenumber WHEN 3 THEN 'Ghost ' || CAST(l_suppkey AS STRING) WHEN 4 THEN p_name || ',  ' || upper(p_name)
                    WHEN 5 THEN ' ' || replace(p_name, ' ', '  ') || ' ?' ELSE p_name END AS column_names,
               p_name AS ui_field,
               CASE l_returnflag WHEN 'R' THEN 'Slicer'
                    WHEN 'A' THEN CASE WHEN p_type = 'PROMO' THEN 'Visual Value, Filter (Measure)' ELSE 'Visual Value' END
                    ELSE 'Page Filter' END AS usage_label,
               CASE WHEN p_type = 'PROMO' THEN 'SUM([x])' WHEN p_type = 'SMALL' THEN ' ' END AS formula,
               CASE WHEN l_linestatus = 'O' THEN 'valid' ELSE 'dropped' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN lens_hubs h ON h.model_id = o_custkey""",
    # --- protections and structure ---
    "lens_security": f"SELECT o_custkey AS model_id, ' ' || upper({TABLE_NAME}) AS table_name FROM orders WHERE o_totalprice > 450000",
    "lens_detected": f"SELECT o_custkey AS model_id, {TABLE_NAME} AS table_name FROM orders WHERE o_totalprice > 480000 OR o_totalprice < 5000",
    "lens_views": f"""
        SELECT o_custkey AS model_id, CASE WHEN l_discount = 0.0 THEN NULL ELSE {TABLE_NAME} END AS table_name, upper(p_name) || ' ' AS column_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_tax = 0.08""",
    "lens_levels": f"""
        SELECT DISTINCT o_custkey AS model_id, {TABLE_NAME} AS table_name, 'By ' || l_returnflag AS hierarchy, p_name AS column_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "lens_variations": """
        SELECT c.model_id, c.table_name, c.column_name, 'Variation' AS variation, h.hub_name AS hier_table, 'By R' AS hierarchy
        FROM lens_columns c JOIN lens_hubs h ON c.model_id = h.model_id WHERE c.column_name LIKE 'old%'""",
    "lens_sort_by": """
        SELECT c.model_id, c.table_name, c.column_name, e.first_column AS sort_column
        FROM lens_columns c JOIN lens_ends e ON c.model_id = e.model_id AND c.table_id = e.table_id
        WHERE c.column_name <> e.first_column AND c.column_name LIKE '%ring'""",
    "lens_links": """
        SELECT c.model_id, c.table_name, c.column_name, e.table_name AS target_table, e.last_column AS target_column
        FROM lens_columns c JOIN lens_hub_ids h ON c.model_id = h.model_id
        JOIN lens_ends e ON e.model_id = h.model_id AND e.table_id = h.hub_id WHERE c.source_column = ''""",
    "lens_owner_refs": """
        SELECT c.model_id, c.table_name, c.column_name AS name, e.table_name AS ref_table, upper(e.last_column) AS ref_column
        FROM lens_columns c JOIN lens_ends e ON c.model_id = e.model_id AND c.table_id = e.table_id
        WHERE c.source_column IN ('', '[Measure]') AND c.column_name <> e.last_column""",
    # --- definition text ---
    "lens_sources": f"""
        SELECT o_custkey AS model_id, o_orderkey AS table_id, {TABLE_NAME} AS table_name, o_orderstatus AS status,
               o_orderpriority AS priority, o_totalprice AS price, hub_id, hub_name
        FROM orders JOIN lens_hubs h ON h.model_id = o_custkey""",
    "lens_files": f"SELECT model_id, 'tables/' || table_name || '.tmdl' AS path, {MODEL_FILE} AS content FROM lens_sources",
    "lens_raw_files": """
        SELECT model_id, path, CASE WHEN model_id < table_id THEN replace(content, chr(10), chr(13) || chr(10)) ELSE content END AS content
        FROM (SELECT model_id, path, content, length(content) AS table_id FROM lens_files) f""",
    "lens_relation_files": f"SELECT model_id, table_id, 'relationships.tmdl' AS path, {RELATIONS_FILE} AS content FROM lens_sources",
    "lens_role_files": f"SELECT model_id, 'roles/r.tmdl' AS path, {ROLE_FILE} AS content FROM lens_sources",
    # --- report JSON ---
    "lens_visual_files": f"""
        SELECT model_id, model_id AS report_id, 'P' || CAST(model_id AS STRING) AS page_id, 'V' || CAST(table_id AS STRING) AS visual_id,
               {VISUAL_FILE} AS content FROM lens_sources""",
    "lens_page_files": f"""
        SELECT c_custkey AS model_id, c_custkey AS report_id, 'P' || CAST(c_custkey AS STRING) AS page_id, {PAGE_FILE} AS content
        FROM customer LEFT JOIN lens_hubs h ON h.model_id = c_custkey""",
    "lens_report_files": f"""
        SELECT c_custkey AS model_id, c_custkey AS report_id, {REPORT_FILE} AS content
        FROM customer LEFT JOIN lens_hubs h ON h.model_id = c_custkey""",
    "lens_layouts": f"SELECT table_id AS report_id, {LAYOUT_FILE} AS layout_json FROM lens_sources",
    # --- exported object model ---
    "lens_tom_tables": f"""
        SELECT o_custkey AS model_id, o_orderkey AS ID,
               CASE WHEN o_orderstatus = 'P' THEN 'DateTableTemplate_' || CAST(o_orderkey AS STRING) ELSE {TABLE_NAME} END AS Name,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS IsHidden, CASE WHEN o_orderstatus = 'P' THEN 1 END AS ShowAsVariationsOnly,
               'tag' || CAST(o_orderkey AS STRING) AS LineageTag, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS SystemFlags
        FROM orders""",
    "lens_tom_columns": """
        SELECT o_custkey AS model_id, l_orderkey * 10 + l_linenumber AS ID, l_orderkey AS TableID,
               CASE WHEN min(l_returnflag) = 'A' THEN NULL ELSE 'Col ' || CAST(l_linenumber AS STRING) END AS ExplicitName,
               CASE WHEN min(l_linestatus) = 'F' THEN 'inf_' || CAST(l_linenumber AS STRING) END AS InferredName,
               CASE WHEN min(l_returnflag) = 'N' THEN 1 ELSE 0 END AS IsNameInferred,
               CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END AS Type,
               CASE l_linenumber WHEN 1 THEN 2 WHEN 4 THEN 9 WHEN 5 THEN 10 WHEN 6 THEN 77 END AS ExplicitDataType,
               CASE l_linenumber WHEN 5 THEN 'src5' WHEN 6 THEN '' END AS SourceColumn,
               CASE l_linenumber WHEN 2 THEN '[A] * ' || CAST(min(l_partkey) AS STRING) END AS Expression,
               l_linenumber AS SummarizeBy,
               CASE WHEN l_linenumber IN (5, 7) THEN l_orderkey * 10 + 4 END AS SortByColumnID
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber""",
    "lens_tom_measures": """
        SELECT o_custkey AS model_id, l_orderkey * 10 + l_linenumber AS ID, l_orderkey AS TableID, 'M' || CAST(l_linenumber AS STRING) || ' ' || CAST(l_orderkey AS STRING) AS Name,
               CASE WHEN l_linenumber = 7 THEN 'VAR x = 1' || chr(10) || 'RETURN x' ELSE 'SUM([' || CAST(min(l_partkey) AS STRING) || '])' END AS Expression,
               CASE WHEN l_linenumber = 6 THEN '0.00' END AS FormatString
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber""",
    "lens_tom_hierarchies": "SELECT o_custkey AS model_id, o_orderkey AS ID, o_orderkey AS TableID, 'Levels ' || o_orderstatus AS Name, 'ht' AS LineageTag FROM orders",
    # levels of closed lines belong to a hierarchy that was not exported
    "lens_tom_levels": """
        SELECT o_custkey AS model_id, CASE WHEN l_linestatus = 'O' THEN l_orderkey ELSE -1 - l_orderkey END AS HierarchyID, l_linenumber AS Ordinal, 'Level ' || CAST(l_linenumber AS STRING) AS Name,
               l_orderkey * 10 + l_linenumber AS ColumnID
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber, l_linestatus""",
    "lens_tom_relationships": """
        SELECT model_id, from_id AS ID, CASE WHEN is_active THEN 'rel' || CAST(from_id AS STRING) END AS Name, from_id AS FromTableID, from_id * 10 + 1 AS FromColumnID,
               to_id AS ToTableID, to_id * 10 + 4 AS ToColumnID, CASE WHEN is_active THEN 1 ELSE 0 END AS IsActive,
               CASE WHEN cross_filter = 'bothDirections' THEN 2 ELSE 1 END AS CrossFilteringBehavior
        FROM lens_arrows""",
    "lens_tom_variations": """
        SELECT model_id, from_id AS ID, from_id * 10 + 1 AS ColumnID, 'Variation' AS Name, 1 AS IsDefault,
               CASE WHEN is_active THEN from_id END AS RelationshipID, to_id AS DefaultHierarchyID
        FROM lens_arrows""",
    "lens_tom_partitions": """
        SELECT o_custkey AS model_id, o_orderkey AS ID, o_orderkey AS TableID, CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'part' || CAST(o_orderkey AS STRING) END AS Name,
               CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 4 ELSE 1 END AS Type, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS Mode,
               'let' || chr(10) || 'Source' AS QueryDefinition
        FROM orders""",
    "lens_tom_roles": "SELECT c_custkey AS model_id, c_nationkey AS ID, c_mktsegment AS Name, c_name AS Description FROM customer",
    "lens_tom_permissions": """
        SELECT o_custkey AS model_id, o_orderkey AS TableID, c_nationkey AS RoleID, '[Owner] = ' || o_orderstatus AS FilterExpression
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000""",
    "lens_tom_annotations": """
        SELECT o_custkey AS model_id, l_linenumber AS ObjectType, CAST(l_orderkey AS STRING) AS ObjectID, 'note' || CAST(l_suppkey AS STRING) AS Name, l_returnflag AS Value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}

# The same relations as Spark builds them at scale; the statements above stay what they are checked with.
# Lines meet their parts first and their orders last, so that grouping by order needs no further shuffle.  Levels
# are the groups of order, priority and flag: a table's name ends with its order's number, so no two
# orders share one.
SCALED = {
    # the names of an order's lines by flag, as columns and levels take them
    "lens_named": f"""
        SELECT o_custkey, o_orderkey AS table_id, {TABLE_NAME} AS table_name, l_returnflag, p_name, min(p_type) AS p_type, min(p_partkey) AS p_partkey
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, o_orderkey, o_orderpriority, l_returnflag, p_name""",
    "lens_columns": """
        SELECT o_custkey AS model_id, table_id, table_name, p_name AS column_name, CAST(table_id AS STRING) || '-' || p_name AS column_id,
               CASE min(p_type) WHEN 'PROMO' THEN '[Measure]' WHEN 'ECONOMY' THEN ''
                    ELSE 'src_' || CAST(min(p_partkey) AS STRING) END AS source_column
        FROM lens_named GROUP BY o_custkey, table_id, table_name, p_name""",
    "lens_levels": """
        SELECT o_custkey AS model_id, table_name, 'By ' || l_returnflag AS hierarchy, p_name AS column_name FROM lens_named""",
    # the hub's ends are met before the columns are
    "lens_links": """
        SELECT c.model_id, c.table_name, c.column_name, e.table_name AS target_table, e.last_column AS target_column
        FROM (SELECT e.model_id, e.table_name, e.last_column FROM lens_ends e JOIN lens_hub_ids h ON e.model_id = h.model_id AND e.table_id = h.hub_id) e
        JOIN lens_columns c ON c.model_id = e.model_id WHERE c.source_column = ''""",
}
# Lenses that come dealt by the number of the order.
DEALT_LENSES = {"lens_named", "lens_columns"}


def needed(sql: str, given: tuple[str, ...] = (), forms: dict[str, str] | None = None) -> list[str]:
    """Lenses a statement uses, dependencies first; ``given`` ones are left out, ``forms`` replace some."""
    out: list[str] = []
    known = LENSES | (forms or {})

    def visit(name: str) -> None:
        if name in out or name in given:
            return
        for other in sorted(set(re.findall(r"\blens_\w+", known[name])) - {name}):
            visit(other)
        out.append(name)

    for name in sorted(set(re.findall(r"\blens_\w+", sql))):
        visit(name)
    return out


def with_lenses(sql: str, given: tuple[str, ...] = (), forms: dict[str, str] | None = None) -> str:
    """``sql`` with the lenses it names, except ``given`` ones, as common table expressions; ``forms`` replace some."""
    ctes = [f"{name} AS ({(LENSES | (forms or {}))[name].strip()})" for name in needed(sql, given, forms)]
    if not ctes:
        return sql.strip()
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + rest[10:]
        return "WITH " + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lens(spark: SparkSession, sf_dir: str, name: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    """A lens over the tables of ``sf_dir``; ``written`` lenses are read, not built again.

    Lenses that render text are spread by table first: the rows are narrow before and wide
    after, and reading text is what costs time.
    """
    ready = dict(written or {})
    if name in ready:
        return ready[name]
    if "lens_sources" in needed((LENSES | SCALED)[name], (), SCALED) and "lens_sources" not in ready:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ready["lens_sources"] = lens(spark, sf_dir, "lens_sources").repartition(parts, "table_id")
    sql = with_lenses(f"SELECT * FROM {name}", tuple(ready), SCALED)
    for table in BASE_TABLES:
        if re.search(rf"\b{table}\b", sql):
            base(spark, sf_dir, table).createOrReplaceTempView(table)
    for other, df in ready.items():
        if re.search(rf"\b{other}\b", sql):
            df.createOrReplaceTempView(other)
    return spark.sql(sql)
