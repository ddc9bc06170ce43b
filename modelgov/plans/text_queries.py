"""Queries over definition text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs
from ..functions.text import normalise_definition, normalize_key
from ..operators import textparse as tp
from .lenses import BASE_BLOCK, CALC_BLOCK, SLOTS, TOTAL_BLOCK, text
from .registry import query

K = "CAST(table_id AS STRING)"
SRC = "model_id, 'tables/' || table_name || '.tmdl' AS path, table_name"
TOTAL_FORMULA = f"'SUM(''' || table_name || '''[Price]) + [Base ' || {K} || ']'"
BASE_HEAD = "'VAR x = SUM(Facts[Qty]) -- Old[Gone]'"
BASE_TAIL = "'    RETURN [Price] + x /* Dead[Ref] */ & \"[Text]\"'"
BASE_FORMULA = f"{BASE_HEAD} || chr(10) || {BASE_TAIL}"


@query("scan_model_text", "SELECT model_id, path, content FROM lens_files")
def _scan(ctx):
    return ctx.lens("lens_raw_files").withColumn("content", normalise_definition("content"))


@query("parse_tables", f"SELECT {SRC} FROM lens_sources")
def _tables(ctx):
    return tp.parse_tables(ctx.files)


@query("parse_columns", f"""
    SELECT {SRC}, 3 AS block_no, 'Price' AS column_name, 'price_' || status AS source_column, FALSE AS calculated FROM lens_sources
    UNION ALL SELECT {SRC}, 4, 'Sort Key', 'Sort Key', FALSE FROM lens_sources
    UNION ALL SELECT {SRC}, 5, 'It''s ' || {K}, '', TRUE FROM lens_sources""")
def _columns(ctx):
    return tp.parse_columns(ctx.blocks)


@query("parse_measures", f"""
    SELECT {SRC}, 1 AS block_no, 'Total ' || {K} AS measure FROM lens_sources
    UNION ALL SELECT {SRC}, 2, 'Base ' || {K} FROM lens_sources""")
def _measures(ctx):
    return tp.parse_measures(ctx.blocks)


@query("measure_formulas", f"""
    SELECT {SRC}, 1 AS block_no, 'Total ' || {K} AS measure, {TOTAL_FORMULA} AS formula FROM lens_sources
    UNION ALL SELECT {SRC}, 2, 'Base ' || {K}, {BASE_FORMULA} FROM lens_sources""")
def _formulas(ctx):
    return tp.measure_formulas(ctx.blocks)


@query("strip_comments", f"""
    SELECT model_id, 'Total ' || {K} AS measure, {TOTAL_FORMULA} AS formula FROM lens_sources
    UNION ALL SELECT model_id, 'Base ' || {K},
        'VAR x = SUM(Facts[Qty]) ' || chr(10) || '    RETURN [Price] + x  & "[Text]"' FROM lens_sources""")
def _comments(ctx):
    return tp.measure_formulas(ctx.blocks).select(
        "model_id", "measure", refs.strip_comments(F.col("formula")).alias("formula")
    )


def stream(measure: str, tokens: list[tuple[str, str]]) -> str:
    """SQL: the given (kind, text as an expression) as rows of every source."""
    listed = ", ".join(f"struct_pack(position := {i}, kind := '{k}', text := {t})" for i, (k, t) in enumerate(tokens))
    return f"SELECT model_id, table_name, {measure} AS measure, unnest([{listed}], recursive := true) FROM lens_sources"


def word(text: str, kind: str = "word") -> tuple[str, str]:
    return kind, "'" + text.replace("'", "''") + "'"


TOTAL_TOKENS = [
    word("SUM"), word("(", "symbol"), ("quoted", "chr(39) || table_name || chr(39)"), word("[Price]", "bracketed"), word(")", "symbol"),
    word("+", "symbol"), ("bracketed", f"'[Base ' || {K} || ']'"),
]
BASE_TOKENS = [
    word("VAR"), word("x"), word("=", "symbol"), word("SUM"), word("(", "symbol"), word("Facts"), word("[Qty]", "bracketed"), word(")", "symbol"),
    word("-- Old[Gone]", "comment"), word("RETURN"), word("[Price]", "bracketed"), word("+", "symbol"), word("x"),
    word("/* Dead[Ref] */", "comment"), word("&", "symbol"), word('"[Text]"', "string"),
]


@query("token_stream", stream(f"'Total ' || {K}", TOTAL_TOKENS) + " UNION ALL " + stream(f"'Base ' || {K}", BASE_TOKENS))
def _tokens(ctx):
    return tp.measure_formulas(ctx.blocks).select(
        "model_id", "table_name", "measure", F.posexplode(refs.tokens(F.col("formula"))).alias("position", "t")
    ).select("model_id", "table_name", "measure", "position", "t.kind", "t.text")


@query("dax_refs", f"""
    SELECT model_id, table_name, 'Total ' || {K} AS measure, table_name AS ref_table, 'Price' AS ref_column FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Total ' || {K}, NULL, 'Base ' || {K} FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Base ' || {K}, 'Facts', 'Qty' FROM lens_sources
    UNION ALL SELECT model_id, table_name, 'Base ' || {K}, NULL, 'Price' FROM lens_sources""")
def _refs(ctx):
    return tp.measure_refs(tp.measure_formulas(ctx.blocks))


OWN = "model_id, table_name"


@query("protection_refs", f"""
    SELECT {OWN}, 'measure' AS kind, 'Total ' || {K} AS name, table_name AS ref_table, 'Price' AS ref_column FROM lens_sources
    UNION ALL SELECT {OWN}, 'measure', 'Total ' || {K}, table_name, 'Base ' || {K} FROM lens_sources
    UNION ALL SELECT {OWN}, 'measure', 'Base ' || {K}, v.t, v.c FROM lens_sources
        CROSS JOIN (VALUES ('Facts', 'Qty'), ('Old', 'Gone'), ('Dead', 'Ref')) v(t, c)
    UNION ALL SELECT {OWN}, 'measure', 'Base ' || {K}, table_name, v.c FROM lens_sources CROSS JOIN (VALUES ('Price'), ('Text')) v(c)
    UNION ALL SELECT {OWN}, 'column', 'It''s ' || {K}, table_name, 'Price' FROM lens_sources
    UNION ALL SELECT {OWN}, 'column', 'It''s ' || {K}, 'Facts', 'Rate' FROM lens_sources
    UNION ALL SELECT {OWN}, 'column', 'It''s ' || {K}, table_name,
        {text('{"LinkTarget":{"TableName":"«hub»","TableItemName":"Price"}},{"Other":1}', hub="hub_name")}
        FROM lens_sources WHERE status = 'F'""")
def _protection_refs(ctx):
    return tp.formula_owner_refs(tp.dax_blocks(ctx.blocks))


@query("dax_blocks", f"""
    SELECT {SRC}, 'measure' AS kind, 'Total ' || {K} AS name, replace({text(TOTAL_BLOCK, **SLOTS)}, chr(10), ' ') AS dax_text FROM lens_sources
    UNION ALL SELECT {SRC}, 'measure', 'Base ' || {K}, replace({text(BASE_BLOCK, **SLOTS)}, chr(10), ' ') FROM lens_sources
    UNION ALL SELECT {SRC}, 'column', 'It''s ' || {K}, replace({text(CALC_BLOCK, **SLOTS)}, chr(10), ' ') FROM lens_sources""")
def _dax(ctx):
    return tp.dax_blocks(ctx.blocks)


@query("parse_relations", f"""
    SELECT model_id, 'relationships.tmdl' AS path, 1 AS rel_no, 'r1-' || {K} AS relationship, table_name AS from_table, 'Sort Key' AS from_column,
        hub_name AS to_table, 'Price' AS to_column, CASE WHEN status = 'F' THEN 'bothDirections' ELSE 'oneDirection' END AS cross_filter, TRUE AS is_active
    FROM lens_sources
    UNION ALL SELECT model_id, 'relationships.tmdl', 2, 'r2-' || {K}, table_name, 'Price', 'Facts_' || {K}, 'Some Key', 'oneDirection', FALSE FROM lens_sources""")
def _relations(ctx):
    return tp.parse_relations(ctx.lens("lens_relation_files"))


@query("security_tables", """
    SELECT DISTINCT model_id, table_name FROM lens_sources
    UNION SELECT model_id, 'Facts_' || status FROM lens_sources""")
def _security(ctx):
    return tp.security_tables(ctx.lens("lens_role_files"))


@query("hier_levels", f"""
    SELECT {SRC}, 6 AS block_no, 'Date Levels' AS hierarchy, v.no AS level_no, v.c AS level, v.c AS column_name
    FROM lens_sources CROSS JOIN (VALUES (1, 'Price'), (2, 'Sort Key')) v(no, c)""")
def _levels(ctx):
    return tp.hier_levels(ctx.blocks)


@query("variations", f"""
    SELECT {SRC}, 5 AS block_no, 'It''s ' || {K} AS column_name, 'Variation' AS variation, hub_name AS hier_table, 'Date Levels' AS hierarchy
    FROM lens_sources""")
def _variations(ctx):
    return tp.variations(ctx.blocks)


@query("sort_by", f"SELECT {SRC}, 'Price' AS column_name, 'Sort Key' AS sort_column FROM lens_sources")
def _sort_by(ctx):
    return tp.sort_by(ctx.blocks)


@query("semantic_links", f"""
    SELECT {SRC}, 'It''s ' || {K} AS column_name, CASE status WHEN 'F' THEN hub_name ELSE table_name END AS target_table,
        CASE status WHEN 'F' THEN 'Price' ELSE 'Sort Key' END AS target_column
    FROM lens_sources WHERE status IN ('F', 'O')""")
def _links(ctx):
    return tp.semantic_links(ctx.blocks)


@query("bad_semantic_links", f"SELECT {SRC}, 'It''s ' || {K} AS column_name, 'not json' AS raw FROM lens_sources WHERE status = 'P'")
def _bad_links(ctx):
    return tp.bad_semantic_links(ctx.blocks)


P = "CASE WHEN status = 'P' THEN 1 ELSE 0 END"


@query("block_ranges", f"""
    SELECT model_id, 'tables/' || table_name || '.tmdl' AS path, v.level, v.a + {P} AS start_line, v.b + {P} AS end_line,
        CASE v.a WHEN 3 THEN 'measure ''Total ' || {K} || ''' = ' || {TOTAL_FORMULA} WHEN 7 THEN 'measure ''Base ' || {K} || ''' ='
            WHEN 17 THEN 'column Price' WHEN 22 THEN 'column ''Sort Key''' WHEN 26 THEN 'column ''It''''s ' || {K} || ''' = [Price] * Facts[Rate]'
            WHEN 29 THEN 'variation Variation' WHEN 35 THEN 'hierarchy ''Date Levels''' WHEN 44 THEN 'partition p' || {K} || ' = m'
            ELSE 'annotation PBI_Id = ' || {K} END AS header
    FROM lens_sources CROSS JOIN (VALUES (1, 3, 7), (1, 7, 17), (1, 17, 22), (1, 22, 26), (1, 26, 35), (2, 29, 33), (1, 35, 44), (1, 44, 48), (1, 48, 50)) v(level, a, b)""")
def _ranges(ctx):
    return tp.block_ranges(ctx.files)


@query("column_lookup", f"""
    SELECT model_id, name_norm, arg_min(table_name, path) AS first_table, count(*) AS n_tables
    FROM (SELECT {SRC}, 'price' AS name_norm FROM lens_sources UNION ALL SELECT {SRC}, 'sort key' FROM lens_sources
          UNION ALL SELECT {SRC}, 'it''s ' || {K} FROM lens_sources) c GROUP BY model_id, name_norm""")
def _lookup(ctx):
    return tp.column_lookup(tp.parse_columns(ctx.blocks))


@query("normalize_key", r"""
    SELECT model_id, column_names, regexp_replace(lower(trim(regexp_replace(table_name || '$$' || trim(column_names), '\s+', ' ', 'g'))), '\s*\?\s*$', '') AS key_norm
    FROM lens_usage""")
def _keys(ctx):
    return ctx.lens("lens_usage").select(
        "model_id", "column_names",
        normalize_key(F.concat("table_name", F.lit("$$"), F.trim("column_names"))).alias("key_norm"),
    )
