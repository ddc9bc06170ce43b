"""Definition text -> relations.

A file is one row ``(model_id, path, content)``.  Its blocks are found by splitting the text in
front of every block header, inside the row: no line window, no shuffle, no Python worker.  The
concatenation of a file's blocks is the file again, which is what cleanup relies on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import protection_refs, usage_refs
from ..functions.text import normalize_key, strip, unquote

# Keywords of the blocks of a table file, in these patterns.
BLOCK_SPLIT = r"(?md)^(?=\t(?:column|measure|hierarchy|partition|annotation)\s)"
SUB_SPLIT = r"(?md)^(?=\t\t[^\t\n])"
HEADER_LINE = r"^\t(?:column|measure|hierarchy|partition|annotation)\s"
QUOTED = r"'((?:[^']|'')*+)'"
NAME = rf"(?:{QUOTED}|([^=\n]+?))"

# Properties that end a measure's formula.
FORMULA_END = "formatString|lineageTag|annotation|extendedProperty|displayFolder|dataCategory"

LINK_SCHEMA = "array<struct<LinkTarget:struct<TableName:string,TableItemName:string>>>"


def _name_after(text: Column, pattern: str) -> Column:
    """Name captured by ``pattern`` (group 1 quoted, group 2 bare)."""
    quoted = F.replace(F.regexp_extract(text, pattern, 1), F.lit("''"), F.lit("'"))
    return F.coalesce(
        F.nullif(strip(quoted), F.lit("")), F.nullif(strip(F.regexp_extract(text, pattern, 2)), F.lit(""))
    )


def _header(line: Column, pattern: str, groups: int) -> Column:
    """Groups of a header line as an array, taken with one replace; one element if no match."""
    marks = "".join(f"${i}\u0001" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(line, pattern, marks), "\u0001")


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _either(quoted: Column, bare: Column) -> Column:
    return F.nullif(F.when(quoted != "", F.replace(quoted, F.lit("''"), F.lit("'"))).otherwise(bare), F.lit(""))


def declared_table(content: Column) -> Column:
    """Table name declared by a file, or null when the file declares none."""
    parts = _header(_first_line(content), rf"\Atable\s+(?:{QUOTED}|(.+?))\s*\z", 2)
    return F.when(F.size(parts) > 1, _either(parts[0], parts[1]))


def block_texts(content: Column) -> Column:
    return F.split(content, BLOCK_SPLIT)


_HEADER = rf"\A\t(column|measure|hierarchy|partition|annotation)\s+{NAME}\s*(=.*)?\z"


def block_structs(content: Column) -> Column:
    """array<struct<no, kind, name, calculated, block>>, the text before the first block included.

    One regular expression per block reads its header.  ``kind`` is null for text that is no
    block; only columns, measures and hierarchies have names, and a measure needs its '='.
    """
    split = F.transform(
        block_texts(content),
        lambda b, i: F.struct(i.alias("no"), _header(_first_line(b), _HEADER, 4).alias("h"), b.alias("block")),
    )

    def described(x: Column) -> Column:
        kind = F.when(F.size(x["h"]) > 1, x["h"][0])
        has_expression = F.coalesce(F.get(x["h"], F.lit(3)) != "", F.lit(False))
        named = kind.isin("column", "hierarchy") | ((kind == "measure") & has_expression)
        return F.struct(
            x["no"].alias("no"), kind.alias("kind"), F.when(named, _either(x["h"][1], x["h"][2])).alias("name"),
            F.coalesce((kind == "column") & has_expression, F.lit(False)).alias("calculated"), x["block"].alias("block"),
        )

    return F.transform(split, described)


def parse_tables(files: DataFrame) -> DataFrame:
    """(model_id, path, table_name) of every file that declares a table."""
    return files.select("model_id", "path", declared_table(F.col("content")).alias("table_name")).filter(
        F.col("table_name").isNotNull()
    )


def blocks(files: DataFrame) -> DataFrame:
    """(model_id, path, table_name, block_no, kind, name, calculated, block) of every table file.

    Everything is read inside the generator, so later filters only look at its output.  The generator is
    outer, because an inner one gets an inferred size filter that reads the text again.
    """
    found = F.filter(block_structs(F.col("content")), lambda b: b["kind"].isNotNull())
    return (
        files.select("model_id", "path", "content", declared_table(F.col("content")).alias("table_name"))
        .select("model_id", "path", "table_name", F.inline_outer(F.when(F.col("table_name").isNotNull(), found)))
        .filter(F.col("kind").isNotNull())
        .withColumnRenamed("no", "block_no")
    )


def property_value(block: Column, prop: str) -> Column:
    """Value of a two-tab property line, or ''."""
    return strip(F.regexp_extract(block, rf"(?md)^\t\t{prop}:\s*(.+?)$", 1))


def declarations(blocks_df: DataFrame) -> DataFrame:
    """Named columns and measures with what the readers below take from their text.

    Written once, it stands for the blocks in ``parse_columns``, ``parse_measures`` and ``measure_formulas``, so text is
    read once for all of them.
    """
    return blocks_df.filter(F.col("kind").isin("column", "measure") & F.col("name").isNotNull()).select(
        "model_id", "path", "table_name", "block_no", "kind", "name", "calculated",
        F.when(F.col("kind") == "column", property_value(F.col("block"), "sourceColumn")).alias("source_column"),
        F.when(F.col("kind") == "measure", formula_text(F.col("block"))).alias("formula"),
    )


def parse_columns(blocks_df: DataFrame) -> DataFrame:
    """Column declarations with their source column ('' when none is given)."""
    source = F.col("source_column") if "source_column" in blocks_df.columns else property_value(F.col("block"), "sourceColumn")
    return blocks_df.filter((F.col("kind") == "column") & F.col("name").isNotNull()).select(
        "model_id", "path", "table_name", "block_no", F.col("name").alias("column_name"),
        source.alias("source_column"),
        "calculated",
    )


def parse_measures(blocks_df: DataFrame) -> DataFrame:
    return blocks_df.filter((F.col("kind") == "measure") & F.col("name").isNotNull()).select(
        "model_id", "path", "table_name", "block_no", F.col("name").alias("measure")
    )


def formula_text(block: Column) -> Column:
    """Formula of a measure block: what its header holds behind '=' and the lines up to the first property.

    Blank lines and fences go; an indent counts as four blanks however deep it is.
    """
    below = F.slice(F.split(block, "\n"), F.lit(2), F.length(block))
    is_end = F.transform(below, lambda line: line.rlike(rf"\A[ \t]*(?:{FORMULA_END})[ \t]*[: ]"))
    end = F.array_position(is_end, F.lit(True))
    body = F.slice(below, F.lit(1), F.when(end > 0, end.cast("int") - 1).otherwise(F.size(below)))
    own = F.regexp_replace(_first_line(block), rf"\A\tmeasure\s+{NAME}\s*=", "")
    lines = F.filter(F.concat(F.array(own), body), lambda line: ~strip(line).isin("", "```"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\t+", "    "))


def measure_formulas(blocks_df: DataFrame) -> DataFrame:
    """(model_id, path, table_name, block_no, measure, formula)."""
    formula = F.col("formula") if "formula" in blocks_df.columns else formula_text(F.col("block"))
    return blocks_df.filter((F.col("kind") == "measure") & F.col("name").isNotNull()).select(
        "model_id", "path", "table_name", "block_no", F.col("name").alias("measure"),
        formula.alias("formula"),
    )


# An endpoint is two names with a dot between them.  A name is quoted ('' for a quote), bracketed,
# or bare: bare names end at the first dot, quote or bracket and may use letters of any script.
_NAME_FORMS = (r"'((?:[^']|'')+)'", r"\[([^\]]+)\]", r"([^'\[\].\n]+)")
_ENDPOINT = rf"\A(?:{'|'.join(_NAME_FORMS)})[ \t]*\.[ \t]*(?:{'|'.join(_NAME_FORMS)})\z"


def _line_value(block: Column, prop: str) -> Column:
    """What follows ``prop:`` on its own line, or ''."""
    return strip(F.regexp_extract(block, rf"(?md)^[ \t]*{prop}:(.*)$", 1))


def _endpoint_forms(line: Column) -> Column:
    """The six name forms of an endpoint line as an array; of another size when it cannot be read."""
    return F.split(F.regexp_replace(line, _ENDPOINT, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6"), "\u0001")


def _endpoint_name(forms: Column, first: int) -> Column:
    quoted = F.replace(forms[first], F.lit("''"), F.lit("'"))
    whole = F.concat(quoted, forms[first + 1], forms[first + 2])
    return F.when(F.size(forms) == 6, F.nullif(strip(whole), F.lit("")))


def _relation_structs(content: Column) -> Column:
    """array<struct> of the relationship blocks of a file, the text before the first one included (rel_no 0).

    One step takes the lines, the next splits endpoints, the last names them; a lambda's argument is
    evaluated once, so every line is matched once however many columns it gives.
    """
    lines = F.transform(
        F.split(content, r"(?md)^relationship\s+"),
        lambda b, i: F.struct(
            i.alias("rel_no"), strip(F.regexp_extract(b, r"\A([^\n]*)", 1)).alias("relationship"),
            _line_value(b, "crossFilteringBehavior").alias("cross"), _line_value(b, "isActive").alias("active"),
            _line_value(b, "fromColumn").alias("from_text"), _line_value(b, "toColumn").alias("to_text"),
        ),
    )
    forms = F.transform(lines, lambda x: F.struct(
        x.alias("x"), _endpoint_forms(x["from_text"]).alias("f"), _endpoint_forms(x["to_text"]).alias("t")))
    return F.transform(forms, lambda y: F.struct(
        y["x"]["rel_no"].alias("rel_no"), y["x"]["relationship"].alias("relationship"),
        _endpoint_name(y["f"], 0).alias("from_table"), _endpoint_name(y["f"], 3).alias("from_column"),
        _endpoint_name(y["t"], 0).alias("to_table"), _endpoint_name(y["t"], 3).alias("to_column"),
        F.coalesce(F.nullif(y["x"]["cross"], F.lit("")), F.lit("oneDirection")).alias("cross_filter"),
        (F.lower(y["x"]["active"]) != "false").alias("is_active"),
        y["x"]["from_text"].alias("from_text"), y["x"]["to_text"].alias("to_text"),
    ))


def _relation_blocks(files: DataFrame) -> DataFrame:
    """Everything is read inside the generator, so later filters only look at its output.

    An outer generator gets no inferred size filter, which would read the text again.
    """
    return files.select("model_id", "path", F.inline_outer(_relation_structs(F.col("content")))).filter(F.col("rel_no") > 0)


def _read(prefix: str) -> Column:
    return F.col(f"{prefix}_table").isNotNull() & F.col(f"{prefix}_column").isNotNull()


def parse_relations(files: DataFrame) -> DataFrame:
    """Relationship blocks: endpoints by name, cross-filter direction, active flag."""
    return _relation_blocks(files).filter(_read("from") & _read("to")).drop("from_text", "to_text")


def unread_relations(files: DataFrame) -> DataFrame:
    """Audit of relationship blocks with an endpoint that cannot be read: its text as it stands."""
    return _relation_blocks(files).filter(~(_read("from") & _read("to"))).select(
        "model_id", "path", "rel_no", "relationship", "from_text", "to_text"
    )


def security_tables(files: DataFrame) -> DataFrame:
    """Distinct tables with a row filter, filter on the same line or on the next."""
    pattern = rf"tablePermission\s+(?:{QUOTED}|([^'=\n]+?))\s*(?:=|\n\s*filterExpression\s*=)"
    hits = F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(0))
    return (
        files.select("model_id", F.explode(hits).alias("hit"))
        .select("model_id", _name_after(F.col("hit"), pattern).alias("table_name"))
        .distinct()
    )


def hier_levels(blocks_df: DataFrame) -> DataFrame:
    """(model_id, path, table_name, block_no, hierarchy, level_no, level, column_name)."""
    parts = F.filter(F.split("block", SUB_SPLIT), lambda p: p.rlike(r"\A\t\tlevel\s"))
    levels = F.transform(
        parts,
        lambda p: F.struct(
            _name_after(p, rf"(?md)\A\t\tlevel\s+(?:{QUOTED}|([^\n]+?))\s*$").alias("level"),
            unquote(F.regexp_extract(p, r"(?md)^\t\t\tcolumn:\s*(.+)$", 1)).alias("column_name"),
        ),
    )
    return (
        blocks_df.filter(F.col("kind") == "hierarchy")
        .select("model_id", "path", "table_name", "block_no", F.col("name").alias("hierarchy"),
                F.posexplode(levels).alias("level_no", "lv"))
        .select("model_id", "path", "table_name", "block_no", "hierarchy",
                (F.col("level_no") + 1).alias("level_no"), "lv.level", "lv.column_name")
        .filter(F.col("column_name") != "")
    )


def split_reference(ref: Column) -> tuple[Column, Column]:
    """``Table.Item`` reference, each side quoted or not -> (table, item)."""
    pattern = rf"\A(?:{QUOTED}|([^.']+))\.(?:{QUOTED}|(.+))\z"

    def side(first: int) -> Column:
        quoted = F.replace(F.regexp_extract(ref, pattern, first), F.lit("''"), F.lit("'"))
        return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(F.regexp_extract(ref, pattern, first + 1), F.lit("")))

    return side(1), side(3)


def default_hierarchy(part: Column) -> Column:
    return strip(F.regexp_extract(part, r"(?md)^\t\t\tdefaultHierarchy:\s*(.+)$", 1))


def variations(blocks_df: DataFrame) -> DataFrame:
    """Variations of columns: owner column and the hierarchy they open."""
    parts = F.filter(F.split("block", SUB_SPLIT), lambda p: p.rlike(r"\A\t\tvariation\s"))
    table, item = split_reference(F.col("ref"))
    return (
        blocks_df.filter((F.col("kind") == "column") & F.col("name").isNotNull())
        .select("model_id", "path", "table_name", "block_no", F.col("name").alias("column_name"), F.explode(parts).alias("part"))
        .select("model_id", "path", "table_name", "block_no", "column_name",
                _name_after(F.col("part"), rf"(?md)\A\t\tvariation\s+(?:{QUOTED}|([^\n]+?))\s*$").alias("variation"),
                default_hierarchy(F.col("part")).alias("ref"))
        .select("model_id", "path", "table_name", "block_no", "column_name", "variation",
                table.alias("hier_table"), item.alias("hierarchy"))
        .filter(F.col("hierarchy").isNotNull())
    )


def sort_by(blocks_df: DataFrame) -> DataFrame:
    """(.., column_name, sort_column) for columns sorted by another column."""
    return (
        blocks_df.filter((F.col("kind") == "column") & F.col("name").isNotNull())
        .select("model_id", "path", "table_name", F.col("name").alias("column_name"),
                unquote(property_value(F.col("block"), "sortByColumn")).alias("sort_column"))
        .filter(F.col("sort_column") != "")
    )


def _link_json(blocks_df: DataFrame) -> DataFrame:
    pattern = r"(?md)^\t\tannotation\s+__PBI_SemanticLinks\s*=\s*(.+)$"
    raw = F.explode(F.regexp_extract_all(F.col("block"), F.lit(pattern), F.lit(1)))
    return (
        blocks_df.filter((F.col("kind") == "column") & F.col("name").isNotNull())
        .select("model_id", "path", "table_name", F.col("name").alias("column_name"), raw.alias("raw"))
        .withColumn("raw", strip(F.col("raw")))
        .withColumn("as_list", F.when(F.col("raw").startswith("["), F.col("raw")).otherwise(F.concat(F.lit("["), F.col("raw"), F.lit("]"))))
        .withColumn("valid", F.try_parse_json("raw").isNotNull())
    )


def semantic_links(blocks_df: DataFrame) -> DataFrame:
    """Link targets named by column annotations; unreadable JSON gives no row here."""
    target = F.col("link.LinkTarget")
    return (
        _link_json(blocks_df)
        .filter("valid")
        .select("model_id", "path", "table_name", "column_name", F.explode(F.from_json("as_list", LINK_SCHEMA)).alias("link"))
        .select("model_id", "path", "table_name", "column_name",
                strip(target["TableName"]).alias("target_table"), strip(target["TableItemName"]).alias("target_column"))
        .filter((F.col("target_table") != "") & (F.col("target_column") != ""))
    )


def bad_semantic_links(blocks_df: DataFrame) -> DataFrame:
    """Audit of annotations that are not JSON."""
    return _link_json(blocks_df).filter(~F.col("valid")).select("model_id", "path", "table_name", "column_name", "raw")


def block_ranges(files: DataFrame) -> DataFrame:
    """Line ranges [start, end) of blocks (level 1) and variations (level 2), 0-based."""
    lines = F.split("content", "\n")

    def marks(pattern: str) -> Column:
        numbered = F.transform(F.col("lines"), lambda line, i: F.struct(i.alias("no"), line.alias("line")))
        return F.filter(numbered, lambda x: x["line"].rlike(pattern))

    def closed(name: str) -> Column:
        """Each mark ends where the next mark starts, the last at the end of the file."""
        following = F.transform(F.slice(F.col(name), 2, F.greatest(F.size(name), F.lit(1))), lambda x: x["no"])
        return F.transform(
            F.arrays_zip(F.col(name).alias("mark"), following.alias("next")),
            lambda z: F.struct(
                z["mark"]["no"].alias("start_line"),
                F.coalesce(z["next"], F.size("lines")).alias("end_line"),
                z["mark"]["line"].alias("line"),
            ),
        )

    # A variation ends at the next non-blank line with at most two tabs.
    outer = r"^(?:\t\t[^\t\n]|\t[^\t\n]|[^\t\s])"
    return (
        files.filter(declared_table(F.col("content")).isNotNull())
        .select("model_id", "path", lines.alias("lines"))
        .withColumns({"level1": marks(HEADER_LINE), "level2": marks(outer)})
        .select(
            "model_id", "path",
            F.explode(F.concat(
                F.transform(closed("level1"), lambda r: F.struct(F.lit(1).alias("level"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), r["line"].alias("line"))),
                F.transform(
                    F.filter(closed("level2"), lambda r: r["line"].rlike(r"^\t\tvariation\s")),
                    lambda r: F.struct(F.lit(2).alias("level"), r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), r["line"].alias("line")),
                ),
            )).alias("r"),
        )
        .select("model_id", "path", "r.level", "r.start_line", "r.end_line", strip(F.col("r.line")).alias("header"))
    )


def dax_blocks(blocks_df: DataFrame) -> DataFrame:
    """Declaration plus indented lines of calculated columns and measures, on one line."""
    text = F.regexp_extract("block", r"\A[^\n]*+(?:\n(?:\t\t[^\n]*+|[ \t]*+(?=\n|\z)))*+", 0)
    return blocks_df.filter(((F.col("kind") == "measure") | F.col("calculated")) & F.col("name").isNotNull()).select(
        "model_id", "path", "table_name", "kind", "name", F.replace(text, F.lit("\n"), F.lit(" ")).alias("dax_text")
    )


def formula_owner_refs(dax_df: DataFrame) -> DataFrame:
    """Protection references: bare names belong to the owner's table."""
    return (
        dax_df.select("model_id", "table_name", "kind", "name", F.explode(protection_refs(F.col("dax_text"))).alias("r"))
        .select("model_id", "table_name", "kind", "name",
                F.coalesce("r.ref_table", "table_name").alias("ref_table"), "r.ref_column")
    )


def measure_refs(formulas: DataFrame) -> DataFrame:
    """Usage references of measure formulas; bare references have a null table."""
    return formulas.select(
        "model_id", "table_name", "measure", F.explode(usage_refs(F.col("formula"))).alias("r")
    ).select("model_id", "table_name", "measure", "r.ref_table", "r.ref_column")


def column_lookup(columns: DataFrame) -> DataFrame:
    """First table (by path) that holds a name, and how many tables hold it.

    ``columns`` needs model_id, path, table_name, column_name.  The aggregate keeps one struct
    per name, so a very common name costs no more than a rare one.
    """
    return columns.groupBy("model_id", normalize_key("column_name").alias("name_norm")).agg(
        F.min(F.struct("path", "table_name"))["table_name"].alias("first_table"),
        F.count("*").alias("n_tables"),
    )
