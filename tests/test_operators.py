"""Distributed operators against brute force on small fixtures."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from modelgov.operators import decide, graph, layout, rank, render
from modelgov.operators import textparse as tp
from modelgov.sources.containers import decode_layouts
from modelgov.sources.relations import require_columns, view_set


def hot_rows(n=600):
    rnd = random.Random(7)
    return [(0 if i % 3 == 0 else rnd.randint(1, 40), rnd.randint(0, 10_000), i) for i in range(n)]


@pytest.mark.parametrize("size", [10, 600])
def test_number_within(spark, size):
    rows = hot_rows(size)
    df = spark.createDataFrame(rows, "g int, o int, i int").repartition(7)
    got = {(r.g, r.o, r.i): r.n for r in rank.number_within(df, ["g"], ["o", "i"], "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, row in enumerate(sorted(r for r in rows if r[0] == g), 1):
            want[row] = n
    assert got == want


def test_listed_has_one_form_for_any_size(spark):
    df = spark.createDataFrame([("a", f"v{i:04}") for i in range(2000)] + [("b", "x"), ("b", "x"), (None, "y")], "g string, v string")
    rows = {(r.g, r.position): r.v for r in rank.listed(df, ["g"], "v").collect()}
    assert rows == {("a", i + 1): f"v{i:04}" for i in range(2000)} | {("b", 1): "x", (None, 1): "y"}


def test_formula_lines(spark):
    blocks = [
        "\tmeasure A = 1 + 2\n\t\tformatString: 0\n\t\tannotation x = y\n\n",
        "\tmeasure 'B = c' =\n\t\t\tVAR x = 1\n\n\t\t\t\tRETURN x\n\t\tlineageTag: t\n\t\t\tnot part of it\n",
        "\tmeasure C = ```\n\t\t\tIF(a,\n\t\t\t\tb)\n\t\t\t```\n\t\tdisplayFolder: f\n",
        "\tmeasure D =\n\t\t```\n\t\tx\n\t\t```\n",
        "\tmeasure E =",
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, block string")
    got = [r.f for r in df.select("i", tp.formula_text(F.col("block")).alias("f")).orderBy("i").collect()]
    assert got == ["1 + 2", "VAR x = 1\n    RETURN x", "IF(a,\n    b)", "x", ""]


def brute_reach(edges):
    out, nodes = {}, {n for e in edges for n in e}
    for start in nodes:
        seen, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for a, b in edges:
                if a == at and b not in seen:
                    seen[b] = seen[at] + 1
                    queue.append(b)
        out.update({(start, n): h for n, h in seen.items() if n != start})
    return out


def test_reach_on_cycles_and_a_hub(spark):
    rnd = random.Random(3)
    edges = {(rnd.randint(0, 14), rnd.randint(0, 14)) for _ in range(25)} | {(0, i) for i in range(10)} | {(20, 21), (21, 20)}
    df = spark.createDataFrame([("m", str(a), str(b)) for a, b in edges], "model_id string, src string, dst string")
    got = {(int(r.src), int(r.dst)): r.hops for r in graph.reach(df).collect()}
    assert got == brute_reach(edges)


def test_reach_keeps_models_apart(spark):
    df = spark.createDataFrame([("m", "a", "b"), ("n", "b", "c")], "model_id string, src string, dst string")
    assert graph.reach(df).count() == 2


def test_relations_without_optional_columns(spark):
    rel = spark.createDataFrame([(1, 1, 2)], "model_id int, from_table_id int, to_table_id int")
    tables = spark.createDataFrame([(1, 1, "Fact"), (1, 2, "Dim")], "model_id int, table_id int, table_name string")
    assert [tuple(r) for r in graph.filter_edges(rel, tables).collect()] == [(1, "Dim", "Fact")]


def decisions(spark, rows):
    return spark.createDataFrame(
        [("m", t, c, s, k, f"{t}$${c}".lower(), rem, "No") for t, c, s, k, rem in rows],
        "model_id string, table_name string, column_name string, source_column string, kind string, key_norm string, remove_column string, protected string",
    )


def test_fixpoint_keeps_what_single_pass_loses(spark):
    rows = [("T", "A", "a", "imported", "No"), ("T", "B", "", "calculated", "Yes"), ("T", "C", "c", "imported", "Yes"), ("T", "D", "d", "imported", "Yes")]
    links = spark.createDataFrame([("m", "T", "A", "T", "B")], "model_id string, table_name string, column_name string, target_table string, target_column string")
    owner = spark.createDataFrame([("m", "T", "B", "T", "C")], "model_id string, table_name string, name string, ref_table string, ref_column string")
    late = spark.createDataFrame([("m", "T", "C", "T", "D")], "model_id string, table_name string, column_name string, target_table string, target_column string")
    d = decisions(spark, rows)
    single = decide.protect_structure(d, links.unionByName(late), owner)
    fix = decide.protect_fixpoint(d, decide.dependency_edges(links.unionByName(late), owner))
    flags = lambda df: {r.column_name: r.remove_column for r in df.collect()}
    assert flags(single) == {"A": "No", "B": "No", "C": "No", "D": "Yes"}
    assert set(flags(fix).values()) == {"No"}
    assert {r.column_name: r.protected for r in single.collect()}["C"] == "DAXReference"


def test_drop_sql_escapes_and_skips_model_items(spark):
    d = decisions(spark, [("T]x", "A", " a]b ", "imported", "Yes"), ("T]x", "M", "[Measure]", "measure", "Yes"), ("T]x", "K", "k", "imported", "No"), ("Gone", "Z", "z", "imported", "Yes")])
    tables = decide.table_decisions(d)
    assert [r.drop_sql for r in decide.drop_columns(d, tables).collect()] == ["ALTER TABLE [dbo].[T]]x] DROP COLUMN [a]]b];"]
    assert [r.drop_sql for r in decide.drop_tables(tables).collect()] == ["DROP TABLE [dbo].[Gone];"]
    assert [(r.column_name, r.type, r.file) for r in decide.model_cleanup(d, tables).collect()] == [("M", "Measure", "T]x.tmdl")]


def test_blank_view_rows_protect_nothing(spark):
    views = spark.createDataFrame([("m", None, "A"), ("m", "T", " "), ("m", " t ", "A")], "model_id string, table_name string, column_name string")
    assert [tuple(r) for r in view_set(views).collect()] == [("m", "t$$a")]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="table_name"):
        require_columns(spark.range(1), "table_name")


def test_deep_conditions_have_no_depth_limit(spark):
    inner = '{"Comparison":{"Left":{"Column":{"Expression":{"SourceRef":{"Source":"s"}},"Property":"P"}}}}'
    for i in range(30):
        inner = [f'{{"Not":{{"Expression":{inner}}}}}', f'{{"And":{{"Left":{inner}}}}}', f'{{"Or":{{"Left":{inner}}}}}', f'{{"Not":{inner}}}'][i % 4]
    doc = f'[{{"filter":{{"From":[{{"Name":"s","Entity":"T"}}],"Where":[{{"Condition":{inner}}}]}}}}]'
    row = layout.normalise_filters(spark.createDataFrame([("r", doc)], "report_id string, filters string")).first()
    assert (row.table_name, row.column_name, row.origin) == ("T", "P", "condition")


def test_containers_in_both_encodings(spark):
    import io
    import zipfile

    def pack(name, data):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(name, data)
        return bytearray(buffer.getvalue())

    rows = [("a", pack("Report/Layout", "﻿{}".encode("utf-16-le"))), ("b", pack("REPORT/layout", '{"é":1}'.encode())), ("c", pack("other", b"x"))]
    got = {r.path: r.layout_json for r in decode_layouts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"] == "{}" and got["c"] is None and got["b"]


def test_large_files_are_one_text_that_reads_back(spark):
    n = 9000
    rows = [("m", "big", 0, 0, 0, "", "table T\n\n")] + [("m", "big", 1, i, 0, "", f"\tcolumn C{i}\n\t\tsourceColumn: s{i}\n\n") for i in range(n)]
    parts = spark.createDataFrame(rows, "model_id string, path string, section int, ordinal long, step int, sub string, text string").repartition(5)
    columns = tp.parse_columns(tp.blocks(render.assemble(parts))).collect()
    assert [(r.column_name, r.source_column) for r in sorted(columns, key=lambda r: r.block_no)] == [(f"C{i}", f"s{i}") for i in range(n)]


def test_files_are_put_together_in_order(spark):
    rows = [("m", "big", 1, i, 0, "", f"line {i}\n") for i in range(9000)] + [("m", "small", 0, 0, 0, "", "x\n"), ("m", "small", 1, 0, 0, "", "y\n")]
    parts = spark.createDataFrame(rows, "model_id string, path string, section int, ordinal long, step int, sub string, text string")
    got = {r.path: r.content for r in render.assemble(parts).collect()}
    assert got == {"small": "x\ny\n", "big": "".join(f"line {i}\n" for i in range(9000))}


def test_blocks_join_to_the_file_again(spark):
    content = "table 'A B'\n\tisHidden\n\n\tcolumn X\n\t\tsourceColumn: x\n\n\tmeasure 'M = 1' = 2\n\thierarchy H\n\t\tlevel L\n\t\t\tcolumn: X\n\n\tcolumn Calc = [X]\n"
    df = spark.createDataFrame([("m", "p", content)], "model_id string, path string, content string")
    assert "".join(df.select(tp.block_texts(F.col("content"))).first()[0]) == content
    rows = [(r.kind, r.name, r.calculated) for r in tp.blocks(df).orderBy("block_no").collect()]
    assert rows == [("column", "X", False), ("measure", "M = 1", False), ("hierarchy", "H", False), ("column", "Calc", True)]
