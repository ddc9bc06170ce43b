"""What keeps the decisions' work in proportion: inputs read once, full rows moved once."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from modelgov.functions.text import PLACE, key_place, norm_pair
from modelgov.operators import catalog, decide, layout, textparse, usage
from modelgov.plans import registry
from modelgov.session import reuse_dealing


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def decided(spark):
    """Decisions whose making shows in a plan: they come from a range."""
    n = F.col("id").cast("string")
    return spark.range(6).select(
        F.lit(1).alias("model_id"), F.concat(F.lit("t$$c"), n).alias("key_norm"), F.lit("t").alias("table_name"),
        F.concat(F.lit("c"), n).alias("column_name"), F.lit("measure").alias("kind"),
        F.when(F.col("id") < 2, "No").otherwise("Yes").alias("remove_column"), F.lit("No").alias("protected"),
    )


def reasons(df) -> dict[str, tuple[str, str]]:
    return {r.column_name: (r.remove_column, r.protected) for r in df.collect()}


def test_protections_make_their_decisions_once(spark):
    links = spark.createDataFrame([(1, "T", "c0", "t", "c3")], "model_id int, table_name string, column_name string, target_table string, target_column string")
    refs = spark.createDataFrame([(1, "t", "c1", "t", "C4")], "model_id int, table_name string, name string, ref_table string, ref_column string")
    levels = spark.createDataFrame([(1, "t", "h", "c1"), (1, "t", "h", "c5"), (1, "t", "g", "c2")], "model_id int, table_name string, hierarchy string, column_name string")
    for step, given, saved, reason in (
        (decide.protect_links, links, "c3", "SemanticLink"), (decide.protect_dax, refs, "c4", "DAXReference"),
        (decide.protect_siblings, levels, "c5", "HierarchyLevel"),
    ):
        out = step(decided(spark), given)
        expected = {f"c{k}": ("No" if k < 2 else "Yes", "No") for k in range(6)} | {saved: ("No", reason)}
        assert reasons(out) == expected
        assert "Range (" not in plan(out)


def test_uses_by_key_and_by_name_reach_the_rows_in_one_join(spark):
    master = spark.createDataFrame(
        [(1, "a", "b$$c", "a$$b$$c", "measure"), (1, "a$$b", "c", "a$$b$$c", "measure"), (1, "t", "x", "t$$x", "imported"),
         (1, "t", "m", "t$$m", "measure"), (1, "t", "y", "t$$y", "imported"), (2, "t", "m", "t$$m", "measure")],
        "model_id int, table_name string, column_name string, key_norm string, kind string",
    )
    counts = spark.createDataFrame([(1, "z$$C"), (1, "t$$X ?"), (1, "q$$m"), (1, "q$$y")], "model_id int, key string")
    out = usage.used_in_report(master, counts)
    found = {(r.model_id, r.table_name, r.column_name): r.used_in_report for r in out.collect()}
    assert found == {(1, "a", "b$$c"): 0, (1, "a$$b", "c"): 1, (1, "t", "x"): 1, (1, "t", "m"): 1, (1, "t", "y"): 0, (2, "t", "m"): 0}
    assert plan(out).count("Join LeftOuter") == 1


def test_security_marks_tables_and_reaches_columns(spark):
    tables = spark.createDataFrame([(1, 1, "Sales"), (1, 2, "Other")], "model_id int, table_id int, table_name string")
    listed = spark.createDataFrame([(1, "sales"), (1, "sales")], "model_id int, table_norm string")
    marked = decide.secured_tables(tables, listed)
    assert {r.table_name: r.secured for r in marked.collect()} == {"Sales": True, "Other": False}
    rows = spark.createDataFrame([(1, "k", "Yes", True), (1, "l", "Yes", False)], "model_id int, key_norm string, remove_column string, secured boolean")
    out = {r.key_norm: (r.remove_column, r.protected) for r in decide.protect_lists(rows).collect()}
    assert out == {"k": ("No", "Yes"), "l": ("Yes", "No")}


RELATIONS = """relationship r1
	fromColumn: 'It''s'.[a b]
	toColumn: Dim.Key
	isActive: FALSE

relationship r2
	crossFilteringBehavior: bothDirections
	fromColumn: 'x y'.'p.q'
	toColumn: nothing

relationship r3
	toColumn: A . B
	fromColumn: C.D
"""


def test_text_is_matched_once_however_many_columns_are_read_from_it(spark):
    files = spark.range(3).select(
        "id", F.lit(1).alias("model_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") == 0, RELATIONS).when(F.col("id") == 1, "no relations").alias("content"),
    ).drop("id")
    read = textparse.parse_relations(files)
    rows = [tuple(r) for r in read.orderBy("rel_no").collect()]
    assert rows == [
        (1, "f0", 1, "r1", "It's", "a b", "Dim", "Key", "oneDirection", False),
        (1, "f0", 3, "r3", "C", "D", "A", "B", "oneDirection", True),
    ]
    assert [r.relationship for r in textparse.unread_relations(files).collect()] == ["r2"]
    assert plan(read).count("fromColumn:(") == 1
    assert plan(textparse.parse_columns(textparse.blocks(files))).count("column|measure|hierarchy|partition|annotation)\\s)") == 1


def test_a_condition_is_unwrapped_once_however_many_paths_are_tried(spark):
    column = '{"Column":{"Expression":{"SourceRef":{"Source":"a"}},"Property":"P"}}'
    direct = '{"Condition":{"StartsWith":{"Left":%s}}}' % column
    wrapped = '{"Condition":{"Not":{"Expression":{"And":{"Left":{"Not":{"In":{"Expressions":[%s]}}},"Right":{}}}}}}' % column
    alias = '"From":[{"Name":"a","Entity":"T"}]'
    lists = [
        f'[{{"filter":{{{alias},"Where":[{{"Condition":{{"Exists":{{}}}}}},{direct}]}}}},{{"filter":{{{alias},"Where":[{wrapped}]}}}}]',
        "[]", None, "[null]", '[{"type":"x","filter":{"Where":[{"Condition":{"Exists":{"Not":1}}}]}}]', "broken",
    ]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, filters string")
    read = layout.normalise_filters(rows)
    found = sorted((r.id, r.filter_no, r.filter_type, r.origin, r.table_name, r.column_name) for r in read.collect() if r.id < 5)
    assert found == [
        (0, 0, "Categorical", "condition", "T", "P"), (0, 1, "Categorical", "condition", "T", "P"),
        (3, 0, "Categorical", "none", "", ""), (4, 0, "x", "none", "", ""),
    ]
    assert plan(read).count("aggregate(") == 1
    assert "size(from_json(" not in plan(read)


def test_shuffles_start_from_partitions_in_proportion_to_the_input(spark, tmp_path, monkeypatch):
    (tmp_path / "orders.parquet").write_bytes(b"x" * 1000)
    monkeypatch.setitem(registry.QUERIES, "probe", lambda ctx: ctx.spark.range(1))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(registry.INITIAL_PARTITIONS, None)
    try:
        registry.run("probe", spark, str(tmp_path))
        assert int(spark.conf.get(registry.INITIAL_PARTITIONS)) == least
        monkeypatch.setattr(registry, "PARTITION_BYTES", 10)
        registry.run("probe", spark, str(tmp_path))
        assert int(spark.conf.get(registry.INITIAL_PARTITIONS)) == 100
    finally:
        spark.conf.unset(registry.INITIAL_PARTITIONS) if before is None else spark.conf.set(registry.INITIAL_PARTITIONS, before)


def test_text_is_read_once_for_columns_measures_and_formulas(spark):
    text_of = "table T\n\n\tmeasure 'M 1' = SUM(T[a])\n\t\tformatString: 0\n\n\tcolumn a\n\t\tsourceColumn: s\n\n\tcolumn b = [a]\n\n"
    blocks = textparse.blocks(spark.createDataFrame([(1, "p", text_of)], "model_id int, path string, content string"))
    declared = textparse.declarations(blocks)
    for reader in (textparse.parse_columns, textparse.parse_measures, textparse.measure_formulas):
        assert reader(declared).schema == reader(blocks).schema
        assert reader(declared).collect() == reader(blocks).collect() != []


def test_dealt_decisions_stay_where_they_are(spark):
    """Protections of dealt decisions give the same rows, and no step moves the decisions."""
    n = F.col("id").cast("string")
    rows = spark.range(12).select(
        (F.col("id") % 2).alias("model_id"), F.concat(F.lit("T"), F.col("id") % 3).alias("table_name"), F.concat(F.lit("c"), n).alias("column_name"),
        F.lit("measure").alias("kind"), F.when(F.col("id") < 3, "No").otherwise("Yes").alias("remove_column"), F.lit("No").alias("protected"),
    ).withColumn("key_norm", norm_pair("table_name", "column_name"))
    links = spark.createDataFrame([(0, "T0", "C0 ?", "T1", "c4"), (1, "T0", "c0", "T0", "c3")], "model_id long, table_name string, column_name string, target_table string, target_column string")
    refs = spark.createDataFrame([(0, "t1", "c4", "t0", "C6"), (1, "t1", "c7", "t2", "c5")], "model_id long, table_name string, name string, ref_table string, ref_column string")
    levels = spark.createDataFrame(
        [(0, "T0", "h", "c6"), (0, "T0", "h", "c0"), (1, "T1", "h", "c1"), (1, "T1", "h", "c7"), (1, "T1", "h", None), (1, "T2", "h", "c5")],
        "model_id long, table_name string, hierarchy string, column_name string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    reuse_dealing(spark)
    try:
        plain = decide.protect_structure(rows, links, refs, levels)
        dealt = decide.protect_structure(rows.withColumn(PLACE, key_place("key_norm")).repartition("model_id", PLACE), links, refs, levels)
        found = {(r.model_id, r.column_name): (r.remove_column, r.protected) for r in dealt.collect()}
        assert found == {(r.model_id, r.column_name): (r.remove_column, r.protected) for r in plain.collect()}
        assert {k: v[1] for k, v in found.items() if v[1] != "No"} == {(0, "c4"): "SemanticLink", (0, "c6"): "DAXReference", (1, "c7"): "HierarchyLevel"}
        assert "Exchange" not in dealt._jdf.queryExecution().executedPlan().toString()
        kept = decide.kept_keys(dealt)
        for targets in (decide.link_targets(links, kept), decide.formula_targets(refs, kept)):
            text = targets._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning(model_id" in text and "Bucketed: false" not in text
    finally:
        reuse_dealing(spark, False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_lines_are_read_once_for_columns_and_levels(spark):
    """Both lenses come from one grouping of the lines, and joins by table do not move it."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    ctx = registry.Context(spark, sf)
    ctx.deal(lens_named="table_id", lens_columns="table_id", lens_tables="table_id")
    try:
        assert "lineitem" not in plan(ctx.lens("lens_columns")) + plan(ctx.lens("lens_levels"))
        joined = ctx.lens("lens_columns").join(ctx.lens("lens_tables"), ["model_id", "table_id"])
        assert "Exchange" not in joined.hint("merge")._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    finally:
        reuse_dealing(spark, False)


def test_flags_meet_where_their_master_lies(spark):
    """Both flags of one written master are put together by column id without moving it, and without changing a row."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    reuse_dealing(spark)
    try:
        tables = spark.createDataFrame([(m, t, f"T {t % 4}") for m in range(3) for t in range(9)], "model_id long, table_id long, table_name string")
        columns = spark.createDataFrame(
            [(m, t, f"{t}-{c}", f"c{c}", "[Measure]" if c == 2 else "") for m in range(3) for t in range(9) for c in range(4)],
            "model_id long, table_id long, column_id string, column_name string, source_column string")
        plain = catalog.semantic_master(columns, tables)
        dealt = catalog.written_master(plain)
        assert sorted(map(tuple, dealt.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
        flags = [
            (m.withColumn("used_in_report", F.col("table_id").cast("int") % 2), m.withColumn("used_in_relationship", F.length("column_id") % 2))
            for m in (plain, dealt)]
        want, got = (decide.column_decisions(*f) for f in flags)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        reuse_dealing(spark, False)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_filters_of_visuals_read_their_documents_once(spark, monkeypatch):
    from modelgov.operators import report

    registry.load_all()
    calls, real = [], report.visual_documents
    monkeypatch.setattr(report, "visual_documents", lambda visuals: calls.append(1) or real(visuals))
    registry.run("visual_filters", spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
