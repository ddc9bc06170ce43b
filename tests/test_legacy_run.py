"""Legacy containers and exported object models through the whole run, input checks, stored inputs and audits."""

import json
import zipfile

import pytest

from modelgov import versions
from modelgov.plans import governance


def column(source, name):
    return {"Column": {"Expression": {"SourceRef": {"Source": source}}, "Property": name}}


def entity(kind, table, name):
    return {kind: {"Expression": {"SourceRef": {"Entity": table}}, "Property": name}}


def where(condition):
    return {"filter": {"From": [{"Name": "s", "Entity": "Sales"}], "Where": [{"Condition": condition}]}}


MEASURE = {"Measure": {"Expression": {"SourceRef": {"Source": "s"}}, "Property": "Twice"}, "Name": "Sales.Twice"}
CARD = {"name": "v1", "singleVisual": {"visualType": "card", "projections": {"Values": [{"queryRef": "Sales.Twice"}]}, "prototypeQuery": {
    "From": [{"Name": "s", "Entity": "Sales"}], "Select": [MEASURE]}}}
OUTER = {"Commands": [{"SemanticQueryDataShapeCommand": {"Query": {
    "From": [{"Name": "s", "Entity": "Sales"}], "Select": [{**column("s", "Outer é"), "Name": "Sales.Outer"}]}}}]}
LAYOUT = {
    "filters": json.dumps([{"field": entity("Column", "Area", "Name")}]),
    "sections": [{"name": "S1", "displayName": "Main", "ordinal": 0, "filters": json.dumps([where({"Not": {"Expression": {"Contains": {"Left": column("s", "By Contains")}}}})]),
                  "visualContainers": [
                      {"config": json.dumps(CARD), "filters": json.dumps([
                          where({"Between": {"Left": column("s", "By Between")}}), where({"And": {"Left": {"StartsWith": {"Left": column("s", "By Start")}}}}),
                          where({"EndsWith": {"Left": column("s", "By End")}})])},
                      {"config": json.dumps({"name": "v2", "singleVisual": {"visualType": "card"}}), "query": json.dumps(OUTER)},
                  ]}],
}
SALES = ["Key", "Amount", "By Contains", "By Between", "By Start", "By End", "Outer é", "Spare"]


def pack(path, layout):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("Report/Layout", layout if isinstance(layout, bytes) else json.dumps(layout, ensure_ascii=False).encode("utf-16-le"))


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("legacy")
    export, layouts = root / "export", root / "layouts"
    layouts.mkdir()
    pack(layouts / "Old.pbix", LAYOUT)

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(export / name))

    save("tables", [("Old.Model", 1, "Sales", 0), ("Old.Model", 2, "Area", 0), ("Old.Model", 3, "Loose", 0)], "model_id string, ID long, Name string, SystemFlags int")
    columns = [("Old.Model", 10 + i, 1, n, n) for i, n in enumerate(SALES)]
    columns += [("Old.Model", 30, 2, "Key", "Key"), ("Old.Model", 31, 2, "Name", "Name"), ("Old.Model", 40, 3, "A", "A"), ("Old.Model", 41, 3, "Value", "[Value]")]
    save("columns", [(*c, 1) for c in columns], "model_id string, ID long, TableID long, ExplicitName string, SourceColumn string, Type int")
    save("measures", [("Old.Model", 50, 1, "Revenue", "SUM(Sales[Amount])"), ("Old.Model", 51, 1, "Twice", "[Revenue] * 2"), ("Old.Model", 52, 1, "Idle", "1")],
         "model_id string, ID long, TableID long, Name string, Expression string")
    save("relationships", [("Old.Model", 60, "r1", 1, 10, 2, 30)], "model_id string, ID long, Name string, FromTableID long, FromColumnID long, ToTableID long, ToColumnID long")
    return root


@pytest.fixture(scope="module")
def result(spark, inputs):
    out = str(inputs / "out")
    return governance.run(spark, None, None, out, layouts_root=str(inputs / "layouts"), export_root=str(inputs / "export"), cleanup_mode="all"), out


def test_from_containers_to_statements(result):
    decided, _ = result
    kept = {(r.table_name, r.column_name) for r in decided.columns.filter("remove_column = 'No'").collect()}
    assert kept == {("Sales", n) for n in [*SALES[:-1], "Revenue", "Twice"]} | {("Area", "Key"), ("Area", "Name")}
    assert {r.drop_sql for r in decided.drop_tables.collect()} == {"DROP TABLE [dbo].[Loose];"}
    assert {r.drop_sql for r in decided.drop_columns.collect()} == {"ALTER TABLE [dbo].[Sales] DROP COLUMN [Spare];"}


def test_usage_of_a_layout(spark, result):
    uses = spark.read.parquet(f"{result[1]}/usage").collect()
    found = {(r.page_name, r.visual_label, r.usage_label, r.table_name, r.column_name) for r in uses}
    assert {f for f in found if f[1] != "Card"} == {
        ("(All Pages)", "Report Filters", "Report Filter", "Area", "Name"), ("Main", "Page Filters", "Page Filter", "Sales", "By Contains"),
        ("Main", "Card (2)", "Visual Value", "Sales", "Outer é"),
    }
    assert {(f[2], f[4]) for f in found if f[1] == "Card"} == {
        *(("Visual Value, Filter (Measure)", n) for n in ("Twice", "Revenue", "Amount")), ("Filter", "By Between"), ("Filter", "By Start"), ("Filter", "By End"),
    }


def test_audits_and_versions(spark, result):
    _, out = result
    assert [tuple(r) for r in spark.read.parquet(f"{out}/audit/implicit_value_columns").collect()] == [("Old.Model", "Loose")]
    for name in ("unresolved_relations", "bad_semantic_links", "unread_documents", "unmatched_reports"):
        assert spark.read.parquet(f"{out}/audit/{name}").count() == 0
    summary = {(r.action, r.label) for r in spark.read.parquet(f"{out}/cleanup/summary").collect()}
    assert ("removed", "Measure") in summary
    before = {r.path: r.content for r in versions.restore(spark, f"{out}/cleanup/versions", 1).collect()}
    after = {r.path: r.content for r in versions.restore(spark, f"{out}/cleanup/versions").collect()}
    assert "Idle" in before["tables/Sales.tmdl"] and "Idle" not in after["tables/Sales.tmdl"]
    assert set(before) - set(after) == {"tables/Loose.tmdl"}


def test_metrics_equal_the_relations(spark, result):
    _, out = result
    metrics = {r.relation: r.rows for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert len(metrics) > 15 and metrics["usage"] > 0
    assert metrics == {name: spark.read.parquet(f"{out}/{name}").count() for name in metrics}


def test_decisions_from_stored_inputs(spark, result):
    decided, out = result
    again = governance.decide_stored(spark, out)
    assert sorted(map(tuple, again.columns.select(*decided.columns.columns).collect()), key=str) == sorted(map(tuple, decided.columns.collect()), key=str)
    views = spark.createDataFrame([("Old.Model", "Sales", "Spare")], "model_id string, table_name string, column_name string")
    assert governance.decide_stored(spark, out, views=views).drop_columns.count() == 0


def test_an_unread_layout_holds_statements_back(spark, inputs, tmp_path):
    layouts = tmp_path / "layouts"
    layouts.mkdir()
    pack(layouts / "Old.pbix", LAYOUT)
    pack(layouts / "Other.pbix", b"no json")
    model_of = spark.createDataFrame([("Old.pbix", "Old.Model"), ("Other.pbix", "Old.Model")], "report_id string, model_id string")
    done = governance.run(spark, None, None, str(tmp_path / "out"), layouts_root=str(layouts), export_root=str(inputs / "export"), model_of=model_of)
    assert done.drop_columns.count() == 0 and done.drop_tables.count() == 0
    assert [(r.report_id, r.kind) for r in spark.read.parquet(f"{tmp_path}/out/audit/unread_documents").collect()] == [("Other.pbix", "layout")]


def test_all_faults_of_the_inputs_are_told_at_once(spark, tmp_path):
    for path in ("models/loose.tmdl", "models/Empty.Model/definition/model.tmdl", "reports/Bare.Report/definition/report.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("{}", encoding="utf-8")
    with pytest.raises(FileNotFoundError) as told:
        governance.run(spark, str(tmp_path / "models"), str(tmp_path / "reports"), str(tmp_path / "out"), layouts_root=str(tmp_path / "nowhere"))
    for text in ("layouts_root not found", "outside a definition folder: 1", "models without a tables folder: 1, such as ['Empty.Model']",
                 "reports without pages: 1, such as ['Bare.Report']"):
        assert text in str(told.value)
    with pytest.raises(FileNotFoundError, match="no model given.*no report given"):
        governance.run(spark, None, None, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError, match="lacks"):
        governance.read_exports(spark, str(tmp_path))
