"""A small corpus of files through the whole run."""

import json

import pytest
from pyspark.sql import functions as F

from modelgov.plans import governance
from modelgov.sources import definitions

SALES = """table Sales

	measure Revenue = SUM([Amount])
		formatString: 0

	measure Twice = [Revenue] * 2 -- Old[Gone]

	measure Idle = COUNT(Sales[Key])

	column Key
		dataType: int64
		sourceColumn: key_id

	column Amount
		sourceColumn: Amount

	column Month
		sourceColumn: Month
		sortByColumn: 'Month No'

	column 'Month No'
		sourceColumn: Month No

	column Spare
		sourceColumn: Spare
"""
AREA = "table Area\n\n\tcolumn Key\n\t\tsourceColumn: Key\n\n\tcolumn Name\n\t\tsourceColumn: Name\n"
LOOSE = "table Loose\n\n\tcolumn A\n\t\tsourceColumn: A\n"
OWNERS = "table Owners\n\n\tcolumn Who\n\t\tsourceColumn: Who\n"
LINKS = "relationship r1\n\tfromColumn: Sales.Key\n\ttoColumn: Area.Key\n"
ROLE = "role Readers\n\n\ttablePermission Owners\n\t\tfilterExpression = [Who] = USERNAME()\n"


def field(kind, table, name):
    return {kind: {"Expression": {"SourceRef": {"Entity": table}}, "Property": name}}


def put(root, path, body):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    models, reports = root / "models", root / "reports"
    for name, mark in (("One", ""), ("Two 2", "﻿")):
        base = f"{name}.SemanticModel/definition"
        put(models, f"{base}/tables/Sales.tmdl", mark + SALES.replace("\n", "\r\n" if mark else "\n"))
        put(models, f"{base}/tables/Area.tmdl", AREA)
        put(models, f"{base}/tables/Loose.tmdl", LOOSE)
        put(models, f"{base}/tables/Owners.tmdl", OWNERS)
        put(models, f"{base}/relationships.tmdl", LINKS)
        put(models, f"{base}/roles/Readers.tmdl", ROLE)
        pages = f"{name}.Report/definition/pages"
        put(reports, f"{pages}/p1/page.json", {"displayName": "First", "filterConfig": {"filters": [{"field": field("Column", "Area", "Name")}]}})
        put(reports, f"{pages}/p1/visuals/v1/visual.json", {"visual": {"visualType": "card", "query": {"queryState": {"Values": {"projections": [{"field": field("Measure", "Sales", "Twice")}]}}}}})
        put(reports, f"{pages}/p1/visuals/v2/visual.json", {"visual": {"visualType": "card", "query": {"queryState": {"Values": {"projections": [{"field": field("Column", "Wrong", "Month")}]}}}}, "filterConfig": {"filters": [{"field": field("Column", "Wrong", "Nowhere")}]}})
        put(reports, f"{pages}/p1/visuals/v3/visual.json", {"visual": {"visualType": "image"}})
        put(reports, f"{pages}/orphan/visuals/v9/visual.json", {"visual": {"visualType": "card"}})
    return root


@pytest.fixture(scope="module")
def result(spark, corpus):
    out = str(corpus / "out")
    views = spark.createDataFrame([("One.SemanticModel", "sales", "SPARE")], "model_id string, table_name string, column_name string")
    return governance.run(spark, str(corpus / "models"), str(corpus / "reports"), out, views=views, cleanup_mode="all"), out


def test_models_do_not_mix(spark, result):
    decided, _ = result
    assert {r.model_id: r.n for r in decided.columns.groupBy("model_id").agg(F.count("*").alias("n")).collect()} == {
        "One.SemanticModel": 12, "Two 2.SemanticModel": 12,
    }


def test_decisions(result):
    decided, _ = result
    rows = {(r.model_id[:3], r.table_name, r.column_name): (r.remove_column, r.protected) for r in decided.columns.collect()}
    assert rows["Two", "Sales", "Revenue"] == ("No", "No")  # nested in a used measure
    assert rows["Two", "Sales", "Amount"] == ("No", "DAXReference")
    assert rows["Two", "Sales", "Idle"] == ("Yes", "No")
    assert rows["Two", "Sales", "Key"] == ("No", "No")  # relationship
    assert rows["One", "Sales", "Spare"] == ("No", "Yes")  # view list
    assert rows["Two", "Sales", "Spare"] == ("Yes", "No")
    assert rows["Two", "Owners", "Who"] == ("No", "Yes")  # row filter on the next line
    assert rows["Two", "Sales", "Month"] == ("No", "No")  # remapped reference


def test_statements(result):
    decided, _ = result
    sql = sorted((r.model_id[:3], r.drop_sql) for r in decided.drop_columns.collect())
    month = "ALTER TABLE [dbo].[Sales] DROP COLUMN [Month No];"
    assert sql == [("One", month), ("Two", month), ("Two", "ALTER TABLE [dbo].[Sales] DROP COLUMN [Spare];")]
    assert {r.drop_sql for r in decided.drop_tables.collect()} == {"DROP TABLE [dbo].[Loose];"}
    assert {(r.column_name, r.reason) for r in decided.conflicts.collect()} == {("Month No", "sort by")}


def test_written_results(spark, result):
    _, out = result
    usage = spark.read.parquet(f"{out}/usage")
    assert {(r.column_name, r.status) for r in usage.filter("table_name IN ('Wrong', 'Sales')").collect()} >= {("Month", "remapped"), ("Nowhere", "dropped")}
    assert {r.visual_label for r in usage.collect()} == {"Card", "Card (2)", "Page Filters"}
    lineage = spark.read.parquet(f"{out}/lineage/table_lineage")
    assert {(r.table_name, r.filtered_by, r.hops) for r in lineage.filter("hops > 0").collect()} == {("Sales", "Area", 1)}
    assert spark.read.text(f"{out}/sql/drop_tables").count() == 2


def test_cleaned_text(spark, result):
    _, out = result
    files = {(r.model_id[:3], r.table_name): r for r in spark.read.parquet(f"{out}/cleanup/files").collect()}
    after = files["Two", "Sales"].content_after
    assert "Idle" not in after and "Spare" not in after and "'Month No'\n\t\tsourceColumn" in after
    assert "Spare" in files["One", "Sales"].content_after
    assert files["Two", "Loose"].deleted and not files["Two", "Area"].changed
    removed = {(r.item_name, r.item_type) for r in spark.read.parquet(f"{out}/cleanup/removed").collect()}
    assert ("(entire table)", "Empty Table Deleted") in removed and ("Idle", "Measure") in removed
    skipped = {(r.item_name, r.reason) for r in spark.read.parquet(f"{out}/cleanup/skipped").collect()}
    assert skipped == {("Month No", "kept_variation_needs_it")}


def test_stream_gives_the_same_rows(spark, corpus):
    from modelgov.operators import textparse as tp
    from modelgov.streaming import scan_stream

    batch = tp.parse_columns(tp.blocks(definitions.table_files(definitions.scan_model_text(spark, str(corpus / "models")))))
    stream = tp.parse_columns(tp.blocks(definitions.table_files(scan_stream(spark, str(corpus / "models")))))
    query = stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, batch.collect()))
