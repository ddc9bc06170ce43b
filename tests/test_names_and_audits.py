"""Names of any script and shape, and audits of what cannot be read."""

import json

import pytest
from pyspark.sql import functions as F

from modelgov.functions import labels, refs
from modelgov.operators import textparse as tp
from modelgov.operators import usage
from modelgov.plans import governance
from modelgov.sources.containers import decode_layouts, unread_layouts

TABLE = "table Verkäufe\n\n\tmeasure Summe = SUM(Verkäufe[Umsatz])\n\n" + "".join(
    f"\tcolumn {n}\n\t\tsourceColumn: {s}\n\n"
    for n, s in (("Größe", "Größe"), ("Umsatz", "Umsatz"), ("'Net, Gross'", "Net, Gross"), ("Frei", "Frei"))
)
AREA = "table 'Région A'\n\n\tcolumn Größe\n\t\tsourceColumn: Größe\n"
LINK = "relationship r1\n\tfromColumn: Verkäufe.Größe\n\ttoColumn: 'Région A'.[Größe]\n"


def card(kind, table, name):
    one = {"field": {kind: {"Expression": {"SourceRef": {"Entity": table}}, "Property": name}}}
    return json.dumps({"visual": {"visualType": "card", "query": {"queryState": {"Values": {"projections": [one]}}}}})


def put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Three models: a sound one, one with a broken visual, one with a relationship that cannot be read."""
    root = tmp_path_factory.mktemp("names")
    for model in ("Lager", "Kaputt", "Lose"):
        base = f"{model}.SemanticModel/definition"
        put(root / "models", f"{base}/tables/a.tmdl", TABLE)
        put(root / "models", f"{base}/tables/b.tmdl", AREA)
        loose = "relationship r2\n\tfromColumn: nodot\n\ttoColumn: a.b\n" if model == "Lose" else ""
        put(root / "models", f"{base}/relationships.tmdl", LINK + loose)
    for name in ("Lager", "Kaputt", "Lose", "Anders"):
        pages = f"{name}.Report/definition/pages/p1"
        put(root / "reports", f"{pages}/page.json", json.dumps({"displayName": "Eins"}))
        put(root / "reports", f"{pages}/visuals/v1/visual.json", card("Column", "Verkäufe", "Net, Gross"))
        put(root / "reports", f"{pages}/visuals/v2/visual.json", card("Measure", "Verkäufe", "Summe"))
    put(root / "reports", "Kaputt.Report/definition/pages/p1/visuals/v3/visual.json", card("Column", "Verkäufe", "Frei")[:-9])
    return str(root / "models"), str(root / "reports"), str(root / "out")


def test_reports_without_a_model_end_the_run(spark, corpus):
    with pytest.raises(ValueError, match="Anders.Report"):
        governance.run(spark, *corpus)


def test_run_over_doubtful_models(spark, corpus):
    result = governance.run(spark, *corpus, on_unmatched="audit", mode="fixpoint")
    out = corpus[2]
    # used columns of any name stay, and a model with unread parts gets no statements
    assert {(r.model_id, r.drop_sql) for r in result.drop_columns.collect()} == {
        ("Lager.SemanticModel", "ALTER TABLE [dbo].[Verkäufe] DROP COLUMN [Frei];")
    }
    assert [r.report_id for r in spark.read.parquet(f"{out}/audit/unmatched_reports").collect()] == ["Anders.Report"]
    assert [(r.report_id, r.visual_id) for r in spark.read.parquet(f"{out}/audit/unread_documents").collect()] == [("Kaputt.Report", "v3")]
    assert [r.from_text for r in spark.read.parquet(f"{out}/audit/unread_relations").collect()] == ["nodot"]


@pytest.mark.parametrize(("end", "table", "column"), [
    ("Sales.Key", "Sales", "Key"), ("'My ''big'' one'.Key No", "My 'big' one", "Key No"), ("[a.b].[c]", "a.b", "c"),
    ("Verkäufe.'Größe (cm)'", "Verkäufe", "Größe (cm)"), ("テーブル . 列", "テーブル", "列"), ("a-b 1.[x, y]", "a-b 1", "x, y"),
])
def test_endpoints(spark, end, table, column):
    text = f"relationship q\n\tisActive: false\n\tcrossFilteringBehavior: bothDirections\n\tfromColumn: {end}\n\ttoColumn: T.C\n"
    files = spark.createDataFrame([("m", "relationships.tmdl", text)], "model_id string, path string, content string")
    row = tp.parse_relations(files).first()
    assert (row.from_table, row.from_column, row.to_table, row.cross_filter, row.is_active) == (table, column, "T", "bothDirections", False)
    assert tp.unread_relations(files).count() == 0


def test_references_and_comments(spark):
    text = "SUM(Verkäufe[Umsatz]) + 'a // b'[c--d] + [Rev//Cost] -- Old[Gone]\n+ Ünder[x] // 'open"
    frame = spark.createDataFrame([(text,)], "v string")
    kept = frame.select(refs.strip_comments(F.col("v")).alias("x")).first().x
    assert "Gone" not in kept and "open" not in kept and "[Rev//Cost]" in kept and "[c--d]" in kept
    for find in (refs.usage_refs, refs.protection_refs):
        got = {(r.ref_table, r.ref_column) for r in frame.select(find(F.col("v")).alias("x")).first().x}
        assert {("Verkäufe", "Umsatz"), ("a // b", "c--d"), (None, "Rev//Cost"), ("Ünder", "x")} <= got


def test_names_with_commas_are_one_name(spark):
    row = [("m", "T", "Net, Gross", "Net, Gross", "Slicer", None)]
    schema = "model_id string, table_name string, {} string, ui_field string, usage_label string, formula string"
    long = usage.usage_explode(usage.distinct_uses(spark.createDataFrame(row, schema.format("column_name"))))
    assert [r.column_name for r in long.collect()] == ["Net, Gross"]
    lists = usage.usage_explode(usage.distinct_uses(spark.createDataFrame(row, schema.format("column_names"))))
    assert sorted(r.column_name for r in lists.collect()) == ["Gross", "Net"]


def test_unknown_visual_names(spark):
    frame = spark.createDataFrame([("PBI_CV_12ab",), ("myOwnVisual",)], "v string")
    got = [r.x for r in frame.select(labels.visual_type_name(F.col("v")).alias("x")).collect()]
    assert got[0].endswith("12Ab") and got[1] == "My Own Visual"


def test_unread_containers(spark):
    import io
    import zipfile

    def pack(data):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("Report/Layout", data)
        return bytearray(buffer.getvalue())

    rows = [("even", pack(b'{"sections":[]} ')), ("wide", pack('{"a":1}'.encode("utf-16-le"))), ("cut", pack(b'{"a":')), ("no", bytearray(b"text"))]
    layouts = decode_layouts(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.path: r.layout_json for r in layouts.collect()}
    assert got["even"] == '{"sections":[]} ' and got["wide"] == '{"a":1}' and got["no"] is None
    assert {r.path for r in unread_layouts(layouts).collect()} == {"cut", "no"}
