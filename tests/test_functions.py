"""Expressions against plain Python on small and generated inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelgov.functions import labels, refs, text
from modelgov.operators import textparse as tp


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


def many(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expr(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def python_key(s):
    return re.sub(r"\s*\?\s*$", "", re.sub(r"\s+", " ", s.replace("\n", " ").strip()).lower())


def test_normalize_key_matches_python(spark):
    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.text(alphabet="aB ?\n\t$ ", max_size=12), min_size=50, max_size=80))
    def check(values):
        assert many(spark, values, text.normalize_key) == [python_key(v) for v in values]

    check()


def python_tokens(formula):
    """(kind, text) from left to right, character by character; blanks are tokens of their own here."""
    out, i = [], 0

    def closed(mark, i):
        """End of a name that begins at i, or None if it is not closed on its line; a doubled mark is part of it."""
        j = i + 1
        while j < len(formula) and formula[j] != "\n":
            if formula[j] == mark:
                if mark in "'\"" and formula[j + 1 : j + 2] == mark:
                    j += 1
                else:
                    return j + 1
            j += 1
        return None

    while i < len(formula):
        ch, two = formula[i], formula[i : i + 2]
        line = (formula + "\n").index("\n", i)
        if two == "/*" and "*/" in formula[i + 2 :]:
            kind, end = "comment", formula.index("*/", i + 2) + 2
        elif two in ("--", "//"):
            kind, end = "comment", line
        elif ch == '"':
            kind, end = "string", closed('"', i) or line
        elif ch == "'" and closed("'", i):
            kind, end = "quoted", closed("'", i)
        elif ch == "[" and closed("]", i):
            kind, end = "bracketed", closed("]", i)
        elif ch.isalpha() or ch == "_":
            kind, end = "word", i + 1
            while end < len(formula) and (formula[end].isalnum() or formula[end] == "_"):
                end += 1
        elif ch.isdigit():
            kind, end = "number", i + 1
            while end < len(formula) and (formula[end].isdigit() or formula[end] == "."):
                end += 1
        else:
            kind, end = "blank" if ch in " \n\t" else "symbol", i + 1
        out.append((kind, formula[i:end]))
        i = end
    return out


def python_strip(formula):
    return "".join(t for kind, t in python_tokens(formula) if kind != "comment")


FORMULAS = st.lists(st.text(alphabet="a1é_-/\"'*[]().+\n ", max_size=24), min_size=80, max_size=120)


def test_strip_comments_matches_python(spark):
    @settings(max_examples=4, deadline=None)
    @given(FORMULAS)
    def check(values):
        assert many(spark, values, refs.strip_comments) == [python_strip(v) for v in values]

    check()


def test_tokens_match_python(spark):
    @settings(max_examples=4, deadline=None)
    @given(FORMULAS)
    def check(values):
        got = [[(t["kind"], t["text"]) for t in row] for row in many(spark, values, refs.tokens)]
        assert got == [[t for t in python_tokens(v) if t[0] != "blank"] for v in values]

    check()


def test_signs_stand_for_what_they_stand_in(spark):
    assert one(spark, '"a /* b" & [C] & "d */ e"', refs.strip_comments) == '"a /* b" & [C] & "d */ e"'
    assert one(spark, "-- no /* block\n[A] */ [B]", refs.strip_comments) == "\n[A] */ [B]"
    assert {r["ref_column"] for r in one(spark, '"/*" & [Kept] & "*/" /* [Gone] */', refs.usage_refs)} == {"Kept"}


def test_keywords_are_no_tables(spark):
    found = one(spark, "VAR a = 1 RETURN [Sales] + RETURN Fact[Qty] + 'My ''T'[C] + X[Y].[Date]", refs.usage_refs)
    assert [(r["ref_table"], r["ref_column"]) for r in found] == [
        (None, "Sales"), ("Fact", "Qty"), ("My 'T", "C"), ("X", "Y"), (None, "Date"),
    ]


def test_brackets_in_strings_are_no_references(spark):
    assert one(spark, '"T[A]" & [B]', refs.usage_refs) == [(None, "B")]
    assert {tuple(r) for r in one(spark, '"T[A]" & [B]', refs.protection_refs)} == {("T", "A"), (None, "B")}


def test_usage_labels(spark):
    rows = spark.createDataFrame(
        [("slicer", "Values", False), ("kpi", "Goal", True), ("barChart", "Y2", False), ("treemap", "Group", True)],
        "t string, r string, m boolean",
    )
    got = [r[0] for r in rows.select(labels.usage_label(F.col("t"), F.col("r"), F.col("m"))).collect()]
    assert got == ["Slicer", "Visual Goal, Filter (Measure)", "Visual Y2", "Visual Group, Filter (Measure)"]


def test_codes(spark):
    df = spark.createDataFrame([(9, 1), (99, 3), (None, 8)], "a int, b int")
    got = df.select(labels.data_type_name(F.col("a")), labels.summarize_by_name(F.col("b")), labels.aggregation_name(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("dateTime", None, "Func9"), ("string", "sum", "Func99"), (None, "distinctCount", "Sum")]


def test_sql_identifier_doubles_brackets(spark):
    assert one(spark, "a]b", text.sql_identifier) == "[a]]b]"


def test_quote_and_unquote_are_inverse(spark):
    names = ["Plain", "With Blank", "It's", "a'b c", "x.y"]
    assert many(spark, names, lambda c: text.unquote(text.quote_name(c))) == names


def test_long_line_does_not_overflow(spark):
    body = "x" * 200_000 + ' + "' + "y" * 200_000 + '" -- end'
    assert one(spark, body, refs.strip_comments).endswith('" ')
    block = "\tmeasure m = 1\n" + "\t\tline\n" * 50_000
    assert len(one(spark, block, tp.block_texts)) == 1
