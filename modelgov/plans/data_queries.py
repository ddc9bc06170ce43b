"""Star-schema queries: the loads, joins and visuals a model declares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import star
from .registry import query

R = "CAST(round({0}, 2) AS DOUBLE)"


def money(column, digits: int = 2):
    """Exact sum of a rounded amount, so that the result does not depend on addition order."""
    return F.round(F.sum(F.col(column).cast("decimal(18,4)")).cast("double"), digits)


def total(column: str) -> str:
    return f"round(CAST(sum(CAST({column} AS DECIMAL(18, 4))) AS DOUBLE), 2)"


def mean(column):
    return F.round(F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column), 4)


def average(column: str) -> str:
    return f"round(CAST(sum(CAST({column} AS DECIMAL(18, 4))) AS DOUBLE) / count({column}), 4)"


def fact(ctx):
    """Order lines with their calculated date: one scan of the fact."""
    return ctx.base("lineitem").withColumn("date", F.to_date("l_shipdate"))


def united(ctx):
    """The same fact put together from the open lines and all others, those without a status included."""
    lines, opened = ctx.base("lineitem"), F.col("l_linestatus").eqNullSafe("O")
    return star.fact_union(lines.filter(opened), lines.filter(~opened), "l_shipdate")


def star_rows(ctx):
    """Fact with its dimensions; customers bring nation and region along."""
    customers = star.star_join(ctx.base("customer"), [
        (ctx.base("nation"), "c_nationkey", "n_nationkey"), (ctx.base("region"), "n_regionkey", "r_regionkey"),
    ])
    return star.star_join(fact(ctx), [
        (ctx.base("part"), "l_partkey", "p_partkey"), (ctx.base("supplier"), "l_suppkey", "s_suppkey"),
        (ctx.base("orders"), "l_orderkey", "o_orderkey"), (customers, "o_custkey", "c_custkey"),
    ])


STAR = """lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


@query("fact_union", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus, CAST(l_shipdate AS DATE) AS date FROM lineitem""")
def _fact(ctx):
    return united(ctx).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus", "date"
    )


@query("typed_load", """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(CAST(l_extendedprice AS DECIMAL(19, 4)) AS VARCHAR) AS l_extendedprice,
        l_discount, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""")
def _typed(ctx):
    rows = star.typed_load(
        ctx.base("lineitem"), l_orderkey="text", l_quantity="int64", l_extendedprice="currency",
        l_discount="percentage", l_shipdate="datetime",
    )
    return rows.withColumns({"l_extendedprice": F.col("l_extendedprice").cast("string"), "l_shipdate": F.to_date("l_shipdate")})


SPINE = """SELECT CAST(unnest(generate_series(make_date(lo, 1, 1), make_date(hi, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT min(year(l_shipdate)) AS lo, max(year(l_shipdate)) AS hi FROM lineitem) b"""
CALENDAR = f"""SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month_no, monthname(date) AS month, CAST(quarter(date) AS INT) AS quarter_no,
    'Qtr ' || CAST(quarter(date) AS VARCHAR) AS quarter, CAST(day(date) AS INT) AS day FROM ({SPINE}) s"""


@query("date_spine", SPINE)
def _spine(ctx):
    return star.date_spine(ctx.base("lineitem"), "l_shipdate")


def calendar(ctx):
    return star.calendar_columns(star.date_spine(ctx.base("lineitem"), "l_shipdate"))


@query("calendar_columns", CALENDAR)
def _calendar(ctx):
    return calendar(ctx)


@query("measures_total", f"""
    SELECT {total('l_extendedprice')} AS revenue, {average('l_extendedprice')} AS avg_revenue, count(l_orderkey) AS line_count, {total('l_quantity')} AS quantity FROM lineitem""")
def _totals(ctx):
    return star.card(
        fact(ctx), revenue=money("l_extendedprice"), avg_revenue=mean("l_extendedprice"),
        line_count=star.measure("counta", "l_orderkey"), quantity=money("l_quantity"),
    )


@query("star_join", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_brand, s_name, o_orderpriority, c_name, n_name, r_name FROM {STAR}""")
def _star(ctx):
    return star_rows(ctx).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_brand", "s_name", "o_orderpriority", "c_name", "n_name", "r_name"
    )


@query("date_join", f"""
    SELECT c.year, c.quarter, c.month, c.month_no, {total('l_extendedprice')} AS revenue, count(l_orderkey) AS line_count
    FROM lineitem LEFT JOIN ({CALENDAR}) c ON CAST(l_shipdate AS DATE) = c.date GROUP BY c.year, c.quarter, c.month, c.month_no""")
def _date_join(ctx):
    rows = star.date_join(fact(ctx).drop("date"), calendar(ctx), "l_shipdate")
    return star.grouped(
        rows, ["year", "quarter", "month", "month_no"], revenue=money("l_extendedprice"), line_count=star.measure("counta", "l_orderkey")
    )


@query("visual_bar", f"SELECT r_name, n_name, {total('l_extendedprice')} AS revenue FROM {STAR} GROUP BY r_name, n_name")
def _bar(ctx):
    return star.category_bar(star_rows(ctx), ["r_name", "n_name"], "revenue", money("l_extendedprice"))


@query("visual_combo", f"""
    SELECT monthname(l_shipdate) AS month, CAST(month(l_shipdate) AS INT) AS month_no, {total('l_extendedprice')} AS revenue, count(l_orderkey) AS line_count
    FROM lineitem GROUP BY 1, 2""")
def _combo(ctx):
    rows = fact(ctx).withColumns({"month": F.date_format("date", "MMMM"), "month_no": F.month("date")})
    return star.combo(rows, "month", "month_no", revenue=money("l_extendedprice"), line_count=star.measure("counta", "l_orderkey"))


@query("visual_card_filter", f"""
    SELECT count(l_orderkey) AS line_count, {total('l_extendedprice')} AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderpriority NOT IN ('1-URGENT') OR o_orderpriority IS NULL""")
def _card(ctx):
    rows = star.star_join(fact(ctx), [(ctx.base("orders"), "l_orderkey", "o_orderkey")])
    return star.card(
        rows, ("o_orderpriority", ["1-URGENT"]), line_count=star.measure("counta", "l_orderkey"), revenue=money("l_extendedprice")
    )


@query("drillthrough", f"""
    SELECT o_orderpriority, {total('l_extendedprice')} AS revenue FROM {STAR} WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment IN ('BUILDING') GROUP BY o_orderpriority""")
def _drill(ctx):
    rows = star.drillthrough(star_rows(ctx), r_name=["ASIA", "EUROPE"], c_mktsegment=["BUILDING"])
    return star.grouped(rows, ["o_orderpriority"], revenue=money("l_extendedprice"))


@query("visual_matrix", f"""
    SELECT o_orderpriority, r_name, p_type, CAST(3 - (CASE WHEN grouping(o_orderpriority) = 0 THEN 1 ELSE 0 END + CASE WHEN grouping(r_name) = 0 THEN 1 ELSE 0 END
            + CASE WHEN grouping(p_type) = 0 THEN 1 ELSE 0 END) AS INT) AS level,
        count(l_orderkey) AS line_count, {total('l_extendedprice')} AS revenue, {total('l_quantity')} AS quantity, {average('l_extendedprice')} AS avg_revenue
    FROM {STAR} GROUP BY ROLLUP (o_orderpriority, r_name, p_type)""")
def _matrix(ctx):
    return star.matrix(
        star_rows(ctx), ["o_orderpriority", "r_name", "p_type"], line_count=star.measure("counta", "l_orderkey"),
        revenue=money("l_extendedprice"), quantity=money("l_quantity"), avg_revenue=mean("l_extendedprice"),
    )


@query("slicer_values", "SELECT DISTINCT c_mktsegment FROM customer")
def _slicer(ctx):
    return star.slicer_values(ctx.base("customer"), "c_mktsegment")


@query("visual_share", f"""
    SELECT c_mktsegment, revenue, round(revenue / (sum(revenue) OVER ()), 6) AS share
    FROM (SELECT c_mktsegment, {total('l_extendedprice')} AS revenue FROM {STAR} GROUP BY c_mktsegment) g""")
def _share(ctx):
    return star.shares(star_rows(ctx), ["c_mktsegment"], "revenue", money("l_extendedprice")).withColumn("share", F.round("share", 6))


@query("date_drill", f"""
    SELECT CAST(year(l_shipdate) AS INT) AS year, 'Qtr ' || CAST(quarter(l_shipdate) AS VARCHAR) AS quarter, CAST(month(l_shipdate) AS INT) AS month,
        CAST(day(l_shipdate) AS INT) AS day, CAST(grouping(year(l_shipdate)) + grouping('Qtr ' || CAST(quarter(l_shipdate) AS VARCHAR)) + grouping(month(l_shipdate)) + grouping(day(l_shipdate)) AS INT) AS level,
        {total('l_extendedprice')} AS revenue
    FROM lineitem GROUP BY ROLLUP (year(l_shipdate), 'Qtr ' || CAST(quarter(l_shipdate) AS VARCHAR), month(l_shipdate), day(l_shipdate))""")
def _date_drill(ctx):
    return star.date_drill(fact(ctx), "date", revenue=money("l_extendedprice"))
