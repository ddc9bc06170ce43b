"""Graph operators: filter propagation and measure dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.relations import with_typed_nulls


def reach(edges: DataFrame) -> DataFrame:
    """Transitive closure with fewest hops: (model_id, src, dst, hops), self pairs left out.

    ``edges`` is (model_id, src, dst).  Path doubling: a shortest path of more than n and at most 2n hops
    is one of exactly n hops followed by one of at most n.  So a round joins the pairs exactly n hops
    apart with all pairs known, and a path of 2,000 edges takes 11 rounds.  A pair found is one
    of the result's pairs, cycles end by themselves, and hop counts are exact because a pair's first round
    holds all its shortest paths.  Every round is written to the shared checkpoint folder, so a lost executor costs one
    round at most.  The loop runs until no pair is exactly n hops apart.
    """
    known = materialise(edges.select("model_id", "src", "dst").filter(F.col("src") != F.col("dst")).distinct().withColumn("hops", F.lit(1)))
    farthest, hops = known, 1
    while not farthest.isEmpty():
        rest = known.select("model_id", F.col("src").alias("middle"), F.col("dst"), F.col("hops").alias("more"))
        found = (
            farthest.select("model_id", "src", F.col("dst").alias("middle"))
            .join(rest, ["model_id", "middle"])
            .filter(F.col("src") != F.col("dst"))
            .groupBy("model_id", "src", "dst").agg((F.min("more") + hops).alias("hops"))
            .join(known, ["model_id", "src", "dst"], "left_anti")
        )
        level = materialise(found)
        known, hops = known.unionByName(level), 2 * hops
        farthest = level.filter(F.col("hops") == hops)
    return known


def reachable_from(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reachable from any start node, start included: (model_id, node).

    One visited set per model instead of all pairs.
    """
    level = materialise(start.select("model_id", "node").distinct())
    known = level
    step = materialise(edges.select("model_id", F.col("src").alias("node"), "dst").distinct())
    while True:
        found = (
            level.join(step, ["model_id", "node"])
            .select("model_id", F.col("dst").alias("node"))
            .distinct()
            .join(known, ["model_id", "node"], "left_anti")
        )
        level = materialise(found)
        if level.isEmpty():
            return known
        known = known.unionByName(level)


def filter_edges(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges src -> dst meaning "src filters dst", from active relationships.

    The one side filters the many side; ``bothDirections`` adds the way back.  Missing
    direction and activity columns mean one direction and active.
    """
    names = tables.select("model_id", "table_id", "table_name")
    rel = with_typed_nulls(relations, cross_filter="string", is_active="boolean")
    active = F.coalesce(F.lower(F.col("is_active").cast("string")) != "false", F.lit(True))
    rel = (
        rel.filter(active)
        .join(names.select("model_id", F.col("table_id").alias("from_table_id"), F.col("table_name").alias("many")),
              ["model_id", "from_table_id"])
        .join(names.select("model_id", F.col("table_id").alias("to_table_id"), F.col("table_name").alias("one")),
              ["model_id", "to_table_id"])
    )
    forward = F.struct(F.col("one").alias("src"), F.col("many").alias("dst"))
    back = F.struct(F.col("many").alias("src"), F.col("one").alias("dst"))
    both = F.col("cross_filter") == "bothDirections"
    return (
        rel.select("model_id", F.explode(F.when(both, F.array(forward, back)).otherwise(F.array(forward))).alias("e"))
        .select("model_id", "e.src", "e.dst")
        .distinct()
    )


def filter_lineage(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """For each table, every table whose filter reaches it; isolated tables get (none), -1."""
    pairs = reach(edges).select(
        "model_id", F.col("dst").alias("table_name"), F.col("src").alias("filtered_by"), "hops"
    )
    return (
        tables.select("model_id", "table_name").distinct()
        .join(pairs, ["model_id", "table_name"], "left")
        .select(
            "model_id", "table_name",
            F.coalesce("filtered_by", F.lit("(none)")).alias("filtered_by"),
            F.coalesce("hops", F.lit(-1)).alias("hops"),
        )
    )


def measure_lineage(lineage: DataFrame, columns: DataFrame) -> DataFrame:
    """Measures take over the filter sources of their home table.

    ``columns``: model_id, table_name, column_name, kind.
    """
    measures = columns.filter(F.col("kind") == "measure").select(
        "model_id", F.col("column_name").alias("measure"), F.col("table_name").alias("home_table")
    )
    sources = lineage.withColumnRenamed("table_name", "home_table")
    return measures.join(sources, ["model_id", "home_table"], "left").select(
        "model_id", "measure", "home_table",
        F.coalesce("filtered_by", F.lit("(none)")).alias("filtered_by"),
        F.coalesce("hops", F.lit(-1)).alias("hops"),
    )


def lineage_summary(edges: DataFrame, lineage: DataFrame) -> DataFrame:
    """Per model: edges, reachable pairs, isolated tables."""
    n_edges = edges.groupBy("model_id").agg(F.count("*").alias("n_edges"))
    pairs = lineage.groupBy("model_id").agg(
        F.count_if(F.col("hops") > 0).alias("n_pairs"), F.count_if(F.col("hops") == -1).alias("n_isolated")
    )
    return pairs.join(n_edges, "model_id", "left").select(
        "model_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_pairs", "n_isolated"
    )


def measure_closure(formulas: DataFrame, refs: DataFrame) -> DataFrame:
    """Everything a measure depends on: (model_id, table_name, measure, dep_table, dep_column).

    ``formulas``: model_id, path, table_name, measure, formula, as a written table.
    ``refs``: model_id, table_name, measure, ref_table, ref_column (bare: null ref_table).

    Bare names that are measures are followed (first table by path wins, a qualified column of
    the same name in the same formula hides them); bare column names are not recorded.  The
    measure itself is part of its rows.
    """
    # References are read several times and come from text, so they are written once.
    formulas = formulas.select("model_id", "path", "table_name", "measure")
    refs = materialise(refs)
    owner = F.struct(F.col("table_name").alias("t"), F.col("measure").alias("m"))
    home = formulas.groupBy("model_id", F.col("measure").alias("ref_column")).agg(
        F.min(F.struct("path", "table_name"))["table_name"].alias("ref_home")
    )
    qualified = refs.filter(F.col("ref_table").isNotNull())
    bare = refs.filter(F.col("ref_table").isNull()).join(
        qualified.select("model_id", "table_name", "measure", "ref_column"),
        ["model_id", "table_name", "measure", "ref_column"], "left_anti",
    )
    edges = bare.join(home, ["model_id", "ref_column"]).select(
        "model_id", owner.alias("src"),
        F.struct(F.col("ref_home").alias("t"), F.col("ref_column").alias("m")).alias("dst"),
    )
    pairs = reach(edges)
    itself = formulas.select("model_id", owner.alias("src"), owner.alias("dst")).distinct()
    # With the self pairs added, one join brings every direct reference to every owner.
    all_pairs = pairs.select("model_id", "src", "dst").unionByName(itself)
    direct = qualified.select(
        "model_id", owner.alias("dst"), F.col("ref_table").alias("dep_table"), F.col("ref_column").alias("dep_column")
    )
    deps = all_pairs.join(direct, ["model_id", "dst"]).select("model_id", "src", "dep_table", "dep_column")
    nested = all_pairs.select(
        "model_id", "src", F.col("dst.t").alias("dep_table"), F.col("dst.m").alias("dep_column")
    )
    return (
        deps.unionByName(nested).distinct()
        .select("model_id", F.col("src.t").alias("table_name"), F.col("src.m").alias("measure"), "dep_table", "dep_column")
    )
