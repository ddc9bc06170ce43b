"""Mix sources to target weights by hash-threshold histograms.

Method.  The size of a document is its number of words.  A source's target is its weight's share
of the budget, stopped at ``most`` times the source's own size, with the excess shared again by
weight until no target is above its stop.  A source takes each document floor(target / size) times
and once more those whose hash is at or below a threshold.  The threshold comes from nested
histograms: sizes are summed by source and hash bucket, the running sum finds the bucket in which
the budget ends, and only that bucket is counted again on finer buckets.  Nothing is sorted by
hash; documents are filtered by the threshold.

The hash depends on the id and the text only, so reruns agree, however rows are spread.

Rows: null or blank texts have size 0 and take nothing; a null source is a source, the last one;
rows with equal id and text are taken or left together; an empty table gives an empty result;
other columns pass through ``apply`` untouched, except those it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import Work, rows_like

HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3
KEYS = ["_no_source", "_source"]


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(key: str = "doc_id", text: str = "text") -> Column:
    """A number below 2**60 from id and text."""
    content = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    named = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), content).cast("binary"))
    return F.conv(F.substring(named, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_keys(source: str = "source") -> list[Column]:
    return [F.col(source).isNull().alias(KEYS[0]), F.coalesce(F.col(source), F.lit("")).alias(KEYS[1])]


def measured(docs: DataFrame) -> DataFrame:
    """The narrow rows that budgets are counted on."""
    return docs.select("doc_id", *source_keys(), size_of().alias("size"), place_of().alias("_place"))


def _numbered(work: Work, sources: DataFrame) -> DataFrame:
    """Position of every source in the order of KEYS, from 0, without one sort of all of them."""
    ranged = work.keep(sources.repartitionByRange(*KEYS).withColumn("_part", F.spark_partition_id()))
    before, starts = 0, []
    for part, n in sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = rows_like(work.spark, "_part int, _before bigint", starts)
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*KEYS)) - 1
    return ranged.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_before") + inside).drop("_part", "_before")


def plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """Per source: source_size, target, times, upto (``rows`` as ``measured`` gives them, written)."""
    work = Work(rows.sparkSession, "mixture")
    sources = rows.groupBy(*KEYS).agg(F.sum("size").alias("source_size"))
    numbered = _numbered(work, sources)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("long")
    sources = work.keep(numbered.withColumn("_weight", weight).withColumn("_stop", F.col("source_size") * most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # each round stops more sources; the level only rises
        over = F.col("_weight") * F.lit(level) > F.col("_stop") if stopped >= 0 else F.lit(False)
        n, full, free = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_stop"))), F.sum(F.when(~over, F.col("_weight")))
        ).first()
        if n == stopped or not free:
            break
        level, stopped = (total * share - (full or 0)) / free, n
    target = F.least(F.col("_weight") * F.lit(level), F.col("_stop").cast("double"))
    sources = sources.withColumn("target", target).withColumn(
        "times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("_left", F.col("target") - F.col("times") * F.col("source_size"))
    sources = work.keep(sources)

    # Nested thresholds: the bucket in which the rest of the budget ends, then finer buckets in it.
    ends = sources.select(*KEYS, F.lit(0).cast("long").alias("_prefix"), "_left")
    inside = rows
    shift = HASH_BITS
    by_source = W.partitionBy(*KEYS).orderBy("_bucket")
    for _ in range(LEVELS):
        finer = shift - LEVEL_BITS
        inside = inside.withColumn("_prefix", F.shiftright("_place", shift)).join(ends, [*KEYS, "_prefix"]).drop("_left")
        sums = inside.groupBy(*KEYS, F.shiftright("_place", finer).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        running = sums.withColumn("_after", F.sum("_sum").over(by_source)).join(ends.drop("_prefix"), KEYS)
        ends = work.keep(
            running.where((F.col("_after") > F.col("_left")) & (F.col("_after") - F.col("_sum") <= F.col("_left")))
            .select(*KEYS, F.col("_bucket").alias("_prefix"), (F.col("_left") - (F.col("_after") - F.col("_sum"))).alias("_left"))
        )
        inside = inside.drop("_prefix")
        shift = finer
    last = inside.withColumn("_prefix", F.shiftright("_place", shift)).join(ends, [*KEYS, "_prefix"])
    groups = last.groupBy(*KEYS, F.col("_place").alias("_bucket")).agg(
        F.sum("size").alias("_sum"), F.first("_left").alias("_left"), F.first("_prefix").alias("_prefix")
    )
    middle = F.sum("_sum").over(by_source) * 2 - F.col("_sum")
    upto = groups.withColumn("_in", middle < F.col("_left") * 2).groupBy(*KEYS).agg(
        F.coalesce(F.max(F.when(F.col("_in"), F.col("_bucket"))), F.shiftleft(F.first("_prefix"), shift) - 1).alias("upto")
    )
    return work.keep(
        sources.join(upto, KEYS, "left")
        .select(*KEYS, "position", "source_size", "target", "times", F.coalesce("upto", F.lit(-1)).alias("upto"))
    )


def apply(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """``rows`` (with KEYS and ``_place``) and ``copies``: how often the mix takes each."""
    copies = (F.col("times") + (F.col("_place") <= F.col("upto")).cast("long")).alias("copies")
    return rows.join(budget, KEYS).select(*rows.columns, "source_size", "target", copies)


def mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    work = Work(docs.sparkSession, "mixture-rows")
    rows = work.keep(measured(docs))
    done = apply(rows, plan(rows))
    source = F.when(~F.col(KEYS[0]), F.col(KEYS[1])).alias("source")
    return done.select("doc_id", source, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def materialise_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, columns unchanged."""
    work = Work(docs.sparkSession, "mixture-rows")
    rows = work.keep(measured(docs))
    budget = plan(rows)
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    keyed = docs.select(own, *source_keys(), place_of().alias("_place"))
    taken = apply(keyed, budget).where(F.col("copies") > 0)
    # pyspark's range of one element per copy; rows stay where they are
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")
