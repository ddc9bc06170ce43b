"""Queries registered with the driver, each with the statement that checks it.

A query takes a context over one scale-factor folder.  All of them read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import textparse as tp
from ..session import INITIAL_PARTITIONS, dealt, materialise, release_shuffles, reuse_dealing
from .lenses import DEALT_LENSES, base, lens, with_lenses


@dataclass
class Context:
    spark: SparkSession
    sf_dir: str
    written: dict[str, DataFrame] = field(default_factory=dict)

    def base(self, name: str) -> DataFrame:
        return base(self.spark, self.sf_dir, name)

    def lens(self, name: str) -> DataFrame:
        return lens(self.spark, self.sf_dir, name, self.written)

    def share(self, *names: str) -> None:
        """Write lenses that one query reads many times; later lenses build on the tables."""
        for name in names:
            if name not in self.written:
                self.written[name] = materialise(self.lens(name))

    def deal(self, **by: str) -> None:
        """``share`` as tables dealt by a column each, so that joins by them do not move them."""
        reuse_dealing(self.spark)
        for name, column in by.items():
            if name not in self.written:
                rows = self.lens(name)
                self.written[name] = dealt(rows if name in DEALT_LENSES else rows.repartition(column), column)

    @cached_property
    def waves(self) -> int:
        """Parts in which files of their own are written and read, one part on disk at a time."""
        return max(1, -(-input_bytes(self.spark, self.sf_dir) // WAVE_BYTES))

    @cached_property
    def files(self) -> DataFrame:
        return self.lens("lens_files")

    @cached_property
    def blocks(self) -> DataFrame:
        return tp.blocks(self.files)

    @cached_property
    def declared(self) -> DataFrame:
        """Columns and measures of the files, read from the text once and written."""
        return materialise(tp.declarations(self.blocks))


QUERIES: dict[str, Callable[[Context], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function under ``name``; ``sql`` may name lenses."""

    def register(fn: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_lenses(sql)
        return fn

    return register


#: input that one shuffle partition stands for before adaptive execution merges small ones
PARTITION_BYTES = 2 << 20
#: input whose files of their own are on disk at once
WAVE_BYTES = 64 << 20


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def spread(spark: SparkSession, sf_dir: str) -> None:
    """Let shuffles start from partitions in proportion to the input, so that a task's memory does not grow with it.

    Adaptive execution merges those that turn out small; ``spark.sql.shuffle.partitions`` stays the least.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL_PARTITIONS, max(least, -(-input_bytes(spark, sf_dir) // PARTITION_BYTES)))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark, sf_dir)
    reuse_dealing(spark, False)
    release_shuffles(spark)
    return QUERIES[name](Context(spark, sf_dir))


def load_all() -> None:
    """Import every module that registers queries."""
    from . import catalog_queries, data_queries, decision_queries, file_queries, legacy_queries, report_queries, text_queries  # noqa: F401
