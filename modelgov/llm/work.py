"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names, and shared small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class Work:
    """Tables that one operator writes and reads again.

    A written table cuts lineage and survives lost executors.  ``drop`` deletes tables that no
    later step reads; tables a returned DataFrame still reads stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._work_path = path  # type: ignore[attr-defined]
        return back

    def keep_bucketed(self, df: DataFrame, column: str, buckets: int, codec: str = "zstd", **options: str) -> DataFrame:
        """Like ``keep``, in buckets of ``column``: a join on it moves the other side only.

        A task whose rows share their ``column`` writes one file.  The table is external and known to this session
        only; ``drop`` forgets it.
        """
        path, name = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}", f"kept_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, column).options(path=path, compression=codec, **options).saveAsTable(name)
        back = self.spark.table(name)
        self.paths[id(back)] = path
        back._work_path, back._work_table = path, name  # type: ignore[attr-defined]
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if hasattr(df, "_work_table"):
                self.spark.sql(f"DROP TABLE {df._work_table}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._work_path)  # type: ignore[attr-defined]
            path.getFileSystem(conf).delete(path, True)


def rows_like(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table made on the driver from plain numbers, as SQL literals; ``columns`` is a DDL list."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    kinds = [c.strip().split()[1] for c in columns.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) {n}" for n, k in zip(names, kinds, strict=True)) + " WHERE false")
    body = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in row) + ")" for row in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return raw.select(*(F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))
