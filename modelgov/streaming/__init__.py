"""Incremental scan of definition folders.

The text operators are narrow, so they run on this stream as they run on a batch scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_definition
from ..sources.definitions import folder_id


def scan_stream(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    """New model definition files as they arrive -> (model_id, path, content)."""
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.tmdl")
        .option("maxFilesPerTrigger", str(max_files))
        .load(root)
        .select(uri.alias("uri"), normalise_definition("value").alias("content"))
        .select(folder_id(F.col("uri")).alias("model_id"), F.regexp_extract("uri", r"/definition/(.+)$", 1).alias("path"), "content")
    )
