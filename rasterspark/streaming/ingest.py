"""Containers that arrive in a folder, as a stream of files; every relation of the reader applies to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reader import is_container

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return rows.filter(is_container(F.col("content"), F.col("length"))).select("path", "content")
