"""File listing by glob (SRC-4): metadata only, the content column is pruned from the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, base_dir: str, pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """path, relative_path, name, size_bytes, modified for files matching ``pattern``.

    Directories never match (the binary-file source lists files only)."""
    base = base_dir.rstrip("/")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    df = reader.load(base)
    if not recursive:  # files directly under the folder, also where nothing matches
        parent = F.regexp_replace(F.col("path"), "/[^/]*$", "")
        df = df.filter(F.regexp_replace(parent, r"^[a-z]+:/*", "/") == F.lit("/" + re.sub(r"^[a-z]+:/*", "", base).lstrip("/")))
    path = F.regexp_replace(F.col("path"), r"^file:", "")
    return df.select(
        path.alias("path"),
        F.regexp_replace(path, r"^.*?" + _escape(base) + "/", "").alias("relative_path"),
        F.element_at(F.split(path, "/"), -1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.date_format(F.col("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("modified"),
    )


def _escape(s: str) -> str:
    return re.escape(s)
