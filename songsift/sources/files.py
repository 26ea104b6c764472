"""Finding input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_files(spark: SparkSession, base: str, ext: str = ".h5") -> DataFrame:
    """Every file below ``base`` whose name ends in ``ext``, without reading its content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{ext}")
        .load(base)
        .select("path", "length", "modificationTime")
    )
