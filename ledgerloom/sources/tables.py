"""Scans: the Parquet tables of a folder, yearly file families with lineage, text records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def families(spark: SparkSession, paths: dict[int, str], reader: str = "parquet", schema=None, **options) -> DataFrame:
    """The yearly files of one family, united by column name, with source_file and source_year. Columns that a year lacks are null there."""
    out = None
    for year, path in sorted(paths.items()):
        load = spark.read.format(reader).options(**options)
        one = (load.schema(schema) if schema else load).load(path)
        one = one.select("*", F.col("_metadata.file_name").alias("source_file"), F.lit(year).alias("source_year"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def csv_records(spark: SparkSession, path: str, schema, null: str = "") -> DataFrame:
    """Delimited text with a header, plain or gzip, every column of the type told; a byte-order mark is dropped. Quoted values may hold line breaks, so a file is one task's. A cell that is `null` is null; where that is the empty text, texts that are empty are null too."""
    return spark.read.schema(schema).options(header=True, encoding="UTF-8", multiLine=True, escape='"', nullValue=null, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
