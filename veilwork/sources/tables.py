"""Parquet tables as input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files, whether it is one file or a folder of many.

    A file stream takes a pattern or a folder but no single file, hence the one-letter class.
    """
    schema = read_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by ``key``, for a caller who knows that the source is a few small files.

    It moves every row once. Tables of many files need no such thing, and no reader asks for it by itself.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def load_documents(
    spark: SparkSession, folder: str, filename: Column | None = None, columns: tuple[str, ...] = ()
) -> DataFrame:
    """``documents`` as (doc_id, filename, text, ...); the scan reads only what is asked for."""
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")) if filename is None else filename
    return read_table(spark, folder, "documents").select("doc_id", name.alias("filename"), "text", *columns)
