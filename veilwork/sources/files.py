"""Files as input: text decoding and routing by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork import patterns


def read_binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, content, file_size) of the files below ``path``.

    Spark's file reader leaves out files of no bytes; they have no text to process.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            "path",
            F.substring_index("path", "/", -1).alias("filename"),
            "content",
            F.col("length").alias("file_size"),
        )
    )


def decode_text(df: DataFrame) -> DataFrame:
    """Add ``text`` and ``error`` from ``content``: strict UTF-8, a bad file fails alone."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.withColumn("text", text).withColumn(
        "error",
        F.when(F.col("content").isNotNull() & F.col("text").isNull(), F.lit("Invalid UTF-8 text")),
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return decode_text(read_binary_files(spark, path, "*.[tT][xX][tT]"))


def route_format(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Add ``file_type`` (the lower-cased part after the last dot) and an error if not accepted."""
    file_type = F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1)))
    refused = F.when(
        ~file_type.isin(*patterns.ACCEPTED_TYPES), F.concat(F.lit("Unsupported file format: "), file_type)
    )
    error = F.coalesce(F.col("error"), refused) if "error" in df.columns else refused
    return df.withColumn("file_type", file_type).withColumn("error", error)
