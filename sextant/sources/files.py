"""Sources of snippets and model lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import extract_family, fold, format_size, is_code_model


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content): each file whole; the name is the last part of its path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "content")


def from_text(spark: SparkSession, name: str, content: str) -> DataFrame:
    return spark.createDataFrame([(name, content)], "name string, content string")


def model_list(replies: DataFrame, column: str = "value") -> DataFrame:
    """(name, family, size, is_code) of the models in JSON replies, code models first, then by name."""
    models = F.from_json(column, "models array<struct<name: string, size: bigint>>")["models"]
    rows = replies.select(F.explode(models).alias("m")).select("m.name", extract_family(F.col("m.name")).alias("family"), format_size(F.coalesce("m.size", F.lit(0))).alias("size"), is_code_model(F.col("m.name")).alias("is_code"))
    return rows.orderBy(F.desc("is_code"), fold(F.col("name")), "name")


def completion_text(chunks: DataFrame, column: str = "value") -> DataFrame:
    """(text, done) of each line of a completion stream, in either of the two reply forms."""
    reply = F.from_json(column, "response string, message struct<content: string>, done boolean")
    return chunks.select(F.coalesce(reply["message"]["content"], reply["response"], F.lit("")).alias("text"), F.coalesce(reply["done"], F.lit(False)).alias("done"))
