"""The row-local operators and the dedup of commands on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.columns import text_key
from planloom.functions.normalize import normalize
from planloom.operators.plans import with_issues


def read_records(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def checked_stream(df: DataFrame, text: str = "input", goals: str = "goals") -> DataFrame:
    """Normalised text, issues and validity of each arriving row."""
    return with_issues(df.withColumn("normalized_input", normalize(F.col(text))), goals).drop("parsed")


def first_per_text(df: DataFrame, time: str, text: str = "input", late: str = "1 day") -> DataFrame:
    """The first arrival of every text; state of a text is kept for the lateness allowed."""
    return df.withColumn("text_key", text_key(F.coalesce(F.col(text), F.lit("")))).withWatermark(time, late).dropDuplicatesWithinWatermark(["text_key"])


def issue_counts(df: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Issues per window of event time and code."""
    rows = df.withWatermark(time, late).select(time, F.explode("issues").alias("i"))
    return rows.groupBy(F.window(time, window).alias("w"), F.col("i.code").alias("code")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "code", "n")
