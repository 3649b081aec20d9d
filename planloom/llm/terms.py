"""Occurrences and record counts of every distinct value (problem 4).

Each record is turned into sorted entries with a flag on the first copy of a
value, inside the row and without a shuffle.  One hash aggregation then sums
occurrences (all entries) and records (flagged entries): Spark combines the
partial counts per task before the shuffle, so a value that a third of all rows
hold reaches the shuffle once per task, and the reducers see distinct values only.

Defined cases: null entries are no term, the empty string is one; an empty list
counts as a record without terms; a null field is no record; values are compared
exactly as stored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON_SHARE = (1, 20)  # a term in more than 1/20 of the records is common
RARE_RECORDS = 3  # a term in fewer records is rare


def term_counts(df: DataFrame, values: Column, field_name: str) -> DataFrame:
    """``field_name, term, n_occurrences, n_records, n_field_records`` for an array or plain string column."""
    is_array = df.select(values.alias("v")).schema["v"].dataType.typeName() == "array"
    entries = values if is_array else F.array(values)
    rows = df.where(values.isNotNull()).select(F.array_sort(F.filter(entries, lambda x: x.isNotNull())).alias("__sorted"))
    flagged = F.transform(
        "__sorted",
        lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("__sorted", i - 1))).cast("int").alias("first")),
    )
    n_field = df.where(values.isNotNull()).agg(F.count("*")).scalar()
    return (
        rows.select(F.explode(flagged).alias("e"))
        .groupBy(F.col("e.term").alias("term"))
        .agg(F.count("*").alias("n_occurrences"), F.sum("e.first").alias("n_records"))
        .select(F.lit(field_name).alias("field_name"), "term", "n_occurrences", "n_records", n_field.alias("n_field_records"))
    )


def mark_terms(counts: DataFrame, common: tuple[int, int] = COMMON_SHARE, rare_below: int = RARE_RECORDS) -> DataFrame:
    """Add ``mark``: 'common', else 'rare', else null."""
    part, whole = common
    mark = F.when(F.col("n_records") * whole > F.col("n_field_records") * part, "common").when(
        F.col("n_records") < rare_below, "rare"
    )
    return counts.withColumn("mark", mark)
