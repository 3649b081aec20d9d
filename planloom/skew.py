"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000  # a counted side of at most so many rows may be broadcast
JOIN_SALTS = 16


def salt_of(*cols: Column | str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def lookup_join(rows: DataFrame, side: DataFrame, key: str, spread_by: str, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` to ``side`` (unique on ``key``), whatever the share of the hottest key.

    ``side`` is counted first: up to ``bound`` rows it is broadcast.  Beyond that, the
    rows of a key are salted by a hash of ``spread_by`` and the side is repeated per salt.
    """
    if side.limit(bound + 1).count() <= bound:
        return rows.join(F.broadcast(side), key, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))
    salted = rows.withColumn("__salt", salt_of(spread_by, salts=JOIN_SALTS))
    return salted.join(side.withColumn("__salt", salts), [key, "__salt"], how).drop("__salt")


def salted_rank(df: DataFrame, group: list[str], id_col: str, name: str, salts: int, bound: int = 1_000_000) -> DataFrame:
    """Number the rows of each group from 0 in column ``name``, a hot group by many tasks.

    Rows are ranked inside (group, salt) by a hash of the id; the offset of each
    salt is the count of the salts before it.  The offsets hold one row per group
    and salt; they are broadcast behind a count, and joined on group and salt beyond ``bound``.
    """
    salted = df.withColumn("__salt", salt_of(id_col, salts=salts))
    counts = salted.groupBy(*group, "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__salt")) - F.col("__n")
    offsets = counts.select(*group, "__salt", before.alias("__offset"))
    small = offsets.limit(bound + 1).count() <= bound
    order = Window.partitionBy(*group, "__salt").orderBy(F.xxhash64(id_col, F.lit(1)), id_col)
    ranked = salted.withColumn("__at", F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(offsets) if small else offsets, [*group, "__salt"])
    return joined.withColumn(name, (F.col("__at") + F.col("__offset")).cast("long")).drop("__at", "__offset", "__salt")
