"""Connected components of a graph given as edges, for the operators of this package.

Alternating large-star / small-star rounds (Kiveris et al., "Connected components
in MapReduce and beyond").  Every round is two hash aggregations over the edges;
lineage is cut by a reliable checkpoint per round, and a round only reads the
checkpoint of the one before.  A star step sends a vertex's edges through a
``min`` aggregation (combined before the shuffle) and a join on the vertex and a salt,
so the edges of a hub are met by ``HUB_SALTS`` tasks and never collected into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.session import cut
from planloom.skew import salt_of

HUB_SALTS = 16


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` joined to ``low`` (unique on ``u``), the edges of one vertex over all salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1)))
    return edges.withColumn("s", salt_of("v", salts=HUB_SALTS)).join(low.withColumn("s", salts), ["u", "s"]).drop("s")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on directed pairs ``u > v`` (no self loops)."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = _with_least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = _with_least(edges, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that has an edge; ``edges`` has string columns ``u`` and ``v``.

    ``component`` is the least node of the component.  Null ends and self loops are
    ignored.  Raises if the rounds do not suffice rather than return a partial answer.
    """
    now = cut(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    for _ in range(max_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        new = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
