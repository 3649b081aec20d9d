"""Deduplication with label conflicts, quotas, balanced fill, splits and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.columns import text_key
from planloom.session import cut
from planloom.skew import BROADCAST_ROWS, lookup_join


def hash_rank(seed: int | str, key: Column) -> Column:
    """Order key of seeded sampling: md5 of ``seed:key``; the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def attempt_status_counts(df: DataFrame, id_col: str, refused: Column, text: str = "input", goals: str = "goals") -> DataFrame:
    """``status, n`` of attempts to add rows to a set, in the order of their ids, by two aggregations and no join.

    ``refused`` names why a row is not even compared (an error of its generation, an invalid
    plan, another signature than asked for), null for the others: of these, the first row
    of a text is 'added', rows with its plan are 'duplicate', all others 'label_conflict'.
    Rows are counted per text and plan first (128-bit hashes of both, combined before the
    shuffle), then per text.
    """
    taken = F.col("refused").isNull()
    key = F.md5(text_key(F.coalesce(F.col(text), F.lit(""))))
    plan = F.when(F.col(goals).isNotNull(), F.md5(F.to_json(F.struct(goals))))
    rows = df.select(refused.alias("refused"), key.alias("k"), plan.alias("g"), F.col(id_col).alias("id"))
    pairs = rows.select("refused", F.when(taken, F.col("k")).alias("k"), F.when(taken, F.col("g")).alias("g"), "id").groupBy("refused", "k", "g").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    texts = pairs.groupBy("refused", "k").agg(F.sum("n").alias("n"), F.min_by("n", "id").alias("of_first"))
    parts = (("added", F.lit(1)), ("duplicate", F.col("of_first") - 1), ("label_conflict", F.col("n") - F.col("of_first")))
    compared = F.array(*[F.struct(F.lit(x).alias("status"), c.cast("long").alias("n")) for x, c in parts])
    counts = texts.select(F.explode(F.when(taken, compared).otherwise(F.array(F.struct(F.col("refused").alias("status"), F.col("n").alias("n"))))).alias("c"))
    return counts.groupBy("c.status").agg(F.sum("c.n").alias("n")).where("n > 0")


def dedup_status(df: DataFrame, id_col: str, text: str = "input", goals: str = "goals", valid: Column | None = None) -> DataFrame:
    """Add ``status``: 'added' for the first row of a text, then 'duplicate' or 'label_conflict'; 'invalid_label' where ``valid`` is false.

    The first row of a text is found by an aggregation that keeps one row per task and
    text; its rows are joined back over a salt, so the copies of a text that a third of
    all rows hold are neither sorted nor joined in one task.
    """
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    keyed = df.withColumn("__key", text_key(F.coalesce(F.col(text), F.lit("")))).withColumn("__ok", ok)
    first = keyed.where("__ok").groupBy("__key").agg(F.min_by(F.struct(F.col(id_col).alias("id"), F.col(goals).alias("goals")), F.col(id_col)).alias("__first"))
    joined = lookup_join(keyed, first, "__key", id_col, "left")
    status = (
        F.when(~F.col("__ok"), "invalid_label")
        .when(F.col(id_col) == F.col("__first.id"), "added")
        .when(F.col(goals).eqNullSafe(F.col("__first.goals")), "duplicate")
        .otherwise("label_conflict")
    )
    return joined.withColumn("status", status).drop("__key", "__ok", "__first")


def dedup_first(df: DataFrame, id_col: str, text: str = "input") -> DataFrame:
    """The first row of every text, by id."""
    rest = [c for c in df.columns]
    keyed = df.withColumn("__key", text_key(F.coalesce(F.col(text), F.lit(""))))
    return keyed.groupBy("__key").agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("r")).select("r.*")


def even_quota(items: DataFrame, order: list[str], total: Column, by: list[str] | None = None, name: str = "quota") -> DataFrame:
    """Split ``total`` evenly over the items (of each ``by`` group); the first ones take the remainder."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n, at = F.count("*").over(group), F.row_number().over(group.orderBy(*order))
    whole = F.floor(total / n).cast("long")
    return items.withColumn(name, whole + (at <= total - whole * n).cast("long"))


def hierarchical_quota(strata: DataFrame, n_samples: int, person_ratio: float) -> DataFrame:
    """Quotas of ``category, family, signature``: by ratio, evenly over families, evenly over signatures."""
    if n_samples < 1 or not 0.0 <= person_ratio <= 1.0:
        raise ValueError("n_samples must be positive and person_ratio within 0..1")
    people = int(n_samples * person_ratio)
    of_category = F.when(F.col("category") == "people", people).otherwise(n_samples - people).cast("long")
    families = even_quota(strata.select("category", "family").distinct(), ["family"], of_category, ["category"], "family_quota")
    every = strata.select("category", "family", "signature").distinct().join(families, ["category", "family"])
    return even_quota(every, ["signature"], F.col("family_quota"), ["category", "family"])


FILL_SALTS = 16
def raise_levels(items: DataFrame, by: list[str], order: list[str], base: str, cap: str, goal: str, name: str) -> DataFrame:
    """Add ``name``: in every group the lowest ``base`` are raised to a common level, none above its ``cap``, until the sum is ``goal`` (or all are full).

    A remainder below one step for each goes to the first open items in ``order``.  The sum
    is piecewise linear in the level: it gets steeper where an item starts to rise and
    flatter where one is full, so the level is found by running sums over these places.
    """
    low = F.least(base, cap)
    places = items.select(*by, low.alias("__p"), F.lit(1).alias("__d")).unionByName(items.select(*by, F.col(cap).alias("__p"), F.lit(-1).alias("__d")))
    totals = items.groupBy(*by).agg(F.sum(low).alias("__s0"), F.least(F.max(goal), F.sum(cap)).alias("__g"))
    along = Window.partitionBy(*by).orderBy("__p")
    steps = places.groupBy(*by, "__p").agg(F.sum("__d").alias("__d")).withColumn("__slope", F.sum("__d").over(along))
    steps = steps.withColumn("__more", F.coalesce(F.lag("__slope").over(along) * (F.col("__p") - F.lag("__p").over(along)), F.lit(0)))
    reached = steps.withColumn("__s", F.sum("__more").over(along)).join(totals, by).withColumn("__left", F.col("__g") - F.col("__s0") - F.col("__s")).where("__left >= 0")
    last = reached.groupBy(*by).agg(F.max_by(F.struct("__p", "__slope", "__left"), "__p").alias("__k"))
    rise = F.when(F.col("__k.__slope") > 0, F.floor(F.col("__k.__left") / F.col("__k.__slope"))).otherwise(0)
    levels = last.select(*by, (F.col("__k.__p") + rise).alias("__level"), F.when(F.col("__k.__slope") > 0, F.col("__k.__left") - rise * F.col("__k.__slope")).otherwise(0).alias("__rest"))
    found = items.join(levels, by, "left").withColumn("__now", F.least(cap, F.greatest(low, F.coalesce("__level", low))))
    found = found.withColumn("__open", F.coalesce((F.col("__now") == F.col("__level")) & (F.col("__now") < F.col(cap)), F.lit(False)))
    at = F.row_number().over(Window.partitionBy(*by, "__open").orderBy(*order))
    extra = (F.col("__open") & (at <= F.col("__rest"))).cast("long")
    return found.withColumn(name, (F.col("__now") + F.coalesce(extra, F.lit(0))).cast("long")).drop("__level", "__rest", "__now", "__open")


def water_fill(strata: DataFrame) -> DataFrame:
    """Add ``final_quota`` to rows of ``category, family, signature, family_quota, quota, capacity``.

    What saturated strata cannot take stays in its category: it raises the least filled
    families first and, inside a family, the least filled signatures.
    """
    rows = strata.select("category", "family", "signature", "quota", "capacity")
    families = rows.groupBy("category", "family").agg(F.sum("quota").alias("q"), F.sum("capacity").alias("c"))
    families = families.withColumn("goal", F.sum("q").over(Window.partitionBy("category")))  # one row per family
    totals = raise_levels(families, ["category"], ["family"], "q", "c", "goal", "total").select("category", "family", "total")
    return raise_levels(rows.join(totals, ["category", "family"]), ["category", "family"], ["signature"], "quota", "capacity", "total", "final_quota").drop("total")


def fill_strata(candidates: DataFrame, quotas: DataFrame, strata: list[str], key: Column, seed: int | str, quota: str = "final_quota") -> DataFrame:
    """The first ``quota`` candidates of each stratum in seeded hash order.

    No stratum is sorted: its candidates are counted by the first digits of their hash, all
    below the digits in which the quota ends are taken, and only the candidates that share
    these, one in 65,536 of the stratum, are ranked.
    """
    side = cut(quotas.select(*strata, F.col(quota).alias("__quota")).where("__quota > 0"))  # one row per stratum, read three times
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(side) if small else side
    hashed = candidates.withColumn("__h", hash_rank(seed, key)).withColumn("__digits", F.substring("__h", 1, 4)).join(side, strata)
    counts = hashed.groupBy(*strata, "__quota", "__digits").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*strata).orderBy("__digits"))  # at most 65,536 rows of a stratum
    ends = counts.withColumn("__upto", upto).where((F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__n") < F.col("__quota")))
    ends = ends.select(*strata, F.col("__digits").alias("__end"), (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__need"))
    met = hashed.drop("__quota").join(F.broadcast(ends) if small else ends, strata, "left")
    inner = met.where(F.col("__end").isNull() | (F.col("__digits") < F.col("__end")))
    last = met.where(F.col("__digits") == F.col("__end")).withColumn("__at", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key))).where("__at <= __need").drop("__at")
    return inner.unionByName(last).drop("__h", "__digits", "__end", "__need")


def require_size(df: DataFrame, n: int) -> DataFrame:
    found = df.count()
    if found != n:
        raise RuntimeError(f"{found} rows instead of {n}")
    return df


def shuffle_rows(df: DataFrame, key: Column, seed: int | str) -> DataFrame:
    """A seeded permutation: rows in the order of their hash."""
    return df.orderBy(hash_rank(seed, key), key)


def split_eval(df: DataFrame, key: Column, seed: int | str, percent: int = 10) -> DataFrame:
    """Add ``part``: the ``ceil(n * percent / 100)`` rows of lowest hash are 'eval', the others 'train'.

    Only the hash at the boundary is looked up; rows are not ranked globally.
    """
    hashed = df.withColumn("__h", hash_rank(seed, key))
    n = hashed.count()
    k = -(-n * percent // 100)
    if not k:
        return hashed.withColumn("part", F.lit("train")).drop("__h")
    # the boundary is searched among prefixes of the hash: counts per prefix narrow it down
    prefix = hashed.groupBy(F.substring("__h", 1, 4).alias("p")).agg(F.count("*").alias("n"))
    before, bucket = 0, ""
    for p, c in sorted((r["p"], r["n"]) for r in prefix.collect()):  # at most 65,536 prefixes
        if before + c >= k:
            bucket = p
            break
        before += c
    order = Window.partitionBy("__in").orderBy("__h", key)
    inside = F.substring("__h", 1, 4)
    edge = hashed.where(inside == bucket).withColumn("__in", F.lit(bucket)).select("__h", F.row_number().over(order).alias("r")).where(F.col("r") == k - before).first()["__h"]
    return hashed.withColumn("part", F.when(F.col("__h") <= edge, "eval").otherwise("train")).drop("__h")


def signatures(df: DataFrame, parsed_signature: Column) -> DataFrame:
    """Distinct signatures by category and family."""
    return df.select("category", "family", parsed_signature.alias("signature")).distinct()


def distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per stratum and their percent of all rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per stratum
    return counts.withColumn("percent", F.col("n") * 100.0 / whole)
