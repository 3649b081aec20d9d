"""Checks of entity catalogs in long form ``group, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.columns import casefold, squeeze


def catalog_key(c: Column) -> Column:
    """Identity of a catalog value: no underscores, case or extra blanks."""
    return squeeze(casefold(F.replace(c, F.lit("_"), F.lit(" "))))


def keyed(catalog: DataFrame) -> DataFrame:
    """Non-null values with their key."""
    return catalog.where("value is not null").select("group", "value", catalog_key(F.col("value")).alias("key"))


def duplicates(catalog: DataFrame) -> DataFrame:
    return keyed(catalog).groupBy("group", "key").agg(F.count("*").alias("n")).where("n > 1")


def empty_groups(catalog: DataFrame, expected: list[str]) -> DataFrame:
    groups = catalog.sparkSession.createDataFrame([(g,) for g in expected], "`group` string")
    return groups.join(keyed(catalog).select("group").distinct(), "group", "left_anti")


def collisions(catalog: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Keys that stand in a group of either side."""
    keys = keyed(catalog).where("key != ''")
    of = lambda groups: keys.where(F.col("group").isin(*groups)).select("key").distinct()
    return of(left).join(of(right), "key", "left_semi")


def unusual_case(catalog: DataFrame, groups: list[str]) -> DataFrame:
    rows = keyed(catalog).where(F.col("group").isin(*groups))
    return rows.where(F.col("value") != casefold(F.col("value"))).select("group", "value")


def drift(local: DataFrame, external: DataFrame) -> DataFrame:
    """Keys on one side only; both inputs have a column ``value``."""
    keys = lambda df: df.where("value is not null").select(catalog_key(F.col("value")).alias("key")).where("key != ''").distinct()
    a, b = keys(local), keys(external)
    return (
        a.join(b, "key", "left_anti").select("key", F.lit("only_local").alias("side"))
        .unionByName(b.join(a, "key", "left_anti").select("key", F.lit("only_external").alias("side")))
    )


def catalog_issues(catalog: DataFrame, names: list[str], objects: list[str], expected: list[str], external: DataFrame | None = None) -> DataFrame:
    """The quality report: ``severity, code, message``."""
    listed = lambda df, by, value: df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias("m"))
    row = lambda severity, code, m: (F.lit(severity).alias("severity"), F.lit(code).alias("code"), m.alias("message"))
    parts = [
        empty_groups(catalog, expected).select(*row("error", "empty_catalog", F.col("group"))),
        listed(duplicates(catalog), ["group"], "key").select(*row("warning", "duplicates", F.concat_ws(": ", "group", "m"))),
        listed(collisions(catalog, names, objects), [], "key").where("m != ''").select(*row("error", "person_object_collision", F.col("m"))),
        listed(unusual_case(catalog, objects), [], "value").where("m != ''").select(*row("warning", "object_case", F.col("m"))),
    ]
    if external is not None:
        local = catalog.where(F.col("group").isin(*names))
        parts.append(listed(drift(local, external), ["side"], "key").select(*row("warning", "name_catalog_drift", F.concat_ws("=", "side", "m"))))
        twice = duplicates(external.select(F.lit("external").alias("group"), "value"))
        parts.append(listed(twice, [], "key").where("m != ''").select(*row("warning", "external_duplicates", F.col("m"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_no_errors(issues: DataFrame) -> None:
    bad = [r["message"] for r in issues.where("severity = 'error'").limit(20).collect()]
    if bad:
        raise RuntimeError("catalog errors: " + "; ".join(bad))
