"""Plans as rows: parse once, validate, derive features, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions import goals as G
from planloom.functions import validate as V
from planloom.functions.columns import let, strip
from planloom.session import spread


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that filters and projections above do not evaluate them again.

    A plain projection would be inlined into every filter that is pushed below it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_parsed(df: DataFrame, goals: str = "goals") -> DataFrame:
    """Add ``parsed``, computed once per row; a table in fewer splits than cores is spread first."""
    return once(spread(df), parsed=G.parse_goals(F.col(goals)))


def with_issues(df: DataFrame, goals: str = "goals") -> DataFrame:
    """Add ``parsed``, ``issues`` and ``valid``, computed once per row."""
    out = once(with_parsed(df, goals), issues=V.issues(F.col(goals), F.col("parsed")))
    return out.withColumn("valid", F.size("issues") == 0)


def family_of(family: Column, meta_family: Column) -> Column:
    """Family of a row: its own column, else the one in ``meta``, else 'unknown'; empty counts as missing."""
    return F.coalesce(F.nullif(family, F.lit("")), F.nullif(meta_family, F.lit("")), F.lit("unknown"))


def family_from_json(meta: Column) -> Column:
    """Family inside ``meta`` given as JSON text; text that is no JSON object has none."""
    return F.get_json_object(meta, "$.family")


def goals_from_response(goals: Column, response: Column) -> Column:
    """``goals``, or those of the JSON text in ``response`` where they are null."""
    return F.coalesce(goals, F.from_json(response, "goals array<string>")["goals"])


def enrich(df: DataFrame, goals: str = "goals") -> DataFrame:
    """Keep valid plans and add ``goal_signature``, ``entity_kinds`` and ``slot_names``."""
    valid = with_issues(df, goals).where("valid")
    p = F.col("parsed")
    return valid.withColumns({"goal_signature": G.goal_signature(p), "entity_kinds": G.entity_kinds(p), "slot_names": G.slot_names(p)}).drop("parsed", "issues", "valid")


MARKERS = ("WARNING", "None", "{", "}")  # fixed values: texts that no goal of a usable payload holds


def has_marker(*texts: Column) -> Column:
    found = F.lit(False)
    for t in texts:
        for m in MARKERS:
            found = found | F.contains(t, F.lit(m))
    return found


def usable_payload(goals: Column, parsed: Column) -> Column:
    """A non-empty list of non-blank goals, none with a marker, no issue."""
    shaped = F.coalesce((F.size(goals) > 0) & F.forall(goals, lambda g: g.isNotNull() & (strip(g) != "") & ~has_marker(g)), F.lit(False))
    return shaped & (F.size(V.issues(goals, parsed)) == 0)


def source_row_problem(text: Column, goals: Column, parsed: Column) -> Column:
    """First problem of a training row, or null: input, goals, schema, marker."""
    found = let(V.issues(goals, parsed), lambda i: F.when(F.size(i) > 0, F.concat(F.lit("bad plan: "), V.issue_text(F.get(i, F.lit(0))))))
    bad_list = goals.isNull() | (F.size(goals) == 0) | F.exists(goals, lambda g: g.isNull() | (strip(g) == ""))
    early = F.when(text.isNull() | (strip(text) == ""), "no input").when(bad_list, "no goals or a blank one")
    return F.coalesce(early, found, F.when(has_marker(text, F.array_join(goals, "")), "marker in the row"))


def issue_rows(df: DataFrame, id_col: str, goals: str = "goals") -> DataFrame:
    """One row per issue: ``id, code, message, goal_index``."""
    return with_issues(df, goals).select(id_col, F.explode("issues").alias("i")).select(id_col, "i.code", "i.message", "i.goal_index")


def audit(df: DataFrame, family: Column, template: Column, goals: str = "goals", sections: tuple[str, ...] | None = None) -> DataFrame:
    """The audit report, long: ``section, key1, key2, value``; all sections or the ones asked for.

    The rows are parsed and validated once, if a section needs it, and turned into the
    report's counters inside the row; one aggregation with map-side combine adds them up.
    """
    want = lambda *names: sections is None or not set(names).isdisjoint(sections)
    named = df.withColumns({"__family": family, "__template": template})
    of_plans = ("entity_kinds", "goal_signatures", "family_goal_signatures", "slot_coverage")
    checked = with_issues(named, goals) if want("totals", "issues", *of_plans) else named
    p = F.col("parsed")
    kind = "array<struct<section:string,key1:string,key2:string>>"
    none = F.array().cast(kind)

    def entry(section: str, k1: Column | str, k2: Column | str = "") -> Column:
        column = lambda k: F.lit(k) if isinstance(k, str) else k
        return F.struct(F.lit(section).alias("section"), column(k1).alias("key1"), column(k2).alias("key2"))

    signature = F.array_join(G.goal_signature(p), " -> ")
    valid_parts = [
        build()
        for name, build in (
            ("entity_kinds", lambda: F.transform(G.entity_kinds(p), lambda k: entry("entity_kinds", k))),
            ("goal_signatures", lambda: F.array(entry("goal_signatures", signature))),
            ("family_goal_signatures", lambda: F.array(entry("family_goal_signatures", F.col("__family"), signature))),
            ("slot_coverage", lambda: F.transform(F.map_keys(G.semantic_slots(p)), lambda k: entry("slot_coverage", k))),
        )
        if want(name)
    ]
    parts = []
    if want("totals"):
        parts.append(F.array(entry("totals", "rows"), entry("totals", F.when(F.col("valid"), "valid").otherwise("invalid"))))
    if want("families"):
        parts.append(F.array(entry("families", F.col("__family"))))
    if want("surface_templates"):
        parts.append(F.when(F.col("__template") != "", F.array(entry("surface_templates", F.col("__family"), F.col("__template")))))
    if want("issues"):
        parts.append(F.transform("issues", lambda i: entry("issues", i["code"])))
    if valid_parts:
        parts.append(F.when(F.col("valid"), F.concat(*[c.cast(kind) for c in valid_parts])))
    counters = F.concat(none, *[F.coalesce(c.cast(kind), none) for c in parts])
    return checked.select(F.explode(counters).alias("c")).groupBy("c.section", "c.key1", "c.key2").agg(F.count("*").alias("value"))


def gate(report: DataFrame, section: str, key: str) -> None:
    """Raise if a counter of a report is above zero."""
    n = report.where((F.col("section") == section) & (F.col("key1") == key)).agg(F.sum("value")).first()[0]
    if n:
        raise RuntimeError(f"{section}.{key}: {n} rows")


def apply_planner(df: DataFrame, id_col: str, planner: Callable, goals: str = "goals") -> DataFrame:
    """Run a planner plug-in over valid plans: ``planner(iterator of pandas frames)`` with ``id, facts``.

    The plug-in is started once per task and yields ``id, plannable, message_count, reason``.
    """
    valid = with_issues(df, goals).where("valid")
    facts = F.transform("parsed", lambda p, i: G.planner_fact(i + 1, p)["fact"])
    kind = df.schema[id_col].dataType.simpleString()
    return valid.select(id_col, facts.alias("facts")).mapInPandas(planner, f"`{id_col}` {kind}, plannable boolean, message_count int, reason string")
