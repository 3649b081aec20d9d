"""Scores of predicted plans against gold plans.

``score_cases`` makes one row per case with everything the reports need; the reports
are single aggregations over it.  Slots are compared by probing one map with the
entries of the other inside the row, so no report needs a join of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions import goals as G
from planloom.functions import validate as V
from planloom.functions.columns import safe_ratio, text_key
from planloom.operators.plans import once


def latest_answers(predictions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One answer per case: the last in the given order.  ``max_by`` keeps one row per task and case before the shuffle."""
    rest = [c for c in predictions.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return predictions.groupBy(key).agg(last).select(key, "r.*")


def score_cases(gold: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """One row per gold case, joined on its id.

    ``gold`` has ``id, input, expected, family``; ``answers`` has ``id, predicted,
    normalized_input, elapsed_ms, error, raw``.  A case without an answer predicts nothing.
    """
    nothing = F.array().cast("array<string>")
    rows = gold.join(answers, key, "left").withColumns(
        {
            "predicted": F.coalesce("predicted", nothing),
            "normalized_input": F.coalesce("normalized_input", "input"),
        }
    )
    rows = once(rows, expected_parsed=G.parse_goals(F.col("expected")), predicted_parsed=G.parse_goals(F.col("predicted")))
    same = F.col("expected").eqNullSafe(F.col("predicted"))
    folded = (F.size("expected") == F.size("predicted")) & F.forall(F.arrays_zip(F.col("expected").alias("e"), F.col("predicted").alias("p")), lambda z: text_key(z["e"]).eqNullSafe(text_key(z["p"])))
    rows = once(
        rows,
        exact=same,
        casefold_exact=F.coalesce(folded, F.lit(False)),
        schema_valid=F.size(V.issues(F.col("predicted"), F.col("predicted_parsed"))) == 0,
    )
    rows = rows.withColumn("case_only_difference", F.col("casefold_exact") & ~F.col("exact"))
    empty = F.create_map().cast("map<string,string>")
    # slots count for cases with a valid prediction only; gold plans that do not parse have none
    slots = lambda c: F.when(F.col("schema_valid") & G.all_parse(F.col(f"{c}_parsed")), G.semantic_slots(F.col(f"{c}_parsed"))).otherwise(empty)
    rows = once(rows, expected_slots=slots("expected"), predicted_slots=slots("predicted"))
    return rows.drop("expected_parsed", "predicted_parsed")


def _hits(folded: bool) -> Column:
    """Array with one boolean per expected slot."""
    found = lambda e: F.try_element_at(F.col("predicted_slots"), e["key"])
    strict = lambda e: F.coalesce(found(e) == e["value"], F.lit(False))
    loose = lambda e: text_key(F.coalesce(found(e), F.lit(""))) == text_key(e["value"])
    return F.transform(F.map_entries("expected_slots"), loose if folded else strict)


def exact_by_family(scored: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col(c))
    return scored.groupBy("family").agg(
        F.count("*").alias("total"),
        n("exact").alias("exact"),
        safe_ratio(n("exact"), F.count("*")).alias("accuracy"),
        n("casefold_exact").alias("casefold_exact"),
        safe_ratio(n("casefold_exact"), F.count("*")).alias("casefold_accuracy"),
    )


def slot_scores(scored: DataFrame, folded: bool = False, by: list[str] | None = None) -> DataFrame:
    """``correct, expected, predicted, precision, recall, f1``; recall is over cases with a valid prediction."""
    hits = _hits(folded)
    sums = scored.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.size(F.filter(hits, lambda h: h)).cast("long")), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.size("expected_slots").cast("long")), F.lit(0)).alias("expected"),
        F.coalesce(F.sum(F.size("predicted_slots").cast("long")), F.lit(0)).alias("predicted"),
    )
    out = sums.withColumns({"precision": safe_ratio(F.col("correct"), F.col("predicted")), "recall": safe_ratio(F.col("correct"), F.col("expected"))})
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def kind_scores(scored: DataFrame) -> DataFrame:
    """Accuracy of ``kind`` slots by the expected kind."""
    kinds = F.filter(F.map_entries("expected_slots"), lambda e: F.endswith(e["key"], F.lit(".kind")))
    pairs = F.transform(kinds, lambda e: F.struct(e["value"].alias("kind"), F.coalesce(F.try_element_at(F.col("predicted_slots"), e["key"]) == e["value"], F.lit(False)).alias("hit")))
    rows = scored.select(F.explode(pairs).alias("k"))
    return rows.groupBy(F.col("k.kind").alias("kind")).agg(
        F.count("*").alias("total"), F.count_if("k.hit").alias("correct"), safe_ratio(F.count_if("k.hit"), F.count("*")).alias("accuracy")
    )


def outcome(scored: DataFrame) -> DataFrame:
    """Counts of exact, case-only and wrong cases."""
    kind = F.when(F.col("exact"), "exact").when(F.col("case_only_difference"), "case_only").otherwise("error")
    return scored.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def case_table(scored: DataFrame) -> DataFrame:
    """The flat case table; plans as JSON text."""
    return scored.select(
        "id", "family", "exact", "casefold_exact", "case_only_difference", "elapsed_ms", "input", "normalized_input",
        F.to_json("expected").alias("expected"), F.to_json("predicted").alias("predicted"), F.col("error").alias("prediction_error"),
    )


def status(scored: DataFrame) -> DataFrame:
    label = F.when(F.col("exact"), "OK").when(F.col("case_only_difference"), "CASE-OK").otherwise("ERROR")
    return scored.select("id", "family", label.alias("status"))


def latency_stats(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, median and 95th percentile (linear interpolation); 0 where nothing was measured."""
    p = lambda q: F.coalesce(F.expr(f"percentile(elapsed_ms, {q})"), F.lit(0.0))
    return scored.groupBy(*(by or [])).agg(
        F.count("elapsed_ms").alias("n"), F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms")
    )


def throughput(scored: DataFrame) -> DataFrame:
    """One row: measured cases, their seconds and cases per second; 0 where nothing was measured."""
    seconds = F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)) / 1000
    return scored.agg(F.count("elapsed_ms").alias("n"), seconds.alias("seconds"), safe_ratio(F.count("elapsed_ms"), seconds).alias("per_second"))


def latency_histogram(scored: DataFrame) -> DataFrame:
    """Equal-width bins: a quarter of the values, at least 4 and at most 12; the maximum belongs to the last bin."""
    values = scored.where("elapsed_ms is not null").select(F.col("elapsed_ms").alias("v"))
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.count("*") / 4))).cast("int").alias("bins")).first()
    if edges["lo"] is None:
        return values.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi, bins = edges
    if lo == hi:  # one value: bins of width 1/bins around it
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    number = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width)).cast("int")
    return values.groupBy(number.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"), "n")


def family_ranking(by_family: DataFrame) -> DataFrame:
    """Families from worst to best."""
    order = Window.orderBy("casefold_accuracy", "accuracy", "family")  # one row per family
    return by_family.withColumn("rank", F.row_number().over(order))


def overview(scored: DataFrame) -> DataFrame:
    """The headline metrics, one row each, from one pass over the cases."""
    strict, folded = _hits(False), _hits(True)
    total = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    right = lambda hits: F.size(F.filter(hits, lambda h: h))
    kind = lambda k, hit: F.size(F.filter(F.map_entries("expected_slots"), lambda e: F.endswith(e["key"], F.lit(".kind")) & (e["value"] == k) & ((F.coalesce(F.try_element_at(F.col("predicted_slots"), e["key"]) == e["value"], F.lit(False))) if hit else F.lit(True))))
    s = scored.agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("casefold_exact").alias("folded"), F.count_if("schema_valid").alias("valid"),
        total(right(strict)).alias("hit"), total(right(folded)).alias("fold_hit"), total(F.size("expected_slots")).alias("expected"), total(F.size("predicted_slots")).alias("predicted"),
        total(kind("person", True)).alias("person_hit"), total(kind("person", False)).alias("person"), total(kind("object", True)).alias("object_hit"), total(kind("object", False)).alias("object"),
    )
    f1 = lambda hit: safe_ratio(2 * F.col(hit), F.col("expected") + F.col("predicted"))
    metrics = [
        ("exact_accuracy", safe_ratio(F.col("exact"), F.col("n"))),
        ("casefold_exact_accuracy", safe_ratio(F.col("folded"), F.col("n"))),
        ("schema_valid_rate", safe_ratio(F.col("valid"), F.col("n"))),
        ("slots_f1", f1("hit")),
        ("casefold_slots_f1", f1("fold_hit")),
        ("kind_person_accuracy", safe_ratio(F.col("person_hit"), F.col("person"))),
        ("kind_object_accuracy", safe_ratio(F.col("object_hit"), F.col("object"))),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(metrics)])
    return s.select(F.explode(rows).alias("m")).select("m.*")


def perfect_gate(scored: DataFrame, strict: bool = False) -> DataFrame:
    """One row: cases, misses and whether the run is perfect."""
    hit = "exact" if strict else "casefold_exact"
    return scored.agg(F.count("*").alias("cases"), F.count_if(~F.col(hit)).alias("misses")).withColumn("passed", F.col("misses") == 0)


def require_perfect(scored: DataFrame, strict: bool = False) -> None:
    row = perfect_gate(scored, strict).first()
    if not row["passed"]:
        raise RuntimeError(f"{row['misses']} of {row['cases']} cases are wrong")
