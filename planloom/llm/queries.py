"""The pN_ queries and their SQL, bound to the tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import bpe, mojibake, overlap, packing, residue, sampling, splits, terms
from planloom.session import table


P1_COLUMNS = ("variant_id", "input", "goals", "source")


def p1_residue(spark: SparkSession, d: str) -> DataFrame:
    """Every record with residue and what it holds."""
    return residue.residue(table(spark, d, "all_command_variants"), *P1_COLUMNS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_residue(spark, d).select("variant_id")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """The records without residue."""
    rows = table(spark, d, "all_command_variants")
    return residue.without_residue(rows, "variant_id", residue.residue(rows, *P1_COLUMNS))


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    """The residue messages with rows and sources."""
    return residue.residue_messages(table(spark, d, "all_command_variants"), *P1_COLUMNS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cases, rows = table(spark, d, "model_evaluation_cases"), table(spark, d, "dataset_gpsr")
    return overlap.overlap_pairs(cases, "id", "input", rows, "row_id", "input")


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per split and source of the case."""
    return overlap.overlap_report(table(spark, d, "model_evaluation_cases"), "id", p2_found(spark, d), ["split", "source"])


GRAINS = ("family", "surface_template_id")


def _solved(spark: SparkSession, d: str, grain: str):
    rows = table(spark, d, "dataset_gpsr")
    targets = table(spark, d, "sample_targets").where(F.col("grain") == grain)
    return rows, sampling.calibrate(rows, F.col(grain), targets)


def p3_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Every target with what is there and what is missing."""
    parts = []
    for grain in GRAINS:
        rows, solved = _solved(spark, d, grain)
        parts.append(sampling.gaps(rows, solved, grain))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_gaps(spark, d).where("gap > 0").select("grain", "label")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The two samples: grain, label, row_id."""
    parts = []
    for grain in GRAINS:
        rows, solved = _solved(spark, d, grain)
        parts.append(sampling.draw(rows, "row_id", F.col(grain), solved).withColumn("grain", F.lit(grain)))
    return parts[0].unionByName(parts[1])


def p3_sample_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the samples: their size, no row twice, and no label more than a row off its goal."""
    parts = []
    for grain in GRAINS:
        rows, solved = _solved(spark, d, grain)
        drawn = sampling.draw(rows, "row_id", F.col(grain), solved)
        goals = spark.createDataFrame(solved.drop_duplicates("key")[["label", "goal"]], "label string, goal double")
        per_label = drawn.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("rows")).join(F.broadcast(goals), "label", "right")
        off = (F.abs(F.coalesce("n", F.lit(0)) - F.col("goal")) > 1).cast("long")
        parts.append(per_label.agg(F.lit(grain).alias("grain"), F.sum("n").alias("n_rows"), F.sum(F.col("n") - F.col("rows")).alias("n_repeated"), F.sum(off).alias("n_labels_off")))
    return parts[0].unionByName(parts[1])


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct goal and family with its counts and mark."""
    goals = terms.term_counts(table(spark, d, "dataset_gpsr"), F.col("goals"), "goals")
    family = terms.term_counts(table(spark, d, "model_evaluation_cases"), F.col("meta.family"), "family")
    return terms.mark_terms(goals.unionByName(family)).drop("n_field_records")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_terms(spark, d).where("mark is not null").select("field_name", "term", "mark")


def _p5_args() -> dict:
    key = sampling.fold_label
    template = key(F.col("surface_template_id"))
    return {
        "id_col": "row_id",
        "keys": {"family": key(F.col("family")), "template": F.when(template.rlike(r"^\p{L}+:v[0-9]+$"), template)},
        "label": F.col("meta.category"),
    }


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """row_id, component, split of every row."""
    return splits.assign_splits(table(spark, d, "dataset_gpsr"), **_p5_args())


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """Every family and template with its component and the rows of the component."""
    members, groups, _ = splits.plan_groups(table(spark, d, "dataset_gpsr"), **_p5_args())
    kind = F.substring_index("node", ":", 1)
    return members.join(groups, "component").select(kind.alias("key"), F.expr("substring(node, instr(node, ':') + 1)").alias("value"), "component", "n_rows")


def p5_splits_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every row once, no family or template in two, and the quotas within a twentieth of all rows."""
    args, rows = _p5_args(), table(spark, d, "dataset_gpsr")
    given = splits.assign_splits(rows, **args).join(rows.select("row_id", *[c.alias(k) for k, c in args["keys"].items()]), "row_id")
    torn = None
    for k in args["keys"]:
        part = given.where(f"{k} is not null and {k} != ''").groupBy(k).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit(1).alias("torn"))
        torn = part if torn is None else torn.unionByName(part)
    sizes = given.groupBy("split").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame(list(splits.SPLITS.items()), "split string, share int")
    rows_of = wanted.join(sizes, "split", "left").fillna(0, ["n"]).agg(F.sum("n").alias("n_rows"), F.collect_list(F.struct("n", "share")).alias("each"))  # one entry per split
    missed = F.size(F.filter("each", lambda x: F.abs(x["n"] - x["share"] * F.col("n_rows") / 100) * 20 > F.col("n_rows"))).cast("long")
    off = rows_of.select("n_rows", missed.alias("n_quotas_missed"), F.lit(1).alias("one"))
    return off.join(torn.agg(F.count("*").alias("n_torn_keys"), F.lit(1).alias("one")), "one").drop("one")  # one row each


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, groups, _ = splits.plan_groups(table(spark, d, "dataset_gpsr"), **_p5_args())
    pairs = splits.tied_pairs(members, groups, "family")
    return pairs.select(F.col("a").alias("family_a"), F.col("b").alias("family_b"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(packing.pack(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents")))


def p7_containers_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document and token placed, none overfull, nothing cut that fits, 98 % of the room used."""
    packed = packing.pack(table(spark, d, "documents"))
    loads = packed.where("container is not null").groupBy("container").agg(F.sum("part_tokens").alias("load"))
    used = loads.agg(
        F.sum((F.col("load") > packing.CAPACITY).cast("long")).alias("n_overfull"),
        (F.sum("load") < F.lit(0.98 * packing.CAPACITY) * (F.count("*") - 1)).alias("wasteful"),
        (F.max("container") + 1 - F.count("*")).alias("n_unused_numbers"),
        F.lit(1).alias("one"),
    )
    per_text = packed.groupBy("doc_id", "n_tokens").agg(F.sum("part_tokens").alias("placed"), F.count("container").alias("parts"))
    needed = F.ceil(F.col("n_tokens") / packing.CAPACITY)
    texts = per_text.agg(F.count("*").alias("n_documents"), F.sum((F.col("placed") != F.col("n_tokens")).cast("long")).alias("n_lost"), F.sum((F.col("parts") != needed).cast("long")).alias("n_needlessly_cut"), F.lit(1).alias("one"))
    return texts.join(used, "one").drop("one")  # one row each


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled document with its restored text and the chains that were undone."""
    fixed = mojibake.repair_texts(table(spark, d, "documents"), "doc_id", "text", "lang")
    return fixed.where("garbled").select("doc_id", "restored", "chains", "repaired")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_residue": p1_residue,
        "p1_clean": p1_clean,
        "p1_messages": p1_messages,
        "p2_found": p2_found,
        "p2_overlaps": p2_overlaps,
        "p3_found": p3_found,
        "p3_gaps": p3_gaps,
        "p3_sample": p3_sample,
        "p3_sample_check": p3_sample_check,
        "p4_found": p4_found,
        "p4_terms": p4_terms,
        "p5_found": p5_found,
        "p5_splits": p5_splits,
        "p5_splits_check": p5_splits_check,
        "p5_members": p5_members,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_containers": p7_containers,
        "p7_containers_check": p7_containers_check,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_restored": p8_restored,
    }


_TRIM = lambda x: f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13)))"

P3_SQL = f"""WITH n AS (SELECT count(*) // 5 AS n FROM dataset_gpsr),
have AS (SELECT 'family' AS grain, {_TRIM("family")} AS key, count(*) AS c FROM dataset_gpsr GROUP BY 2
UNION ALL SELECT 'surface_template_id', {_TRIM("surface_template_id")}, count(*) FROM dataset_gpsr GROUP BY 2),
t AS (SELECT s.grain, s.label, CAST(coalesce(c, 0) AS BIGINT) AS available, CAST(greatest(min_rows, (target_permille * n + 999) // 1000) AS BIGINT) AS wanted
FROM sample_targets s CROSS JOIN n LEFT JOIN have h ON h.grain = s.grain AND h.key = {_TRIM("s.label")})
SELECT grain, label, available, wanted, greatest(wanted - available, 0) AS gap FROM t"""

P4_SQL = """WITH e AS (SELECT 'goals' AS field_name, row_id::VARCHAR AS r, unnest(goals) AS term FROM dataset_gpsr
UNION ALL SELECT 'family', id, meta.family FROM model_evaluation_cases),
n AS (SELECT 'goals' AS field_name, count(goals) AS n FROM dataset_gpsr UNION ALL SELECT 'family', count(meta.family) FROM model_evaluation_cases),
c AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT r) AS n_records FROM e WHERE term IS NOT NULL GROUP BY ALL)
SELECT field_name, term, n_occurrences, n_records, CASE WHEN n_records * 20 > n THEN 'common' WHEN n_records < 3 THEN 'rare' END AS mark FROM c JOIN n USING (field_name)"""

P5_SQL = f"""WITH RECURSIVE pairs AS (SELECT DISTINCT {_TRIM("family")} AS f, {_TRIM("surface_template_id")} AS t FROM dataset_gpsr),
good AS (SELECT f, t FROM pairs WHERE f <> '' AND regexp_full_match(t, '\\p{{L}}+:v[0-9]+')),
edge AS (SELECT DISTINCT a.f AS a, b.f AS b FROM good a JOIN good b USING (t)),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT a AS family_a, b AS family_b FROM reach WHERE a < b"""


# Components by the closure over families; a template of no family is a component of its own.
P5_MEMBERS_SQL = P5_SQL.split("SELECT a AS family_a")[0] + """, keyed AS (SELECT f, CASE WHEN regexp_full_match(t, '\\p{L}+:v[0-9]+') THEN t END AS t FROM (SELECT nullif(f, '') AS f, t FROM all_rows)),
fc AS (SELECT f, least(f, coalesce((SELECT min(b) FROM reach WHERE a = f), f)) AS c FROM (SELECT DISTINCT f FROM keyed WHERE f IS NOT NULL)),
tc AS (SELECT t, coalesce('family:' || min(c), 'template:' || t) AS c FROM (SELECT DISTINCT f, t FROM keyed WHERE t IS NOT NULL) LEFT JOIN fc USING (f) GROUP BY t),
members AS (SELECT 'family' AS key, f AS value, 'family:' || c AS component FROM fc UNION ALL SELECT 'template', t, c FROM tc),
sizes AS (SELECT m.component, count(*) AS n_rows FROM keyed JOIN members m ON m.key = CASE WHEN f IS NULL THEN 'template' ELSE 'family' END AND m.value = coalesce(f, t) GROUP BY 1)
SELECT key, value, component, n_rows FROM members JOIN sizes USING (component)"""
P5_MEMBERS_SQL = P5_MEMBERS_SQL.replace("WITH RECURSIVE pairs AS", f"WITH RECURSIVE all_rows AS (SELECT {_TRIM('family')} AS f, {_TRIM('surface_template_id')} AS t FROM dataset_gpsr), pairs AS")


def oracle_sql() -> dict[str, str]:
    return {
        "p5_members": P5_MEMBERS_SQL,
        "p3_sample_check": """SELECT grain, count(*) // 5 AS n_rows, 0 AS n_repeated, 0 AS n_labels_off FROM dataset_gpsr, (VALUES ('family'), ('surface_template_id')) AS g(grain) GROUP BY grain""",
        "p5_splits_check": "SELECT count(*) AS n_rows, 0 AS n_quotas_missed, 0 AS n_torn_keys FROM dataset_gpsr",
        "p7_containers_check": "SELECT count(*) AS n_documents, 0 AS n_lost, 0 AS n_needlessly_cut, 0 AS n_overfull, false AS wasteful, 0 AS n_unused_numbers FROM documents",
        "p3_gaps": P3_SQL,
        "p3_found": f"SELECT grain, label FROM ({P3_SQL}) WHERE gap > 0",
        "p4_terms": P4_SQL,
        "p4_found": f"SELECT field_name, term, mark FROM ({P4_SQL}) WHERE mark IS NOT NULL",
        "p5_found": P5_SQL,
    }
