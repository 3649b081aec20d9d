"""All named queries of the core and their SQL oracles.

Every query runs over its whole tables.  The oracles are DuckDB SQL over the same
Parquet files; queries without one are tested against brute force in ``tests``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.functions import goals as G
from planloom.functions import normalize as N
from planloom.functions.columns import text_key
from planloom.functions.payload import chat_messages, extract_goals, goals_json, prediction_payload
from planloom.operators import balance as B
from planloom.operators import catalog as C
from planloom.operators import plans as P
from planloom.operators import scoring as S
from planloom.plans import sqltext as Q
from planloom.session import cut, stored, spread, table
from planloom.sources.catalogs import from_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def dataset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_gpsr")


def cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "model_evaluation_cases")


FAMILY_SQL = "coalesce(nullif(family, ''), 'unknown')"


def _family():
    return P.family_of(F.col("family"), F.lit(None).cast("string"))


# ---- goal strings -----------------------------------------------------------------------------


@query(
    f"WITH {Q.parsed_sql(Q.DATASET)} SELECT id AS row_id, i AS goal_index, CASE WHEN bad THEN NULL ELSE name END AS name, "
    "CASE WHEN bad THEN NULL ELSE array_to_string(args, '|') END AS args, "
    "CASE WHEN bad THEN NULL ELSE array_to_string(list_sort(list_transform(kw, lambda x: x.k || '=' || x.v)), '|') END AS slots FROM p"
)
def goal_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_parsed(dataset(spark, d).select("row_id", "goals"))
    one = rows.select("row_id", F.posexplode("parsed").alias("i", "p")).withColumn("ok", G.parses(F.col("p")))
    when = lambda c: F.when(F.col("ok"), c)
    slots = F.array_sort(F.transform(F.map_entries("p.slots"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return one.select("row_id", (F.col("i") + 1).alias("goal_index"), when(F.col("p.name")).alias("name"), when(F.array_join("p.args", "|")).alias("args"), when(F.array_join(slots, "|")).alias("slots"))


def _valid(df: DataFrame) -> DataFrame:
    return P.with_issues(df).where("valid")


VALID_SQL = f"WITH {Q.issues_sql(Q.DATASET)}, vp AS (SELECT p.* FROM p WHERE id NOT IN (SELECT id FROM issues))"


@query(f"{VALID_SQL} SELECT signature, count(*) AS n FROM (SELECT id, string_agg(name, ' -> ' ORDER BY i) AS signature FROM vp GROUP BY id) GROUP BY signature")
def goal_signature_counts(spark: SparkSession, d: str) -> DataFrame:
    return _valid(dataset(spark, d).select("goals")).groupBy(F.array_join(G.goal_signature(F.col("parsed")), " -> ").alias("signature")).agg(F.count("*").alias("n"))


@query(f"{VALID_SQL} SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, {Q.entity_kind_sql()} AS kind FROM vp) WHERE kind <> '' GROUP BY kind")
def entity_kind_rows(spark: SparkSession, d: str) -> DataFrame:
    return _valid(dataset(spark, d).select("goals")).select(F.explode(G.entity_kinds(F.col("parsed"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"{VALID_SQL} SELECT id AS row_id, array_to_string(list_sort(list_distinct(list_concat(['target'], flatten(list(list_transform(kw, lambda x: x.k))), "
    "CASE WHEN max(len(args)) > 1 THEN ['destination'] ELSE [] END))), ',') AS slot_names FROM vp GROUP BY id"
)
def slot_names_rows(spark: SparkSession, d: str) -> DataFrame:
    return _valid(dataset(spark, d).select("row_id", "goals")).select("row_id", F.array_join(G.slot_names(F.col("parsed")), ",").alias("slot_names"))


@query(f"WITH {Q.parsed_sql(Q.CASES)} {Q.slots_sql()}")
def semantic_slots_long(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_parsed(cases(spark, d).select("id", "goals")).where(G.all_parse(F.col("parsed")))
    return rows.select("id", F.explode(G.semantic_slots(F.col("parsed"))).alias("slot_key", "slot_value"))


_V = lambda x: f"replace(trim(trim({x}), '\"'''), ' ', '_')"
_TO = "CASE WHEN name = 'deliver' AND len(args) > 1 THEN list_extract(args, 2) END"
_REL = ("to", "at", "on", "in", "gesture", "pose", "wearing", "property")


@query(
    f"WITH {Q.parsed_sql(Q.CASES)}, f AS (SELECT id, i, name, target, {Q.entity_kind_sql()} AS ek, "
    f"coalesce({Q.slot('to')}, {Q.slot('at')}, {Q.slot('on')}, {Q.slot('in')}, {_TO}, '') AS destination, "
    f"CASE {' '.join(f'WHEN {Q.has(r)} THEN {r!r}' for r in _REL)} WHEN {_TO} IS NOT NULL THEN 'to' ELSE '' END AS relation, "
    f"CASE {' '.join(f'WHEN {Q.has(r)} THEN {Q.slot(r)}' for r in _REL)} ELSE coalesce({_TO}, '') END AS value, "
    f"CASE {' '.join(f'WHEN {Q.has(r)} THEN {(r + chr(58))!r} || {_V(Q.slot(r))}' for r in _REL[4:])} ELSE '' END AS qualifier FROM p) "
    f"SELECT id, i AS step, '(gpsr-goal (step ' || i || ') (name ' || name || ') (target \"' || {_V('target')} || '\") (kind ' || "
    f"CASE WHEN ek = '' THEN 'unknown' ELSE ek END || ') (destination \"' || {_V('destination')} || '\") (relation \"' || relation || '\") (value \"' || {_V('value')} "
    "|| '\") (qualifier \"' || qualifier || '\"))' AS fact FROM f"
)
def planner_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_parsed(cases(spark, d).select("id", "goals")).where(G.all_parse(F.col("parsed")))
    facts = F.transform("parsed", lambda p, i: G.planner_fact(i + 1, p))
    return rows.select("id", F.explode(facts).alias("f")).select("id", "f.step", "f.fact")


# ---- validation -------------------------------------------------------------------------------

ISSUES_SQL = f"WITH {Q.issues_sql(Q.DATASET)}"


@query(f"{ISSUES_SQL} SELECT code, count(*) AS n FROM issues GROUP BY code")
def issue_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.issue_rows(dataset(spark, d), "row_id").groupBy("code").agg(F.count("*").alias("n"))


@query(f"{ISSUES_SQL} SELECT code, count(*) AS n FROM local_issues GROUP BY code")
def issue_histogram_local(spark: SparkSession, d: str) -> DataFrame:
    return issue_histogram(spark, d).where(F.col("code").isin(*P.V.LOCAL_CODES))


@query(f"{ISSUES_SQL} SELECT id AS row_id, code, goal_index FROM issues")
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return P.issue_rows(dataset(spark, d), "row_id").select("row_id", "code", "goal_index")


def _sequence(code: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return P.issue_rows(dataset(spark, d), "row_id").where(F.col("code") == code).select("row_id", "goal_index")

    QUERIES[f"seq_{code}"] = run
    ORACLES[f"seq_{code}"] = f"{ISSUES_SQL} SELECT id AS row_id, goal_index FROM sequence_issues WHERE code = '{code}'"


for _code in P.V.SEQUENCE_CODES:
    _sequence(_code)


@query(
    f"WITH {Q.issues_sql('SELECT prediction_id AS id, coalesce(prediction.goals, []) AS goals FROM cached_predictions')} "
    "SELECT count(*) AS answers, count(*) FILTER (WHERE id NOT IN (SELECT id FROM issues)) AS valid, count(*) FILTER (WHERE id IN (SELECT id FROM issues)) AS invalid FROM src"
)
def schema_valid_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_issues(table(spark, d, "cached_predictions").select(F.coalesce("prediction.goals", F.array().cast("array<string>")).alias("goals")))
    return rows.agg(F.count("*").alias("answers"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


# ---- audit ------------------------------------------------------------------------------------

AUDIT_SQL = f"""WITH {Q.issues_sql(Q.DATASET)},
base AS (SELECT row_id AS id, {FAMILY_SQL} AS fam, surface_template_id AS tpl, row_id NOT IN (SELECT id FROM issues) AS valid FROM dataset_gpsr),
vp AS (SELECT p.* FROM p JOIN base USING (id) WHERE base.valid),
sig AS (SELECT id, string_agg(name, ' -> ' ORDER BY i) AS s FROM vp GROUP BY id),
a AS (SELECT 'totals' AS section, 'rows' AS key1, '' AS key2 FROM base
UNION ALL SELECT 'totals', CASE WHEN valid THEN 'valid' ELSE 'invalid' END, '' FROM base
UNION ALL SELECT 'families', fam, '' FROM base
UNION ALL SELECT 'surface_templates', fam, tpl FROM base WHERE tpl <> ''
UNION ALL SELECT 'issues', code, '' FROM issues
UNION ALL SELECT 'entity_kinds', k, '' FROM (SELECT DISTINCT id, {Q.entity_kind_sql()} AS k FROM vp) WHERE k <> ''
UNION ALL SELECT 'goal_signatures', s, '' FROM sig
UNION ALL SELECT 'family_goal_signatures', fam, s FROM sig JOIN base USING (id)
UNION ALL SELECT 'slot_coverage', slot_key, '' FROM ({Q.slots_sql("vp")}))
SELECT section, key1, key2, count(*) AS value FROM a GROUP BY ALL"""


@query(AUDIT_SQL)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return P.audit(dataset(spark, d), _family(), F.col("surface_template_id"))


def _section(name: str, section: str) -> None:
    QUERIES[name] = lambda spark, d: P.audit(dataset(spark, d), _family(), F.col("surface_template_id"), sections=(section,)).drop("section")
    ORACLES[name] = f"SELECT key1, key2, value FROM ({AUDIT_SQL}) WHERE section = '{section}'"


_section("audit_totals", "totals")
_section("family_counts", "families")
_section("family_signature_counts", "family_goal_signatures")
_section("surface_template_counts", "surface_templates")
_section("slot_coverage", "slot_coverage")


# ---- dedup and balance ------------------------------------------------------------------------

KEY_SQL = Q.text_key("coalesce(input, '')")
SAME = "(goals IS NOT DISTINCT FROM first_goals)"


@query(f"SELECT row_id, input FROM (SELECT row_id, input, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY row_id) AS r FROM dataset_gpsr) WHERE r = 1")
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return B.dedup_first(dataset(spark, d).select("row_id", "input"), "row_id")


@query(
    f"""{ISSUES_SQL}, base AS (SELECT row_id, goals, {KEY_SQL} AS k, row_id NOT IN (SELECT id FROM issues) AS ok FROM dataset_gpsr),
f AS (SELECT *, CASE WHEN ok THEN first_value(row_id) OVER w END AS first_id, CASE WHEN ok THEN first_value(goals) OVER w END AS first_goals FROM base WINDOW w AS (PARTITION BY k, ok ORDER BY row_id))
SELECT CASE WHEN NOT ok THEN 'invalid_label' WHEN row_id = first_id THEN 'added' WHEN {SAME} THEN 'duplicate' ELSE 'label_conflict' END AS status, count(*) AS n FROM f GROUP BY 1"""
)
def dedup_status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_issues(dataset(spark, d).select("row_id", "input", "goals"))
    return B.attempt_status_counts(rows, "row_id", F.when(~F.col("valid"), "invalid_label"))


_MARKED = "(input IS NULL OR trim(input) = '' OR contains(input, 'WARNING') OR contains(input, 'None') OR contains(input, '{') OR contains(input, '}'))"


@query(
    f"""{VALID_SQL}, sig AS (SELECT id, list(name ORDER BY i) AS s FROM vp GROUP BY id),
base AS (SELECT row_id, goals, {KEY_SQL} AS k, CASE WHEN {_MARKED} THEN 'generation_error' WHEN sig.id IS NULL THEN 'invalid_label' WHEN meta.goal_signature IS NOT NULL AND meta.goal_signature <> s THEN 'signature_mismatch' END AS refused
 FROM dataset_gpsr LEFT JOIN sig ON row_id = sig.id),
f AS (SELECT *, first_value(row_id) OVER w AS first_id, first_value(goals) OVER w AS first_goals FROM base WINDOW w AS (PARTITION BY k, refused IS NULL ORDER BY row_id))
SELECT coalesce(refused, CASE WHEN row_id = first_id THEN 'added' WHEN {SAME} THEN 'duplicate' ELSE 'label_conflict' END) AS status, count(*) AS n FROM f GROUP BY 1"""
)
def attempt_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """All six outcomes of adding the rows one by one, the stored signature as the one asked for."""
    rows = P.with_issues(dataset(spark, d).select("row_id", "input", "goals", F.col("meta.goal_signature").alias("wanted")))
    broken = F.col("input").isNull() | (F.trim("input") == "") | P.has_marker(F.col("input"))
    other = F.col("wanted").isNotNull() & (F.col("wanted") != G.goal_signature(F.col("parsed")))
    refused = F.when(broken, "generation_error").when(~F.col("valid"), "invalid_label").when(other, "signature_mismatch")
    return B.attempt_status_counts(rows, "row_id", refused)


@query(
    f"""{ISSUES_SQL}, base AS (SELECT row_id, goals, {KEY_SQL} AS k, row_id NOT IN (SELECT id FROM issues) AS ok FROM dataset_gpsr),
f AS (SELECT *, CASE WHEN ok THEN first_value(row_id) OVER w END AS first_id, CASE WHEN ok THEN first_value(goals) OVER w END AS first_goals FROM base WINDOW w AS (PARTITION BY k, ok ORDER BY row_id))
SELECT row_id, CASE WHEN NOT ok THEN 'invalid_label' WHEN row_id = first_id THEN 'added' WHEN {SAME} THEN 'duplicate' ELSE 'label_conflict' END AS status FROM f"""
)
def dedup_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of every row."""
    rows = stored(P.with_issues(dataset(spark, d).select("row_id", "input", "goals")).select("row_id", "input", "goals", "valid"))  # validated once, read twice
    return B.dedup_status(rows, "row_id", valid=F.col("valid")).select("row_id", "status")


STRATA_SQL = (
    f"{VALID_SQL}, strata AS (SELECT CASE WHEN meta.category = 'people' THEN 'people' ELSE 'objects' END AS category, {FAMILY_SQL} AS family, s AS signature, count(*) AS capacity "
    "FROM (SELECT id, string_agg(name, ' -> ' ORDER BY i) AS s FROM vp GROUP BY id) x JOIN dataset_gpsr ON row_id = x.id GROUP BY 1, 2, 3)"
)
N_SAMPLES = 4000


def _valid_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _valid(dataset(spark, d).select("row_id", "goals", "meta", "family"))
    category = F.when(F.col("meta.category") == "people", "people").otherwise("objects")
    # parsed once: the strata are counted and the rows are ranked from the written table
    return stored(rows.select("row_id", category.alias("category"), _family().alias("family"), F.array_join(G.goal_signature(F.col("parsed")), " -> ").alias("signature")))


def _strata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "family", "signature").agg(F.count("*").alias("capacity"))


@query(f"{STRATA_SQL} SELECT DISTINCT category, family, signature FROM strata")
def signature_discovery(spark: SparkSession, d: str) -> DataFrame:
    return B.signatures(_valid_rows(spark, d), F.col("signature"))


@query("SELECT family, CAST(1000 // n + (CASE WHEN r <= 1000 % n THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM (SELECT family, row_number() OVER (ORDER BY family) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT " + FAMILY_SQL + " AS family FROM dataset_gpsr))")
def even_quota(spark: SparkSession, d: str) -> DataFrame:
    families = dataset(spark, d).select(_family().alias("family")).distinct()
    return B.even_quota(families, ["family"], F.lit(1000).cast("long"))


HIERARCHY_SQL = f"""{STRATA_SQL}, fam AS (SELECT category, family, CAST(2000 // n + (CASE WHEN r <= 2000 % n THEN 1 ELSE 0 END) AS BIGINT) AS family_quota FROM
 (SELECT category, family, row_number() OVER (PARTITION BY category ORDER BY family) AS r, count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, family FROM strata))),
h AS (SELECT category, family, signature, family_quota, CAST(family_quota // n + (CASE WHEN r <= family_quota % n THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM
 (SELECT s.category, s.family, signature, family_quota, row_number() OVER (PARTITION BY s.category, s.family ORDER BY signature) AS r, count(*) OVER (PARTITION BY s.category, s.family) AS n
  FROM strata s JOIN fam USING (category, family)))"""


@query(f"{HIERARCHY_SQL} SELECT * FROM h")
def hierarchical_quota(spark: SparkSession, d: str) -> DataFrame:
    return B.hierarchical_quota(_strata(_valid_rows(spark, d)), N_SAMPLES, 0.5).select("category", "family", "signature", "family_quota", "quota")


def _final_quotas(rows: DataFrame) -> DataFrame:
    strata = _strata(rows)
    return B.water_fill(B.hierarchical_quota(strata, N_SAMPLES, 0.5).join(strata, ["category", "family", "signature"]))


# A stratum holds what the level of its group leaves it: the level is the highest whose sum is within the goal.
_RAISED = lambda name, source, by, base, cap, goal, order: f"""{name}_l AS (SELECT {by}, max(l) AS l FROM (SELECT {by}, l, sum(least({cap}, greatest(least({base}, {cap}), l))) AS s, least(any_value({goal}), sum({cap})) AS g
  FROM {source}, range({N_SAMPLES} + 1) AS r(l) GROUP BY {by}, l) WHERE s <= g OR l = 0 GROUP BY {by}),
{name}_n AS (SELECT *, least({cap}, greatest(least({base}, {cap}), l)) AS now FROM {source} JOIN {name}_l USING ({by})),
{name}_m AS (SELECT *, least({goal}, sum({cap}) OVER (PARTITION BY {by})) - sum(now) OVER (PARTITION BY {by}) AS rest, now = l AND now < {cap} AS open FROM {name}_n),
{name} AS (SELECT *, CAST(now + (CASE WHEN open AND row_number() OVER (PARTITION BY {by}, open ORDER BY {order}) <= rest THEN 1 ELSE 0 END) AS BIGINT) AS final FROM {name}_m)"""  # noqa: E731
FINAL_SQL = f"""{HIERARCHY_SQL}, leaf AS (SELECT h.*, s.capacity, category || chr(1) || family AS branch FROM h JOIN strata s USING (category, family, signature)),
fam_sum AS (SELECT category, branch, sum(quota) AS q, sum(capacity) AS cap FROM leaf GROUP BY 1, 2), fam_goal AS (SELECT *, sum(q) OVER (PARTITION BY category) AS goal FROM fam_sum),
{_RAISED("famx", "fam_goal", "category", "q", "cap", "goal", "branch")},
leaf_goal AS (SELECT leaf.*, famx.final AS total FROM leaf JOIN famx USING (branch)),
{_RAISED("leafx", "leaf_goal", "branch", "quota", "capacity", "total", "signature")}"""


@query(f"{FINAL_SQL} SELECT category, family, signature, quota, capacity, final AS final_quota FROM leafx")
def waterfill_quota(spark: SparkSession, d: str) -> DataFrame:
    return _final_quotas(_valid_rows(spark, d))


@query(
    f"{HIERARCHY_SQL}, c AS (SELECT row_id, CASE WHEN meta.category = 'people' THEN 'people' ELSE 'objects' END AS category, {FAMILY_SQL} AS family, s AS signature FROM "
    "(SELECT id, string_agg(name, ' -> ' ORDER BY i) AS s FROM vp GROUP BY id) x JOIN dataset_gpsr ON row_id = x.id) "
    "SELECT row_id, category, family, signature FROM (SELECT c.*, quota, row_number() OVER (PARTITION BY category, family, signature ORDER BY md5('42:' || row_id), row_id) AS r "
    "FROM c JOIN h USING (category, family, signature)) WHERE r <= quota"
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _valid_rows(spark, d)
    quotas = B.hierarchical_quota(_strata(rows), N_SAMPLES, 0.5)
    return B.fill_strata(rows, quotas, ["category", "family", "signature"], F.col("row_id"), 42, "quota")


@query(
    f"{FINAL_SQL}, c AS (SELECT row_id, CASE WHEN meta.category = 'people' THEN 'people' ELSE 'objects' END AS category, {FAMILY_SQL} AS family, s AS signature FROM "
    "(SELECT id, string_agg(name, ' -> ' ORDER BY i) AS s FROM vp GROUP BY id) x JOIN dataset_gpsr ON row_id = x.id) "
    "SELECT row_id, category, family, signature FROM (SELECT c.*, final, row_number() OVER (PARTITION BY category, family, signature ORDER BY md5('42:' || row_id), row_id) AS r "
    "FROM c JOIN leafx USING (category, family, signature)) WHERE r <= final"
)
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _valid_rows(spark, d)
    return B.fill_strata(rows, _final_quotas(rows), ["category", "family", "signature"], F.col("row_id"), 42)


@query(f"{STRATA_SQL} SELECT category, family, signature, capacity AS n, capacity * 100.0::DOUBLE / sum(capacity) OVER () AS percent FROM strata")
def distribution_report(spark: SparkSession, d: str) -> DataFrame:
    return B.distribution(_valid_rows(spark, d), ["category", "family", "signature"])


@query("SELECT row_id, md5('7:' || row_id) AS h FROM dataset_gpsr ORDER BY h, row_id LIMIT 500")
def hash_shuffle_topn(spark: SparkSession, d: str) -> DataFrame:
    """The head of the seeded permutation; the limit is the feature."""
    rows = dataset(spark, d).select("row_id", B.hash_rank(7, F.col("row_id")).alias("h"))
    return rows.orderBy("h", "row_id").limit(500)


@query("SELECT row_id, CASE WHEN row_number() OVER (ORDER BY md5('11:' || row_id), row_id) <= ceil(count(*) OVER () * 0.1) THEN 'eval' ELSE 'train' END AS part FROM dataset_gpsr")
def train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    return B.split_eval(dataset(spark, d).select("row_id"), F.col("row_id"), 11)


@query("SELECT row_id, input FROM dataset_gpsr ORDER BY row_id LIMIT 200")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 rows by id, as a gate samples them; the limit is the feature."""
    return dataset(spark, d).select("row_id", "input").orderBy("row_id").limit(200)


# ---- scoring ----------------------------------------------------------------------------------

ANSWERS_SQL = "ans AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY predicted_at DESC, prediction_id DESC) AS r FROM cached_predictions) WHERE r = 1)"
_EQ_FOLD = f"len(expected) = len(predicted) AND list_bool_and(list_transform(list_zip(expected, predicted), lambda z: {Q.text_key('z[1]')} = {Q.text_key('z[2]')}))"
SCORED_SQL = f"""WITH {ANSWERS_SQL},
sc0 AS (SELECT c.id, c.input, coalesce(nullif(c.meta.family, ''), 'unknown') AS family, c.goals AS expected, coalesce(a.prediction.goals, []) AS predicted,
  coalesce(a.normalized_input, c.input) AS normalized_input, a._elapsed_ms AS elapsed_ms, a.error, a.raw FROM model_evaluation_cases c LEFT JOIN ans a USING (id)),
{Q.issues_sql("SELECT id, predicted AS goals FROM sc0")},
sc AS (SELECT *, expected = predicted AS exact, coalesce(CASE WHEN len(expected) = 0 AND len(predicted) = 0 THEN true ELSE {_EQ_FOLD} END, false) AS casefold_exact,
  id NOT IN (SELECT id FROM issues) AS schema_valid FROM sc0)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    gold = cases(spark, d).select("id", "input", F.col("goals").alias("expected"), P.family_of(F.lit(None).cast("string"), F.col("meta.family")).alias("family"))
    found = table(spark, d, "cached_predictions").select(
        "id", "prediction_id", "predicted_at", F.col("prediction.goals").alias("predicted"), "normalized_input", F.col("_elapsed_ms").alias("elapsed_ms"), "error", "raw"
    )
    answers = S.latest_answers(found, "id", ["predicted_at", "prediction_id"]).drop("predicted_at", "prediction_id")
    return S.score_cases(gold, answers)


_RATIO = lambda n, d: f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0.0::DOUBLE)"
BY_FAMILY_SQL = (
    f"{SCORED_SQL} SELECT family, count(*) AS total, count(*) FILTER (WHERE exact) AS exact, {_RATIO('count(*) FILTER (WHERE exact)', 'count(*)')} AS accuracy, "
    f"count(*) FILTER (WHERE casefold_exact) AS casefold_exact, {_RATIO('count(*) FILTER (WHERE casefold_exact)', 'count(*)')} AS casefold_accuracy FROM sc GROUP BY family"
)


@query(BY_FAMILY_SQL)
def exact_by_family(spark: SparkSession, d: str) -> DataFrame:
    return S.exact_by_family(scored(spark, d))


def _pairs_sql() -> str:
    gold = Q.parsed_sql("SELECT id, goals FROM model_evaluation_cases")
    for name in ("src", "g", "m", "t", "k", "p"):
        gold = gold.replace(f"\n{name} AS (", f"\ne{name} AS (").replace(f"FROM {name})", f"FROM e{name})").replace(f"FROM {name}\n", f"FROM e{name}\n")
    return (
        f"{SCORED_SQL},{gold}, "
        f"es AS (SELECT x.* FROM ({Q.slots_sql('ep')}) x JOIN sc USING (id) WHERE schema_valid), ps AS (SELECT x.* FROM ({Q.slots_sql('p')}) x JOIN sc USING (id) WHERE schema_valid), "
        "pairs AS (SELECT es.id, es.slot_key, es.slot_value AS want, ps.slot_value AS got FROM es LEFT JOIN ps ON es.id = ps.id AND es.slot_key = ps.slot_key)"
    )


PAIRS_SQL = _pairs_sql()
_SUMS = "CAST(c AS BIGINT) AS correct, CAST(e AS BIGINT) AS expected, CAST(p AS BIGINT) AS predicted"


def _prf_sql(hit: str) -> str:
    prec, rec = _RATIO("c", "p"), _RATIO("c", "e")
    return (
        f"{PAIRS_SQL}, sums AS (SELECT (SELECT count(*) FROM pairs WHERE {hit}) AS c, (SELECT count(*) FROM es) AS e, (SELECT count(*) FROM ps) AS p) "
        f"SELECT {_SUMS}, {prec} AS precision, {rec} AS recall, {_RATIO(f'2 * {prec} * {rec}', f'({prec} + {rec})')} AS f1 FROM sums"
    )


@query(_prf_sql("got = want"))
def slot_prf(spark: SparkSession, d: str) -> DataFrame:
    return S.slot_scores(scored(spark, d))


FOLD_HIT = f"{Q.text_key(chr(99) + 'oalesce(got, ' + chr(39) * 2 + ')')} = {Q.text_key('want')}"


@query(_prf_sql(FOLD_HIT))
def casefold_slot_prf(spark: SparkSession, d: str) -> DataFrame:
    return S.slot_scores(scored(spark, d), folded=True)


@query(f"{PAIRS_SQL} SELECT want AS kind, count(*) AS total, count(*) FILTER (WHERE got = want) AS correct, {_RATIO('count(*) FILTER (WHERE got = want)', 'count(*)')} AS accuracy FROM pairs WHERE slot_key LIKE '%.kind' GROUP BY want")
def kind_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return S.kind_scores(scored(spark, d))


DETAILS_SQL = f"{SCORED_SQL} SELECT id, family, exact, casefold_exact, casefold_exact AND NOT exact AS case_only_difference, elapsed_ms, input, normalized_input, array_to_string(expected, ';') AS expected, array_to_string(predicted, ';') AS predicted, error AS prediction_error, raw FROM sc"


@query(DETAILS_SQL)
def case_details(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(
        "id", "family", "exact", "casefold_exact", "case_only_difference", "elapsed_ms", "input", "normalized_input",
        F.array_join("expected", ";").alias("expected"), F.array_join("predicted", ";").alias("predicted"), F.col("error").alias("prediction_error"), "raw",
    )


@query(f"{SCORED_SQL} SELECT id, family, CASE WHEN exact THEN 'OK' WHEN casefold_exact THEN 'CASE-OK' ELSE 'ERROR' END AS status FROM sc")
def case_status(spark: SparkSession, d: str) -> DataFrame:
    return S.status(scored(spark, d))


@query(f"SELECT id, family, input, prediction_error FROM ({DETAILS_SQL}) WHERE NOT exact AND NOT case_only_difference")
def error_cases(spark: SparkSession, d: str) -> DataFrame:
    return case_details(spark, d).where("not exact and not case_only_difference").select("id", "family", "input", "prediction_error")


@query(f"{SCORED_SQL} SELECT CASE WHEN exact THEN 'exact' WHEN casefold_exact THEN 'case_only' ELSE 'error' END AS outcome, count(*) AS n FROM sc GROUP BY 1")
def outcome_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.outcome(scored(spark, d))


@query(
    f"{SCORED_SQL} SELECT count(elapsed_ms) AS n, round(coalesce(avg(elapsed_ms), 0.0), 4) AS mean_ms, round(coalesce(quantile_cont(elapsed_ms, 0.5), 0.0), 6) AS p50_ms, "
    "round(coalesce(quantile_cont(elapsed_ms, 0.95), 0.0), 6) AS p95_ms FROM sc"
)
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return S.latency_stats(scored(spark, d)).select("n", r("mean_ms", 4), r("p50_ms", 6), r("p95_ms", 6))


@query(
    f"""{SCORED_SQL}, v AS (SELECT elapsed_ms AS v FROM sc WHERE elapsed_ms IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, least(12, greatest(4, count(*) // 4)) AS bins FROM v),
b AS (SELECT CAST(least(bins - 1, floor((v - lo) / ((hi - lo) / bins))) AS INTEGER) AS bin FROM v, e) SELECT bin, count(*) AS n FROM b GROUP BY bin"""
)
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.latency_histogram(scored(spark, d)).select("bin", "n")


_ONE = lambda hit, where="true": f"(SELECT count(*) FILTER (WHERE {hit}) FROM pairs WHERE {where})"
_KIND = lambda k: f"slot_key LIKE '%.kind' AND want = '{k}'"
_F1 = lambda hit: _RATIO(f"2 * {_ONE(hit)}", "((SELECT count(*) FROM es) + (SELECT count(*) FROM ps))")
_SC = lambda c: _RATIO(f"(SELECT count(*) FROM sc WHERE {c})", "(SELECT count(*) FROM sc)")


@query(
    f"""{PAIRS_SQL} SELECT 'exact_accuracy' AS metric, {_SC("exact")} AS value UNION ALL SELECT 'casefold_exact_accuracy', {_SC("casefold_exact")}
UNION ALL SELECT 'schema_valid_rate', {_SC("schema_valid")} UNION ALL SELECT 'slots_f1', {_F1("got = want")} UNION ALL SELECT 'casefold_slots_f1', {_F1(FOLD_HIT)}
UNION ALL SELECT 'kind_person_accuracy', {_RATIO(_ONE("got = want", _KIND("person")), _ONE("true", _KIND("person")))}
UNION ALL SELECT 'kind_object_accuracy', {_RATIO(_ONE("got = want", _KIND("object")), _ONE("true", _KIND("object")))}"""
)
def metrics_overview(spark: SparkSession, d: str) -> DataFrame:
    return S.overview(scored(spark, d)).select("metric", "value")


@query(f"SELECT family, accuracy, casefold_accuracy, CAST(row_number() OVER (ORDER BY casefold_accuracy, accuracy, family) AS INTEGER) AS rank FROM ({BY_FAMILY_SQL})")
def family_ranking(spark: SparkSession, d: str) -> DataFrame:
    return S.family_ranking(exact_by_family(spark, d)).select("family", "accuracy", "casefold_accuracy", "rank")


@query(f"{SCORED_SQL} SELECT count(*) AS cases, count(*) FILTER (WHERE NOT casefold_exact) AS misses, count(*) FILTER (WHERE NOT casefold_exact) = 0 AS passed FROM sc")
def perfect_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.perfect_gate(scored(spark, d))


@query(f"{SCORED_SQL} SELECT count(elapsed_ms) AS n, round(coalesce(sum(elapsed_ms), 0) / 1000, 3) AS seconds, round(coalesce(count(elapsed_ms) / nullif(sum(elapsed_ms) / 1000, 0), 0), 6) AS per_second FROM sc")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return S.throughput(scored(spark, d)).select("n", F.round("seconds", 3).alias("seconds"), F.round("per_second", 6).alias("per_second"))


# ---- catalogs ---------------------------------------------------------------------------------

CATALOG_SQL = f"""WITH k AS (SELECT entry_group AS grp, entry_value AS value, {Q.squeeze(Q.fold("replace(entry_value, '_', ' ')"))} AS key FROM catalog_entries WHERE entry_value IS NOT NULL)"""
GROUPS = ["names", "rooms", "locations", "objects", "clothing", "categories"]


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return from_rows(table(spark, d, "catalog_entries"))


@query(f"{CATALOG_SQL} SELECT grp AS \"group\", key, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) > 1")
def catalog_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(catalog(spark, d))


@query(f"{CATALOG_SQL} SELECT g AS \"group\" FROM (SELECT unnest({GROUPS!r}) AS g) WHERE g NOT IN (SELECT grp FROM k)")
def catalog_empty(spark: SparkSession, d: str) -> DataFrame:
    return C.empty_groups(catalog(spark, d), GROUPS)


@query(f"{CATALOG_SQL} SELECT DISTINCT key FROM k WHERE grp = 'names' AND key <> '' AND key IN (SELECT key FROM k WHERE grp IN ('objects', 'clothing'))")
def catalog_collisions(spark: SparkSession, d: str) -> DataFrame:
    return C.collisions(catalog(spark, d), ["names"], ["objects", "clothing"])


@query(f"{CATALOG_SQL} SELECT grp AS \"group\", value FROM k WHERE grp = 'objects' AND value <> {Q.fold('value')}")
def catalog_case(spark: SparkSession, d: str) -> DataFrame:
    return C.unusual_case(catalog(spark, d), ["objects"])


@query(
    f"""{CATALOG_SQL}, a AS (SELECT DISTINCT key FROM k WHERE grp = 'rooms' AND key <> ''), b AS (SELECT DISTINCT key FROM k WHERE grp = 'locations' AND key <> '')
SELECT key, 'only_local' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'only_external' FROM b WHERE key NOT IN (SELECT key FROM a)"""
)
def catalog_drift(spark: SparkSession, d: str) -> DataFrame:
    """Rooms against locations: what either list has alone."""
    rows = catalog(spark, d)
    return C.drift(rows.where("`group` = 'rooms'"), rows.where("`group` = 'locations'"))


_LISTED = lambda x: f"string_agg(DISTINCT {x}, ', ' ORDER BY {x})"


@query(
    f"""{CATALOG_SQL}, dup AS (SELECT grp, key FROM k GROUP BY 1, 2 HAVING count(*) > 1),
hit AS (SELECT DISTINCT key FROM k WHERE grp = 'names' AND key <> '' AND key IN (SELECT key FROM k WHERE grp = 'objects')), odd AS (SELECT DISTINCT value FROM k WHERE grp = 'objects' AND value <> {Q.fold('value')})
SELECT 'error' AS severity, 'empty_catalog' AS code, g AS message FROM (SELECT unnest(['names', 'objects', 'locations', 'rooms']) AS g) WHERE g NOT IN (SELECT grp FROM k)
UNION ALL SELECT 'warning', 'duplicates', grp || ': ' || {_LISTED("key")} FROM dup GROUP BY grp
UNION ALL SELECT 'error', 'person_object_collision', m FROM (SELECT {_LISTED("key")} AS m FROM hit) WHERE m IS NOT NULL
UNION ALL SELECT 'warning', 'object_case', m FROM (SELECT {_LISTED("value")} AS m FROM odd) WHERE m IS NOT NULL"""
)
def catalog_report(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog_issues(catalog(spark, d), ["names"], ["objects"], ["names", "objects", "locations", "rooms"])


# ---- normalisation ----------------------------------------------------------------------------

_CLEAN = lambda x: Q.squeeze(f"replace(regexp_replace(translate(lower({x}), '_-’', '  '''), '[,.;:!?()\\[\\]{{}}]', ' ', 'g'), '''', '')")
_W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"  # word characters
# every word between two marks, so that a phrase is matched as whole words without looking behind
_MARK = lambda x: f"regexp_replace({x}, '([{_W}]+)', chr(1) || '\\1' || chr(2), 'g')"
_UNMARK = lambda x: f"translate({x}, chr(1) || chr(2), '')"


def _chain(x: str, pairs: list[tuple[str, str]]) -> str:
    """Replace whole phrases one after the other in marked text."""
    words = lambda text, between: between.join(f"chr(1) || '{w}' || chr(2)" for w in text.split())
    for a, b in pairs:
        put = words(b, " || ' ' || ") or "' '"
        x = f"regexp_replace({x}, {words(a, ' || ' + repr(' +') + ' || ')}, {put}, 'g')"
    return x


@query(f"SELECT row_id, {_CLEAN('input')} AS cleaned FROM dataset_gpsr WHERE input IS NOT NULL")
def norm_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return dataset(spark, d).where("input is not null").select("row_id", N.cleanup(F.col("input")).alias("cleaned"))


_ALIASES = [(a, b) for a, b in sorted(N.PHRASE_ALIASES.items(), key=lambda x: -len(x[0])) if a != b and "'" not in a]
_FILLERS = [(p, "") for p in N.FILLER_PHRASES]
_STOP = ", ".join(repr(w) for w in N.FILLER_WORDS)
_NO_FILLERS = lambda x: f"array_to_string(list_filter(string_split({Q.squeeze(_UNMARK(_chain(_MARK(x), _FILLERS)))}, ' '), lambda w: w NOT IN ({_STOP}) AND w <> ''), ' ')"
_NO_ALIASES = lambda x: Q.squeeze(_UNMARK(_chain(_MARK(x), _ALIASES)))
_ONCE_EACH = "array_to_string(list_transform(list_filter(list_zip(w, list_concat([NULL], w[1:len(w) - 1])), lambda z: z[2] IS NULL OR z[1] <> z[2]), lambda z: z[1]), ' ')"
_PERSON = Q.squeeze(f"regexp_replace({_ONCE_EACH}, '\\bthe person the ([a-z ]+? person)\\b', 'the \\1', 'g')")


def _no_repeats(source: str, text: str, name: str) -> str:
    """``source`` with a column ``name``: ``text`` without repetitions."""
    return f"(SELECT * EXCLUDE (w), {_PERSON} AS {name} FROM (SELECT *, string_split({Q.squeeze(text)}, ' ') AS w FROM {source}))"


_CLEANED = f"(SELECT row_id, input, {_CLEAN('input')} AS c FROM dataset_gpsr WHERE input IS NOT NULL)"


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return spread(dataset(spark, d).select("row_id", "input")).where("input is not null")


@query(f"SELECT row_id, {_NO_FILLERS('c')} AS text FROM {_CLEANED}")
def norm_fillers(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).select("row_id", N.remove_fillers(N.cleanup(F.col("input"))).alias("text"))


@query(f"SELECT row_id, text FROM {_no_repeats(_CLEANED, 'c', 'text')}")
def norm_repetitions(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).select("row_id", N.remove_repetitions(N.cleanup(F.col("input"))).alias("text"))


@query(f"SELECT row_id, {_NO_ALIASES('c')} AS text FROM {_CLEANED}")
def norm_phrase_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).select("row_id", N.replace_aliases(N.cleanup(F.col("input")), N.PHRASE_ALIASES).alias("text"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    is_name = F.col("group") == "names"
    rows = catalog(spark, d).where("value is not null").select("group", "pos", is_name.alias("is_name"), F.when(is_name, F.replace("value", F.lit("_"), F.lit(" "))).otherwise(F.col("value")).alias("value"))
    # names first, then the groups in order: a catalog is small, its aliases are counted when they are collected
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("is_name"), "group", "pos", "value"))
    return N.entity_aliases(rows.select("value", "is_name", place.alias("place")))


_KEY = Q.squeeze(f"replace(regexp_replace(translate(lower(value), '_-', '  '), '[^{_W}\\s'']', ' ', 'g'), '''', '')")


ALIAS_SQL = f"""e0 AS (SELECT entry_group = 'names' AS is_name, CASE WHEN entry_group = 'names' THEN replace(entry_value, '_', ' ') ELSE entry_value END AS value, entry_group, pos FROM catalog_entries WHERE entry_value IS NOT NULL),
e AS (SELECT *, row_number() OVER (ORDER BY is_name DESC, entry_group, pos NULLS FIRST, value) AS place, {_KEY} AS key FROM e0),
s AS (SELECT place, key, CASE WHEN value IN (SELECT value FROM e WHERE is_name AND key <> '') THEN value ELSE key END AS canonical FROM e WHERE key <> ''),
o AS (SELECT key, max_by(canonical, place) AS canonical, min(place) AS place FROM s GROUP BY key),
c AS (SELECT key AS alias, canonical, place, 1 AS r FROM o UNION ALL SELECT replace(key, ' ', ''), canonical, place, 1 FROM o WHERE contains(key, ' ')
UNION ALL SELECT left(key, length(key) - 1), canonical, place, 2 FROM o WHERE key LIKE '%s' AND length(key) > 4),
alias_table AS (SELECT alias, first(canonical ORDER BY r, CASE WHEN r = 2 THEN place ELSE -place END) AS canonical, min(place) AS place FROM c GROUP BY alias)"""


@query(f"WITH {ALIAS_SQL} SELECT alias, canonical FROM alias_table")
def entity_alias_table(spark: SparkSession, d: str) -> DataFrame:
    """What every alias of the catalog stands for."""
    return _aliases(spark, d).select("alias", "canonical")


# The aliases of a text are found among its runs of words and replaced one by one, the longest first.
_RUNS = "flatten(list_transform(range(1, 9), lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))))"
_MARKED_TEXT = lambda x: f"chr(1) || replace({x}, ' ', chr(2) || ' ' || chr(1)) || chr(2)"
_MARKED_ALIAS = "chr(1) || replace(alias, ' ', chr(2) || ' +' || chr(1)) || chr(2)"


@query(
    f"""WITH RECURSIVE {ALIAS_SQL}, al AS (SELECT alias, canonical, row_number() OVER (ORDER BY length(alias) DESC, place, alias) AS rk FROM alias_table),
q1 AS (SELECT *, {_NO_FILLERS('c')} AS f FROM {_CLEANED}), q2 AS {_no_repeats('q1', 'f', 'r')}, q3 AS (SELECT row_id, {_NO_ALIASES('r')} AS t FROM q2),
rec AS (SELECT row_id, t, 0::BIGINT AS done FROM q3
UNION ALL SELECT row_id, {Q.squeeze(_UNMARK(f"regexp_replace({_MARK('t')}, {_MARKED_ALIAS}, {_MARKED_TEXT('canonical')}, 'gi')"))}, m.rk
FROM (SELECT row_id, t, min(rk) AS rk FROM (SELECT row_id, t, done, unnest({_RUNS}) AS g FROM (SELECT row_id, t, done, regexp_extract_all(lower(t), '[{_W}]+') AS w FROM rec)) JOIN al ON alias = g AND rk > done AND alias <> canonical GROUP BY row_id, t) m JOIN al USING (rk)),
fin AS (SELECT row_id, arg_max(t, done) AS t FROM rec GROUP BY row_id)
SELECT row_id, text FROM {_no_repeats('fin', 't', 'text')}"""
)
def norm_entities(spark: SparkSession, d: str) -> DataFrame:
    """Cleanup to the exact entity step, with all aliases of the catalog."""
    return N.normalize_rows(_inputs(spark, d), "input", N.alias_table(_aliases(spark, d)), out="text", fuzzy=False).select("row_id", "text")


@query()
def norm_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, the fuzzy entity step after the exact one; tested against difflib itself."""
    return N.normalize_rows(_inputs(spark, d), "input", N.alias_table(_aliases(spark, d)), out="text").select("row_id", "text")


_STEP = lambda changed, name: f"CASE WHEN {changed} THEN '{name}' END"
_CHANGES = ", ".join(_STEP(*x) for x in (("c <> input", "cleanup"), ("f <> c", "fillers"), ("r <> f", "repetitions"), ("a <> r", "phrases")))


@query(
    f"""WITH s1 AS (SELECT *, {_NO_FILLERS('c')} AS f FROM {_CLEANED}), s2 AS {_no_repeats('s1', 'f', 'r')}, s3 AS (SELECT *, {_NO_ALIASES('r')} AS a FROM s2)
SELECT row_id, normalized, array_to_string(list_filter([{_CHANGES}], lambda x: x IS NOT NULL), ',') AS changes FROM {_no_repeats('s3', 'a', 'normalized')}"""
)
def norm_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps with fixed lists and which of them changed a text."""
    steps = N.normalize_steps(F.col("input"))
    return _inputs(spark, d).select("row_id", steps.alias("s")).select("row_id", "s.normalized", F.array_join("s.changes", ",").alias("changes"))


# ---- payloads ---------------------------------------------------------------------------------


@query("SELECT row_id, coalesce(nullif(family, ''), 'unknown') AS family FROM dataset_gpsr")
def family_resolution(spark: SparkSession, d: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("family")))
    return dataset(spark, d).select("row_id", P.family_of(F.lit(None).cast("string"), P.family_from_json(text)).alias("family"))


@query("SELECT variant_id, (contains(t, 'WARNING') OR contains(t, 'None') OR contains(t, '{') OR contains(t, '}')) AS marked FROM (SELECT variant_id, coalesce(input, '') || array_to_string(coalesce(goals, []), '') AS t FROM all_command_variants)")
def marker_filter(spark: SparkSession, d: str) -> DataFrame:
    texts = F.concat(F.coalesce("input", F.lit("")), F.array_join(F.coalesce("goals", F.array().cast("array<string>")), ""))
    return table(spark, d, "all_command_variants").select("variant_id", P.has_marker(texts).alias("marked"))


@query(
    f"WITH {Q.issues_sql('SELECT variant_id AS id, goals FROM all_command_variants')} SELECT variant_id, (goals IS NOT NULL AND len(goals) > 0 AND variant_id NOT IN (SELECT id FROM issues) "
    "AND NOT (contains(array_to_string(goals, ''), 'WARNING') OR contains(array_to_string(goals, ''), 'None') OR contains(array_to_string(goals, ''), '{') OR contains(array_to_string(goals, ''), '}'))) AS usable FROM all_command_variants"
)
def payload_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = P.with_parsed(table(spark, d, "all_command_variants").select("variant_id", "goals"))
    return rows.select("variant_id", P.usable_payload(F.col("goals"), F.col("parsed")).alias("usable"))


@query("SELECT row_id, 'user' AS role, input AS content FROM dataset_gpsr WHERE input IS NOT NULL UNION ALL SELECT row_id, 'system', 'Translate the command.' FROM dataset_gpsr WHERE input IS NOT NULL")
def chat_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset(spark, d).where("input is not null").select("row_id", F.explode(chat_messages("Translate the command.", F.col("input"))).alias("m"))
    return rows.select("row_id", "m.role", "m.content")


@query("""SELECT id, '{"goals":[' || array_to_string(list_transform(goals, lambda g: '"' || replace(replace(g, '\\', '\\\\'), '"', '\\"') || '"'), ',') || ']}' AS response FROM model_evaluation_cases""")
def goals_to_json(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id", goals_json(F.col("goals")).alias("response"))


@query("SELECT id, array_to_string(goals, ';') AS goals FROM model_evaluation_cases")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Goals back out of a model-like output around their JSON text."""
    output = F.concat(F.lit("Here is the plan: "), goals_json(F.col("goals")), F.lit(" done."))
    return cases(spark, d).select("id", F.array_join(extract_goals(output), ";").alias("goals"))


@query("SELECT prediction_id, array_to_string(prediction.goals, ';') AS wrapped, array_to_string(prediction.goals, ';') AS bare FROM cached_predictions")
def prediction_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Goals out of an answer as JSON, whether its payload is wrapped or is the answer itself."""
    goals = lambda text: F.array_join(F.from_json(prediction_payload(text), "goals array<string>")["goals"], ";")
    rows = table(spark, d, "cached_predictions")
    return rows.select("prediction_id", goals(F.to_json(F.struct("prediction"))).alias("wrapped"), goals(F.to_json("prediction")).alias("bare"))


@query(f"SELECT id, {Q.text_key('input')} AS key FROM model_evaluation_cases WHERE input IS NOT NULL")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).where("input is not null").select("id", text_key(F.col("input")).alias("key"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and case-folded accuracy by family, with the slot scores of each family."""
    rows = scored(spark, sf_dir)
    slots = S.slot_scores(rows, by=["family"]).select("family", F.col("f1").alias("slot_f1"))
    return S.exact_by_family(rows).join(slots, "family")


from planloom.plans import grammar_queries  # noqa: E402, F401  registers its queries
