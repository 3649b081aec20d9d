"""Building blocks of the DuckDB oracles: the goal parser and the rules in plain SQL."""

from __future__ import annotations

from planloom.functions.goals import ALLOWED_SLOTS

GOAL_SQL = r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^\n]*)\)\s*$"
TOKEN_SQL = "((?:[^,''\"]|''[^'']*''|\"[^\"]*\")+)"
SPACE_SQL = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
BALANCED_SQL = "^(?:[^''\"]|''[^'']*''|\"[^\"]*\")*$"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_SQL}', ' ', 'g'))"


def text_key(x: str) -> str:
    return squeeze(fold(x))


def slot(name: str) -> str:
    """Value of a slot in a row of ``parsed_sql``, null where it is absent."""
    return f"list_extract(list_transform(list_filter(kw, lambda x: x.k = '{name}'), lambda x: x.v), 1)"


def parsed_sql(source: str) -> str:
    """CTEs ending in ``p(id, i, goal, name, args, kw, target, kind, bad)``: one row per goal of ``source(id, goals)``."""
    return f"""
src AS ({source}),
g AS (SELECT id, unnest(goals) AS goal, CAST(generate_subscripts(goals, 1) AS INTEGER) AS i FROM src),
m AS (SELECT id, i, goal, regexp_matches(goal, '{GOAL_SQL}') AS ok,
  lower(regexp_extract(goal, '{GOAL_SQL}', 1)) AS name, regexp_extract(goal, '{GOAL_SQL}', 2) AS body FROM g),
t AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '{TOKEN_SQL}'),
  lambda x: trim(regexp_replace(x, '''([^'']*)''|"([^"]*)"', '\\1\\2', 'g'))), lambda x: x <> '') AS toks,
  regexp_matches(body, '{BALANCED_SQL}') AS closed FROM m),
k AS (SELECT *, list_transform(list_filter(toks, lambda x: NOT contains(x, '=')), lambda x: trim(x)) AS args,
  list_transform(list_filter(toks, lambda x: contains(x, '=')), lambda x: {{'k': lower(trim(split_part(x, '=', 1))), 'v': trim(substr(x, strpos(x, '=') + 1))}}) AS kw FROM t),
p AS (SELECT id, i, goal, name, args, kw, coalesce(list_extract(args, 1), '') AS target, coalesce({slot("kind")}, '') AS kind,
  (goal IS NULL OR NOT ok OR NOT closed OR list_contains(list_transform(kw, lambda x: x.k), '')
   OR len(list_distinct(list_transform(kw, lambda x: x.k))) < len(kw)) AS bad FROM k)"""


def entity_kind_sql() -> str:
    return "CASE WHEN kind <> '' THEN kind WHEN name IN ('take','deliver','place','drop') THEN 'object' WHEN name IN ('guide','follow','greet') THEN 'person' ELSE '' END"


def has(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"(len(list_filter(kw, lambda x: x.k IN ({listed}))) > 0)"


def local_issues_sql() -> str:
    """CTE ``local_issues(id, code, goal_index)`` on top of ``p``."""
    verbs = ", ".join(f"'{v}'" for v in ALLOWED_SLOTS)
    extra = " OR ".join(
        f"(name = '{v}' AND len(list_filter(kw, lambda x: x.k NOT IN ({', '.join(repr(s) for s in slots) or repr('')}))) > 0)" for v, slots in ALLOWED_SLOTS.items()
    )
    rules = [
        ("unsupported_slots", f"({extra})"),
        ("missing_target", "name <> 'answer_question' AND target = ''"),
        ("unexpected_arguments", "name = 'answer_question' AND (len(args) > 0 OR len(kw) > 0)"),
        ("missing_kind", "name IN ('find','count') AND kind = ''"),
        ("invalid_kind", "name IN ('find','count') AND kind <> '' AND kind NOT IN ('person','object')"),
        ("person_object_qualifier", f"name IN ('find','count') AND kind = 'person' AND {has('property')}"),
        ("object_person_qualifier", f"name IN ('find','count') AND kind = 'object' AND {has('gesture', 'pose', 'wearing')}"),
        ("missing_destination", f"name = 'deliver' AND len(args) < 2 AND NOT {has('to')}"),
        ("missing_destination", f"name IN ('place','drop') AND NOT {has('at', 'in', 'on', 'to')}"),
        ("missing_destination", f"name = 'guide' AND NOT {has('to')}"),
    ]
    parts = [
        "SELECT id, 'empty_goals' AS code, CAST(NULL AS INTEGER) AS goal_index FROM src WHERE goals IS NULL OR len(goals) = 0",
        "SELECT id, 'invalid_goal', i FROM p WHERE goal IS NULL OR trim(goal) = ''",
        "SELECT id, 'invalid_syntax', i FROM p WHERE goal IS NOT NULL AND trim(goal) <> '' AND bad",
        f"SELECT id, 'unsupported_goal', i FROM p WHERE NOT bad AND name NOT IN ({verbs})",
        *[f"SELECT id, '{code}', i FROM p WHERE NOT bad AND name IN ({verbs}) AND ({rule})" for code, rule in rules],
    ]
    return "local_issues AS (\n" + "\nUNION ALL ".join(parts) + ")"


def sequence_issues_sql() -> str:
    """CTE ``sequence_issues(id, code, goal_index)`` on top of ``p``, with windows instead of a fold."""
    place_of = " ".join(f"WHEN {has(s)} THEN {slot(s)}" for s in ("at", "in", "on", "to"))
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
s AS (SELECT id, name, kind, {fold("target")} AS tg, target, kw, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS n FROM p WHERE NOT bad),
d AS (SELECT *, CASE WHEN name IN ('follow','guide') THEN {fold("coalesce(" + slot("to") + ", '')")}
  WHEN name IN ('place','drop') THEN {fold("coalesce(CASE " + place_of + " END, '')")} ELSE '' END AS dest,
  CASE WHEN name IN ('take','deliver','place','drop') THEN 'object' WHEN name IN ('guide','follow','greet') THEN 'person' ELSE '' END AS need,
  CASE WHEN name = 'go' THEN tg END AS went,
  CASE WHEN name = 'find' AND tg <> '' AND kind <> '' THEN kind END AS labelled,
  CASE WHEN name = 'take' AND target <> '' THEN 1 WHEN name IN ('deliver','place','drop') AND target <> '' THEN 0 END AS hold FROM s),
w AS (SELECT *, last_value(went IGNORE NULLS) OVER (PARTITION BY id ORDER BY n {before}) AS place,
  last_value(labelled IGNORE NULLS) OVER (PARTITION BY id, tg ORDER BY n {before}) AS label,
  last_value(hold IGNORE NULLS) OVER (PARTITION BY id, tg ORDER BY n {before}) AS held FROM d),
sequence_issues AS (
SELECT id, 'redundant_navigation' AS code, n AS goal_index FROM w WHERE name = 'go' AND tg <> '' AND tg = coalesce(place, '')
UNION ALL SELECT id, 'redundant_destination', n FROM w WHERE dest <> '' AND coalesce(place, '') <> '' AND dest = place
UNION ALL SELECT id, 'kind_conflict', n FROM w WHERE labelled IS NOT NULL AND label IS NOT NULL AND label <> labelled
UNION ALL SELECT id, 'kind_action_conflict', n FROM w WHERE tg <> '' AND need <> '' AND label IS NOT NULL AND label <> need
UNION ALL SELECT id, 'object_not_taken', n FROM w WHERE hold = 0 AND coalesce(held, 0) = 0)"""


def issues_sql(source: str) -> str:
    return f"{parsed_sql(source)},\n{local_issues_sql()},\n{sequence_issues_sql()},\nissues AS (SELECT * FROM local_issues UNION ALL SELECT * FROM sequence_issues)"


def slots_sql(parsed: str = "p") -> str:
    """SELECT ``id, slot_key, slot_value`` of all goals in a table like ``p``, names of slots not repeated by position."""
    return f"""SELECT id, i || '.' || name || '.target' AS slot_key, target AS slot_value FROM {parsed}
UNION ALL SELECT id, i || '.' || name || '.' || e.k, e.v FROM (SELECT id, i, name, unnest(kw) AS e FROM {parsed})
UNION ALL SELECT id, i || '.' || name || '.arg' || j, a FROM (SELECT id, i, name, unnest(args) AS a, generate_subscripts(args, 1) AS j FROM {parsed}) WHERE j > 1"""


DATASET = "SELECT row_id AS id, goals FROM dataset_gpsr"
CASES = "SELECT id, goals FROM model_evaluation_cases"
