"""Grammar queries: the command families of the plan format over the names, rooms, locations, objects and clothes of the catalog."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators import grammar as GR
from planloom.operators import plans as P
from planloom.plans.registry import catalog, dataset, query

WHO = "find(person, kind=person, {gestPers_posePers})"

# The command families of the plan format, as
# name, weight among commands to people, weight among commands to objects, first clause, second clause, plan, it, them.
# Names, weights and plans are those of the format; the clauses are our own wording.
FAMILIES = [
    ("goToLoc", 8, 4, "go to the {loc_room}", "{FOLLOWUP:atLoc}", ["go({loc_room})"], None, None),
    ("takeObjFromPlcmt", 0, 2, "go to the {plcmtLoc}", "{takeVerb} the {obj} and {FOLLOWUP:hasObj}", ["go({plcmtLoc})", "find({obj}, kind=object)", "take({obj})"], "{obj}", None),
    ("findPrsInRoom", 4, 0, "go to the {room}", "{findVerb} the {gestPers_posePers} and {FOLLOWUP:foundPers}", ["go({room})", WHO], None, "person"),
    ("findObjInRoom", 0, 2, "go to the {room}", "{findVerb} {art} {obj_singCat} and {FOLLOWUP:foundObj}", ["go({room})", "find({obj_singCat}, kind=object)"], "{obj_singCat}", None),
    ("meetPrsAtBeac", 4, 0, "go to the {room}", "meet {name} and {FOLLOWUP:foundPers}", ["go({room})", "find({name}, kind=person)"], None, "{name}"),
    ("countObjOnPlcmt", 0, 1, "go to the {plcmtLoc}", "count the {plurCat}", ["go({plcmtLoc})", "count({plurCat}, kind=object)"], None, None),
    ("countPrsInRoom", 1, 0, "go to the {room}", "count the {gestPersPlur_posePersPlur}", ["go({room})", "count(person, kind=person, {gestPersPlur_posePersPlur})"], None, None),
    ("tellPrsInfoInLoc", 1, 0, "look for the person {inRoom_atLoc}", "tell me the {persInfo} of that person", ["go({inRoom_atLoc})", "find(person, kind=person)", "save({persInfo})", "go(instruction_point)", "tell({persInfo})"], None, None),
    ("tellObjPropOnPlcmt", 0, 1, "go to the {plcmtLoc}", "say which object is the {objComp}", ["go({plcmtLoc})", "find(object, kind=object, property={objComp})", "tell(object,property={objComp})"], None, None),
    ("talkInfoToGestPrsInRoom", 6, 0, "go to the {room}", "tell the {gestPers} {talk}", ["go({room})", "find(person, kind=person, {gestPers})", "talk('{talk}')"], None, None),
    ("followNameFromBeacToRoom", 1, 0, "go to the {loc}", "follow {name} to the {room}", ["go({loc})", "find({name}, kind=person)", "follow({name}, to={room})"], None, None),
    ("guideNameFromBeacToBeac", 1, 0, "go to the {loc}", "{guideVerb} {name} to the {loc_room}", ["go({loc})", "find({name}, kind=person)", "guide({name}, to={loc_room})"], None, None),
    ("guidePrsFromBeacToBeac", 1, 0, "go to the {loc}", "{guideVerb} the {gestPers_posePers} to the {loc_room}", ["go({loc})", WHO, "guide(person, to={loc_room})"], None, None),
    ("guideClothPrsFromBeacToBeac", 1, 0, "go to the {loc}", "{guideVerb} the person in the {colorClothe} to the {loc_room}", ["go({loc})", "find(person, kind=person, wearing='{colorClothe}')", "guide(person, to={loc_room})"], None, None),
    ("bringMeObjFromPlcmt", 0, 1, "go to the {plcmtLoc}", "bring me the {obj}", ["go({plcmtLoc})", "find({obj}, kind=object)", "take({obj})", "deliver({obj}, to=me)"], None, None),
    ("tellCatPropOnPlcmt", 0, 1, "go to the {plcmtLoc}", "say which {singCat} is the {objComp}", ["go({plcmtLoc})", "find({singCat}, kind=object, property={objComp})", "tell({singCat},property={objComp})"], None, None),
    ("greetClothDscInRm", 1, 0, "go to the {room}", "greet the person in the {colorClothe} and {FOLLOWUP:foundPers}", ["go({room})", "find(person, kind=person, wearing='{colorClothe}')", "greet(person)"], None, "person"),
    ("greetNameInRm", 4, 0, "go to the {room}", "greet {name} and {FOLLOWUP:foundPers}", ["go({room})", "find({name}, kind=person)", "greet({name})"], None, "{name}"),
    ("meetNameAtLocThenFindInRm", 1, 0, "meet {name} at the {loc}", "find them in the {room}", ["go({loc})", "find({name}, kind=person)", "go({room})", "find({name}, kind=person)"], None, None),
    ("countClothPrsInRoom", 1, 0, "go to the {room}", "count the people in {colorClothes}", ["go({room})", "count(person, kind=person, wearing='{colorClothes}')"], None, None),
    ("tellPrsInfoAtLocToPrsAtLoc", 1, 0, "learn the {persInfo} of the person at the {loc}", "tell it to the person at the {loc2}", ["go({loc})", "find(person, kind=person)", "save({persInfo})", "go({loc2})", "find(person, kind=person)", "tell({persInfo})"], None, None),
    ("followPrsAtLoc", 1, 0, "look for the {gestPers_posePers} {inRoom_atLoc}", "follow that person", ["go({inRoom_atLoc})", WHO, "follow(person)"], None, None),
    ("simpleGoToLoc", 2, 0, "go to the {loc_room}", "", ["go({loc_room})"], None, None),
    ("bringObjFromTo", 0, 2, "take the {obj} from the {loc}", "put it at the {loc2}", ["go({loc})", "find({obj}, kind=object)", "take({obj})", "place({obj}, at={loc2})"], None, None),
    ("answerQuestionOfPersInRoom", 1, 0, "go to the {room}", "answer the question of the {gestPers}", ["go({room})", "find(person, kind=person, {gestPers})", "answer_question()"], None, None),
    ("takeObjInRoom", 0, 2, "go to the {loc_room}", "{takeVerb} the {obj}", ["go({loc_room})", "find({obj}, kind=object)", "take({obj})"], None, None),
    ("findNameInRoom", 2, 0, "go to the {room}", "{findVerb} {name}", ["go({room})", "find({name}, kind=person)"], None, None),
    ("findObjectInRoomSimple", 0, 2, "go to the {room}", "{findVerb} {art} {obj_singCat}", ["go({room})", "find({obj_singCat}, kind=object)"], None, None),
    ("greetNameInRoomSimple", 2, 0, "go to the {room}", "greet {name}", ["go({room})", "find({name}, kind=person)", "greet({name})"], None, None),
]
# The follow-ups of the plan format, as place, category, name, text, plan, it, them.
FOLLOWUPS = [
    ("atLoc", "objects", "findObj", "{findVerb} {art} {obj_singCat} and {FOLLOWUP:foundObj}", ["find({obj_singCat}, kind=object)"], "{obj_singCat}", None),
    ("atLoc", "people", "findPrs", "{findVerb} the {gestPers_posePers} and {FOLLOWUP:foundPers}", [WHO], None, "person"),
    ("atLoc", "people", "meetName", "meet {name} and {FOLLOWUP:foundPers}", ["find({name}, kind=person)"], None, "{name}"),
    ("foundPers", "people", "talkInfo", "tell them {talk}", ["talk('{talk}')"], None, None),
    ("foundPers", "people", "followPrs", "follow them", ["follow({them})"], None, None),
    ("foundPers", "people", "followPrsToRoom", "follow them to the {loc2_room2}", ["follow({them}, to={loc2_room2})"], None, None),
    ("foundPers", "people", "guidePrsToBeacon", "{guideVerb} them to the {loc2_room2}", ["guide({them}, to={loc2_room2})"], None, None),
    ("foundObj", "objects", "takeObj", "{takeVerb} it and {FOLLOWUP:hasObj}", ["take({it})"], None, None),
    ("hasObj", "objects", "putObjInTrash", "throw it in the trash", ["drop({it}, in=trash)"], None, None),
    ("hasObj", "objects", "placeObjOnPlcmt", "put it on the {plcmtLoc2}", ["place({it}, on={plcmtLoc2})"], None, None),
    ("hasObj", "objects", "deliverObjToMe", "bring it to me", ["deliver({it}, to=me)"], None, None),
    ("hasObj", "objects", "deliverObjToPrsInRoom", "bring it to the {gestPers_posePers} in the {room}", ["go({room})", WHO, "deliver({it}, person)"], None, None),
    ("hasObj", "objects", "deliverObjToNameAtBeac", "bring it to {name} in the {room}", ["go({room})", "find({name}, kind=person)", "deliver({it}, {name})"], None, None),
]
# Slots of a family that must hold different values.
DISTINCT = [
    ("followNameFromBeacToRoom", ["loc", "room"]),
    ("guideNameFromBeacToBeac", ["loc", "loc_room"]),
    ("guidePrsFromBeacToBeac", ["loc", "loc_room"]),
    ("guideClothPrsFromBeacToBeac", ["loc", "loc_room"]),
    ("meetNameAtLocThenFindInRm", ["loc", "room"]),
    ("tellPrsInfoAtLocToPrsAtLoc", ["loc", "loc2"]),
    ("bringObjFromTo", ["loc", "loc2"]),
]
GESTURES = ["waving person", "person raising their left arm", "person pointing to the right"]
POSES = ["sitting person", "standing person", "lying person"]
WORDS = {
    "takeVerb": ["take", "get", "fetch"],
    "findVerb": ["find", "locate", "look for"],
    "guideVerb": ["guide", "escort", "lead"],
    "persInfo": ["name", "pose", "gesture"],
    "objComp": ["biggest", "smallest", "heaviest", "lightest"],
    "talk": ["the time", "what day is tomorrow", "something about yourself"],
}
FRAMES = ["{a} and {b}", "please {a}, then {b}", "your next job: {a} and {b}"]
ALONE = ["{a}", "please {a}", "your next job: {a}"]
PEOPLE = {"persons": "person"}  # plural of a description in a command to its singular in a plan

SURFACES = [
    (name, category, v, (frame if b else alone).replace("{a}", a).replace("{b}", b))
    for name, people, objects, a, b, *_ in FAMILIES
    for category, weight in (("people", people), ("objects", objects))
    if weight
    for v, (frame, alone) in enumerate(zip(FRAMES, ALONE, strict=True), 1)
]
PLANS = [(name, goals, it, them) for name, _, _, _, _, goals, it, them in FAMILIES]
WEIGHTS = [(category, name, float(weight)) for name, people, objects, *_ in FAMILIES for category, weight in (("people", people), ("objects", objects)) if weight]
ROOMS = [("roomToRoom", "people", 0, "walk from the {room} to the {room2}"), ("roomToRoom", "people", 1, "leave the {room} for the {room2}")]


def _sql_rows(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "[" + ", ".join(show(x) for x in v) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(show(v) for v in r) + ')' for r in rows)}) AS x({names}))"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(SURFACES, "family string, category string, version int, template string"),
        spark.createDataFrame(FOLLOWUPS, "key string, category string, route string, template string, goals array<string>, obj string, person string"),
        spark.createDataFrame(PLANS, "family string, goals array<string>, obj string, person string"),
    )


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISTINCT, "family string, slots array<string>")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """``slot, pos, value, goal``: what stands in a command, and how it reads in a plan."""
    rows = catalog(spark, d).where("value is not null").select("group", "pos", F.replace("value", F.lit("_"), F.lit(" ")).alias("value"), "parent")
    v = F.col("value")

    def of(slot: str, group: str, value: Column = v, goal: Column | None = None) -> DataFrame:
        return rows.where(F.col("group") == group).select(F.lit(slot).alias("slot"), "pos", value.alias("value"), (value if goal is None else goal).alias("goal"))

    kinds = rows.where("`group` = 'objects' and parent is not null").groupBy("parent").agg(F.min("pos").alias("pos"))
    kind = lambda slot, text: kinds.select(F.lit(slot).alias("slot"), "pos", text.alias("value"), text.alias("goal"))
    several = lambda texts: [t.replace("person", "persons") for t in texts]
    listed = [(slot, i, x, "{}") for slot, words in WORDS.items() for i, x in enumerate(words)]
    listed += [(slot, i, x, pattern) for slot, words, pattern in (("gestPers", GESTURES, "gesture='{}'"), ("posePers", POSES, "pose='{}'"), ("gestPersPlur", several(GESTURES), "gesture='{}'"), ("posePersPlur", several(POSES), "pose='{}'")) for i, x in enumerate(words)]
    fixed = spark.createDataFrame(listed, "slot string, pos int, value string, pattern string")
    parts = [
        of("name", "names"),
        of("room", "rooms"),
        of("loc", "locations"),
        of("plcmtLoc", "locations"),
        of("obj", "objects"),
        of("inRoom", "rooms", F.concat(F.lit("in the "), v), v),
        of("atLoc", "locations", F.concat(F.lit("at the "), v), v),
        of("colorClothe", "clothing"),
        of("colorClothes", "clothing", F.concat(v, F.lit("s")), v),
        kind("singCat", F.col("parent")),
        kind("plurCat", F.concat("parent", F.lit("s"))),
        fixed.select("slot", "pos", "value", F.replace(F.col("pattern"), F.lit("{}"), GR.singular(v, PEOPLE)).alias("goal")),
    ]
    return reduce(DataFrame.unionByName, parts)


_CATALOG = lambda group: f"(SELECT replace(entry_value, '_', ' ') AS v, pos FROM catalog_entries WHERE entry_group = '{group}' AND entry_value IS NOT NULL)"
_FIRST = lambda group: f"(SELECT min_by(v, (pos, v)) FROM {_CATALOG(group)})"
_KIND = "(SELECT min_by(parent, (p, parent)) FROM (SELECT parent, min(pos) AS p FROM catalog_entries WHERE entry_group = 'objects' AND entry_value IS NOT NULL AND parent IS NOT NULL GROUP BY parent))"
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
# slot -> SQL of its first value and of how that reads in a plan
FIRST_SQL = {
    **{slot: (_QUOTED(words[0]), _QUOTED(words[0])) for slot, words in WORDS.items()},
    **{slot: (_FIRST(g), _FIRST(g)) for slot, g in (("name", "names"), ("room", "rooms"), ("loc", "locations"), ("plcmtLoc", "locations"), ("obj", "objects"), ("colorClothe", "clothing"))},
    "inRoom": (f"'in the ' || {_FIRST('rooms')}", _FIRST("rooms")),
    "colorClothes": (f"{_FIRST('clothing')} || 's'", _FIRST("clothing")),
    "singCat": (_KIND, _KIND),
    "plurCat": (f"{_KIND} || 's'", f"{_KIND} || 's'"),
    "gestPers": (_QUOTED(GESTURES[0]), _QUOTED(f"gesture='{GESTURES[0]}'")),
    "gestPersPlur": (_QUOTED(GESTURES[0].replace("person", "persons")), _QUOTED(f"gesture='{GESTURES[0]}'")),
}


def _slots_sql() -> list[tuple[str, str, str]]:
    """Every slot of the grammar with the SQL of its first value in texts and in plans; the slots filled last are not among them."""
    texts = [s[3] for s in SURFACES] + [f[3] for f in FOLLOWUPS] + [g for p in PLANS for g in p[1]] + [g for f in FOLLOWUPS for g in f[4]]
    found = dict.fromkeys(s for t in texts for s in re.findall(r"\{(\w+)\}", t))
    return [(s, *FIRST_SQL[s.split("_")[0]]) for s in found if s not in ("art", "it", "them") and not s.endswith("2")]


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for slot, value in pairs:
        x = f"replace({x}, '{{{slot}}}', {value})"
    return x


_SURFACES_SQL = _sql_rows(SURFACES, "family, category, version, template")
_FOLLOWUPS_SQL = _sql_rows(FOLLOWUPS, "key, category, route, template, goals, obj, person")
_PLANS_SQL = _sql_rows(PLANS, "family, goals, obj, person")
_PLACES = "list_sort(list_distinct(list_filter(regexp_extract_all(template, '\\{([^{}]+)\\}', 1), lambda p: p NOT IN ('art', 'connector') AND NOT ends_with(p, 'Verb') AND NOT ends_with(p, 'Prep'))))"


@query(
    f"""WITH s AS (SELECT DISTINCT family, version, template, {_PLACES} AS here FROM {_SURFACES_SQL}), w AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, first_value(here) OVER (PARTITION BY family ORDER BY version) AS want FROM s)
SELECT family, CAST(version AS INTEGER) AS version, CASE WHEN n < 3 OR n > 5 THEN 'surface count' ELSE 'semantic places differ' END AS problem FROM w WHERE n < 3 OR n > 5 OR here <> want"""
)
def template_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Families with too few or many surfaces, or with surfaces of other content: none in this grammar."""
    return GR.template_issues(_tables(spark)[0].drop("category").distinct())


_MARK = "regexp_extract(r.template, '\\{FOLLOWUP:([^{}]+)\\}', 1)"
_ROUTES_SQL = f"""WITH RECURSIVE r(family, category, version, template, goals, route, obj, person) AS (
SELECT s.family, s.category, s.version, s.template, p.goals, '' AS route, CAST(p.obj AS VARCHAR), CAST(p.person AS VARCHAR) FROM {_SURFACES_SQL} s JOIN {_PLANS_SQL} p USING (family)
UNION ALL SELECT r.family, r.category, r.version, replace(r.template, '{{FOLLOWUP:' || f.key || '}}', f.template), list_concat(r.goals, list_transform(f.goals, lambda g: replace(replace(g, '{{it}}', coalesce(r.obj, 'it')), '{{them}}', coalesce(r.person, 'person')))),
r.route || CASE WHEN r.route = '' THEN '' ELSE '>' END || f.route, coalesce(CAST(f.obj AS VARCHAR), r.obj), coalesce(CAST(f.person AS VARCHAR), r.person)
FROM r JOIN {_FOLLOWUPS_SQL} f ON f.key = {_MARK} AND f.category = r.category),
routes AS (SELECT * FROM r WHERE NOT contains(template, '{{FOLLOWUP:'))"""


@query(f"{_ROUTES_SQL} SELECT family, category, CAST(version AS INTEGER) AS version, template, route, array_to_string(goals, ';') AS goals FROM routes")
def followup_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every surface in every route of follow-ups, its slots still open."""
    rows = GR.forms(*_tables(spark), own_slots=False)
    return rows.select("family", "category", "version", "template", F.array_join("route", ">").alias("route"), F.array_join("goals", ";").alias("goals"))


@query(
    """WITH o AS (SELECT 'bring me {art} ' || entry_value || ' from the kiosk' AS t FROM catalog_entries WHERE entry_group = 'objects' AND entry_value IS NOT NULL)
SELECT replace(t, '{art}', CASE WHEN lower(regexp_extract(t, '\\{art\\}\\s*(\\w)', 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END) AS text FROM o"""
)
def article_fix(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d).where("`group` = 'objects' and value is not null")
    return rows.select(GR.fix_article(F.concat(F.lit("bring me {art} "), F.col("value"), F.lit(" from the kiosk"))).alias("text"))


@query("SELECT row_id, regexp_replace(input, '\\bpersons\\b', 'person', 'g') AS text FROM dataset_gpsr WHERE input IS NOT NULL")
def singular_forms(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of several people in the singular, as plans hold them."""
    return dataset(spark, d).where("input is not null").select("row_id", GR.singular(F.col("input"), PEOPLE).alias("text"))


_OTHER = lambda group: f"(SELECT arg_min(v, (contains(t, v), pos, v)) FROM {_CATALOG(group)})"
_LATE = [("loc2", "o_loc"), ("loc2_room2", "o_loc"), ("plcmtLoc2", "o_loc")]
_IN_TEXT, _IN_GOAL = [(s, f"v_{s}") for s, _, _ in _slots_sql()], [(s, f"g_{s}") for s, _, _ in _slots_sql()]
_FIRSTS = ", ".join(f"{a} AS v_{s}, {b} AS g_{s}" for s, a, b in _slots_sql())
VARIANTS_SQL = f"""{_ROUTES_SQL}, fv AS (SELECT {_FIRSTS}), f AS (SELECT routes.*, {_replaced("template", _IN_TEXT)} AS t, list_transform(goals, lambda g: {_replaced("g", _IN_GOAL)}) AS gs FROM routes, fv),
l AS (SELECT v, pos FROM {_CATALOG("locations")}), k AS (SELECT DISTINCT t FROM f), m AS (SELECT t, arg_min(v, (contains(t, v), pos, v)) AS o_loc FROM k, l GROUP BY t),
w AS (SELECT f.*, o_loc, {_replaced("t", _LATE)} AS t2 FROM f JOIN m USING (t))
SELECT family, category, family || ':v' || version AS surface_template_id, route, replace(t2, '{{art}}', CASE WHEN lower(regexp_extract(t2, '\\{{art\\}}\\s*(\\w)', 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END) AS input,
array_to_string(list_transform(gs, lambda g: {_replaced("g", _LATE)}), ';') AS goals FROM w"""


@query(VARIANTS_SQL)
def enumerate_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each surface of each family in each route, slots with their first value, with its plan."""
    rows = GR.enumerate_variants(*_tables(spark), _vocabulary(spark, d))
    return rows.select("family", "category", "surface_template_id", F.array_join("route", ">").alias("route"), "input", F.array_join("goals", ";").alias("goals"))


@query(
    f"""WITH v AS (SELECT DISTINCT entry_value AS x, entry_id FROM catalog_entries WHERE entry_group = 'rooms' AND entry_value IS NOT NULL)
SELECT version::INTEGER AS version, replace(replace(template, '{{room}}', a.x), '{{room2}}', b.x) AS input FROM {_sql_rows(ROOMS, "family, category, version, template")}, v a, v b
WHERE NOT contains(replace(template, '{{room}}', a.x), b.x) AND replace(lower(a.x), 'ß', 'ss') <> replace(lower(b.x), 'ß', 'ss')"""
)
def distinct_slots(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of rooms in two surfaces, without repeated values."""
    surfaces = spark.createDataFrame(ROOMS, "family string, category string, version int, template string")
    plans = spark.createDataFrame([("roomToRoom", ["go({room})", "go({room2})"])], "family string, goals array<string>")
    rule = spark.createDataFrame([("roomToRoom", ["room", "room2"])], "family string, slots array<string>")
    none = spark.createDataFrame([], "key string, route string, template string, goals array<string>")
    rooms = catalog(spark, d).where("`group` = 'rooms' and value is not null").select(F.lit("room").alias("slot"), "pos", "value")
    rows = GR.enumerate_variants(surfaces, none, plans, rooms, rule, every_value=True)
    return rows.select(F.substring_index("surface_template_id", ":v", -1).cast("int").alias("version"), "input")


PEOPLE_WEIGHTS = [w for w in WEIGHTS if w[0] == "people"]


@query(
    f"""WITH w AS (SELECT choice, sum(weight) OVER (ORDER BY choice) / sum(weight) OVER () AS hi FROM {_sql_rows(PEOPLE_WEIGHTS, "key, choice, weight")}),
u AS (SELECT row_id, ('0x' || substr(md5('5:' || row_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM dataset_gpsr)
SELECT row_id, (SELECT min_by(choice, hi) FROM w WHERE hi > u) AS choice FROM u"""
)
def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    choices = spark.createDataFrame(PEOPLE_WEIGHTS, "key string, choice string, weight double")
    return GR.weighted_pick(dataset(spark, d).select("row_id", F.lit("people").alias("key")), choices, 5, F.col("row_id")).select("row_id", "choice")


def random_rows(spark: SparkSession, d: str) -> DataFrame:
    """One random command for every training row, of the row's category; draws that break a rule are left out."""
    category = F.when(F.col("meta.category") == "people", "people").otherwise("objects")
    draws = dataset(spark, d).select(F.col("row_id").alias("draw"), category.alias("category"))
    families = spark.createDataFrame(WEIGHTS, "category string, family string, weight double")
    return GR.draw_commands(*_tables(spark), _vocabulary(spark, d), _rules(spark), draws, families, 42)


_COUNT = lambda c: F.sum(c.cast("long"))


def _open_places() -> Column:
    return F.contains(F.concat("input", F.array_join("goals", ";")), F.lit("{"))



@query(
    "SELECT category, count(*) AS n_draws, 0 AS n_invalid, 0 AS n_open, true AS mostly_kept FROM (SELECT CASE WHEN meta.category = 'people' THEN 'people' ELSE 'objects' END AS category FROM dataset_gpsr) GROUP BY category"
)
def random_commands(spark: SparkSession, d: str) -> DataFrame:
    """Random commands for every training row, and what must hold of them: no invalid plan, no open place, at most a fiftieth left out."""
    made = P.with_issues(random_rows(spark, d)).groupBy("category").agg(F.count("*").alias("n"), _COUNT(~F.col("valid")).alias("n_invalid"), _COUNT(_open_places()).alias("n_open"))
    asked = dataset(spark, d).groupBy(F.when(F.col("meta.category") == "people", "people").otherwise("objects").alias("category")).agg(F.count("*").alias("n_draws"))
    return asked.join(made, "category", "left").select("category", "n_draws", "n_invalid", "n_open", (F.col("n") * 50 >= F.col("n_draws") * 49).alias("mostly_kept"))


N_GENERATED = 1000


def generated_rows(spark: SparkSession, d: str) -> DataFrame:
    """A balanced set of ``N_GENERATED`` valid, different commands of the grammar; the size is the feature."""
    return GR.generate(*_tables(spark), _vocabulary(spark, d), _rules(spark), N_GENERATED, 0.5, 42)


@query(f"SELECT {N_GENERATED} AS n_rows, {N_GENERATED // 2} AS n_people, {N_GENERATED} AS n_texts, 0 AS n_invalid, 0 AS n_open, {len(FAMILIES)} AS n_families")
def generated_commands(spark: SparkSession, d: str) -> DataFrame:
    """A generated set, and what must hold of it: its size and balance, no text twice, no invalid plan, no open place, every family."""
    rows = P.with_issues(generated_rows(spark, d))
    return rows.agg(
        F.count("*").alias("n_rows"),
        _COUNT(F.col("category") == "people").alias("n_people"),
        F.count_distinct(F.lower("input")).alias("n_texts"),
        _COUNT(~F.col("valid")).alias("n_invalid"),
        _COUNT(_open_places()).alias("n_open"),
        F.count_distinct("family").alias("n_families"),
    )
