import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from planloom.functions import normalize as N
from planloom.functions import payload as Y
from planloom.operators import balance as B
from planloom.operators import grammar as GR
from planloom.operators import plans as P
from planloom.operators import scoring as S
from planloom.operators.predict import translate
from planloom.skew import lookup_join, salted_rank


def scored(spark, cases):
    gold = spark.createDataFrame([(f"c{i}", f"in {i}", e, "fam") for i, (e, _) in enumerate(cases)], "id string, input string, expected array<string>, family string")
    answers = spark.createDataFrame(
        [(f"c{i}", p, None, 10.0 * i, None, None) for i, (_, p) in enumerate(cases) if p is not None],
        "id string, predicted array<string>, normalized_input string, elapsed_ms double, error string, raw string",
    )
    return S.score_cases(gold, answers)


PLAN = ["go(hall)", "find(Cup, kind=object)", "take(Cup)", "deliver(Cup, to=me)"]


def test_perfect_scores(spark):
    rows = scored(spark, [(PLAN, PLAN)] * 3)
    r = S.slot_scores(rows).first()
    assert (r.correct, r.expected, r.predicted, r.f1) == (18, 18, 18, 1.0)
    assert S.perfect_gate(rows, strict=True).first().passed
    assert {m.metric: m.value for m in S.overview(rows).collect()}["exact_accuracy"] == 1.0
    S.require_perfect(rows, strict=True)


def test_case_only_and_errors(spark):
    lower = [g.lower() for g in PLAN]
    rows = scored(spark, [(PLAN, lower), (PLAN, PLAN[:3]), (PLAN, None), (PLAN, PLAN * 2), (PLAN, PLAN)])
    assert {r.outcome: r.n for r in S.outcome(rows).collect()} == {"exact": 1, "case_only": 1, "error": 3}
    strict, folded = S.slot_scores(rows).first(), S.slot_scores(rows, folded=True).first()
    assert folded.correct > strict.correct and strict.expected == folded.expected
    assert [r.status for r in S.status(rows).orderBy("id").collect()] == ["CASE-OK", "ERROR", "ERROR", "ERROR", "OK"]
    with pytest.raises(RuntimeError):
        S.require_perfect(rows)


def test_empty_scores(spark):
    rows = scored(spark, [(PLAN, PLAN)]).limit(0)
    assert S.slot_scores(rows).first().f1 == 0.0 and S.latency_stats(rows).first().p95_ms == 0.0
    assert S.latency_histogram(rows).count() == 0


def test_percentile_is_linear(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "elapsed_ms double")
    r = S.latency_stats(rows).first()
    assert r.n == 3 and abs(r.p95_ms - 9.2) < 1e-9 and r.p50_ms == 2.0


def test_dedup(spark):
    rows = [(1, "Go  there", ["a"]), (2, "go there", ["a"]), (3, "GO THERE ", ["b"]), (4, "x", ["a"]), (5, "straße", None), (6, "STRASSE", None)]
    df = spark.createDataFrame(rows, "row_id long, input string, goals array<string>")
    got = {r.row_id: r.status for r in B.dedup_status(df, "row_id").collect()}
    assert got == {1: "added", 2: "duplicate", 3: "label_conflict", 4: "added", 5: "added", 6: "duplicate"}
    assert {r.row_id for r in B.dedup_first(df, "row_id").collect()} == {1, 4, 5}


def raised_one_by_one(base, caps, goal):
    """Brute force: one step at a time to the first of the lowest open items."""
    now = [min(b, c) for b, c in zip(base, caps, strict=True)]
    low = list(now)
    while sum(now) < min(goal, sum(caps)):
        open_ = [i for i in range(len(now)) if now[i] < caps[i]]
        at = min(open_, key=lambda i: (now[i], i))
        now[at] += 1
    return now if sum(low) <= goal else low


def test_raise_levels(spark):
    rng = random.Random(1)
    groups = [([5, 5, 5], [5, 2, 100], 15), ([1, 4], [10, 10], 8), ([3, 3], [3, 3], 99), ([4, 4], [9, 9], 3), ([0], [0], 5)]
    groups += [([rng.randrange(20) for _ in range(n)], [rng.randrange(20) for _ in range(n)], rng.randrange(90)) for n in range(1, 9) for _ in range(12)]
    rows = [(g, i, b, c, goal) for g, (base, caps, goal) in enumerate(groups) for i, (b, c) in enumerate(zip(base, caps, strict=True))]
    df = spark.createDataFrame(rows, "g int, i int, b long, c long, goal long")
    got = {(r.g, r.i): r.f for r in B.raise_levels(df, ["g"], ["i"], "b", "c", "goal", "f").collect()}
    want = {(g, i): x for g, x3 in enumerate(groups) for i, x in enumerate(raised_one_by_one(*x3))}
    assert got == want


def test_split(spark):
    df = spark.range(1003)
    got = Counter(r.part for r in B.split_eval(df, F.col("id"), 3).collect())
    assert got == {"eval": 101, "train": 902}
    assert B.split_eval(df.limit(0), F.col("id"), 3).count() == 0


def test_salted_rank_and_lookup(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    ranks = salted_rank(df, ["k"], "id", "r", 7).where("k = 'hot'").agg(F.count_distinct("r"), F.min("r"), F.max("r")).first()
    assert tuple(ranks) == (200, 0, 199)
    side = df.select("k").distinct().withColumn("v", F.upper("k"))
    assert lookup_join(df, side, "k", "id").count() == lookup_join(df, side, "k", "id", bound=3).count() == 300


def normalized(spark, text, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return N.normalize_rows(df, "t", **kw).first().normalized_input if kw else df.select(N.normalize(F.col("t")).alias("t")).first().t


def alias_dict(spark, names, entities, manual=None):
    rows = [(v, True, i) for i, v in enumerate(names)] + [(v, False, len(names) + i) for i, v in enumerate(entities)]
    df = spark.createDataFrame(rows, "value string, is_name boolean, place int")
    more = None if manual is None else spark.createDataFrame(list(manual.items()), "alias string, canonical string")
    return N.alias_table(N.entity_aliases(df, more))


def test_aliases(spark):
    got = alias_dict(spark, ["Robin Hood"], ["side tables", "Side_Table", "cups", "robin hood", "cup"], {"sidetable": "desk"})
    assert got["robin hood"] == "robin hood" and got["robinhood"] == "robin hood", "the last entity of a key counts"
    assert got["side tables"] == got["sidetables"] == "side tables" and got["side table"] == "side table", "a key goes before a singular"
    assert got["sidetable"] == "desk" and got["cup"] == "cup" and "cup s" not in got


def test_normalize(spark):
    aliases = alias_dict(spark, ["Robin"], ["kitchen", "living_room", "apple juice", "waving person"], {"kichen": "kitchen"})
    assert normalized(spark, "uh could you go to the the kichen and grab the apple joos", aliases=aliases) == "go to the kitchen and take the apple juice"
    assert normalized(spark, "please head to the living_room, then look around for robin!", aliases=aliases) == "go to the living room then find Robin"
    assert normalized(spark, "follow the person the waving person in the kitchn", aliases=aliases) == "follow the waving person in the kitchen"
    assert normalized(spark, None) is None and normalized(spark, "éart um art") == "éart art"


def test_steps(spark):
    r = spark.createDataFrame([("Please go go to  the hall",)], "t string").select(N.normalize_steps(F.col("t")).alias("s")).first().s
    assert r.normalized == "go to the hall" and r.changes == ["cleanup", "fillers", "repetitions"]


def test_exact_against_a_chain():
    """The table look-up replaces what a chain of patterns, the longest alias first, would replace."""
    rng = random.Random(8)
    words = ["red", "cup", "side", "table", "tables", "anna", "hall", "x"]
    for _ in range(60):
        phrases = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(12)}
        aliases = {p: rng.choice([p, p.upper(), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))]) for p in sorted(phrases)}
        scan = N.EntityScan(aliases)
        for _ in range(20):
            text = " ".join(rng.choice([*words, "red, cup", "“hall”"]) for _ in range(rng.randrange(9)))
            want = text
            for a in sorted(aliases, key=lambda a: -len(a)):
                if aliases[a] != a:
                    want = re.sub(r"(?<!\w)" + r"\s+".join(a.split()) + r"(?!\w)", lambda _, a=a: aliases[a], want, flags=re.IGNORECASE)
            assert scan.exact(text) == " ".join(want.split())


def test_fuzzy_against_difflib(spark):
    rng = random.Random(5)
    words = ["kitchen", "living room", "refrigerator", "trash bin", "bedroom", "waving person", "office", "side tables"]
    aliases = alias_dict(spark, [], words)
    scan = N.EntityScan(aliases)

    def brute(span, n):
        best, score = None, 0.0
        if len(span) < N.MIN_SPAN:
            return None
        for a in aliases:
            if len(a.split()) == n and (s := SequenceMatcher(None, span, a).ratio()) > score:
                best, score = a, s
        return aliases[best] if best and score >= N.FUZZY_THRESHOLD - (N.MULTIWORD_RELIEF if n > 1 else 0) else None

    for _ in range(400):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh rst")
        span = " ".join("".join(w).split())
        assert scan.best(span, len(span.split())) == brute(span, len(span.split()))
    assert scan.fuzzy("go to the kichen and the livng room") == "go to the kitchen and the living room"


def test_json(spark):
    texts = ['x {"goals": ["go(hall)"]} y {', "{ {} ", "no", None, '{"goals": 3}', '{"goals": ["a"]}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(Y.json_block(F.col("t")).alias("b"), Y.extract_goals(F.col("t")).alias("g")).collect()
    assert [r.b for r in rows] == ['{"goals": ["go(hall)"]}', None, None, None, '{"goals": 3}', '{"goals": ["a"]}']
    assert [r.g for r in rows] == [["go(hall)"], None, None, None, None, ["a"]]


def test_prediction_payload(spark):
    texts = ['{"prediction": {"goals": ["a"]}}', '{"goals": ["a"]}', "text", None, "[1]", '{"prediction": null}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in df.select(Y.prediction_payload(F.col("t")).alias("p")).collect()] == ['{"goals":["a"]}', '{"goals": ["a"]}', "{}", "{}", "{}", '{"prediction": null}']


def test_training_arrays(spark):
    r = spark.range(1).select(
        Y.training_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), 3).alias("t"),
        Y.padded_width(F.lit(9)).alias("w"),
        Y.pad(F.array(F.lit(1)), F.lit(3), 0).alias("p"),
        Y.list_lines(F.lit("intro\n- one\n* two\n3. three\n")).alias("l"),
    ).first()
    assert (r.t.input_ids, r.t.attention_mask, r.t.labels) == ([1, 2, 3], [1, 1, 1], [-100, -100, 3])
    assert r.w == 16 and r.p == [1, 0, 0] and r.l == ["one", "two", "three"]


def test_translate(spark):
    df = spark.createDataFrame([(1, "go to the hall"), (2, "mumble")], "id long, t string")

    def model(parts):
        for pdf in parts:
            out = ['{"goals": ["go(hall)"]}<|im_end|>x' if "hall" in t else "sorry" for t in pdf["normalized_input"]]
            yield pdf[["id", "normalized_input"]].assign(output=out, elapsed_ms=1.0)

    got = {r.id: (r.goals, r.error) for r in translate(df, "id", "t", "sys", model).collect()}
    assert got == {1: (["go(hall)"], None), 2: (None, "no valid plan in output")}


def test_planner(spark):
    df = spark.createDataFrame([(1, ["go(hall)"]), (2, ["go("])], "id long, goals array<string>")

    def planner(parts):
        for pdf in parts:
            yield pdf[["id"]].assign(plannable=True, message_count=0, reason="")

    assert [r.id for r in P.apply_planner(df, "id", planner).collect()] == [1]


@pytest.fixture(scope="module")
def grammar(spark):
    make = spark.createDataFrame
    surfaces = make(
        [("fetch", "objects", v, t) for v, t in enumerate(["bring me {art} {obj} from the {loc}", "{takeVerb} {art} {obj} at the {loc} and bring it", "at the {loc}, get {art} {obj} for me"])]
        + [("visit", "people", v, t) for v, t in enumerate(["go to the {loc} then {FOLLOWUP:at}", "visit the {loc} and {FOLLOWUP:at}", "reach the {loc}, {FOLLOWUP:at}"])]
        + [("move", "objects", v, t) for v, t in enumerate(["take {art} {obj} from the {loc} to the {loc2}", "move {art} {obj} from {loc} to {loc2}", "carry {art} {obj}, {loc} to {loc2}"])],
        "family string, category string, version int, template string",
    )
    followups = make(
        [("at", "meet", "meet {name} and {FOLLOWUP:met}", ["find({name}, kind=person)"]), ("met", "talk", "say hello", ["talk('hello')"]), ("met", "follow", "follow them", ["follow({name})"])],
        "key string, route string, template string, goals array<string>",
    )
    plans = make(
        [("fetch", ["go({loc})", "find({obj}, kind=object)", "take({obj})", "deliver({obj}, to=me)"]), ("visit", ["go({loc})"]), ("move", ["go({loc})", "find({obj}, kind=object)", "take({obj})", "place({obj}, at={loc2})"])],
        "family string, goals array<string>",
    )
    words = {"obj": ["apple", "cup", "egg"], "loc": ["desk", "shelf", "sofa"], "loc2": [], "name": ["Ann", "Bo", "Cy"], "takeVerb": ["take"]}
    vocabulary = make([(k, i, v) for k, vs in words.items() for i, v in enumerate(vs)], "slot string, pos int, value string")
    distinct = make([("move", ["loc", "loc2"])], "family string, slots array<string>")
    return surfaces, followups, plans, vocabulary, distinct


def test_grammar_bound(spark, monkeypatch):
    monkeypatch.setattr(GR, "MAX_GRAMMAR_ROWS", 2)
    words = spark.createDataFrame([("room", i, f"room {i}") for i in range(3)] + [(s, 0, s) for s in ("cup", "name")], "slot string, pos int, value string")
    texts = spark.createDataFrame([("f", i, f"go to the {{room}} {i}") for i in range(3)], "family string, version int, template string")
    follow = spark.createDataFrame([], "key string, route string, template string")
    start = texts.selectExpr("template", "array('go({room})') as goals", "cast(map() as map<string,string>) as context")
    for run in (lambda: GR.grammar_slots(texts, follow), lambda: GR.fill_all(start, words, ["room"]), lambda: GR.followup_steps(texts, follow)):
        with pytest.raises(ValueError, match="more than 2"):
            run()


def test_enumerate(spark, grammar):
    surfaces, followups, plans, vocabulary, distinct = grammar
    assert GR.template_issues(surfaces).count() == 0
    bad = surfaces.where("family != 'move' or version < 2").withColumn("template", F.when((F.col("family") == "visit") & (F.col("version") == 1), "go {name}").otherwise(F.col("template")))
    assert {(r.family, r.problem) for r in GR.template_issues(bad).collect()} == {("move", "surface count"), ("visit", "semantic places differ")}
    first = GR.enumerate_variants(surfaces.where("family != 'move'"), followups, plans, vocabulary).collect()
    assert len(first) == 3 + 3 * 2
    texts = {r.input for r in first}
    assert "bring me an apple from the desk" in texts and "go to the desk then meet Ann and follow them" in texts
    every = GR.enumerate_variants(surfaces, followups, plans, vocabulary, distinct, every_value=True)
    n = Counter(r.family for r in every.collect())
    assert n["fetch"] == 3 * 9 and n["visit"] == 3 * 3 * 3 * 2 and n["move"] == 3 * 3 * 6


def test_generate(spark, grammar):
    out = GR.generate(*grammar, n_samples=60, person_ratio=0.5, seed=42)
    rows = P.with_issues(out).collect()
    assert len(rows) == 60 and all(r.valid for r in rows)
    assert not any("{" in t for r in rows for t in [r.input, *r.goals])
    assert all(f"find({r.input.split('meet ')[1].split()[0]}, kind=person)" in r.goals for r in rows if "meet " in r.input), "a follow-up and its plan share their values"
    assert len({r.input.casefold() for r in rows}) == 60
    assert Counter(r.category for r in rows) == {"people": 30, "objects": 30}
    spread = Counter(r.signature for r in rows if r.category == "people")
    assert max(spread.values()) - min(spread.values()) <= 1
    assert {r.input for r in GR.generate(*grammar, n_samples=60, person_ratio=0.5, seed=42).collect()} == {r.input for r in rows}


def test_followups(spark):
    """Slots of a follow-up are apart from those around it, 'it' is handed on, categories part the options, a place without options goes."""
    make = spark.createDataFrame
    surfaces = make([("a", "objects", 1, "take the {obj} in the {room} and {FOLLOWUP:has}"), ("b", "people", 1, "go to the {room}{FOLLOWUP:has}")], "family string, category string, version int, template string")
    plans = make([("a", ["take({obj})"], "{obj}"), ("b", ["go({room})"], None)], "family string, goals array<string>, obj string")
    rows = [("has", "objects", "give", "give it to {name} in the {room}", ["go({room})", "deliver({it}, {name})"]), ("has", "objects", "drop", "drop it", ["drop({it}, in=trash)"])]
    followups = make(rows, "key string, category string, route string, template string, goals array<string>")
    got = {(r.family, *r.route): (r.template, r.goals, r.weight) for r in GR.forms(surfaces, followups, plans).collect()}
    assert got["a", "give"] == ("take the {obj} in the {room} and give it to {name@1} in the {room@1}", ["take({obj})", "go({room@1})", "deliver({obj}, {name@1})"], 0.5)
    assert got["a", "drop"][1] == ["take({obj})", "drop({obj}, in=trash)"] and got["b",] == ("go to the {room}", ["go({room})"], 1.0)
    again = followups.unionByName(make([("has", "objects", "loop", "then {FOLLOWUP:has}", [])], followups.schema))
    with pytest.raises(ValueError, match="leads back"):
        GR.forms(surfaces, again, plans)


def test_variant_dump(spark, grammar):
    surfaces, followups, plans, vocabulary, _ = grammar
    rows = GR.variant_dump(surfaces, followups.withColumn("category", F.lit("people")), plans, vocabulary).collect()
    n = Counter((r.family, r.category) for r in rows)
    assert n["visit", "people"] == n["visit", "mixed"] == 6 and n["visit", "objects"] == 3 and n["fetch", "mixed"] == 3
    assert all(r.goal_signature for r in rows) and not any("{" in r.input for r in rows)


def test_attempts(spark):
    rows = [(1, "go", ["a"], None), (2, "GO", ["a"], None), (3, "go ", ["b"], None), (4, "go", ["a"], "generation_error"), (5, "x", None, None), (6, "x", None, None), (7, "y", ["c"], "signature_mismatch")]
    df = spark.createDataFrame(rows, "id long, input string, goals array<string>, why string")
    got = {r.status: r.n for r in B.attempt_status_counts(df, "id", F.col("why")).collect()}
    assert got == {"added": 2, "duplicate": 2, "label_conflict": 1, "generation_error": 1, "signature_mismatch": 1}


def test_late_slots(spark):
    """A second slot takes the first value that is not part of the text, or the first of all."""
    make = spark.createDataFrame
    rows = make([("x", "from the {loc} to the {loc2}", ["go({loc})", "go({loc2})"]), ("y", "{loc2} desk sofa desk", [])], "k string, template string, goals array<string>").withColumn("context", F.create_map().cast("map<string,string>"))
    words = make([("loc", 1, "desk"), ("loc", 2, "sofa")], "slot string, pos int, value string")
    got = {r.k: (r.template, r.goals) for r in GR.fill(rows, words, "k").collect()}
    assert got == {"x": ("from the desk to the sofa", ["go(desk)", "go(sofa)"]), "y": ("desk desk sofa desk", [])}


def test_singular(spark):
    df = spark.createDataFrame([("waving persons",), ("red coats",), ("personship",)], "t string")
    assert [r.t for r in df.select(GR.singular(F.col("t"), {"persons": "person", "coats": "coat"}).alias("t")).collect()] == ["waving person", "red coat", "personship"]


def test_weighted_pick(spark):
    choices = spark.createDataFrame([("k", "a", 8.0), ("k", "b", 2.0)], "key string, choice string, weight double")
    draws = spark.range(4000).withColumn("key", F.lit("k"))
    got = Counter(r.choice for r in GR.weighted_pick(draws, choices, 1, F.col("id")).collect())
    assert abs(got["a"] / 4000 - 0.8) < 0.03 and sum(got.values()) == 4000


def test_checkpoint_folder(spark, tmp_path):
    """Off local mode a session without ``spark.checkpoint.dir`` is refused; a stored table keeps rows and types."""
    from types import SimpleNamespace

    from planloom import session

    unset = SimpleNamespace(isDefined=lambda: False)
    context = lambda master: SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context(master)))
    df = spark.createDataFrame([(1, ["a", None], {"k": "v"}), (2, None, None)], "id long, t array<string>, m map<string,string>")
    assert sorted(map(repr, session.stored(df).collect())) == sorted(map(repr, df.collect()))
