"""Expansion of a command grammar given as tables, and random commands from it.

* ``surfaces``: ``family, category, version, template`` - texts with ``{slot}`` and ``{FOLLOWUP:key}`` places
* ``followups``: ``key, route, template, goals`` and optionally ``category, obj, person``
* ``plans``: ``family, goals`` and optionally ``obj, person``: what a follow-up calls it and them
* ``vocabulary``: ``slot, pos, value`` and optionally ``goal``
* ``distinct``: ``family, slots`` - slots that must hold different values

Follow-up places are expanded by joins, one per replacement of the longest chain; slots are
filled by one join of all slots of all texts to the vocabulary.  The grammar tables are
small and checked to be; what grows is the expansion or the draws, which stay distributed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.functions.columns import casefold
from planloom.operators.balance import hash_rank
from planloom.session import cut, stored

PLACE = r"\{([^{}]+)\}"
FOLLOWUP = r"\{FOLLOWUP:([^{}]+)\}"
MAX_GRAMMAR_ROWS = 20_000  # rows of a grammar table that may be broadcast


def _small(df: DataFrame) -> DataFrame:
    if df.limit(MAX_GRAMMAR_ROWS + 1).count() > MAX_GRAMMAR_ROWS:
        return df  # joined by shuffle beyond the bound
    return F.broadcast(df)


def _bounded(rows: list) -> list:
    """``rows`` of a grammar that were read with one more than may be."""
    if len(rows) > MAX_GRAMMAR_ROWS:
        raise ValueError(f"more than {MAX_GRAMMAR_ROWS} rows of a grammar table")
    return rows


def places(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(PLACE), F.lit(1))


def semantic_places(template: Column) -> Column:
    """Sorted content places: without articles, connectors, verbs and prepositions."""
    content = F.filter(places(template), lambda p: ~p.isin("art", "connector") & ~F.endswith(p, F.lit("Verb")) & ~F.endswith(p, F.lit("Prep")))
    return F.array_sort(F.array_distinct(content))


def template_issues(surfaces: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """``family, version, problem``: families with too few or many surfaces, surfaces whose content differs from the first."""
    first = F.first_value(semantic_places(F.col("template"))).over(Window.partitionBy("family").orderBy("version"))
    n = F.count("*").over(Window.partitionBy("family"))
    checked = surfaces.withColumns({"n": n, "here": semantic_places(F.col("template")), "want": first})
    problem = F.when((F.col("n") < least) | (F.col("n") > most), "surface count").when(F.col("here") != F.col("want"), "semantic places differ")
    return checked.select("family", "version", problem.alias("problem")).where("problem is not null")


def _with(df: DataFrame, **defaults: Column) -> DataFrame:
    """``df`` with the columns it lacks."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def followup_steps(surfaces: DataFrame, followups: DataFrame) -> int:
    """How many replacements the longest chain of follow-up places takes; follow-ups that lead back to themselves raise."""
    texts = [r["template"] for r in _bounded(surfaces.select("template").limit(MAX_GRAMMAR_ROWS + 1).collect())]
    options: dict[str, list[str]] = {}
    for r in _bounded(followups.select("key", "template").limit(MAX_GRAMMAR_ROWS + 1).collect()):
        options.setdefault(r["key"], []).append(r["template"])
    known: dict[str, int] = {}

    def steps(text: str, open_keys: tuple[str, ...]) -> int:
        total = 0
        for key in re.findall(FOLLOWUP, text):
            if key in open_keys:
                raise ValueError(f"follow-up {key} leads back to itself")
            if key not in known:
                known[key] = 1 + max((steps(t, (*open_keys, key)) for t in options.get(key, [])), default=0)
            total += known[key]
        return total

    return max((steps(t, ()) for t in texts), default=0)


def expand_followups(templates: DataFrame, followups: DataFrame, own_slots: bool = False) -> DataFrame:
    """Every route through the follow-up places until none is left.

    ``templates`` has ``template, goals, route`` and may have ``category``, ``obj`` and
    ``person``: what ``{it}`` and ``{them}`` stand for in the goals of a follow-up.  A
    follow-up with a ``category`` fits rows of that category alone; one with an ``obj`` or
    ``person`` of its own hands that on.  A place nothing fits is removed.  ``route``
    collects the names, ``weight`` the chance of the route if each choice is even.  With
    ``own_slots`` the slots of a follow-up are apart from those around it: ``{room@1}``.
    """
    text = F.lit(None).cast("string")
    listed = _with(followups, category=text, obj=text, person=text, goals=F.array().cast("array<string>"))
    option = F.struct("route", "template", "goals", "obj", "person", "category")
    side = _small(listed.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(option)).alias("__all")))  # the options of a key of the grammar
    now = _with(templates, category=text, obj=text, person=text, weight=F.lit(1.0))
    here = lambda c, level: F.regexp_replace(c, r"\{(?!art\}|it\}|them\})(\w+)\}", f"{{$1@{level}}}") if own_slots else c
    for level in range(1, followup_steps(templates, followups) + 1):
        key = F.regexp_extract("template", FOLLOWUP, 1)
        met = now.withColumn("__key", F.nullif(key, F.lit(""))).join(side, "__key", "left")
        fits = F.filter("__all", lambda o: o["category"].isNull() | F.col("category").isNull() | (o["category"] == F.col("category")))
        met = met.withColumn("__fit", fits).withColumn("o", F.explode_outer("__fit"))
        at = F.instr("template", "{FOLLOWUP:")
        end = at + F.length("__key") + F.lit(len("{FOLLOWUP:}"))
        put = F.concat(F.substring(F.col("template"), F.lit(1), at - 1), F.coalesce(here(F.col("o.template"), level), F.lit("")), F.substring(F.col("template"), end, F.length("template")))
        called = lambda c: F.replace(F.replace(here(c, level), F.lit("{it}"), F.coalesce("obj", F.lit("it"))), F.lit("{them}"), F.coalesce("person", F.lit("person")))  # noqa: E731, B023
        hit, open_ = F.col("o").isNotNull(), F.col("__key").isNotNull()
        now = met.withColumns(
            {
                "template": F.when(open_, put).otherwise(F.col("template")),
                "goals": F.when(hit, F.concat("goals", F.transform("o.goals", called))).otherwise(F.col("goals")),
                "route": F.when(hit, F.concat("route", F.array("o.route"))).otherwise(F.col("route")),
                "weight": F.when(hit, F.col("weight") / F.size("__fit")).otherwise(F.col("weight")),
                "obj": F.coalesce(here(F.col("o.obj"), level), "obj"),
                "person": F.coalesce(here(F.col("o.person"), level), "person"),
            }
        ).drop("__key", "__all", "__fit", "o")
    return now


def singular(text: Column, pairs: dict[str, str]) -> Column:
    """The text with the plural it ends in, or that stands in it as a word, in the singular."""
    out = text
    for plural, one in sorted(pairs.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"\b{re.escape(plural)}\b", one)
    return out


def fix_article(text: Column) -> Column:
    """Replace all ``{art}`` by the article of the word behind the first one."""
    after = F.regexp_extract(text, r"\{art\}\s*(\w)", 1)
    article = F.when(F.lower(after).isin("a", "e", "i", "o", "u"), "an").otherwise("a")
    return F.replace(text, F.lit("{art}"), article)


SLOT = r"\{(\w+(?:@\d+)?)\}"


def fill(rows: DataFrame, vocabulary: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """Fill the slots of ``template`` and ``goals``: the first value each, or one drawn by hash with a ``seed``.

    ``vocabulary`` has ``slot, pos, value`` and may have ``goal``, how the value reads in a
    goal.  A union slot ``a_b`` takes its first source, or one drawn.  A slot ``x2`` is
    filled last, with a value of ``x`` that is not part of the text; if all are, with
    any.  ``context`` collects the values; ``key`` is unique.
    """
    words = _with(vocabulary, goal=F.col("value")).where("value is not null")
    order = Window.partitionBy("slot").orderBy("pos", "value")
    numbered = words.select(F.col("slot").alias("source"), (F.row_number().over(order) - 1).alias("at"), F.struct("value", "goal", F.col("slot").alias("source")).alias("word"))
    sizes = _small(words.groupBy(F.col("slot").alias("source")).agg(F.count("*").alias("n")))
    chance = lambda *what: F.xxhash64(F.lit(seed), F.col(key), *what)
    for deferred in (False, True):
        text = F.concat_ws(" ", "template", F.array_join("goals", " "))
        base = F.regexp_replace("slot", r"@\d+$", "")
        each = rows.select(key, "template", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(SLOT), F.lit(1)))).alias("slot"))
        each = each.where((F.col("slot") != "art") & (F.endswith(base, F.lit("2")) == F.lit(deferred)))
        sources = F.split(base, "_")
        pick = F.lit(0) if seed is None else F.pmod(chance("slot", F.lit("source")), F.size(sources)).cast("int")
        each = each.withColumn("source", F.regexp_replace(F.get(sources, pick), r"2$", ""))
        if deferred:
            rank = F.col("at") if seed is None else chance("slot", F.col("word.value"))
            best = F.min_by("word", F.struct(F.contains(F.col("template"), F.col("word.value")), rank, "word"))
            found = each.join(_small(numbered), "source").groupBy(key, "slot").agg(best.alias("word"))
        else:
            drawn = F.lit(0) if seed is None else F.pmod(chance("slot", F.lit("value")), F.col("n")).cast("int")
            found = each.join(sizes, "source").withColumn("at", drawn).join(_small(numbered), ["source", "at"]).select(key, "slot", "word")
        # the slots of one text
        maps = found.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "word")))).alias("__m"))
        joined = rows.join(maps, key, "left").withColumn("__e", F.map_entries(F.coalesce("__m", F.create_map().cast(maps.schema["__m"].dataType))))
        put = lambda c, name: F.aggregate("__e", c, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"][name]))
        values = F.map_from_entries(F.transform("__e", lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value"))))
        unions = F.filter("__e", lambda e: F.contains(e["key"], F.lit("_")))
        of = F.map_from_entries(F.transform(unions, lambda e: F.struct(F.concat(e["key"], F.lit(":source")).alias("key"), e["value"]["source"].alias("value"))))
        rows = joined.withColumns({"context": F.map_concat("context", values, of), "goals": F.transform("goals", lambda g: put(g, "goal")), "template": put(F.col("template"), "value")}).drop("__m", "__e")
    return rows


def fill_all(templates: DataFrame, vocabulary: DataFrame, slots: list[str]) -> DataFrame:
    """Fill each slot with each of its values: one row per combination.

    A slot ``x2`` takes the values of ``x`` that are not yet part of the text; a union slot
    ``a_b`` takes those of ``a`` and of ``b`` and records which.  Rows without the slot pass by.
    """
    out = templates
    listed = vocabulary.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))  # the values of a slot of the grammar
    listed = _small(listed.select("slot", F.transform("v", lambda x: x["value"]).alias("v")))
    for s in slots:
        place = "{" + s + "}"
        base = re.sub(r"2(?=_|$)", "", s)
        sources = [base] if "_" not in base else [base, *base.split("_")]
        has = F.contains(F.col("template"), F.lit(place)) | F.exists("goals", lambda g: F.contains(g, F.lit(place)))  # noqa: B023
        mine = listed.where(F.col("slot").isin(*sources)).groupBy().agg(F.flatten(F.collect_list(F.transform("v", lambda x: F.struct(F.col("slot").alias("s"), x.alias("v"))))).alias("__options"))
        options = mine.first()["__options"]  # read once: a grammar's values of one slot
        choice = F.array(*[F.struct(F.lit(o["s"]).alias("s"), F.lit(o["v"]).alias("v")) for o in _bounded(options)]) if options else F.array().cast("array<struct<s:string,v:string>>")
        if base != s:
            choice = F.filter(choice, lambda o: ~F.contains(F.col("template"), o["v"]))
        none = F.array(F.lit(None).cast("struct<s:string,v:string>"))
        rows = out.withColumn("__o", F.explode(F.when(has, choice).otherwise(none)))
        fill = lambda c: F.when(F.col("__o").isNull(), c).otherwise(F.replace(c, F.lit(place), F.col("__o.v")))  # noqa: E731, B023
        pairs = [F.lit(s), F.col("__o.v")] + ([F.lit(f"{s}:source"), F.col("__o.s")] if "_" in base else [])
        context = F.when(F.col("__o").isNull(), F.col("context")).otherwise(F.map_concat("context", F.create_map(*pairs)))
        out = rows.withColumns({"template": fill(F.col("template")), "goals": F.transform("goals", fill), "context": context}).drop("__o")
    return out


def distinct_slots(filled: DataFrame, distinct: DataFrame) -> DataFrame:
    """Drop rows in which slots that must differ hold the same text; groups with a missing slot are no matter."""
    rules = distinct.groupBy("family").agg(F.collect_list("slots").alias("__groups"))  # a few groups per family
    ok = lambda g: F.exists(g, lambda s: ~F.array_contains(F.map_keys("context"), s)) | (
        F.size(F.array_distinct(F.transform(g, lambda s: casefold(F.try_element_at(F.col("context"), s))))) == F.size(g)
    )
    return filled.join(_small(rules), "family", "left").where(F.col("__groups").isNull() | F.forall("__groups", ok)).drop("__groups")


def _start(surfaces: DataFrame, plans: DataFrame) -> DataFrame:
    rows = surfaces.join(_small(plans.drop("category")), "family")
    return rows.withColumns(
        {
            "route": F.array().cast("array<string>"),
            "context": F.create_map().cast("map<string,string>"),
            "surface_template_id": F.concat("family", F.lit(":v"), F.col("version").cast("string")),
        }
    )


def grammar_slots(surfaces: DataFrame, followups: DataFrame) -> list[str]:
    """All slots of a grammar in the order they first appear."""
    texts = [r["template"] for r in _bounded(surfaces.orderBy("family", "version").select("template").limit(MAX_GRAMMAR_ROWS + 1).collect())]
    texts += [r["template"] for r in _bounded(followups.orderBy("key", "route").select("template").limit(MAX_GRAMMAR_ROWS + 1).collect())]
    found = dict.fromkeys(s for t in texts for s in re.findall(PLACE, t) if not s.startswith("FOLLOWUP:") and s != "art")
    return list(found)


def forms(surfaces: DataFrame, followups: DataFrame, plans: DataFrame, own_slots: bool = True) -> DataFrame:
    """Every surface in every route with open slots: ``form`` (a unique name), the plan and the chance of the route inside the family."""
    even = 1.0 / F.count("*").over(Window.partitionBy("category", "family"))
    start = _start(surfaces, plans).withColumn("weight", even)
    grown = expand_followups(start, followups, own_slots)
    return grown.withColumn("form", F.concat_ws("|", "category", "surface_template_id", F.array_join("route", ">")))


def enumerate_variants(surfaces: DataFrame, followups: DataFrame, plans: DataFrame, vocabulary: DataFrame, distinct: DataFrame | None = None, every_value: bool = False) -> DataFrame:
    """``family, category, surface_template_id, route, input, goals, context``: each surface in each route.

    Slots take their first value, or each of their values with ``every_value``.
    """
    grown = forms(surfaces, followups, plans, own_slots=False)
    filled = fill_all(grown, vocabulary, grammar_slots(surfaces, followups)) if every_value else fill(cut(grown), cut(vocabulary), "form")
    if distinct is not None:
        filled = distinct_slots(filled, distinct)
    return filled.select("family", "category", "surface_template_id", "route", fix_article(F.col("template")).alias("input"), "goals", "context")


def variant_dump(surfaces: DataFrame, followups: DataFrame, plans: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The variants of every family as commands to people, to objects and mixed, with the features of their plans; invalid plans are left out."""
    from planloom.operators.plans import enrich

    every = surfaces.drop("category").distinct().withColumn("category", F.explode(F.array(F.lit("people"), F.lit("objects"), F.lit(None))))
    rows = enumerate_variants(every, followups, plans, vocabulary)
    return enrich(rows.withColumn("category", F.coalesce("category", F.lit("mixed"))).drop("context"))


def weighted_pick(draws: DataFrame, choices: DataFrame, seed: int | str, key: Column, by: str = "key") -> DataFrame:
    """One choice per draw with probability by weight: the hash of the draw falls into the cumulative weights.

    ``choices`` has ``by, choice, weight`` and is small; its ranges per key travel in one array.
    """
    order = Window.partitionBy(by).orderBy("choice")
    ends = choices.withColumn("end", F.sum("weight").over(order) / F.sum("weight").over(Window.partitionBy(by)))
    ranges = _small(ends.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("end", "choice"))).alias("__ranges")))
    u = F.conv(F.substring(hash_rank(seed, key), 1, 8), 16, 10).cast("double") / F.lit(2**32)
    found = F.get(F.filter("__ranges", lambda r: r["end"] > u), F.lit(0))["choice"]
    return draws.join(ranges, by).withColumn("choice", found).drop("__ranges")


def _realised(drawn: DataFrame, grown: DataFrame, vocabulary: DataFrame, distinct: DataFrame, seed: int) -> DataFrame:
    """Draws with a ``form`` turned into commands; those that break a rule, or whose plan is not valid, are left out."""
    from planloom.operators.plans import enrich

    filled = distinct_slots(fill(drawn.join(_small(grown), "form"), vocabulary, "draw", seed), distinct)
    texts = filled.withColumn("input", fix_article(F.col("template"))).where(~F.concat("input", F.array_join("goals", "")).rlike(PLACE))
    return enrich(texts).withColumn("signature", F.array_join("goal_signature", " -> ")).drop("template", "weight", "obj", "person", "form", "context")


def draw_commands(surfaces: DataFrame, followups: DataFrame, plans: DataFrame, vocabulary: DataFrame, distinct: DataFrame, draws: DataFrame, families: DataFrame, seed: int) -> DataFrame:
    """A random command for every row of ``draws`` (``draw, category`` and optionally ``family``): family by weight, then surface, follow-ups and values.

    ``families`` has ``category, family, weight``.  Draws that break a rule are left out; the
    caller draws again with other ``draw`` numbers.
    """
    if "family" not in draws.columns:
        choices = families.select(F.col("category").alias("by"), F.col("family").alias("choice"), "weight")
        draws = weighted_pick(draws.withColumn("by", F.col("category")), choices, seed, F.col("draw"), "by").select("draw", "category", F.col("choice").alias("family"))
    grown = cut(forms(surfaces, followups, plans))
    of = F.concat_ws("|", "category", "family")
    choices = grown.select(of.alias("by"), F.col("form").alias("choice"), "weight")
    picked = weighted_pick(draws.withColumn("by", of), choices, seed + 1, F.col("draw"), "by").select("draw", F.col("choice").alias("form"))
    return _realised(picked, grown, cut(vocabulary), distinct, seed)


def _raised(quotas: DataFrame, capacity: DataFrame, strata: list[str], n_samples: int) -> DataFrame:
    """The quotas when strata below theirs are taken as exhausted and the others as endless."""
    from planloom.operators import balance as B

    now = quotas.join(capacity, strata, "left").fillna(0, ["capacity"])
    ends = F.when(F.col("capacity") < F.col("quota"), F.col("capacity")).otherwise(F.lit(n_samples).cast("long"))
    return cut(B.water_fill(now.withColumn("capacity", ends)).select(*strata, F.greatest("quota", "final_quota").alias("quota")))


MAX_ROUNDS = 12  # of drawing for strata that are not full yet


def generate(surfaces: DataFrame, followups: DataFrame, plans: DataFrame, vocabulary: DataFrame, distinct: DataFrame, n_samples: int, person_ratio: float, seed: int) -> DataFrame:
    """A balanced set of ``n_samples`` valid, different commands.

    The strata are the goal signatures of the forms, which need no values.  For each, as
    many numbered draws are made as its quota asks for and half as many again; draws that
    break a rule or repeat a text are rejected and drawn anew, until every quota is full
    or a round brings nothing new.  What a stratum cannot give is raised among the others.
    No combination of values is ever listed.
    """
    from planloom.operators import balance as B

    names = F.transform("goals", lambda g: F.regexp_extract(g, r"^\s*(\w+)", 1))
    grown = cut(forms(surfaces, followups, plans).withColumn("signature", F.array_join(names, " -> ")))
    strata = ["category", "family", "signature"]
    by = F.concat_ws("|", *strata)
    choices = grown.select(by.alias("by"), F.col("form").alias("choice"), "weight")
    quotas = cut(B.hierarchical_quota(grown.select(*strata).distinct(), n_samples, person_ratio))
    pool, before, first, vocabulary = None, -1, 0, cut(vocabulary)
    for _ in range(MAX_ROUNDS):
        # raised quotas included, a stratum needs no more than its share of what is missing
        goal = quotas if pool is None else _raised(quotas, capacity, strata, n_samples)  # noqa: F821
        have = quotas.select(*strata, F.lit(0).cast("long").alias("capacity")) if pool is None else capacity  # noqa: F821
        missing = goal.join(have, strata, "left").fillna(0, ["capacity"]).withColumn("more", F.ceil((F.col("quota") - F.col("capacity")) * 1.5 + 4)).where("quota > capacity")
        draws = missing.select(by.alias("by"), F.explode(F.sequence(F.lit(first), F.lit(first) + F.col("more"))).alias("k")).withColumn("draw", F.concat_ws("#", "by", "k"))
        picked = weighted_pick(draws, choices, seed, F.col("draw"), "by").select("draw", "k", F.col("choice").alias("form"))
        new = _realised(picked, grown.drop("signature"), vocabulary, distinct, seed)
        every = new if pool is None else pool.unionByName(new)
        # a text that two strata give goes to the first draw
        pool = stored(B.dedup_first(every.withColumn("__id", F.struct("k", F.md5("draw"))), "__id").drop("__id"))
        capacity = cut(pool.groupBy(*strata).agg(F.count("*").alias("capacity")))
        found, open_ = pool.count(), quotas.join(capacity, strata, "left").where("coalesce(capacity, 0) < quota").limit(1).count()
        if found == before or (not open_ and found >= n_samples):
            break
        before, first = found, first + 4 * n_samples
    final = B.water_fill(quotas.join(capacity, strata, "left").fillna(0, ["capacity"]))
    chosen = B.fill_strata(pool, final, strata, F.col("draw"), seed)
    return chosen.drop("draw", "k", "route")
