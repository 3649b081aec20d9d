"""Train/validation/test splits that keep related rows together (problem 5).

1. Rows that share a key (of any key column), directly or through other rows, form
   a component; components come from the distinct pairs of keys, not from the rows.
2. Components of the same size and label profile are bundled.  The profile is the most
   frequent label and its share in tenths.  Sizes are exact, but for components above
   1,000 rows that hold less than a ``1 / EXACT_SHARE`` of all rows: of these, sizes with
   the same first three digits are one bundle, counted with its mean size.  Beyond
   ``MAX_LABELS`` labels, those of fewest rows count as one.  So the bundles are bounded,
   and only they reach the driver.
3. Split quotas are solved as a min-cost flow from the bundles (merged by label and
   by the splits they fit into) through label quotas to split quotas; rows beyond a
   quota cost their deviation.
4. The flow is rounded to whole components, largest first.
5. The components of a bundle are numbered by hash and dealt by these numbers; rows
   without a key, a bundle of single rows per label, are dealt by their hash alone.

Defined cases: null or blank keys tie nothing; a row without any key is a component
of its own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.graph import components
from planloom.session import cut
from planloom.skew import lookup_join, salt_of, salted_rank

SPLITS = {"train": 80, "validation": 10, "test": 10}
SALT_GROUPS = 250_000  # components of one bundle that one task numbers
EXACT_SHARE = 10_000  # a component of more than this part of the rows is bundled by its exact size
MAX_LABELS = 1_000  # labels with quotas of their own
LOOSE = "row:"  # component of a row without a key
OVER_LABEL, OVER_SPLIT, MISFIT = 1, 4, 16  # cost of a row beyond a label quota, a split quota, in a split smaller than its component


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)`` of a maximum flow of least cost (successive shortest paths)."""
    to, room, cost, graph = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        graph[a].append(len(to))
        to.append(b)
        room.append(c)
        cost.append(w)
        graph[b].append(len(to))
        to.append(a)
        room.append(0)
        cost.append(-w)
    price = [0] * n
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in graph[v]:
                if room[e] and (x := d + cost[e] + price[v] - price[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if via[sink] < 0:
            return [room[2 * k + 1] for k in range(len(arcs))]
        price = [p + (d if d < float("inf") else 0) for p, d in zip(price, dist, strict=True)]
        push, v = float("inf"), sink
        while v != source:
            push = min(push, room[via[v]])
            v = to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def solve_quotas(bundles: list[dict], shares: dict[str, int]) -> list[dict]:
    """``bundles`` of ``{size, label, n, rows}`` -> the same with ``counts``: components per split."""
    names, whole = list(shares), sum(shares.values())
    total = sum(b["rows"] for b in bundles)
    labels = sorted({b["label"] for b in bundles})
    by_label = {x: sum(b["rows"] for b in bundles if b["label"] == x) for x in labels}
    quota = {s: -(-total * shares[s] // whole) for s in names}
    label_quota = {(s, x): -(-by_label[x] * shares[s] // whole) for s in names for x in labels}
    fits = lambda b: tuple(b["size"] <= quota[s] for s in names)
    classes = sorted({(b["label"], fits(b)) for b in bundles})
    supply = {c: sum(b["rows"] for b in bundles if (b["label"], fits(b)) == c) for c in classes}
    node = {x: k for k, x in enumerate(["source", "sink", *classes, *label_quota, *names])}
    arcs = [(node["source"], node[c], supply[c], 0) for c in classes]
    pick = {}
    for c in classes:
        for s, ok in zip(names, c[1], strict=True):
            pick[c, s] = len(arcs)
            arcs.append((node[c], node[s, c[0]], supply[c], 0 if ok else MISFIT))
    for s, x in label_quota:
        arcs.append((node[s, x], node[s], label_quota[s, x], 0))
        arcs.append((node[s, x], node[s], total, OVER_LABEL))
    for s in names:
        arcs.append((node[s], node["sink"], quota[s], 0))
        arcs.append((node[s], node["sink"], total, OVER_SPLIT))
    flow = min_cost_flow(len(node), arcs, node["source"], node["sink"])
    open_rows = {key: flow[k] for key, k in pick.items()}
    out = []
    for b in sorted(bundles, key=lambda b: (-b["size"], b["label"], b["profile"])):
        c = (b["label"], fits(b))
        want = {s: max(0, open_rows[c, s]) for s in names}
        # shares of the bundle follow what is still open; a tie goes to the first split
        all_open = sum(want.values())
        ideal = {s: b["n"] * want[s] / all_open if all_open else b["n"] * shares[s] / whole for s in names}
        counts = {s: int(ideal[s]) for s in names}
        size = b["rows"] / b["n"]
        for _ in range(b["n"] - sum(counts.values())):
            s = max(names, key=lambda s: (open_rows[c, s] - counts[s] * size, -names.index(s)))
            counts[s] += 1
        for s in names:
            open_rows[c, s] -= counts[s] * size
        out.append(b | {"counts": counts})
    return out


def key_nodes(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``df`` plus one ``__node_<name>`` per key column: the tagged key, null where the key ties nothing."""
    return df.withColumns({f"__node_{k}": F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}:"), c)) for k, c in keys.items()})


def _known_labels(tagged: DataFrame) -> DataFrame:
    """``tagged`` with ``__label`` cut down to the ``MAX_LABELS`` labels of most rows."""
    counts = tagged.groupBy("__label").agg(F.count("*").alias("n"))
    top = [r["__label"] for r in counts.orderBy(F.desc("n"), "__label").limit(MAX_LABELS + 1).collect()]
    if len(top) <= MAX_LABELS:
        return tagged
    kept = tagged.sparkSession.createDataFrame([(x,) for x in top[:MAX_LABELS]], "__label string").withColumn("__kept", F.lit(True))
    return tagged.join(F.broadcast(kept), "__label", "left").withColumn("__label", F.when(F.col("__kept"), F.col("__label")).otherwise("")).drop("__kept")


def plan_groups(df: DataFrame, id_col: str, keys: dict[str, Column], label: Column, shares: dict[str, int] = SPLITS) -> tuple[DataFrame, DataFrame, list[dict]]:
    """``(members, groups, loose)``: every key with its component, every component with its rows and split, and the solved bundles of rows without a key."""
    nodes = [f"__node_{k}" for k in keys]
    tagged = key_nodes(df.select(F.col(id_col).alias("__id"), *[c.alias(k) for k, c in keys.items()], F.coalesce(label, F.lit("")).alias("__label")), {k: F.col(k) for k in keys})
    # one aggregation with map-side combine; rows without a key are one combination per label
    combos = cut(_known_labels(tagged).groupBy(*nodes, "__label").agg(F.count("*").alias("n")))
    edges = combos.select(F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("v")).limit(0)
    for at, a in enumerate(nodes):
        # rows may lack a key in the middle; every pair of columns ties
        for other in nodes[at + 1 :]:
            edges = edges.unionByName(combos.where(f"{a} is not null and {other} is not null").select(F.col(a).alias("u"), F.col(other).alias("v")))
    tied = components(edges)
    every = combos.select(F.explode(F.array(*nodes)).alias("node")).where("node is not null").distinct()
    members = cut(every.join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    # a combination belongs to the component of its first key
    keyed = combos.select(F.coalesce(*nodes).alias("node"), "__label", "n").groupBy("node", "__label").agg(F.sum("n").alias("n"))
    sized = keyed.where("node is not null").join(members, "node").groupBy("component", "__label").agg(F.sum("n").alias("n"))
    stats = (
        sized.groupBy("component")
        .agg(F.sum("n").alias("n_rows"), F.max(F.struct("n", "__label")).alias("top"))
        .select("component", "n_rows", F.col("top.__label").alias("label"), F.floor(F.col("top.n") * 10 / F.col("n_rows")).cast("int").alias("profile"))
    )
    free = {r["__label"]: r["n"] for r in keyed.where("node is null").collect()}  # at most MAX_LABELS rows
    total = combos.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digits = F.pow(F.lit(10), F.greatest(F.lit(0), F.floor(F.log10("n_rows")) - 2)).cast("long")
    exact = (F.col("n_rows") <= 1000) | (F.col("n_rows") * EXACT_SHARE > total)
    stats = cut(stats.withColumn("size", F.when(exact, F.col("n_rows")).otherwise((F.col("n_rows") / digits).cast("long") * digits)))
    # at most 1,000 + EXACT_SHARE + some thousand sizes, MAX_LABELS labels and ten profiles
    bundles = [r.asDict() for r in stats.groupBy("size", "label", "profile").agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).collect()]
    bundles += [{"size": 1, "label": x, "profile": ALONE, "n": n, "rows": n} for x, n in sorted(free.items())]
    solved = solve_quotas(bundles, shares)
    names = list(shares)
    ends = lambda b: [sum(b["counts"][s] for s in names[: k + 1]) for k in range(len(names))]
    rows = [(b["size"], b["label"], b["profile"], *ends(b)) for b in solved if b["profile"] != ALONE]
    frame = pd.DataFrame(rows, columns=["size", "label", "profile", *[f"__end_{s}" for s in names]])
    dealt = df.sparkSession.createDataFrame(frame, "size long, label string, profile int, " + ", ".join(f"__end_{s} long" for s in names))
    split = F.coalesce(*[F.when(F.col("__rank") < F.col(f"__end_{s}"), s) for s in names])
    salts = max(1, -(-max((b["n"] for b in solved if b["profile"] != ALONE), default=0) // SALT_GROUPS))
    groups = (
        salted_rank(stats, ["size", "label", "profile"], "component", "__rank", salts)
        .join(F.broadcast(dealt), ["size", "label", "profile"])
        .select("component", "n_rows", "label", split.alias("split"))
    )
    return members, cut(groups), [b for b in solved if b["profile"] == ALONE]


ALONE = -1  # profile of the rows without a key


def assign_splits(df: DataFrame, id_col: str, keys: dict[str, Column], label: Column, shares: dict[str, int] = SPLITS) -> DataFrame:
    """``id_col, component, split`` for every row of ``df``."""
    members, groups, loose = plan_groups(df, id_col, keys, label, shares)
    slim = df.select(F.col(id_col).alias("__id"), *[c.alias(k) for k, c in keys.items()], F.coalesce(label, F.lit("")).alias("__label"))
    rows = key_nodes(slim, {k: F.col(k) for k in keys}).select("__id", "__label", F.coalesce(*[f"__node_{k}" for k in keys]).alias("node"))
    where = members.join(groups, "component").select("node", "component", "split")
    tied = lookup_join(rows.where("node is not null"), cut(where), "node", "__id").select("__id", "component", "split")
    # a row without a key goes by its hash: the shares of its label's bundle are ranges of it
    place = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    names = list(shares)
    if loose:
        ends = {b["label"]: [sum(b["counts"][s] for s in names[: k + 1]) / b["n"] for k in range(len(names))] for b in loose}
        side = df.sparkSession.createDataFrame([(x, e) for x, e in ends.items()], "__known string, __ends array<double>")
        other = ends.get("", [sum(shares[s] for s in names[: k + 1]) / sum(shares.values()) for k in range(len(names))])
        free = rows.where("node is null").join(F.broadcast(side), F.col("__label") == F.col("__known"), "left")
        free = free.withColumn("__ends", F.coalesce("__ends", F.array(*map(F.lit, other))))
        share = F.coalesce(*[F.when(place < F.get("__ends", F.lit(k)), s) for k, s in enumerate(names)], F.lit(names[-1]))
        own = F.concat(F.lit(LOOSE), F.xxhash64("__id").cast("string"), F.lit(":"), F.col("__id").cast("string"))
        tied = tied.unionByName(free.select("__id", own.alias("component"), share.alias("split")))
    return tied.select(F.col("__id").alias(id_col), "component", "split")


PAIR_SALTS = 16


def tied_pairs(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``a, b``: the different keys of one column that the plan holds in one split for being tied; the pairs of a large component by many tasks."""
    tag = f"{key}:"
    of = members.where(F.col("node").startswith(tag)).join(groups.select("component", "split"), "component")
    of = of.select("component", F.substring("node", len(tag) + 1, 1 << 30).alias("k"))
    left = of.select("component", F.col("k").alias("a"), salt_of("k", salts=PAIR_SALTS).alias("salt"))
    right = of.select("component", F.col("k").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))).alias("salt"))
    return left.join(right, ["component", "salt"]).where("a < b").select("a", "b")
