"""Fixed-capacity packing of whole texts (problem 7).

Hierarchical packing over *histograms* of sizes.  The corpus is only ever seen as "how
many items have size s", at most ``capacity`` numbers, so planning costs the same for a
thousand documents and for a trillion, and nothing that grows with the corpus reaches
the driver:

1. *Routing*: an item belongs to the tier of the shortest context window that holds it
   (``capacity``, /2, /4, /8; the shortest tier takes all that is shorter).
2. *Windows*: each tier is packed by itself, longest first.  A window of the tier starts
   with the largest of its items and its gap is filled with the largest items of shorter
   tiers that still fit, as many equal windows at a time as the histogram allows.
3. *Containers*: the filled windows are blocks; blocks of like load are one size of a second
   histogram, and containers are filled with the largest blocks that fit.
4. *Step groups*: containers are numbered by falling load and dealt back and forth, so
   that every group has the same number of containers (but for one) and a like load.

The plan is two short tables: "windows a..b take the items of size s ranked x..y" and
"containers a..b take the blocks of load l ranked x..y".  Items get their rank within
their size from salted windows, as many salts as the most frequent size needs, so a size
that a third of the corpus shares is ranked by many tasks; each item finds its window and
its container by two binary searches.

Defined cases: null/empty texts have no token and take no container (``n_parts`` 0);
an item above the capacity is cut into full containers and one remainder, nothing
else is ever cut; equal sizes are ranked by a hash of the id; repeated ids stay
separate rows; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.bpe import DEFAULT_RANKS, token_counts
from planloom.session import stored
from planloom.skew import salted_rank

CAPACITY = 2048
SALT_ROWS = 250_000  # rows of one size that one task ranks
GROUP_CONTAINERS = 64  # containers of one step group


def tiers_of(capacity: int, levels: int = 4) -> list[int]:
    """Window lengths of the context tiers, longest first."""
    return [capacity >> k for k in range(levels) if capacity >> k >= 1]


def fill_windows(left: dict[int, int], length: int, shortest: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(windows, [(size, items of it in each window)])``: windows of ``length``, started with the largest size left above ``shortest``.

    Gaps take the largest sizes that still fit.  ``left`` is reduced by what is placed.
    """
    sizes = sorted(s for s, n in left.items() if n > 0)
    out = []
    while True:
        at = bisect.bisect_right(sizes, length)
        if not at or sizes[at - 1] <= shortest:
            return out
        pattern: list[tuple[int, int]] = []
        room = length
        while at:
            size = sizes[at - 1]
            take = min(room // size, left[size])
            pattern.append((size, take))
            room -= take * size
            at = bisect.bisect_right(sizes, min(room, size - 1))
        times = min(left[s] // n for s, n in pattern)
        for s, n in pattern:
            left[s] -= n * times
            if not left[s]:
                del sizes[bisect.bisect_left(sizes, s)]
        out.append((times, pattern))


def plan_packing(histogram: dict[int, int], capacity: int, tiers: list[int] | None = None) -> tuple[list[dict], list[dict]]:
    """``(windows, containers)``: the two tables of runs that place every item.

    ``histogram`` maps a size (1..capacity) to its number of items.  A row of ``windows``
    says that the items of ``size`` from ``rank`` on, ``each`` to a block, stand in the blocks
    of ``load`` numbered from ``block`` on, which are windows of ``tier``.  A row of
    ``containers`` says that the blocks of ``load`` from ``rank`` on, ``each`` to a container,
    stand in the containers from ``container`` on; these are ``times`` in number.
    """
    left = {s: n for s, n in histogram.items() if n > 0 and 1 <= s <= capacity}
    lengths = sorted(tiers or tiers_of(capacity), reverse=True)
    ranks, blocks = Counter(), Counter()
    windows: list[dict] = []
    for length, shortest in zip(lengths, [*lengths[1:], 0], strict=True):
        for times, pattern in fill_windows(left, length, shortest):
            load = sum(s * n for s, n in pattern)
            for s, n in pattern:
                windows.append({"size": s, "rank": ranks[s], "each": n, "load": load, "block": blocks[load], "tier": length})
                ranks[s] += n * times
            blocks[load] += times
    filled = fill_windows(dict(blocks), capacity, 0)
    filled.sort(key=lambda f: -sum(s * n for s, n in f[1]))  # numbered by falling load
    placed, number = Counter(), 0
    containers: list[dict] = []
    for times, pattern in filled:
        load = sum(s * n for s, n in pattern)
        for s, n in pattern:
            containers.append({"load": s, "rank": placed[s], "each": n, "container": number, "times": times, "total": load})
            placed[s] += n * times
        number += times
    return windows, containers


def _table(rows: list[dict], key: str, at: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns of a run table sorted by ``key`` and rank, with one search key of both."""
    rows = sorted(rows, key=lambda r: (r[key], r[at]))
    out = {n: np.array([r[n] for r in rows], dtype=np.int64) for n in names}
    out["search"] = np.array([(r[key] << SEARCH_BITS) + r[at] for r in rows], dtype=np.int64)
    return out


SEARCH_BITS = 48  # bits of a rank in a search key; sizes take the others


def locate(size: np.ndarray, rank: np.ndarray, windows: dict[str, np.ndarray], containers: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tier and container of the items of ``size`` ranked ``rank``, by two binary searches."""
    w = np.searchsorted(windows["search"], (size << SEARCH_BITS) + rank, side="right") - 1
    block = windows["block"][w] + (rank - windows["rank"][w]) // windows["each"][w]
    c = np.searchsorted(containers["search"], (windows["load"][w] << SEARCH_BITS) + block, side="right") - 1
    return windows["tier"][w], containers["container"][c] + (block - containers["rank"][c]) // containers["each"][c]


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    ranks_path: str = DEFAULT_RANKS,
    salt_rows: int = SALT_ROWS,
    tiers: list[int] | None = None,
) -> DataFrame:
    """One row per part of a document: ``id_col, n_tokens, n_parts, part, part_tokens, tier, container, step_group``.

    A text that fits has one part; a larger one has its full containers (parts
    0..k-1) and a remainder.  Texts without tokens keep one row with null part.
    """
    sized = token_counts(df, id_col, text_col, ranks_path)
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    sized = stored(sized.withColumn("full", full).withColumn("rest", rest).withColumn("n_parts", full + (rest > 0).cast("int")))

    histogram = {r["rest"]: r["n"] for r in sized.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}  # < capacity rows
    cut_up = {r["full"]: r["n"] for r in sized.where("full > 0").groupBy("full").agg(F.count("*").alias("n")).collect()}  # one row per number of full containers
    windows, containers = plan_packing(histogram, capacity, tiers)
    salts = lambda counts: max(1, -(-max(counts.values(), default=0) // salt_rows))
    # Containers that a cut text fills come first, texts of most of them at the head; the others follow by falling load.
    heads, whole = {}, 0
    for parts in sorted(cut_up, reverse=True):
        heads[parts] = whole
        whole += parts * cut_up[parts]
    total = whole + max((r["container"] + r["times"] for r in containers), default=0)
    tables = (
        _table(windows, "size", "rank", ("rank", "each", "load", "block", "tier")),
        _table(containers, "load", "rank", ("rank", "each", "container")),
    )
    shared = df.sparkSession.sparkContext.broadcast(tables)  # runs of the plan, bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("rest", "rank"))
            tier, container = locate(size, rank, *shared.value) if len(size) else (size, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("n_tokens"), batch.column("n_parts"), batch.column("full"), batch.column("rest"), pa.array(tier, pa.int32()), pa.array(container + whole, pa.int64())], names=names
            )

    names = [id_col, "n_tokens", "n_parts", "part", "part_tokens", "tier", "container"]
    kind = sized.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, n_tokens int, n_parts int, part int, part_tokens int, tier int, container long"
    ranked = salted_rank(sized.where("rest > 0").select(id_col, "n_tokens", "n_parts", "full", "rest"), ["rest"], id_col, "rank", salts(histogram))
    placed = ranked.mapInArrow(run, shape)
    big = salted_rank(sized.where("full > 0"), ["full"], id_col, "rank", salts(cut_up))
    head = F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in (heads or {-1: 0}).items() for x, t in ((k, "int"), (v, "long"))]), F.col("full"))
    whole_parts = (
        big.withColumn("first", head + F.col("rank") * F.col("full"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
        .select(id_col, "n_tokens", "n_parts", "part", F.lit(capacity).alias("part_tokens"), F.lit(capacity).alias("tier"), (F.col("first") + F.col("part")).cast("long").alias("container"))
    )
    none = F.lit(None).cast("int")
    empty = sized.where("n_tokens = 0").select(id_col, "n_tokens", "n_parts", none.alias("part"), F.lit(0).alias("part_tokens"), none.alias("tier"), F.lit(None).cast("long").alias("container"))
    # Containers are numbered by falling load: dealing them back and forth balances the groups.
    groups = max(1, -(-total // GROUP_CONTAINERS))
    turn, seat = F.floor(F.col("container") / groups), F.pmod(F.col("container"), F.lit(groups))
    group = F.when(turn % 2 == 0, seat).otherwise(groups - 1 - seat).cast("long")
    return placed.unionByName(whole_parts).unionByName(empty).withColumn("step_group", group)


def split_documents(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents the packing had to cut, by their first container: more tokens than one container holds."""
    return packed.where("part = 0 and n_parts > 1 and container >= 0").select(id_col)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused tokens and the share of the capacity in use."""
    by_container = packed.where("container is not null").groupBy("container").agg(F.sum("part_tokens").alias("load"))
    return by_container.agg(
        F.count("*").alias("containers"),
        F.sum("load").alias("tokens"),
        F.sum(F.lit(capacity) - F.col("load")).alias("unused_tokens"),
        F.max("load").alias("largest_load"),
    ).withColumn("fill_permille", F.expr(f"cast(floor(tokens * 1000 / (containers * {capacity})) as int)"))
