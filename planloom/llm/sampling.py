"""Sample with given category shares (problem 3).

1. *Moments*: the rows of each category, one partial aggregation.
2. *Floors*: a category whose target is out of reach is taken whole and reported;
   what it leaves is spread over the other categories in proportion to their shares.
3. *Calibration*: inclusion probabilities by Newton iterations on the dual of the
   exponential-tilting problem.  The odds of the base rate n/N are tilted by
   exp(lambda_category); gradient and Hessian need the category moments alone.
4. *Sampling*: the pivotal method in bounded blocks of each category; the at most one
   undecided row of every block meets the others of its category in further rounds of
   bounded blocks, until one is left of each, so a category of any size is drawn by many
   tasks and its size is right to one row.

Defined cases: labels are compared without letter case and surrounding blanks, tabs
and line ends; null labels and labels without target have share 0; repeated rows are
rows of their own; with an empty table every target above 0 is a gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.session import cut

BLOCK_ROWS = 50_000  # rows of one block, on average
SEED = 17
MAX_TARGETS = 100_000  # categories a target list may name; their moments are solved on the driver


def fold_label(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def tilt(counts: np.ndarray, goals: np.ndarray, rate: float, rounds: int = 60) -> np.ndarray:
    """Inclusion probabilities p(lambda) with counts * p = goals, by Newton steps on the dual."""
    lam = np.zeros(len(counts))
    base = np.log(rate / (1 - rate)) if 0 < rate < 1 else 0.0
    prob = lambda x: 1 / (1 + np.exp(-np.clip(base + x, -700, 700)))
    for _ in range(rounds):
        p = prob(lam)
        gap = goals - counts * p
        if np.all(np.abs(gap) < 1e-9 * np.maximum(goals, 1)):
            break
        lam += np.clip(gap / np.maximum(counts * p * (1 - p), 1e-300), -4, 4)
    return prob(lam)


def calibrate(df: DataFrame, category: Column, targets: DataFrame, share: tuple[int, int] = (1, 5)) -> pd.DataFrame:
    """One row per target: ``label, key, available, wanted, goal, p, gap``.

    ``targets`` has ``label, target_permille, min_rows``.  ``wanted`` is the greater of
    the floor and the share of the sample rounded up; ``gap`` what is missing to it;
    ``goal`` what the sample will hold; ``p`` the probability of each row of the category.
    """
    wanted = targets.select("label", "target_permille", "min_rows").withColumn("key", fold_label(F.col("label"))).limit(MAX_TARGETS + 1).toPandas()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    total = df.count()
    have = df.groupBy(fold_label(category).alias("key")).agg(F.count("*").alias("available"))
    keys = df.sparkSession.createDataFrame(pd.DataFrame({"key": wanted["key"].drop_duplicates()}), "key string")
    moments = have.join(F.broadcast(keys), "key").toPandas()  # only categories with a target
    t = wanted.merge(moments, on="key", how="left")
    t["available"] = t["available"].fillna(0).astype("int64")
    n = total * share[0] // share[1]
    permille = t["target_permille"].fillna(0).astype("int64")
    t["wanted"] = np.maximum(t["min_rows"].fillna(0).astype("int64"), -(-permille * n // 1000))
    t["gap"] = np.maximum(0, t["wanted"] - t["available"])
    goal = np.minimum(t["wanted"], t["available"]).to_numpy(dtype=float)
    # floors and exhausted categories are fixed, the rest of n goes to the others by their shares
    weight = permille.to_numpy(dtype=float)
    fixed = (t["gap"] > 0) | (permille * n < t["wanted"] * 1000 - 1000) | (permille == 0)
    fixed = fixed.to_numpy()
    while not fixed.all():
        rest = max(0.0, n - goal[fixed].sum())
        goal[~fixed] = rest * weight[~fixed] / weight[~fixed].sum()
        over = ~fixed & (goal > t["available"].to_numpy())
        if not over.any():
            break
        goal[over] = t["available"].to_numpy()[over]
        fixed |= over
    t["goal"] = goal
    t["p"] = 0.0
    counts = t["available"].to_numpy(dtype=float)
    free = (goal > 0) & (goal < counts)
    t.loc[free, "p"] = tilt(counts[free], goal[free], n / total if total else 0.5)
    t.loc[(goal > 0) & (goal >= counts), "p"] = 1.0
    return t


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """Sequential pivotal method: chosen flags, index of the undecided unit (-1: none) and its probability."""
    chosen = np.zeros(len(p), dtype=bool)
    u = rng.random(len(p))
    at, q = -1, 0.0
    eps = 1e-12
    for i in range(len(p)):
        b = p[i]
        if b >= 1 - eps:
            chosen[i] = True
        elif b <= eps:
            continue
        elif at < 0:
            at, q = i, b
        else:
            s = q + b
            if s < 1 - eps:
                if u[i] < b / s:
                    at = i
                q = s
            else:
                if s <= 1 + eps:  # one of the two, nothing is left
                    chosen[i if u[i] < b else at] = True
                    at, q = -1, 0.0
                elif u[i] < (1 - b) / (2 - s):
                    chosen[at] = True
                    at, q = i, s - 1
                else:
                    chosen[i] = True
                    q = s - 1
    return chosen, at, q


def draw(df: DataFrame, id_col: str, category: Column, solved: pd.DataFrame, seed: int = SEED) -> DataFrame:
    """``label, id_col`` of the drawn rows, with the probabilities of :func:`calibrate`."""
    one = solved.drop_duplicates("key")
    one = one[one["p"] > 0]
    blocks = np.maximum(1, -(-one["available"] // BLOCK_ROWS))
    side = df.sparkSession.createDataFrame(
        pd.DataFrame({"__key": one["key"], "label": one["label"], "__p": one["p"], "__blocks": blocks}), "__key string, label string, __p double, __blocks long"
    )  # at most MAX_TARGETS rows
    rows = df.select(F.col(id_col).alias("__id"), fold_label(category).alias("__key")).join(F.broadcast(side), "__key")
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("__id"), F.col("__blocks")))
    kind = rows.schema["__id"].dataType.simpleString()
    shape = f"label string, __id {kind}, __p double"

    def run(level: int, last: bool = False):
        def block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("__id", kind="stable")
            rng = np.random.default_rng([seed, level, xxhash.xxh3_64_intdigest(repr(key).encode())])
            part = part.iloc[rng.permutation(len(part))]
            chosen, at, q = pivotal(part["__p"].to_numpy(), rng)
            p = chosen.astype(float)
            if at >= 0:
                # the last round settles the last unit by its own probability
                p[at] = float(rng.random() < q) if last else q
            keep = p > 0
            return pd.DataFrame({"label": part["label"].to_numpy()[keep], "__id": part["__id"].to_numpy()[keep], "__p": p[keep]})

        return block

    now = cut(rows.select("label", "__block", "__id", "__p").groupBy("label", "__block").applyInPandas(run(0), shape))
    done, level, most = now.where("__p = 1"), 1, int(blocks.max()) if len(one) else 1
    while most > 1:  # one row of each block at most is left: they meet in blocks of their own
        most = -(-most // BLOCK_ROWS)
        left = now.where("__p < 1").withColumn("__block", F.pmod(F.xxhash64("__id", F.lit(level)), F.lit(most)))
        now = cut(left.groupBy("label", "__block").applyInPandas(run(level), shape))
        done, level = done.unionByName(now.where("__p = 1")), level + 1
    # one row per category at most
    final = now.where("__p < 1").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run(level, last=True), shape)
    return done.unionByName(final).select("label", F.col("__id").alias(id_col))


def gaps(df: DataFrame, solved: pd.DataFrame, grain: str) -> DataFrame:
    """The report of one grain as a DataFrame; ``gap`` > 0 marks targets out of reach."""
    t = solved.assign(grain=grain)
    cols = ["grain", "label", "available", "wanted", "gap"]
    return df.sparkSession.createDataFrame(t[cols], "grain string, label string, available long, wanted long, gap long")

