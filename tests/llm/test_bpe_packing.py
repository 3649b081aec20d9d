import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planloom.llm import bpe, packing

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoders():
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Encoder(raw), tiktoken.Encoding("own", pat_str=bpe.PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_known_texts(encoders):
    own, peer = encoders
    texts = ["", " ", "hello world", "<|endoftext|>", "a" * 3000, "ab" * 900, "\n\n  x", "crème brûlée 🤖", "it's 12,345 o'clock", " " * 2000 + "x"]
    assert own.encode(texts) == [peer.encode_ordinary(t) for t in texts]
    assert own.count(texts) == [len(peer.encode_ordinary(t)) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(encoders, texts):
    own, peer = encoders
    assert own.encode(texts) == [peer.encode_ordinary(t) for t in texts]


def test_memory_overflow(encoders, monkeypatch):
    own, peer = encoders
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    texts = [f"word{i} other{i}" for i in range(50)]
    assert own.encode(texts) == [peer.encode_ordinary(t) for t in texts]


def test_rows(spark, encoders):
    rows = [(1, "go to the hall", "x"), (2, None, "x"), (3, "", None), (3, "go", "y"), (4, "<|endoftext|>", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column named like the result
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted((i, encoders[1].encode_ordinary(t or "")) for i, t, _ in rows)
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def contents(histogram, capacity, tiers=None):
    """Container -> list of (size, tier), by looking every single item up in the plan."""
    windows, containers = packing.plan_packing(histogram, capacity, tiers)
    if not windows:
        return {}
    size = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()]).astype(np.int64)
    tables = packing._table(windows, "size", "rank", ("rank", "each", "load", "block", "tier")), packing._table(containers, "load", "rank", ("rank", "each", "container"))
    tier, container = packing.locate(size, rank, *tables)
    out = {}
    for s, t, c in zip(size.tolist(), tier.tolist(), container.tolist(), strict=True):
        out.setdefault(c, []).append((s, t))
    assert sorted(out) == list(range(max(r["container"] + r["times"] for r in containers)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_item_once(histogram):
    placed = contents(histogram, 64)
    load = [sum(s for s, _ in items) for items in placed.values()]
    assert sum(map(len, placed.values())) == sum(histogram.values())
    assert all(x <= 64 for x in load)
    assert [load for _, load in sorted(zip(placed, load, strict=True))] == sorted(load, reverse=True)
    # no two containers could be one, and an item stands in a window that holds it
    light = sorted(load)[:2]
    assert len(light) < 2 or sum(light) > 64
    assert all(s <= t for items in placed.values() for s, t in items)


def test_tiers_change_the_plan():
    """Long windows take fillers from shorter tiers; what is left of a short tier fills windows of its own length."""
    histogram = {60: 2, 30: 4, 20: 3, 4: 6, 2: 8}
    tiers, one = (packing.plan_packing(histogram, 64, t) for t in ([64, 32, 16], [64]))
    assert tiers != one and {r["tier"] for r in tiers[0]} >= {64, 32} and {r["tier"] for r in one[0]} == {64}
    assert {r["tier"] for r in tiers[0] if r["size"] == 4} == {64, 32}, "the gaps of the windows of 60 first, then those of 20"
    assert {r["tier"] for r in tiers[0] if r["size"] == 30} == {32}


def test_fill(encoders):
    """Lengths like those of a corpus, mostly short: 99.5 % of the room is used."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(np.maximum(1, rng.lognormal(4.3, 0.9, 20_000)), 2048).astype(int)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    placed = contents(histogram, packing.CAPACITY)
    assert sizes.sum() >= 0.995 * packing.CAPACITY * len(placed)


def test_groups_are_balanced(spark):
    rows = [(i, "go " * (i % 700 + 1)) for i in range(4000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), salt_rows=2)
    loads = {r[0]: (r[1], r[2]) for r in packed.groupBy("step_group").agg({"part_tokens": "sum", "container": "approx_count_distinct"}).collect()}
    tokens = [x for x, _ in loads.values()]
    assert len(loads) > 5 and max(tokens) <= 1.01 * (sum(tokens) / len(tokens)) + packing.CAPACITY
    assert packed.select("doc_id").distinct().count() == 4000


def test_pack(spark, encoders):
    texts = ["go " * 5000, "go " * 2049, " ".join(["hall"] * 2048), "a", "b", None, "", "go to the hall", "go to the hall"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df).collect()
    load: dict[int, int] = {}
    for r in rows:
        if r.container is not None:
            load[r.container] = load.get(r.container, 0) + r.part_tokens
    assert max(load.values()) <= packing.CAPACITY
    tokens = {i: len(encoders[1].encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for i, n in tokens.items():
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.part_tokens for r in mine) == n
        assert len(mine) == max(1, -(-n // packing.CAPACITY)), "cut only above the capacity"
    assert {r.doc_id for r in packing.split_documents(packing.pack(df)).collect()} == {i for i, n in tokens.items() if n > packing.CAPACITY}
    assert packing.pack(df.limit(0)).count() == 0
