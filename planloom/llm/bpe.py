"""Byte-level BPE with numpy: whole-corpus encoding (problem 6).

The encoder takes a public rank file (``base64(token) rank`` per line).  A text is
cut into pieces by the tokenizer's pattern; the distinct pieces a worker has not
seen yet are laid into length-bucketed, padded matrices of byte ids, and in every
round each row merges its leftmost pair of minimum rank.  A round drops exactly
one cell of every row still active, so both matrices (ids and pair ranks) are
compacted by one boolean mask, and finished rows leave the matrix.

Defined cases: null or empty text -> empty list; special-token strings are ordinary
text; whole texts are encoded whatever their length; repeated rows come out
repeated; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.session import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The published split pattern of this vocabulary.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_PAIR = np.int32(2**31 - 1)
BUCKET_WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
CACHE_PIECES = 400_000  # pieces a worker remembers; the memory starts anew beyond it


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1), dtype=np.uint64)
        self.values = np.full(size, NO_PAIR, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            want = todo[free]
            first = np.unique(slot[want], return_index=True)[1]
            placed = want[first]
            self.keys[slot[placed]] = keys[placed]
            self.values[slot[placed]] = merged[placed]
            done = np.zeros(len(keys), dtype=bool)
            done[placed] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (
            right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        )
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.full(flat.shape, NO_PAIR, dtype=np.int32)
        todo = np.arange(len(flat))
        mask = len(self.keys) - 1
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            go_on = ~hit & (found != np.uint64(2**64 - 1))
            todo = todo[go_on]
            slot[todo] = (slot[todo] + 1) & mask
        return out.reshape(keys.shape)


class Encoder:
    """Encodes texts with a rank file; one object per Python worker."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        as_array = lambda x: np.array(x, dtype=np.int64)
        self.pairs = PairTable(as_array(left), as_array(right), as_array(merged))
        self.pair_dict: dict[tuple[int, int], int] | None = None
        self._pair_lists = (left, right, merged)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.split = regex.compile(PIECE_PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _merge_bucket(self, pieces: list[bytes], width: int, out: list, index: np.ndarray) -> None:
        n = len(pieces)
        ids = np.full((n, width), -1, dtype=np.int32)
        for row, piece in enumerate(pieces):
            ids[row, : len(piece)] = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        ranks[(ids[:, :-1] < 0) | (ids[:, 1:] < 0)] = NO_PAIR
        while len(ids):
            if ids.shape[1] > 1:
                at = ranks.argmin(axis=1)
                rows = np.arange(len(ids))
                best = ranks[rows, at]
                active = best != NO_PAIR
            else:
                active = np.zeros(len(ids), dtype=bool)
            for row in np.flatnonzero(~active):
                cells = ids[row]
                out[index[row]] = cells[cells >= 0].tolist()
            if not active.any():
                return
            ids, ranks, index = ids[active], ranks[active], index[active]
            at, best = at[active], best[active]
            rows, width = np.arange(len(ids)), ids.shape[1]
            ids[rows, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[rows, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[rows, at] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            before = np.flatnonzero(at > 0)
            if len(before):
                ranks[before, at[before] - 1] = self._lookup(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < width - 2)
            if len(after):
                ranks[after, at[after]] = self._lookup(ids[after, at[after]], ids[after, at[after] + 1])

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.get(left, right)
        found[(left < 0) | (right < 0)] = NO_PAIR
        return found

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and a linked list, for pieces beyond the widest bucket."""
        if self.pair_dict is None:
            left, right, merged = self._pair_lists
            self.pair_dict = {(a, b): m for a, b, m in zip(left, right, merged, strict=True)}
        get = self.pair_dict.get
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            k = before[i]
            if k >= 0 and (x := get((ids[k], m))) is not None:
                heapq.heappush(heap, (x, k, ids[k], m))
            k = after[i]
            if k < n and (x := get((m, ids[k]))) is not None:
                heapq.heappush(heap, (x, i, m, ids[k]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Encode the distinct ``pieces`` into the worker's memory."""
        raw = [p.encode() for p in pieces]
        out: list = [None] * len(raw)
        lengths = np.array([len(p) for p in raw])
        last = 1
        for i in np.flatnonzero(lengths == 1):
            out[i] = [int(self.byte_ids[raw[i][0]])]
        for width in BUCKET_WIDTHS:
            rows = np.flatnonzero((lengths > last) & (lengths <= width))
            step = max(1, 2_000_000 // width)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                self._merge_bucket([raw[i] for i in part], width, out, part)
            last = width
        for i in np.flatnonzero(lengths > last):
            out[i] = self._merge_long(raw[i])
        if len(self.known) + len(out) > CACHE_PIECES:
            self.known.clear()
        self.known.update(zip(pieces, out, strict=True))

    def pieces(self, texts: list[str]) -> list[list[str]]:
        cut = [self.split(t) for t in texts]
        fresh = set().union(*map(set, cut)) if cut else set()
        if len(self.known) + len(fresh) > CACHE_PIECES:
            self.known.clear()
        new = [p for p in fresh if p not in self.known]
        if new:
            self.learn(new)
        return cut

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for part in self.pieces(texts):
            known = self.known
            ids: list[int] = []
            for p in part:
                ids += known[p]
            out.append(ids)
        return out

    def count(self, texts: list[str]) -> list[int]:
        cut = self.pieces(texts)
        known = self.known
        return [sum(len(known[p]) for p in part) for part in cut]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(rank_file: bytes) -> Encoder:
    key = hash(rank_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_file)
    return _ENCODERS[key]


def _chunks(texts: list[str | None], chars: int = 4_000_000) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _broadcast_ranks(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a file of about 1 MB


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row of ``df``; no shuffle beyond spreading few splits."""
    ranks = _broadcast_ranks(df, ranks_path)
    slim = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        for batch in batches:
            start = 0
            for part in _chunks(batch.column(1).to_pylist()):
                ids = enc.encode(part)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists], names=[id_col, "ids"])
                start += len(part)

    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``(id_col, n_tokens int)`` for every row of ``df``; null and empty texts count 0."""
    ranks = _broadcast_ranks(df, ranks_path)
    slim = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        for batch in batches:
            sizes = [n for part in _chunks(batch.column(1).to_pylist()) for n in enc.count(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[id_col, "n_tokens"])

    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")
