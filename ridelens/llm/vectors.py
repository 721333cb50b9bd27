"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt to shards of bounded size by hash of vec_id.  In every shard each tree keeps the
rows' hash strings (64 signs of random projections, balanced by the shard's medians) as a
sorted array.  A query descends to the longest prefixes it shares with each array, then all
trees ascend together, one bit at a time, and the rows that come in are ranked by
their exact distance.  The ascent of a query ends when ``LEAST_RANKED`` rows were ranked and its present
k nearest show that a share of ``RECALL`` is found; so close neighbours end it early and far ones
(nearly random vectors) let it go on, to all rows if need be.  No bucket is capped.  Shards' best
rows are merged by distance.

The share found is measured, not modelled, so it holds for hot clusters and uneven norms too.  If a row
shares the depth's bits with the query in c of T trees, one of which it took to be found, then
p = (c - 1) / (T - 1) estimates the chance of a tree and 1 - (1 - p)^T that of being found at all; each
of the k rows stands for one over that chance rows, found and missed.

Defined cases.  Vectors null, empty, zero or with a null or non-finite component take no part, nor do
rows without a vec_id.  Rows that repeat a vec_id: the smallest vector counts.  Vectors of
different lengths are never neighbours.  Fewer than k candidates: all of them.  Ties: the
smaller vec_id.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs

TREES = 32
BITS = 64
RECALL = 0.985
#: Rows ranked for a query in each shard before its ascent may end.
LEAST_RANKED = 500
SHARD_ROWS = 20_000
SEED = 41


def usable(rows: DataFrame) -> DataFrame:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine & F.exists(v, lambda x: x != 0))


class Forest:
    """Sorted hash strings of the rows of a shard, one array for each tree."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, trees: int = TREES):
        self.ids, self.rows, self.trees = ids, rows, trees
        self.ranked = 0  # rows whose distance from a query was computed
        rng = np.random.Generator(np.random.Philox(SEED))
        self.center = rows.mean(axis=0)
        moved = rows - self.center
        self.planes = rng.standard_normal((trees, rows.shape[1], BITS))
        self.medians, self.strings, self.order = [], [], []
        self.hashes = np.empty((len(rows), trees), np.uint64)
        for t in range(trees):
            projected = moved @ self.planes[t]
            self.medians.append(np.median(projected, axis=0))
            h = self._pack(projected > self.medians[t])
            self.hashes[:, t] = h
            order = np.argsort(h, kind="stable")
            self.order.append(order)
            self.strings.append(h[order])

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()

    def share_found(self, at: np.ndarray, own: np.ndarray, rest: np.uint64) -> float:
        """Estimated share of rows like those ``at`` that share the bits outside ``rest`` with the query's
        strings ``own`` in one tree at least."""
        shared = ((self.hashes[at] ^ own) <= rest).sum(axis=1)
        p = (shared - 1) / max(self.trees - 1, 1)
        chance = 1 - (1 - p) ** self.trees
        return len(at) / float((1 / np.maximum(chance, 1e-9)).sum())

    def nearest(self, query_id: int, query: np.ndarray, k: int, recall: float = RECALL) -> list[tuple[float, int]]:
        """The ``k`` nearest found, as (distance, vec_id), without the query's own row."""
        moved = query - self.center
        depths = np.arange(BITS + 1)
        rest = np.append([np.uint64(2**64 - 1)], np.uint64(2**64 - 1) >> depths[1:].astype(np.uint64) % np.uint64(64))
        rest[BITS] = 0
        # Every tree's range of rows that share the first bits with the query, for each number of bits.
        low, high = np.empty((self.trees, BITS + 1), np.int64), np.empty((self.trees, BITS + 1), np.int64)
        own = np.empty(self.trees, np.uint64)
        for t in range(self.trees):
            own[t] = self._pack((moved @ self.planes[t] > self.medians[t])[None, :])[0]
            low[t] = np.searchsorted(self.strings[t], own[t] & ~rest, "left")
            high[t] = np.searchsorted(self.strings[t], own[t] | rest, "right")
        seen = np.zeros(len(self.ids), bool)
        seen[self.ids == query_id] = True
        left = len(seen) - int(seen.sum())
        ranked = 0
        nearest, found = np.zeros(0, np.int64), np.zeros(0)
        for depth in range(BITS, -1, -1):
            grown = high[:, depth] > low[:, depth]
            if depth < BITS:
                grown &= (high[:, depth] > high[:, depth + 1]) | (low[:, depth] < low[:, depth + 1])
            fresh = []
            for t in np.flatnonzero(grown):
                at = self.order[t][low[t, depth] : high[t, depth]]
                at = at[~seen[at]]
                seen[at] = True
                fresh.append(at)
            at = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
            if len(at):
                ranked += len(at)
                distance = np.sqrt(((self.rows[at] - query) ** 2).sum(axis=1))
                nearest, found = np.concatenate([nearest, at]), np.concatenate([found, distance])
                best = np.lexsort((self.ids[nearest], found))[:k]
                nearest, found = nearest[best], found[best]
            if ranked == left:
                break
            if ranked >= LEAST_RANKED and len(found) == k and self.share_found(nearest, own, rest[depth]) >= recall:
                break
        self.ranked += ranked
        return list(zip(found.tolist(), self.ids[nearest].tolist()))


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query, by Euclidean
    distance.  ``rows`` and ``queries`` have ``vec_id, embedding``; a query's own vec_id is left out.

    A task gets a shard's rows and, sorted behind them, the queries in batches: the forest of a shard is
    built once, no row is copied for the queries, and a task holds one shard and one batch.  ``rows`` are
    counted first, for the number of shards.
    """
    # Of rows that repeat a vec_id the smallest vector; merged before the shuffle, so that no shard takes them all.
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows, queries = (usable(x).select(*columns).groupBy("vec_id").agg(F.min("embedding").alias("embedding")) for x in (rows, queries))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    both = rows.select(deal.alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding").unionByName(
        queries.select(everywhere.alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, forests = None, [], {}
        for at, kind, part in runs(batches, "shard", "kind"):
            if at != shard:
                shard, held, forests = at, [], {}
            if kind == 0:
                held.append(_by_length(part))
                continue
            if held:
                for size in {s for h in held for s in h}:
                    ids, vectors = zip(*[h[size] for h in held if size in h])
                    forests[size] = Forest(np.concatenate(ids), np.concatenate(vectors))
                held = []
            out = []
            for size, (ids, vectors) in _by_length(part).items():
                if size in forests:
                    for q, v in zip(ids.tolist(), vectors):
                        out += [(q, i, d) for d, i in forests[size].nearest(q, v, k, recall)]
            q, i, d = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    placed = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = placed.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(part: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``{length: (ids, vectors)}`` of the rows of a batch."""
    ids, lengths = part["vec_id"].to_numpy(), np.asarray(part["embedding"].value_lengths())
    flat, ends = part["embedding"].flatten().to_numpy(), np.cumsum(lengths)
    out = {}
    for size in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == size)
        out[size] = ids[own], flat[(ends[own] - size)[:, None] + np.arange(size)]
    return out
