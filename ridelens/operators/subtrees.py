"""The lower part of a tree that is too large for a driver: MLlib grows the top, tasks grow what is below its leaves.

A task takes whole leaves of the top tree and grows them level by level in arrays, by MLlib's rules and in its order of
arithmetic (variance gains, categories by their mean label, the first of equal gains; for whole-numbered labels all sums
are exact), so that the tree is the one that MLlib would grow.  Only sums by depth and a number for each leaf of the top
leave a task.  A task holds the distinct vectors of its leaves, so one leaf's must fit there.

Functions are shipped to the executors by value, as a worker may have no copy of this package.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import NodeTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of either side for each task, on average.
ROWS_PER_TASK = 200_000
#: MLlib splits no node of less impurity.
PURE = 2.0**-52


class Below(NamedTuple):
    """By depth: number of nodes, pairs of leaves that a cut there joins, squared errors of the test rows; and ``joined``."""

    nodes: np.ndarray
    gone: np.ndarray
    errors: np.ndarray
    #: For each leaf of the top, bit d is set if all leaves below it predict the same in a cut at depth d.
    joined: np.ndarray


def feature_cuts(rows: DataFrame, column: str = "indexedFeatures") -> list[list[float] | None]:
    """For each feature of an indexed vector the cuts half way between neighbouring values; None for categories."""
    attrs = rows.schema[column].metadata["ml_attr"]["attrs"]
    named = {a["idx"] for kind in ("nominal", "binary") for a in attrs.get(kind, [])}
    out = []
    for f in range(sum(map(len, attrs.values()))):
        values = [] if f in named else sorted(r[0] for r in rows.select(vector_to_array(column)[f]).distinct().collect())
        out.append(None if f in named else [(a + b) / 2 for a, b in zip(values, values[1:])])
    return out


def join_pairs(joined: np.ndarray, mean: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``joined`` of the parents of ``(left, right)`` pairs, without the parents' own depths; counts them in ``gone``."""
    both = np.where(mean[0] == mean[1], joined[0] & joined[1], 0)
    for depth in range(len(gone) if both.any() else 0):
        gone[depth] += np.count_nonzero(both >> depth & 1)
    return both


def grow(at: np.ndarray, x: list[np.ndarray], named: list[bool], train: list[np.ndarray], test: list[np.ndarray], depth: np.ndarray, most: int) -> Below:
    """What grows from the leaves ``0..len(depth)-1``, which are at ``depth``, down to depth ``most``.

    Each row is a vector: its leaf ``at``, each feature's number ``x`` (categories where ``named``, else bins), and count,
    sum and sum of squares of the labels of its ``train`` and ``test`` rows.
    """
    nodes, gone, errors, settled = (np.zeros(most + 1) for _ in range(4))
    width, levels = [int(v.max()) + 1 for v in x], []
    while True:
        k = len(depth)
        n, s, q = (np.bincount(at, w, k) for w in train)
        mean, loss = s / n, (q - s * s / n) / n
        tn, ts, tq = (np.bincount(at, w, k) for w in test)
        off = tq - 2 * mean * ts + mean * mean * tn
        gain, by, last, ranks = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64), {}
        may = (depth < most) & (np.abs(loss) >= PURE)
        own = np.flatnonzero((train[0] > 0) & may[at])
        for f in range(len(x) if len(own) else 0):
            key, of = np.unique(at[own] * width[f] + x[f][own], return_inverse=True)
            vn, vs, vq = (np.bincount(of, w[own], len(key)) for w in train)
            node, value = np.divmod(key, width[f])
            order = np.lexsort((value, vs / vn, node)) if named[f] else np.arange(len(key))
            begins = np.r_[True, node[1:] != node[:-1]]
            first, group = np.flatnonzero(begins), np.cumsum(begins) - 1
            ln, ls, lq = (np.cumsum(v) - (np.cumsum(v) - v)[first][group] for v in (vn[order], vs[order], vq[order]))
            rn, rs, rq = n[node] - ln, s[node] - ls, q[node] - lq
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = loss[node] - ln / n[node] * ((lq - ls * ls / ln) / ln) - rn / n[node] * ((rq - rs * rs / rn) / rn)
            gains = np.where(rn > 0, gains, -np.inf)
            best = np.maximum.reduceat(gains, first)
            hits = np.flatnonzero(gains == best[group])
            cut = hits[np.unique(group[hits], return_index=True)[1]]
            better = best > gain[node[first]]
            won = node[first][better]
            gain[won], by[won] = best[better], f
            last[won] = (cut - first if named[f] else value[cut])[better]
            if named[f]:
                rank = np.empty(len(key), np.int64)
                rank[order] = np.arange(len(key)) - first[group]
                ranks[f] = key, rank
        split = by >= 0
        nodes += np.bincount(depth, minlength=most + 1)
        errors += np.bincount(depth, off, most + 1)
        settled += np.bincount(depth[~split], off[~split], most + 1)
        levels.append((split, depth, mean))
        if not split.any():
            break
        kept = split[at]
        at, x = at[kept], [v[kept] for v in x]
        train, test = [w[kept] for w in train], [w[kept] for w in test]
        left = np.zeros(len(at), bool)
        for f in range(len(x)):
            of = np.flatnonzero(by[at] == f)
            if named[f] and len(of):  # values without training rows in the node go right
                key, rank = ranks[f]
                mine = at[of] * width[f] + x[f][of]
                place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                left[of] = (key[place] == mine) & (rank[place] <= last[at[of]])
            else:
                left[of] = x[f][of] <= last[at[of]]
        at = 2 * (np.cumsum(split) - 1)[at] + ~left
        depth = np.repeat(depth[split] + 1, 2)
    joined = below = None
    for split, depth, mean in levels[::-1]:
        own = np.left_shift(1, depth)
        every = (1 << most + 1) - own
        now = np.where(split, own, every)
        if joined is not None:
            now[split] |= join_pairs((joined[::2], joined[1::2]), (below[::2], below[1::2]), gone)
        joined, below = now, mean
    return Below(nodes, gone, errors + np.cumsum(settled) - settled, joined)


def grow_below(rows: DataFrame, count: int, top: NodeTable, cuts: list[list[float] | None], most: int) -> Below:
    """``rows`` (``leaf`` of the top, ``indexedFeatures``, ``label``, ``train``), some ``count`` of them, grown to depth ``most``."""
    names = [f"x{f}" for f in range(len(cuts))]
    depth, tasks = top.depth[top.leaves], max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // ROWS_PER_TASK + 1)
    x, y = vector_to_array("indexedFeatures"), F.col("label")
    sides = {"train": F.col("train"), "test": ~F.col("train")}
    sums = [F.sum(F.when(own, v).otherwise(0.0)).alias(f"{side}{i}") for side, own in sides.items() for i, v in enumerate((F.lit(1.0), y, y * y))]
    vectors = rows.select("leaf", "label", "train", *[x[f].alias(n) for f, n in enumerate(names)]).groupBy("leaf", *names).agg(*sums)

    def grown(frames):
        import pandas as pd

        frames = [f for f in frames if len(f)]
        if not frames:
            return
        d = pd.concat(frames)
        leaf, at = np.unique(d["leaf"].to_numpy(), return_inverse=True)
        x = [d[n].to_numpy().astype(np.int64) if c is None else np.searchsorted(c, d[n].to_numpy()) for n, c in zip(names, cuts)]
        b = grow(at, x, [c is None for c in cuts], *([d[f"{side}{i}"].to_numpy() for i in range(3)] for side in ("train", "test")), depth[leaf], most)
        yield pd.DataFrame({"leaf": -1, "depth": range(most + 1), "nodes": b.nodes, "gone": b.gone, "errors": b.errors, "joined": 0})
        yield pd.DataFrame({"leaf": leaf, "depth": 0, "nodes": 0.0, "gone": 0.0, "errors": 0.0, "joined": b.joined})

    out = vectors.repartition(tasks, "leaf").mapInPandas(grown, "leaf int, depth int, nodes double, gone double, errors double, joined long").toPandas()
    by_depth, leaves = out[out["leaf"] < 0].groupby("depth")[["nodes", "gone", "errors"]].sum(), out[out["leaf"] >= 0].sort_values("leaf")
    return Below(*(by_depth[c].to_numpy() for c in by_depth), leaves["joined"].to_numpy())


def sizes(top: NodeTable, below: Below) -> np.ndarray:
    """Nodes of the whole tree cut at each depth; like a fit, a cut joins leaves that predict the same."""
    joined, gone = np.zeros(len(top.left), np.int64), below.gone.copy()
    joined[top.leaves] = below.joined
    for level in top.levels[::-1]:
        inner = level[~top.is_leaf[level]]
        pairs = top.left[inner], top.right[inner]
        joined[inner] = np.left_shift(1, top.depth[inner]) | join_pairs([joined[p] for p in pairs], [top.prediction[p] for p in pairs], gone)
    nodes = below.nodes + np.bincount(top.depth[~top.is_leaf], minlength=len(gone))
    return (np.cumsum(nodes) - 2 * gone).astype(np.int64)
