"""Hard-negative mining by a multiway hyperplane tree with sibling distance ranges (after GNAT).

A row's score for an anchor is the inner product of their integer vectors.  With one more component,
sqrt(M - |x|^2) for rows (M: the largest squared norm) and 0 for anchors, the squared distance is
|a|^2 + M - 2 score, so a window of scores is an annulus around the anchor.

A node has several split points; a row belongs to the nearest one.  Every split point stores the least and
largest distance from it to the rows of each sibling's subtree.  The triangle inequality turns the
anchor's distance from a split point and such a range into the distances from the anchor
that the subtree can hold; a subtree whose interval misses the annulus is left out.  What
remains is scored exactly in leaves, so results are exact.  The annulus shrinks from outside as better rows are found.

On Spark the root is shared: its split points come from ``SAMPLE_ROWS`` rows (by hash), its ranges from all
rows.  A subtree of more than ``SHARD_ROWS`` rows (a third of the rows may be one vector) is dealt to several shards.
Tasks get a shard's rows and after them, sorted behind, the anchors that the root sends there, in
batches: rows are not copied for blocks of anchors, and a task holds one shard and one batch.  Positives are first
looked for in the anchor's own shard, which narrows the annulus for the others.

Defined cases.  Rows without vec_id or label, and vectors null or with null or non-finite components, take
no part.  Shorter vectors are filled with zeros.  Integers beyond ``most`` (2**23 at 64 components) count as that
limit, so that scores are exact.  Rows that repeat a vec_id are rows of their own; an anchor's vec_id is never among its
positives or negatives.  Anchors that repeat a vec_id with other vectors or labels are mined each, equal ones once.
Ties: the smaller vec_id.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .codes import integers, matrix_of, usable
from .common import delete_path

POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
SHARD_ROWS = 8_192
SPLIT_POINTS = 256  # of the root, at most
SAMPLE_ROWS = 4_096
FANOUT = 8  # of the nodes inside a shard
LEAF_ROWS = 256
ANCHOR_BATCH = 512
KEY = ["anchor_id", "twin"]
NONE = np.iinfo(np.int64).max


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Indexes of up to ``n`` different points, each the farthest from those before it."""
    chosen, distance = [], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        at = int(distance.argmax()) if chosen else 0
        if distance[at] <= 0:
            break
        chosen.append(at)
        distance = np.minimum(distance, ((points - points[at]) ** 2).sum(axis=1))
    return np.array(chosen, np.int64)


class Space:
    """Distances after the added component; ``top`` is the largest squared norm."""

    def __init__(self, top: float):
        self.top = top

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (rows * rows).sum(axis=1), 0))

    def between(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of rows from split points, both lifted."""
        inner = rows @ points.T + self.lifted(rows)[:, None] * self.lifted(points)
        return np.sqrt(np.maximum(2 * (self.top - inner), 0))

    def radius(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance from anchors of squared ``norms`` at which rows have ``scores``."""
        return np.sqrt(np.maximum(norms + self.top - 2 * scores, 0))

    def slack(self, norms: np.ndarray) -> np.ndarray:
        """More than the rounding errors of the distances."""
        return 1e-6 * np.sqrt(norms + self.top) + 1e-9


def may_hold(distance: np.ndarray, least: np.ndarray, largest: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """True where the annulus from ``inner`` to ``outer`` around an anchor can meet a subtree.

    ``distance`` (anchors, points) to all split points of a node; ``least`` and ``largest`` (points) the
    ranges that these store for the subtree.
    """
    nearest_row = np.maximum(distance - largest, least - distance).max(axis=1)
    farthest_row = (distance + largest).min(axis=1)
    return (nearest_row <= outer) & (farthest_row >= inner)


class Best:
    """The ``k`` best (score, vec_id) of each of many windows."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), NONE)
        self.k = k

    def floor(self, at: np.ndarray) -> np.ndarray:
        """Scores that a further row must reach."""
        return self.scores[at, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``scores`` (-inf: none) of rows with ascending ``ids`` to the windows ``at``."""
        scores = scores.copy()
        line = np.arange(len(at))
        new_scores, new_ids = [self.scores[at]], [self.ids[at]]
        for _ in range(min(self.k, scores.shape[1])):
            best = scores.argmax(axis=1)  # of equal ones the first, so the smallest id
            top = scores[line, best]
            new_scores.append(top[:, None])
            new_ids.append(np.where(top > -np.inf, ids[best], NONE)[:, None])
            scores[line, best] = -np.inf
        s, i = np.concatenate(new_scores, axis=1), np.concatenate(new_ids, axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Tree:
    """The rows of a shard: nodes of split points with the ranges of all siblings, and exact leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, top: float, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order].astype(float)
        self.space, self.leaf_rows = Space(top), leaf_rows
        self.scored = 0  # pairs of anchors and rows that leaves scored
        self.root = self._node(np.arange(len(ids)))

    def _node(self, at: np.ndarray):
        if len(at) <= self.leaf_rows:
            return at
        sample = at[:: max(1, len(at) // (6 * FANOUT))]
        points = self.rows[sample[far_apart(self.rows[sample], FANOUT)]]
        distance = self.space.between(self.rows[at], points)
        side = distance.argmin(axis=1)
        counts = np.bincount(side, minlength=len(points))
        if counts.max() == len(at):  # nothing tells these rows apart
            return at
        children = []
        for j in np.flatnonzero(counts):
            own = distance[side == j]
            children.append((self._node(at[side == j]), own.min(axis=0), own.max(axis=0), points[j]))
        return points, children

    def search(self, anchors: np.ndarray, anchor_ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Best:
        """The ``k`` best rows for every line: of the anchor's label if ``same``, else of others, with scores
        from ``low`` to ``high``."""
        norms = (anchors * anchors).sum(axis=1)
        best = Best(len(anchors), k)
        slack = self.space.slack(norms)
        inner = self.space.radius(norms, np.minimum(high, norms + self.space.top)) - slack

        def visit(node, lines: np.ndarray) -> None:
            if not isinstance(node, tuple):
                for at in range(0, len(node), self.leaf_rows):  # equal rows may make a leaf of any size
                    leaf(node[at : at + self.leaf_rows], lines)
                return
            points, children = node
            distance = self.space.radius(norms[lines][:, None], anchors[lines] @ points.T)
            for child, least, largest, _ in sorted(children, key=lambda c: float((anchors[lines] @ c[3]).mean()), reverse=True):
                floor = np.maximum(low[lines], best.floor(lines))
                outer = np.where(floor == -np.inf, np.inf, self.space.radius(norms[lines], np.where(floor == -np.inf, 0, floor)))
                on = may_hold(distance, least, largest, inner[lines], outer + slack[lines])
                if on.any():
                    visit(child, lines[on])

        def leaf(rows: np.ndarray, lines: np.ndarray) -> None:
            self.scored += len(rows) * len(lines)
            scores = anchors[lines] @ self.rows[rows].T
            floor = np.maximum(low[lines], best.floor(lines))
            fits = (scores >= floor[:, None]) & (scores <= high[lines][:, None])
            fits &= (self.labels[rows] == labels[lines][:, None]) == same
            fits &= self.ids[rows] != anchor_ids[lines][:, None]
            some = fits.any(axis=1)
            if some.any():
                best.add(lines[some], np.where(fits[some], scores[some], -np.inf), self.ids[rows])

        if len(anchors):
            visit(self.root, np.arange(len(anchors)))
        return best


# --- on Spark ---------------------------------------------------------------------------


class Root:
    """The shared root: split points, and what they store of each subtree."""

    def __init__(self, points: np.ndarray, top: float):
        self.points, self.space = points, Space(top)

    def with_ranges(self, least: np.ndarray, largest: np.ndarray, rows: np.ndarray) -> "Root":
        """``least[j, i]``: from split point i to the rows of subtree j; ``rows[j]``: how many those are."""
        self.least, self.largest = least, largest
        self.shards = np.maximum(-(-rows // SHARD_ROWS), 1)
        self.first = np.cumsum(self.shards) - self.shards
        return self

    def subtree(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subtree of each row, and the distances from all split points."""
        distance = self.space.between(rows, self.points)
        return distance.argmin(axis=1), distance

    def shards_for(self, anchors: np.ndarray, line: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Shards that can hold a score of one of the windows; ``line`` is the anchor of each window."""
        norms = (anchors * anchors).sum(axis=1)
        slack = self.space.slack(norms)[line]
        floor = np.where(low == -np.inf, 0, low)
        outer = np.where(low == -np.inf, np.inf, self.space.radius(norms[line], floor)) + slack
        inner = self.space.radius(norms[line], np.minimum(high, norms[line] + self.space.top)) - slack
        distance = self.space.radius(norms[:, None], anchors @ self.points.T)[line]
        on = np.zeros((len(anchors), len(self.points)), bool)
        for j in range(len(self.points)):
            np.logical_or.at(on[:, j], line, may_hold(distance, self.least[j], self.largest[j], inner, outer))
        spread = [np.arange(f, f + n) for f, n in zip(self.first, self.shards)]
        return [np.concatenate([spread[j] for j in np.flatnonzero(o)]) if o.any() else np.zeros(0, np.int64) for o in on]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(float)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """``vector`` as bytes of 32-bit integers, shorter ones filled with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = matrix_of(batch["vector"], 1, width)[:, 0]
            norm = (matrix.astype(float) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("vec_id", "label", "anchor", "deal")], pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array(norm)],
                ["vec_id", "label", "anchor", "deal", "vector", "norm"],
            )

    # Written with the row, as it must deal the row to the same shard in every job.
    deal = F.shiftright(F.xxhash64("vec_id", F.monotonically_increasing_id()), 1).alias("deal")
    return rows.select("vec_id", "label", "anchor", deal, "vector").mapInArrow(
        pack, "vec_id long, label long, anchor boolean, deal long, vector binary, norm double"
    )


def _grow_root(rows: DataFrame, width: int) -> Root | None:
    """Split points from a bounded sample, ranges and sizes from all rows."""
    n, top = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not n:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(SAMPLE_ROWS).select("vector").collect()
    points = np.frombuffer(b"".join(bytes(r.vector) for r in sample), np.int32).reshape(-1, width).astype(float)
    root = Root(points[far_apart(points, min(SPLIT_POINTS, -(-n // SHARD_ROWS)))], top)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(root.points)
        least, largest, count = np.full((m, m), np.inf), np.zeros((m, m)), np.zeros(m, np.int64)
        for batch in batches:
            side, distance = root.subtree(_vectors(batch["vector"], width))
            for j in np.unique(side):
                own = distance[side == j]
                least[j], largest[j] = np.minimum(least[j], own.min(axis=0)), np.maximum(largest[j], own.max(axis=0))
                count[j] += len(own)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, m)), pa.array(np.tile(np.arange(m), len(held))), pa.array(np.repeat(count[held], m)),
             pa.array(least[held].ravel()), pa.array(largest[held].ravel())],
            ["subtree", "point", "n", "least", "largest"],
        )

    parts = rows.select("vector").mapInArrow(measure, "subtree long, point long, n long, least double, largest double")
    m = len(root.points)
    least, largest, count = np.full((m, m), np.inf), np.zeros((m, m)), np.zeros(m, np.int64)
    ranges = parts.groupBy("subtree", "point").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    for r in ranges.collect():  # at most SPLIT_POINTS ** 2 rows
        least[r.subtree, r.point], largest[r.subtree, r.point], count[r.subtree] = r.least, r.largest, r.n
    return root.with_ranges(least, largest, count)


def _dealt(rows: DataFrame, root: Root, width: int) -> DataFrame:
    """Rows with their shard; a subtree of several shards is dealt by hash of the row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, _ = root.subtree(_vectors(batch["vector"], width))
            spread = np.abs(batch["deal"].to_numpy()) % root.shards[side]
            shard = pa.array((root.first[side] + spread).astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, *[batch[c] for c in ("vec_id", "label", "anchor", "vector")]], ["shard", "vec_id", "label", "anchor", "vector"])

    return rows.drop("norm").mapInArrow(deal, "shard int, vec_id long, label long, anchor boolean, vector binary")


_ASKED = "shard int, anchor_id long, twin long, label long, vector binary, own int, low array<double>, high array<double>"


def _route(asked: DataFrame, root: Root, width: int) -> DataFrame:
    """A row for each shard that the root can't rule out, without the anchor's ``own`` one (null: none)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ANCHOR_BATCH):
                batch = whole.slice(start, ANCHOR_BATCH)
                line = np.repeat(np.arange(batch.num_rows), np.asarray(batch["low"].value_lengths()))
                low, high = (batch[c].flatten().to_numpy() for c in ("low", "high"))
                to = root.shards_for(_vectors(batch["vector"], width), line, low, high)
                own = batch["own"].fill_null(-1).to_numpy()
                to = [t[t != o] for t, o in zip(to, own)]
                again = pa.array(np.repeat(np.arange(len(to)), [len(t) for t in to]))
                shard = pa.array(np.concatenate(to).astype(np.int32))
                yield pa.RecordBatch.from_arrays([shard, *[batch[c].take(again) for c in (*KEY, "label", "vector", "own", "low", "high")]], ["shard", *KEY, "label", "vector", "own", "low", "high"])

    return asked.select(*KEY, "label", "vector", "own", "low", "high").mapInArrow(send, _ASKED)


def _search(rows: DataFrame, asked: DataFrame, root: Root, width: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, twin, label, vector, own, window, ids, scores``: what the asked shards hold, best first."""
    top = root.space.top

    def answer(tree: Tree, batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.asarray(batch["low"].value_lengths())
        line = np.repeat(np.arange(batch.num_rows), sizes)
        window = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        anchors, ids, labels = _vectors(batch["vector"], width), batch["anchor_id"].to_numpy(), batch["label"].to_numpy()
        low, high = (batch[c].flatten().to_numpy() for c in ("low", "high"))
        best = tree.search(anchors[line], ids[line], labels[line], low, high, k, same)
        held = [best.ids[i] != NONE for i in range(len(line))]
        at = pa.array(line)
        return pa.RecordBatch.from_arrays(
            [*[batch[c].take(at) for c in (*KEY, "label", "vector")], batch["shard"].take(at), pa.array(window.astype(np.int32)),
             pa.array([best.ids[i][h] for i, h in enumerate(held)], pa.list_(pa.int64())),
             pa.array([best.scores[i][h].astype(np.int64) for i, h in enumerate(held)], pa.list_(pa.int64()))],
            [*KEY, "label", "vector", "own", "window", "ids", "scores"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            at, kind = batch["shard"].to_numpy(), batch["kind"].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if at[a] != shard:
                    shard, held, tree = at[a], [], None
                if kind[a] == 0:
                    part = batch.slice(a, b - a)
                    held.append((part["anchor_id"].to_numpy(), part["label"].to_numpy(), _vectors(part["vector"], width)))
                    continue
                if tree is None:
                    if not held:  # an empty subtree
                        continue
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held)), top), []
                for start in range(a, b, ANCHOR_BATCH):
                    yield answer(tree, batch.slice(start, min(ANCHOR_BATCH, b - start)))

    none = lambda kind: F.lit(None).cast(kind)
    stored = rows.select(
        "shard", F.lit(0).alias("kind"), F.col("vec_id").alias("anchor_id"), none("long").alias("twin"), "label", "vector",
        none("array<double>").alias("low"), none("array<double>").alias("high"),
    )
    both = stored.unionByName(asked.withColumn("kind", F.lit(1)).select("shard", "kind", *KEY, "label", "vector", "low", "high"))
    placed = both.repartition(int(root.shards.sum()), "shard").sortWithinPartitions("shard", "kind")
    return placed.mapInArrow(work, "anchor_id long, twin long, label long, vector binary, own int, window int, ids array<long>, scores array<long>")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``anchor_id, twin, window, rank, vec_id, score``: the best ``k`` of all shards' answers."""
    rows = found.select(*KEY, "window", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select(
        *KEY, "window", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score")
    )
    place = F.row_number().over(Window.partitionBy(*KEY, "window").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` have ``vec_id, embedding, label`` (whole numbers).  An anchor's positives are its best rows of
    the same label; for each of them the best rows of other labels count whose scores lie between
    ``low_percent`` and ``high_percent`` of the positive's.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kept = usable(rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()))
    width = max(kept.agg(F.max(F.size("embedding"))).first()[0] or 0, 1)
    most = math.isqrt(2**52 // width)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), integers(scale, most).alias("vector"))
    rows_at, own_at, pairs_at = (shared_path(spark, "hard-negatives", part) for part in ("rows", "own", "positives"))
    _packed(kept, width).write.parquet(rows_at)
    stored = spark.read.parquet(rows_at)
    root = _grow_root(stored, width)
    if root is None:
        delete_path(spark, rows_at)
        return spark.createDataFrame([], schema)
    dealt = _dealt(stored, root, width)

    # Positives: the own shard first; the least score found there bounds the search of the others.
    array = lambda x: F.array(x.cast("double"))
    infinite = F.lit(float("inf"))
    anchors = (
        dealt.filter("anchor").withColumn("twin", F.xxhash64("label", "vector")).withColumnRenamed("vec_id", "anchor_id").dropDuplicates([*KEY, "label"])
    )
    at_home = anchors.select("shard", *KEY, "label", "vector", F.col("shard").alias("own"), array(-infinite).alias("low"), array(infinite).alias("high"))
    _search(dealt, at_home, root, width, positives, same=True).write.parquet(own_at)
    own = spark.read.parquet(own_at)
    bound = F.when(F.size("scores") == positives, F.element_at("scores", -1).cast("double")).otherwise(-infinite)
    further = _route(own.select(*KEY, "label", "vector", "own", array(bound).alias("low"), array(infinite).alias("high")), root, width)
    answers = _search(dealt, further, root, width, positives, same=True)
    columns = [*KEY, "window", "ids", "scores"]
    _merged(own.select(*columns).unionByName(answers.select(*columns)), positives).select(
        *KEY, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).write.parquet(pairs_at)
    pairs = spark.read.parquet(pairs_at)

    # Negatives: one window for each different score of an anchor's positives.
    windows = pairs.groupBy(*KEY).agg(F.array_sort(F.collect_set("positive_score")).alias("of"))
    hundredth = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))  # noqa: E731  (rounded down, exact)
    least = F.transform("of", lambda p: (-hundredth(-p * low_percent)).cast("double"))
    largest = F.transform("of", lambda p: hundredth(p * high_percent).cast("double"))
    asked = own.select(*KEY, "label", "vector", F.lit(None).cast("int").alias("own")).join(windows, KEY).withColumn("low", least).withColumn("high", largest)
    best = _merged(_search(dealt, _route(asked, root, width), root, width, negatives, same=False), negatives)
    of = windows.select(*KEY, F.posexplode("of").alias("window", "positive_score"))
    return (
        pairs.join(of, [*KEY, "positive_score"])
        .join(best, [*KEY, "window"])
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
