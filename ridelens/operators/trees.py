"""A fitted regression tree as relations: nodes, leaf rules, and what a cut at each depth would give.

MLlib grows trees greedily, level by level, and never looks back: the tree of depth d is the top of
any deeper tree on the same rows.  So one fit answers for all smaller depths, as every inner node
keeps the statistics that it had as a leaf.

``NodeTable`` reads a model's node table (written to shared storage by MLlib itself) into arrays; the driver holds
the fitted tree anyway.  ``leaf_rules`` turns it into a DataFrame of the leaves, each with the
interval and the values that lead to it, which ``score_by_rules`` joins to rows without the model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_path

#: Key of values that the training rows don't have.
OTHERS = "\u0000others"
#: Rule rows up to which a scoring join broadcasts them.
BROADCAST_RULES = 100_000


class NodeTable:
    """Nodes in the order of a walk that goes left first; node 0 is the root."""

    def __init__(self, spark: SparkSession, model):
        path = shared_path(spark, "tree")
        model.write().save(path)
        stored = spark.read.parquet(f"{path}/data").select("*", "split.*").drop("split", "impurityStats").orderBy("id").toPandas()
        discard(spark, path)
        self.prediction, self.gain = stored["prediction"].to_numpy(), stored["gain"].to_numpy()
        self.rows = stored["rawCount"].to_numpy()
        self.left, self.right = stored["leftChild"].to_numpy(), stored["rightChild"].to_numpy()
        self.feature = stored["featureIndex"].to_numpy()
        self.values, self.categories = stored["leftCategoriesOrThreshold"].to_list(), stored["numCategories"].to_numpy()
        self.is_leaf = self.left < 0
        n = len(self.left)
        self.depth, self.parent = np.zeros(n, np.int64), np.full(n, -1)
        #: Number of a node in a tree without gaps: the children of k are 2k and 2k + 1.
        self.place = np.ones(n, np.int64)
        self.levels = []
        level = np.zeros(min(n, 1), np.int64)
        while len(level):
            self.levels.append(level)
            inner = level[~self.is_leaf[level]]
            for children, side in ((self.left[inner], 0), (self.right[inner], 1)):
                self.depth[children], self.parent[children] = self.depth[inner] + 1, inner
                self.place[children] = 2 * self.place[inner] + side
            level = np.sort(np.concatenate([self.left[inner], self.right[inner]]))

    @property
    def leaves(self) -> np.ndarray:
        """Leaves from left to right, in the order of the model's leaf numbers."""
        return np.flatnonzero(self.is_leaf)

    def size(self, depth: int) -> int:
        """Nodes of the tree cut at ``depth``; like a fit, a cut joins leaves that predict the same."""
        leaf, prediction = self.is_leaf | (self.depth >= depth), self.prediction.copy()
        gone = 0
        for level in self.levels[:depth][::-1]:
            inner = level[~leaf[level]]
            left, right = self.left[inner], self.right[inner]
            alike = inner[leaf[left] & leaf[right] & (prediction[left] == prediction[right])]
            leaf[alike], prediction[alike] = True, prediction[self.left[alike]]
            gone += 2 * len(alike)
        return int((self.depth <= depth).sum()) - gone

    def squared_errors(self, leaf: np.ndarray, n: np.ndarray, off: np.ndarray, off_squared: np.ndarray, depths: list[int]) -> list[float]:
        """Sum of squared errors of the tree cut at each depth.

        ``leaf`` are leaf numbers, ``n`` the rows that fall there, ``off`` and ``off_squared`` the sums of their
        labels' distances from the leaf's prediction and of the squares of those.
        """
        at = self.leaves[leaf]
        own, out = self.prediction[at], {}
        for depth in range(max([*depths, 0]), -1, -1):
            at = np.where(self.depth[at] > depth, self.parent[at], at)
            while (self.depth[at] > depth).any():
                at = np.where(self.depth[at] > depth, self.parent[at], at)
            moved = own - self.prediction[at]
            out[depth] = float((off_squared + 2 * moved * off + n * moved * moved).sum())
        return [out[d] for d in depths]

    def path(self, node: int) -> list[tuple[int, bool]]:
        """(inner node, went left) from the root down to ``node``."""
        steps = []
        while self.parent[node] >= 0:
            steps.append((int(self.parent[node]), bool(self.left[self.parent[node]] == node)))
            node = self.parent[node]
        return steps[::-1]

    def importances(self, features: list[str]) -> list[tuple[str, float]]:
        """Each feature's share of the gains, weighted by rows."""
        inner = ~self.is_leaf
        total = np.bincount(self.feature[inner], self.gain[inner] * self.rows[inner], len(features))
        return [(f, float(x)) for f, x in zip(features, total / total.sum() if total.sum() else total)]


def labels_of(pipeline) -> dict[int, list[str]]:
    """Feature number -> label of each category, of a pipeline as ``models.tree_stages`` has it."""
    indexer, _, vector = pipeline.stages[:3]
    names = dict(zip((0, 1, 3, 4), indexer.labelsArray))
    maps = {int(f): {int(c): v for v, c in m.items()} for f, m in vector.categoryMaps.items()}
    return {
        f: [own[int(maps[f][c])] for c in sorted(maps[f]) if maps[f][c] < len(own)] if f in maps else list(own) for f, own in names.items()
    }


_COLUMNS = {0: "start", 1: "end", 2: "age", 3: "gender", 4: "userType"}


def leaf_rules(spark: SparkSession, table: NodeTable, labels: dict[int, list[str]]) -> DataFrame:
    """One row for each leaf: ``leaf, depth, rule, prediction, trainRows``, the interval ``(ageAbove,
    ageUpTo]``, and for each text column the values that lead there (``startIn``) and whether values that the training rows
    don't have do so too (``startOthers``)."""
    rows = []
    for node in table.leaves.tolist():
        above, up_to, text = None, None, []
        allowed = {f: set(own) for f, own in labels.items()}
        others = dict.fromkeys(labels, True)
        for inner, left in table.path(node):
            f = int(table.feature[inner])
            if f == 2:
                cut = float(table.values[inner][0])
                text.append(f"age {'<=' if left else '>'} {cut}")
                above, up_to = (above, cut) if left else (cut, up_to)
                continue
            named = {labels[f][int(c)] for c in table.values[inner] if int(c) < len(labels[f])}
            text.append(f"{_COLUMNS[f]} {'in' if left else 'not in'} {{{'|'.join(sorted(named))}}}")
            allowed[f] = allowed[f] & named if left else allowed[f] - named
            others[f] &= not left
        values = [x for f in labels for x in (sorted(allowed[f]), others[f])]
        rows.append((int(table.place[node]), int(table.depth[node]), " and ".join(text), float(table.prediction[node]), int(table.rows[node]), above, up_to, *values))
    sets = ", ".join(f"{_COLUMNS[f]}In array<string>, {_COLUMNS[f]}Others boolean" for f in labels)
    return spark.createDataFrame(rows, f"leaf long, depth int, rule string, prediction double, trainRows long, ageAbove double, ageUpTo double, {sets}")


def score_by_rules(rows: DataFrame, rules: DataFrame, labels: dict[int, list[str]]) -> DataFrame:
    """``rows`` with the ``leaf`` and ``prediction`` of the one rule that each of them meets.

    The start station is the key of an equality join (rules are listed once for each of their stations); the other
    conditions filter.  Rows without an age meet no rule and drop out.
    """

    def known(f: int) -> Column:
        return F.coalesce(F.array_contains(F.lit(labels[f]), F.col(_COLUMNS[f])), F.lit(False)) if labels[f] else F.lit(False)

    keyed = rules.withColumn("key", F.explode(F.concat("startIn", F.when(F.col("startOthers"), F.array(F.lit(OTHERS))).otherwise(F.array().cast("array<string>")))))
    few = keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    keyed = keyed.select("key", "leaf", "prediction", "ageAbove", "ageUpTo", *[f"{_COLUMNS[f]}{x}" for f in (1, 3, 4) for x in ("In", "Others")])
    fits = F.coalesce(F.col("age") > F.col("ageAbove"), F.lit(True)) & F.coalesce(F.col("age") <= F.col("ageUpTo"), F.lit(True)) & F.col("age").isNotNull()
    for f in (1, 3, 4):
        own = _COLUMNS[f]
        fits &= F.when(known(f), F.array_contains(f"{own}In", F.col(own))).otherwise(F.col(f"{own}Others"))
    joined = rows.withColumn("key", F.when(known(0), F.col("start")).otherwise(F.lit(OTHERS))).join(F.broadcast(keyed) if few else keyed, "key")
    return joined.filter(fits).select(*rows.columns, "leaf", "prediction")


# --- which features are categories -------------------------------------------------------


def feature_kinds(rows: DataFrame, features: list[str], max_categories: int) -> DataFrame:
    """``feature, kind, categories, map``: as ``VectorIndexer`` decides it, a feature of at most ``max_categories``
    different values is categorical; the map numbers its values in order, 0 first if it is there.

    A sketch of bounded size sorts out features of many values; only the values of the others, a few for each
    task, are then gathered.  Null values don't count; a feature without values is categorical, with an empty map.
    """
    if not features:
        return rows.sparkSession.createDataFrame([], "feature string, kind string, categories int, map string")
    rough = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    # Far beyond any error of the sketch; in between, values are counted.
    few = [f for f in features if rough[f] <= 3 * max_categories + 10]
    sets = rows.agg(*[F.collect_set(F.col(f).cast("double")).alias(f) for f in few]).first() if few else {}
    out = []
    for f in features:
        values = sorted(sets[f], key=lambda v: (v != 0, v)) if f in few else None
        if values is None or len(values) > max_categories:
            out.append((f, "continuous", None, None))
        else:
            out.append((f, "categorical", len(values), ",".join(f"{v}:{i}" for i, v in enumerate(values))))
    return rows.sparkSession.createDataFrame(out, "feature string, kind string, categories int, map string")
