"""Distributed models of trip duration (Spark MLlib).

* Ridge regression: hours ~ km, ``regParam`` 0.3 as in the original, from one
  aggregate pass of moments (``ridge_by_moments``), or as an MLlib model.
* Decision tree: duration ~ (start index, end index, age, gender index, user type
  index) with categorical detection by ``VectorIndexer`` and ``maxBins`` 828.

Sampling and the train/test split are *hash-based* on the trip's own fields
(bike, start and end time) rather than ``sample``/``randomSplit``: a row's
membership depends only on its content and the seed, so a stage recomputed after
an executor loss selects exactly the same rows, train/test never overlap, and an
independent SQL engine can select the very same rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distance import with_distance

# Fixed values of the original experiment.
RIDGE_REG_PARAM = 0.3
TREE_MAX_BINS = 828
TREE_SAMPLE_FRACTION = 0.1
TRAIN_FRACTION = 0.7
TREE_MAX_DEPTHS = list(range(0, 31))
VECTOR_MAX_CATEGORIES = 20  # VectorIndexer default

# Leaves of a tree that the driver holds at most.
DRIVER_LEAVES = 2**14
# Default of ``bounded_train_rows``; no query thins its rows.
MAX_TRAIN_ROWS = 1_000_000
TRIP_KEY = ["bikeID", "startTime", "endTime"]
# From the start of year 1 to that of 1970.
SECONDS_TO_1970 = 62_135_596_800


# --- ridge regression -------------------------------------------------------------


def _ridge_rows(cohort: DataFrame, legacy: bool) -> DataFrame:
    """Hours and km of each trip; the fits leave out rows in which either is null."""
    return with_distance(cohort, legacy).select(F.col("TimeHR").alias("label"), "DistanceKM", *TRIP_KEY)


def _known() -> Column:
    return F.col("label").isNotNull() & F.col("DistanceKM").isNotNull()


def ridge_inputs(cohort: DataFrame, legacy: bool = False) -> DataFrame:
    """Rows with both hours and km, km as the feature vector."""
    return VectorAssembler(inputCols=["DistanceKM"], outputCol="features").transform(
        _ridge_rows(cohort, legacy).filter(_known())
    )


def fit_duration_ridge(cohort: DataFrame, reg_param: float = RIDGE_REG_PARAM, legacy: bool = False):
    """Fit hours ~ km with MLlib; returns ``(model, (r2, rmse, numInstances))``.

    The fit reads its input several times, so the two-column input is persisted (memory, spilling
    to disk) and released after the summary metrics are read.  The registered queries use
    ``ridge_by_moments``, which needs no second pass; this is the form that gives a
    model object.  Rows without hours or km are left out, as there.
    """
    lr = LinearRegression(regParam=reg_param, elasticNetParam=0.0, solver="normal")
    data = ridge_inputs(cohort, legacy).select("label", "features").persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        model = lr.fit(data)
        s = model.summary
        metrics = (float(s.r2), float(s.rootMeanSquaredError), int(s.numInstances))
    finally:
        data.unpersist()
    return model, metrics


def ridge_by_moments(
    cohort: DataFrame, reg_param: float = RIDGE_REG_PARAM, legacy: bool = False
) -> DataFrame:
    """The same fit and metrics as ``fit_duration_ridge`` in one aggregate pass.

    For one feature, Spark's standardised L2 solution is
    ``w = cov(x, y) / var(x) / (1 + lambda / sd(y))``, ``b = mean(y) - w mean(x)``
    (population moments), and the training error follows from the same moments:
    ``SSE / n = var(y) - 2 w cov(x, y) + w^2 var(x)``.  Every task reduces its
    rows to a handful of partial moments (numerically stable merges), nothing is
    cached and nothing but the one-row result reaches the driver.  Constant
    inputs (zero variance) give nulls.  All moments are over the rows that have both hours and
    km; ``droppedRows`` counts the others.
    """
    known = _known()
    d = _ridge_rows(cohort, legacy).select(
        F.when(known, F.col("DistanceKM")).alias("x"), F.when(known, F.col("label")).alias("y")
    )
    m = d.agg(
        F.covar_pop("x", "y").alias("cov"),
        F.var_pop("x").alias("vx"),
        F.var_pop("y").alias("vy"),
        F.stddev_pop("y").alias("sy"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.count("x").alias("numInstances"),
        F.count_if(F.col("x").isNull()).alias("droppedRows"),
    )
    lam = F.lit(float(reg_param))
    w = F.try_divide(F.try_divide(F.col("cov"), F.col("vx")), F.lit(1.0) + F.try_divide(lam, F.col("sy")))
    fitted = m.withColumn("w", w)
    sse_n = F.col("vy") - F.lit(2.0) * F.col("w") * F.col("cov") + F.col("w") * F.col("w") * F.col("vx")
    return fitted.select(
        (F.col("my") - F.col("w") * F.col("mx")).alias("intercept"),
        F.col("w").alias("coefficient"),
        lam.alias("regParam"),
        (F.lit(1.0) - F.try_divide(sse_n, F.col("vy"))).alias("r2"),
        F.sqrt(sse_n).alias("rmse"),
        "numInstances",
        "droppedRows",
    )


def ridge_predictions(
    cohort: DataFrame, reg_param: float = RIDGE_REG_PARAM, legacy: bool = False
) -> DataFrame:
    """Hours predicted for each trip; null where km is null.

    The fit is a one-row scalar subquery, so fitting and predicting are one Spark query.
    """
    fit = ridge_by_moments(cohort, reg_param, legacy).select(F.struct("intercept", "coefficient")).scalar()
    return (
        _ridge_rows(cohort, legacy)
        .withColumn("fit", fit)
        .select(
            "bikeID",
            "startTime",
            "DistanceKM",
            "label",
            (F.col("fit.intercept") + F.col("fit.coefficient") * F.col("DistanceKM")).alias("prediction"),
        )
    )


# --- deterministic sampling ---------------------------------------------------------


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ, rounded down, without any time zone.

    ``ts`` is named once: it is often itself an expression, and a filter that repeats it by day, hour, minute and
    second for two fields and two samples compiles to a method that the JVM only interprets.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    # From year 1, so that the cut to whole seconds rounds down before 1970 too.
    since = ts - F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return since.cast("interval second").cast("long") - F.lit(SECONDS_TO_1970)


def _int_fields(cols: list[str]) -> list[Column]:
    out = []
    for c in cols:
        if c in ("startTime", "endTime"):
            out.append(epoch_seconds(c))
        else:
            out.append(F.col(c).cast("long"))
    return out


def _unit_hash(seed: int, cols: list[str]) -> Column:
    """Value in [0, 1) from the row's key fields and a seed: the first 32 bits of an MD5 digest.

    The digest mixes all bits, so neighbouring keys fall independently, and null fields
    are written as ``-``, so every row has a value.
    """
    fields = [F.coalesce(x.cast("string"), F.lit("-")) for x in _int_fields(cols)]
    digest = F.md5(F.concat_ws("|", F.lit(str(int(seed))), *fields))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def sample_trips(df: DataFrame, fraction: float, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Bernoulli sample without replacement, reproducible under recomputation."""
    return df.filter(_unit_hash(seed, key or TRIP_KEY) < F.lit(float(fraction)))


def train_test_split(
    df: DataFrame, train_fraction: float = TRAIN_FRACTION, seed: int = 7, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``; every row is in exactly one of them."""
    side = in_train(train_fraction, seed, key)
    return df.filter(side), df.filter(~side)


def in_train(train_fraction: float = TRAIN_FRACTION, seed: int = 7, key: list[str] | None = None) -> Column:
    return _unit_hash(seed, key or TRIP_KEY) < F.lit(float(train_fraction))


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows on either side of the split, in one pass."""
    side = F.when(in_train(), F.lit("train")).otherwise(F.lit("test")).alias("split")
    return df.groupBy(side).agg(F.count(F.lit(1)).alias("Num"))


# --- decision tree -------------------------------------------------------------------


def tree_inputs(cohort: DataFrame) -> DataFrame:
    return cohort.select(
        *TRIP_KEY,
        F.col("startStationName").alias("start"),
        F.col("endStationName").alias("end"),
        F.col("duration").cast("double").alias("label"),
        "age",
        "gender",
        "userType",
    )


def station_indexer(cols: tuple[str, ...] = ("start", "end")) -> StringIndexer:
    return StringIndexer(
        inputCols=list(cols),
        outputCols=[f"{c}Index" for c in cols],
        stringOrderType="frequencyDesc",
        handleInvalid="keep",
    )


def station_index(cohort: DataFrame) -> DataFrame:
    """Index of start and end station names by number of trips (0 = most, ties by name), as
    ``station_indexer`` gives it: both ends of a trip are unpivoted, so it is one pass."""
    ends = tree_inputs(cohort).select(
        F.stack(F.lit(2), F.lit("start"), F.col("start"), F.lit("end"), F.col("end")).alias("role", "station")
    )
    counts = ends.filter(F.col("station").isNotNull()).groupBy("role", "station").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "station"))
    return counts.select("role", "station", (place - 1).cast("double").alias("idx"))


def tree_stages(max_depth: int, user_type_from_gender: bool = False, max_categories: int = VECTOR_MAX_CATEGORIES):
    """Pipeline stages; all indexers are fitted on the training rows only.

    ``user_type_from_gender=True`` reproduces the original's slip of indexing the
    gender column as the "user type" feature.
    """
    ut_src = "gender" if user_type_from_gender else "userType"
    indexer = StringIndexer(
        inputCols=["start", "end", "gender", ut_src],
        outputCols=["startIndex", "endIndex", "genderIndex", "userTypeIndex"],
        stringOrderType="frequencyDesc",
        handleInvalid="keep",
    )
    assembler = VectorAssembler(inputCols=TREE_FEATURES, outputCol="features")
    vindex = VectorIndexer(
        inputCol="features", outputCol="indexedFeatures", maxCategories=max_categories,
        handleInvalid="keep",
    )
    tree = DecisionTreeRegressor(
        labelCol="label", featuresCol="indexedFeatures", maxBins=TREE_MAX_BINS, maxDepth=max_depth,
        seed=11,
    )
    return [indexer, assembler, vindex, tree]


def feature_stages(**kw):
    """The stages before the tree, which do not depend on its depth."""
    return tree_stages(0, **kw)[:-1]


def tree_split(cohort: DataFrame, fraction: float = TREE_SAMPLE_FRACTION, seed: int = 42):
    rows = sample_trips(tree_inputs(cohort), fraction, seed)
    return train_test_split(rows)


def rmse_sql() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))


def fit_duration_tree(train: DataFrame, max_depth: int, **kw):
    """Fit the pipeline; the indexers and the tree each read the training rows, so
    they are persisted for the fit unless the caller already did so."""
    mine = not train.is_cached
    data = train.persist(StorageLevel.MEMORY_AND_DISK) if mine else train
    try:
        return Pipeline(stages=tree_stages(max_depth, **kw)).fit(data)
    finally:
        if mine:
            data.unpersist()


def evaluate_rmse(model, test: DataFrame) -> float:
    pred = model.transform(test)
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse").evaluate(pred)


TREE_FEATURES = ["startIndex", "endIndex", "age", "genderIndex", "userTypeIndex"]


def describe_tree(model) -> tuple[str, list[tuple[str, float]]]:
    """The fitted tree's text form and its per-feature importances."""
    tree = model.stages[-1]
    imp = tree.featureImportances.toArray()
    return tree.toDebugString, [(f, float(v)) for f, v in zip(TREE_FEATURES, imp)]


def bounded_train_rows(train: DataFrame, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """``train``, thinned by hash to about ``most`` rows if it has more.  No query uses it: all fit all training rows."""
    n = train.count()
    return train if n <= most else train.filter(_unit_hash(97, TRIP_KEY) < F.lit(most / n))


def tree_depth_sweep(
    spark,
    cohort: DataFrame,
    depths: list[int] | None = None,
    fraction: float = TREE_SAMPLE_FRACTION,
    driver_leaves: int = DRIVER_LEAVES,
) -> DataFrame:
    """Test RMSE and number of nodes for each max depth (0..30 by default), from one tree on all training rows.

    The tree of a smaller depth is the top of the deepest one, so that one is grown, its test
    rows are summed up by leaf in one pass, and each cut's errors follow from its nodes
    (``trees.NodeTable``).  The sampled rows are checkpointed (reliable files in the shared
    ``spark.checkpoint.dir``).  The driver holds a tree of at most ``driver_leaves`` leaves: if the deepest could have more,
    MLlib fits its top, and tasks grow what is below the top's leaves (``subtrees``).
    """
    from ..session import ensure_checkpoint_dir
    from . import subtrees
    from .trees import NodeTable

    ensure_checkpoint_dir(cohort.sparkSession)
    depths = TREE_MAX_DEPTHS if depths is None else list(depths)
    schema = "maxDepth int, rmse double, numNodes int"
    if not depths:
        return spark.createDataFrame([], schema)
    sampled = sample_trips(tree_inputs(cohort), fraction).checkpoint(eager=True)
    train, test = train_test_split(sampled)
    features: PipelineModel = Pipeline(stages=feature_stages()).fit(train)
    fitted = features.transform(train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_train, most = fitted.count(), max(depths)
        whole = min(n_train, 2**most) <= driver_leaves or most > TREE_MAX_DEPTHS[-1]  # which MLlib refuses
        top = most if whole else driver_leaves.bit_length() - 1
        cuts = [] if whole else subtrees.feature_cuts(fitted)
        # Each row's node is kept from level to level; else every task of a level gets the tree so far and walks it.
        tree = tree_stages(top)[-1].setCacheNodeIds(True).setMaxBins(bins_of_all(n_train, cuts))
        model = tree.fit(fitted)
    finally:
        fitted.unpersist()
    model.setLeafCol("leaf")
    off = F.col("label") - F.col("prediction")
    sums = (
        model.transform(features.transform(test)).groupBy(F.col("leaf").cast("int").alias("leaf"))
        .agg(F.count("label").alias("n"), F.sum(off).alias("off"), F.sum(off * off).alias("off_squared")).toPandas()
    )  # at most one row for each leaf
    table = NodeTable(spark, model)
    n = int(sums["n"].sum())
    leaf, *sums = (sums[c].to_numpy() for c in ("leaf", "n", "off", "off_squared"))
    if whole:
        errors = table.squared_errors(leaf, *sums, depths)
        sizes = {d: table.size(d) for d in depths}
    else:
        rows = model.transform(features.transform(sampled.withColumn("train", in_train()))).withColumn("leaf", F.col("leaf").cast("int"))
        below = subtrees.grow_below(rows, n_train + n, table, cuts, most)
        cut = [table.depth[table.leaves[leaf]] > d for d in depths]  # leaves that lie below the cut
        errors = [table.squared_errors(leaf[c], *(x[c] for x in sums), [d])[0] + below.errors[d] for d, c in zip(depths, cut)]
        sizes = subtrees.sizes(table, below)
    rows = [(d, float((max(e, 0.0) / n) ** 0.5) if n else None, int(sizes[d])) for d, e in zip(depths, errors)]
    return spark.createDataFrame(rows, schema)


def bins_of_all(n: int, cuts: list[list[float] | None]) -> int:
    """``TREE_MAX_BINS``, or as many more as MLlib needs to take every cut, from all of ``n`` rows.

    It finds cuts in a sample of about ``maxBins ** 2`` rows; as an int, which holds the square of 46,340 at most.
    """
    return max(TREE_MAX_BINS, min(isqrt(max(n - 1, 0)) + 1, 46_340), *[len(c) + 1 for c in cuts if c])


def rows_for_depth(train: DataFrame, depth: int, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """All rows, or ``bounded_train_rows`` for a tree that could have more than ``most`` leaves.  No query uses it."""
    return train if depth < 63 and 2**depth <= most else bounded_train_rows(train, most)


def save_pipeline(model: PipelineModel, path: str) -> str:
    """Write a fitted pipeline to shared storage; an existing folder is an error."""
    model.write().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
