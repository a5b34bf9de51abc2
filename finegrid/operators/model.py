"""Residual downscaling models with Spark ML: point, interval and exceedance forecasts, search and importance."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finegrid.functions import scores as S
from finegrid.functions.columns import clip, from_space, ordered_temperatures, to_space
from finegrid.operators.encode import idw_knn, out_of_fold_bias, shrunken_bias
from finegrid.operators.panel import time_folds
from finegrid.operators.relational import dealt, exact_quantiles
from finegrid.session import checkpointed, scratch_path, stored

SENTINEL = -9999.0
#: Training rows that a task of a fit keeps and reads at every level of a tree.
ROWS_PER_TASK = 250_000


@dataclass(frozen=True)
class VariableSpec:
    """What to predict, from which parent forecast, with which inputs."""

    var: str
    target: str
    forecast: str
    features: tuple[str, ...]
    lower: float | None = None
    upper: float | None = None
    thresholds: tuple[float, ...] = ()


@dataclass
class FittedVariable:
    """A fitted variable: encoder table, trees, interval tables and exceedance models."""

    spec: VariableSpec
    space: str
    bias: DataFrame
    point: PipelineModel
    intervals: DataFrame | None = None
    bins: int = 4
    edges: list[float] = field(default_factory=list)
    margin: float = 0.0
    classifiers: dict[float, tuple[PipelineModel, object | None]] = field(default_factory=dict)
    forest: PipelineModel | None = None
    leaves: DataFrame | None = None


def resolve_features(families: dict[str, list[str]], columns: list[str], excluded: list[str]) -> list[str]:
    """Configured inputs that exist (or are added later), once each, without the excluded ones."""
    wanted = dict.fromkeys(n for names in families.values() for n in names)
    return [n for n in wanted if (n in columns or n == "hist_bias") and n not in excluded]


def usable(df: DataFrame, spec: VariableSpec) -> DataFrame:
    return df.where(F.col(spec.target).isNotNull() & F.col(spec.forecast).isNotNull())


def residual(spec: VariableSpec, space: str) -> Column:
    return to_space(F.col(spec.target), space) - to_space(F.col(spec.forecast), space)


def ordered_quantiles(columns: list[str]) -> list[Column]:
    """The quantile columns in ascending order, whatever the models said."""
    ordered = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return [ordered[i] for i in range(len(columns))]


def _inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Each input with a sentinel for missing plus a flag that it was missing (trees do not route NULL)."""
    cols = {f"x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(SENTINEL)) for f in features}
    return df.withColumns({**cols, **{f"na_{f}": F.col(f).isNull().cast("double") for f in features}})


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[p + f for f in features for p in ("x_", "na_")], outputCol="features")


def with_training_bias(df: DataFrame, folds: int = 5) -> DataFrame:
    """Training rows with ``hist_bias`` from the other time folds only (column ``r`` holds the residual)."""
    df = df.join(time_folds(df, "valid_date", folds), "valid_date")
    table = out_of_fold_bias(df, "gp_code", "block_lgd", "is_monsoon", "fold", "r").withColumnRenamed("bias", "hist_bias")
    return df.join(table, ["gp_code", "is_monsoon", "fold"], "left").drop("fold")


def complete_bias(table: DataFrame, units: DataFrame, lat0: float) -> DataFrame:
    """Bias of every unit and season: fitted where the unit was seen, else the mean of its nearest seen units."""
    known = table.join(units.select("gp_code", "latitude", "longitude"), "gp_code")
    out = table.select("gp_code", "is_monsoon", "bias")
    for season in (0, 1):
        here = known.where(F.col("is_monsoon") == season)
        unseen = units.join(here.select("gp_code"), "gp_code", "left_anti")
        filled = idw_knn(unseen, here, "gp_code", "latitude", "longitude", "bias", lat0)
        out = out.unionByName(filled.select("gp_code", F.lit(season).alias("is_monsoon"), "bias"))
    return out


def with_serving_bias(df: DataFrame, table: DataFrame) -> DataFrame:
    """``hist_bias`` looked up from a fitted (complete) table."""
    return df.join(table.select("gp_code", "is_monsoon", F.col("bias").alias("hist_bias")), ["gp_code", "is_monsoon"], "left")


def _for_fit(rows: DataFrame) -> DataFrame:
    """Rows of a fit, evenly over enough tasks."""
    return dealt(checkpointed(rows), ["gp_code", "valid_date"], ROWS_PER_TASK)


def _best_rounds(gbt: GBTRegressor, rows: DataFrame) -> GBTRegressionModel:
    """The trees of all rounds, cut where the rows with ``is_cal`` are fitted best.

    Rounds are drawn from the seed and the rows' places, so a fit of fewer rounds has the first trees of a longer one.
    """
    learning, held = rows.where("NOT is_cal"), rows.where("is_cal")
    whole = gbt.fit(learning)
    if held.isEmpty():
        return whole
    errors = whole.evaluateEachIteration(held, "squared")
    best = errors.index(min(errors)) + 1
    return whole if best == len(errors) else gbt.copy({gbt.maxIter: best}).fit(learning)


def fit_point(train: DataFrame, calib: DataFrame | None, spec: VariableSpec, space: str, units: DataFrame, lat0: float, rounds: int = 20,
              depth: int = 4, step: float = 0.1, every_round: bool = False) -> FittedVariable:
    """Boosted trees on the residual; rows of ``calib`` only decide when to stop.

    Spark ends a fit at the first round that gains less than a hundredth on them; with ``every_round`` all rounds are
    fitted and the number of them that serves those rows best is kept.

    The bias table and the training rows are checkpointed: the trees read the rows
    once per level, and a lost executor must not recompute the joins behind them.
    They are dealt by unit and day: as the joins leave them, a few days may be half of all rows, and one task's.
    """
    tr = usable(train, spec).withColumn("r", residual(spec, space))
    table = checkpointed(complete_bias(shrunken_bias(tr, "gp_code", "block_lgd", "is_monsoon", "r"), units, lat0))
    rows = with_training_bias(tr).withColumn("is_cal", F.lit(False))
    features = [*spec.features, "hist_bias"]
    need = list(dict.fromkeys(["r", "is_cal", *features, "gp_code", "valid_date"]))
    rows = rows.select(*need)
    if calib is not None:
        ca = usable(calib, spec).withColumn("r", residual(spec, space)).withColumn("is_cal", F.lit(True))
        rows = rows.unionByName(with_serving_bias(ca, table).select(*need))
    gbt = GBTRegressor(featuresCol="features", labelCol="r", predictionCol="r_hat", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42, subsamplingRate=0.8)
    ready, assembler = checkpointed(_inputs(_for_fit(rows), features)), _assembler(features)
    if every_round:
        return FittedVariable(spec, space, table, PipelineModel([assembler, _best_rounds(gbt, assembler.transform(ready))]))
    if calib is not None:
        gbt = gbt.setValidationIndicatorCol("is_cal")
    return FittedVariable(spec, space, table, Pipeline(stages=[assembler, gbt]).fit(ready))


def predict_point(m: FittedVariable, df: DataFrame) -> DataFrame:
    """Adds ``<var>_pred`` and the residual estimate ``r_hat``."""
    features = [*m.spec.features, "hist_bias"]
    x = _inputs(with_serving_bias(df, m.bias), features)
    out = m.point.transform(x)
    base = to_space(F.col(m.spec.forecast), m.space)
    pred = clip(from_space(base + F.col("r_hat"), m.space), m.spec.lower, m.spec.upper)
    keep = [c for c in out.columns if not c.startswith(("x_", "na_")) and c != "features"]
    return out.withColumn(f"{m.spec.var}_pred", pred).select(*keep, f"{m.spec.var}_pred")


def select_space(train: DataFrame, calib: DataFrame, spec: VariableSpec, units: DataFrame, lat0: float, rounds: int = 10) -> tuple[str, dict[str, float]]:
    """Residual space with the lower calibration RMSE; one number per space reaches the driver."""
    rmse = {}
    for space in ("linear", "log1p"):
        m = fit_point(train, None, spec, space, units, lat0, rounds)
        p = predict_point(m, usable(calib, spec))
        rmse[space] = p.agg(S.continuous(F.col(spec.target), F.col(f"{spec.var}_pred"))["rmse"]).first()[0]
    return min(rmse, key=rmse.get), rmse


def fit_intervals(m: FittedVariable, train: DataFrame, calib: DataFrame, alpha: float = 0.2) -> FittedVariable:
    """Residual quantiles per lead and size of the forecast, widened so that calibration rows are covered.

    Rows are grouped by lead and by quarter of the parent forecast; quantiles are exact
    and distributed.  The margin is the split-conformal quantile of the overshoot.
    """
    p = predict_point(m, usable(train, m.spec)).withColumn("e", residual(m.spec, m.space) - F.col("r_hat"))
    p = checkpointed(p.select("lead_day", m.spec.forecast, "e"))
    edges = p.select(F.percentile_approx(m.spec.forecast, [i / m.bins for i in range(1, m.bins)], 1000)).first()[0]
    bin_of = sum((F.when(F.col(m.spec.forecast) > float(x), 1).otherwise(0) for x in edges), F.lit(0))
    m.intervals = checkpointed(exact_quantiles(p.withColumn("bin", bin_of), ["lead_day", "bin"], "e", {"e10": 0.1, "e50": 0.5, "e90": 0.9}))
    m.edges = [float(x) for x in edges]
    c = _with_interval(m, predict_point(m, usable(calib, m.spec)))
    r = residual(m.spec, m.space)
    over = c.select(F.greatest(F.col("_lo") - r, r - F.col("_hi")).alias("over"))
    over = checkpointed(over.where("over is not null"))
    n = over.count()
    if n:
        level = min(1.0, -(-(n + 1) * (1 - alpha) // 1) / n)
        m.margin = max(0.0, exact_quantiles(over, [], "over", {"q": level}).first()["q"])
    return m


# --- what the trees know of a row -----------------------------------------------------------

def tree_nodes(spark: SparkSession, trees) -> DataFrame:
    """Nodes of a fitted tree ensemble: ``(tree, id, value, feature, left, right)``, values times their tree's weight; a leaf has feature -1.

    Ids grow from left to right, as Spark numbers the leaves that it predicts.
    """
    path = scratch_path(spark, "trees")
    trees.write().save(path)
    n = F.col("nodeData")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in trees.treeWeights]), F.col("treeID") + 1)
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), n["id"].alias("id"), (n["prediction"] * weight).alias("value"), n["split"]["featureIndex"].alias("feature"), n["leftChild"].alias("left"), n["rightChild"].alias("right"))


def leaf_numbers(nodes: DataFrame) -> DataFrame:
    """``(tree, id, leaf)``: the leaves of every tree, numbered from left to right."""
    order = Window.partitionBy("tree").orderBy("id")
    return nodes.where("feature < 0").select("tree", "id", (F.row_number().over(order) - 1).alias("leaf"))


def leaf_contributions(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``(tree, leaf, name, value)``: how far the splits on an input move the prediction on the way to a leaf; ``base`` is the root's value.

    Every step down a tree adds the child's value less the node's to the input that the node splits on, so base and
    contributions of a leaf sum to its value.  One join per level, over nodes only.
    """
    way = F.array(F.struct(F.lit("base").alias("name"), F.col("value")))
    now = stored(nodes.where("id = 0").select("tree", "id", "value", "feature", "left", "right", way.alias("way")), "ways")
    done = now.where("feature < 0").select("tree", "id", "way")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p.feature") + 1)
    while True:
        inner = now.where("feature >= 0").alias("p")
        if inner.isEmpty():
            break
        child = nodes.alias("c")
        met = inner.join(child, (F.col("p.tree") == F.col("c.tree")) & ((F.col("c.id") == F.col("p.left")) | (F.col("c.id") == F.col("p.right"))))
        step = F.struct(name.alias("name"), (F.col("c.value") - F.col("p.value")).alias("value"))
        now = stored(met.select("c.tree", "c.id", "c.value", "c.feature", "c.left", "c.right", F.concat("p.way", F.array(step)).alias("way")), "ways")
        done = done.unionByName(now.where("feature < 0").select("tree", "id", "way"))
    steps = done.join(leaf_numbers(nodes), ["tree", "id"]).select("tree", "leaf", F.inline("way"))
    return steps.groupBy("tree", "leaf", "name").agg(F.sum("value").alias("value"))


def by_leaf(table: DataFrame, payload: str) -> Column:
    """The payload of every leaf as one value, ``[tree][leaf]``; as large as the model, whatever the number of rows."""
    trees = table.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("leaf", payload))).alias("l")).select("tree", F.col(f"l.{payload}").alias("l"))
    return trees.agg(F.array_sort(F.collect_list(F.struct("tree", "l"))).alias("t")).select(F.col("t.l")).scalar()


def with_leaves(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``leaf``, the number of the leaf that each tree puts them in, and the trees' prediction."""
    assembler, trees = model.stages[0], model.stages[-1]
    out = trees.transform(assembler.transform(rows), {trees.leafCol: "leaf_"})
    return out.withColumn("leaf", vector_to_array("leaf_").cast("array<int>")).drop("leaf_", "features")


def tree_contributions(m: FittedVariable, df: DataFrame, family: dict[str, str]) -> DataFrame:
    """``df`` with ``contributions``, a map from input family (and ``base``) to its part of the residual estimate ``r_hat``.

    Parts of a row sum to its ``r_hat``; an input's missing flag counts as the input, inputs of no family as "other".
    What a leaf contributes is worked out once; a row looks up one leaf per tree and shuffles nothing.
    """
    features = [*m.spec.features, "hist_bias"]
    spark = df.sparkSession
    table = leaf_contributions(tree_nodes(spark, m.point.stages[-1]), [f for f in features for _ in range(2)])
    families = ["base", *sorted({family.get(f, "other") for f in features})]
    of = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(family.get(f, "other")))], F.lit("base"), F.lit("base"))
    parts = table.groupBy("tree", "leaf").agg(*[F.sum(F.when(of[F.col("name")] == f, F.col("value")).otherwise(0.0)).alias(f"p{i}") for i, f in enumerate(families)])
    packed = stored(parts.select("tree", "leaf", F.array(*[f"p{i}" for i in range(len(families))]).alias("parts")), "leaves")
    keep = [c for c in df.columns if c not in ("hist_bias", "r_hat", "contributions")]
    x = with_leaves(m.point, _inputs(with_serving_bias(df.select(*keep), m.bias), features)).withColumn("_t", by_leaf(packed, "parts"))
    each = F.transform("leaf", lambda leaf, tree: F.get(F.get(F.col("_t"), tree), leaf))
    total = lambda i: F.aggregate(each, F.lit(0.0), lambda s, p: s + p[i])
    return x.select(*keep, "hist_bias", "r_hat", F.map_from_arrays(F.array(*[F.lit(f) for f in families]), F.array(*map(total, range(len(families))))).alias("contributions"))


def fit_leaf_intervals(m: FittedVariable, train: DataFrame, calib: DataFrame, alpha: float = 0.2, trees: int = 20, depth: int = 5, points: int = 41) -> FittedVariable:
    """Residual quantiles that depend on all inputs: a forest, and per leaf ``points`` quantiles of the training residuals in it.

    A row's quantiles are those of the points of all its leaves together; the points are known not to be null, so that a row's
    are sorted as plain doubles, not by a function that Spark calls for every comparison.  The margin is the split-conformal quantile
    of the overshoot on calibration rows, as in `fit_intervals`.
    """
    features = [*m.spec.features, "hist_bias"]
    tr = with_training_bias(usable(train, m.spec).withColumn("r", residual(m.spec, m.space)))
    rows = checkpointed(_inputs(_for_fit(tr.select(*dict.fromkeys(["r", *features, "gp_code", "valid_date"]))), features))
    forest = RandomForestRegressor(featuresCol="features", labelCol="r", predictionCol="r_forest", numTrees=trees, maxDepth=depth, minInstancesPerNode=20, featureSubsetStrategy="all", seed=42)
    m.forest = Pipeline(stages=[_assembler(features), forest]).fit(rows)
    nodes = leaf_numbers(tree_nodes(rows.sparkSession, m.forest.stages[-1])).select("tree", "leaf")
    held = with_leaves(m.forest, rows).select("r", F.posexplode("leaf").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.percentile_approx("r", [(k + 0.5) / points for k in range(points)], 10_000).alias("points"))
    m.leaves = stored(nodes.join(held, ["tree", "leaf"], "left").select("tree", "leaf", F.coalesce("points", F.array().cast("array<double>")).alias("points")), "leaves")
    r = residual(m.spec, m.space)
    over = _with_leaf_interval(m, usable(calib, m.spec)).select(F.greatest(F.col("_lo") - r, r - F.col("_hi")).alias("over"))
    over = checkpointed(over.where("over is not null"))
    n = over.count()
    level = min(1.0, -(-(n + 1) * (1 - alpha) // 1) / max(n, 1))
    m.margin = max(0.0, exact_quantiles(over, [], "over", {"q": level}).first()["q"]) if n else 0.0
    return m


def _with_leaf_interval(m: FittedVariable, df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in ("hist_bias", "r_hat")]
    features = [*m.spec.features, "hist_bias"]
    known = dealt(with_serving_bias(df.select(*keep), m.bias), ["gp_code", "valid_date"])
    x = with_leaves(m.forest, _inputs(known, features)).withColumn("_t", by_leaf(m.leaves.withColumn("points", F.array_compact("points")), "points"))
    pool = F.sort_array(F.flatten(F.transform("leaf", lambda leaf, tree: F.get(F.get(F.col("_t"), tree), leaf))))
    x = x.select(*keep, pool.alias("_pool"))
    at = lambda q: F.get("_pool", F.floor((F.size("_pool") - 1) * q + 0.5).cast("int"))
    return x.select(*keep, at(0.1).alias("_lo"), at(0.5).alias("_mid"), at(0.9).alias("_hi"))


def predict_leaf_intervals(m: FittedVariable, df: DataFrame) -> DataFrame:
    """Adds the 10, 50 and 90 % quantiles of the variable given all inputs, in order and within its bounds; rows are dealt evenly, as each costs a sort."""
    p = _with_leaf_interval(m, df)
    base = to_space(F.col(m.spec.forecast), m.space)
    wide = {"q10": F.col("_lo") - m.margin, "q50": F.col("_mid"), "q90": F.col("_hi") + m.margin}
    return p.withColumns({f"{m.spec.var}_{n}": clip(from_space(base + r, m.space), m.spec.lower, m.spec.upper) for n, r in wide.items()}).drop("_lo", "_mid", "_hi")


# --- intervals by lead and size of the forecast -------------------------------------------------

def _with_interval(m: FittedVariable, df: DataFrame) -> DataFrame:
    bin_of = sum((F.when(F.col(m.spec.forecast) > x, 1).otherwise(0) for x in m.edges), F.lit(0))
    j = df.withColumn("bin", bin_of).join(m.intervals, ["lead_day", "bin"], "left")
    q = F.array_sort(F.array(*[F.col("r_hat") + F.col(c) for c in ("e10", "e50", "e90")]))
    return j.withColumns({"_lo": q[0], "_mid": q[1], "_hi": q[2]}).drop("bin", "e10", "e50", "e90")


def predict_intervals(m: FittedVariable, df: DataFrame) -> DataFrame:
    """Adds the 10, 50 and 90 % quantiles of the variable, in order and within its bounds."""
    p = _with_interval(m, predict_point(m, df))
    base = to_space(F.col(m.spec.forecast), m.space)
    wide = {"q10": F.col("_lo") - m.margin, "q50": F.col("_mid"), "q90": F.col("_hi") + m.margin}
    for n, r in wide.items():
        p = p.withColumn(f"{m.spec.var}_{n}", clip(from_space(base + r, m.space), m.spec.lower, m.spec.upper))
    return p.drop("_lo", "_mid", "_hi")


def fit_exceedance(m: FittedVariable, train: DataFrame, calib: DataFrame, rounds: int = 10, min_events: int = 50, min_calib: int = 10) -> FittedVariable:
    """Classifier per threshold with enough events, recalibrated where the calibration rows hold enough."""
    features = [*m.spec.features, "hist_bias"]
    need = [m.spec.target, *features]
    tr = checkpointed(_inputs(with_serving_bias(usable(train, m.spec), m.bias).select(*need), features))
    ca = checkpointed(_inputs(with_serving_bias(usable(calib, m.spec), m.bias).select(*need), features))
    y = F.col(m.spec.target)
    events = tr.agg(*[F.count_if(y >= t).alias(str(i)) for i, t in enumerate(m.spec.thresholds)], F.count("*").alias("n")).first()
    calib_events = ca.agg(*[F.count_if(y >= t).alias(str(i)) for i, t in enumerate(m.spec.thresholds)]).first()
    for i, t in enumerate(m.spec.thresholds):
        if events[i] < min_events or events[i] == events["n"]:
            continue
        gbt = GBTClassifier(featuresCol="features", labelCol="y", maxIter=rounds, maxDepth=4, seed=42)
        clf = Pipeline(stages=[_assembler(features), gbt]).fit(tr.withColumn("y", (y >= t).cast("double")))
        iso = None
        if calib_events[i] >= min_calib:
            scored = clf.transform(ca).select(vector_to_array("probability")[1].alias("p"), (y >= t).cast("double").alias("y"))
            iso = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="p_cal").fit(scored)
        m.classifiers[t] = (clf, iso)
    return m


def predict_exceedance(m: FittedVariable, df: DataFrame) -> DataFrame:
    """Adds ``<var>_p_ge_<threshold>`` for every fitted threshold."""
    features = [*m.spec.features, "hist_bias"]
    keep = df.columns
    out = _inputs(with_serving_bias(df, m.bias), features)
    for t, (clf, iso) in m.classifiers.items():
        name = f"{m.spec.var}_p_ge_" + f"{t:g}".replace(".", "p")
        base = out.columns
        p = clf.transform(out).withColumn("p", vector_to_array("probability")[1])
        p = iso.transform(p).withColumn("p", clip(F.col("p_cal"), 0, 1)) if iso is not None else p
        out = p.select(*base, F.col("p").alias(name))
    added = [c for c in out.columns if "_p_ge_" in c and c not in keep]
    return out.select(*keep, *added)


def fit_ridge(train: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> PipelineModel:
    """Ridge regression on standardised inputs; rows with a missing input are left out."""
    ok = train.dropna(subset=[*features, label])
    n = max(1, ok.count())
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
              LinearRegression(featuresCol="features", labelCol=label, predictionCol="ridge", regParam=alpha / n, elasticNetParam=0.0, standardization=False)]
    return Pipeline(stages=stages).fit(ok)


def predict_ridge(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``ridge``; NULL where an input is missing."""
    known = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0)) == len(features)
    flagged = df.withColumn("_ok", known).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return model.transform(flagged).withColumn("ridge", F.when(F.col("_ok"), F.col("ridge"))).drop("raw", "features", "_ok")


def linear_contributions(df: DataFrame, coef: dict[str, float], keys: list[str]) -> DataFrame:
    """Exact contributions ``coef * (x - mean)`` of a linear model in long form; a missing input contributes nothing."""
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in coef])).scalar()
    j = df.select(*keys, *coef).withColumn("_m", means)
    wide = j.select(*keys, *[F.coalesce(w * (F.col(f) - F.col("_m")[f]), F.lit(0.0)).alias(f) for f, w in coef.items()])
    return wide.unpivot(keys, list(coef), "feature", "value")


def family_contributions(long: DataFrame, keys: list[str], family: dict[str, str]) -> DataFrame:
    """Contributions summed by feature family; unknown features are "other"."""
    pairs = [x for k, v in family.items() for x in (F.lit(k), F.lit(v))]
    fam = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("feature")), F.lit("other"))
    return long.groupBy(*keys, fam.alias("family")).agg(F.sum("value").alias("value"))


def importance(m: FittedVariable) -> dict[str, float]:
    """Share of every input in the trees' gain, largest first (value and missing-flag columns together)."""
    features = [*m.spec.features, "hist_bias"]
    v = m.point.stages[-1].featureImportances.toArray()
    gain = {f: float(v[2 * i] + v[2 * i + 1]) for i, f in enumerate(features)}
    total = sum(gain.values()) or 1.0
    return dict(sorted(((k, g / total) for k, g in gain.items()), key=lambda x: -x[1]))


def unit_folds(folds: int, seed: int = 42) -> Column:
    """Fold of a unit, the same on every run: a unit is never split over folds."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("gp_code"))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def grouped_search(df: DataFrame, spec: VariableSpec, space: str, grid: list[dict], units: DataFrame, lat0: float, folds: int = 3) -> list[dict]:
    """Mean cross-validated RMSE of each parameter set; the encoder is fitted anew inside every fold."""
    df = df.withColumn("_fold", unit_folds(folds))
    results = []
    for params in grid:
        rmse = []
        for k in range(folds):
            m = fit_point(df.where(F.col("_fold") != k).drop("_fold"), None, spec, space, units, lat0, **params)
            p = predict_point(m, usable(df.where(F.col("_fold") == k).drop("_fold"), spec))
            value = p.agg(S.continuous(F.col(spec.target), F.col(f"{spec.var}_pred"))["rmse"]).first()[0]
            if value is not None:
                rmse.append(value)
        results.append({**params, "cv_rmse": sum(rmse) / len(rmse)})
    return sorted(results, key=lambda r: r["cv_rmse"])


def leave_parent_out(df: DataFrame, spec: VariableSpec, space: str, units: DataFrame, lat0: float, train: str, test: str, min_units: int = 5, **params) -> DataFrame:
    """Scores per parent of a model trained without that parent (``train`` and ``test`` are flag columns)."""
    ready = usable(df, spec)
    parents = ready.where(test).groupBy("block_lgd").agg(F.count_distinct("gp_code").alias("n")).where(F.col("n") >= min_units)
    out = None
    for row in parents.orderBy("block_lgd").collect():  # one row per parent with enough units
        b = row["block_lgd"]
        m = fit_point(ready.where((F.col("block_lgd") != b) & F.col(train)), None, spec, space, units, lat0, **params)
        p = predict_point(m, ready.where((F.col("block_lgd") == b) & F.col(test)))
        y = F.col(spec.target)
        mod, ref = S.continuous(y, F.col(f"{spec.var}_pred")), S.continuous(y, F.col(spec.forecast))
        fold = p.groupBy("block_lgd").agg(F.count_distinct("gp_code").alias("units"), mod["n"].alias("n"), mod["rmse"].alias("model_rmse"), ref["rmse"].alias("copy_rmse"),
                                          S.skill(mod["rmse"], ref["rmse"]).alias("skill"))
        out = fold if out is None else out.unionByName(fold)
    return out


def predict_all(models: dict[str, FittedVariable], df: DataFrame) -> DataFrame:
    """Predictions of all variables in one frame, with minimum and maximum temperature in order."""
    out = df
    for v, m in models.items():
        out = predict_point(m, out.drop("hist_bias", "r_hat"))
    out = out.drop("hist_bias", "r_hat")
    if {"tmin", "tmax"} <= set(models):
        lo, hi = ordered_temperatures(F.col("tmin_pred"), F.col("tmax_pred"))
        out = out.withColumns({"tmin_pred": lo, "tmax_pred": hi})
    return out


def fit_operational(df: DataFrame, calib_flag: str, spec: VariableSpec, space: str, units: DataFrame, lat0: float, path: str | None = None, **params) -> FittedVariable:
    """Refit on every day except the calibration weeks, which choose among all rounds; saved below ``path``."""
    m = fit_point(df.where(~F.col(calib_flag)), df.where(F.col(calib_flag)), spec, space, units, lat0, every_round=True, **params)
    if path:
        save_fitted(m, path)
    return m


def save_fitted(m: FittedVariable, path: str) -> None:
    """All of a fitted variable below ``path``: trees, bias, interval tables and margin, forest and leaves, classifiers with their calibration."""
    spark = m.bias.sparkSession
    facts = {"space": m.space, "bins": m.bins, "edges": m.edges, "margin": m.margin, "intervals": m.intervals is not None, "leaves": m.leaves is not None, "classifiers": [[t, iso is not None] for t, (_, iso) in m.classifiers.items()]}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    m.point.write().overwrite().save(f"{path}/trees")
    for name, table in (("bias", m.bias), ("intervals", m.intervals), ("leaves", m.leaves)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    if m.forest is not None:
        m.forest.write().overwrite().save(f"{path}/forest")
    for i, (clf, iso) in enumerate(m.classifiers.values()):
        clf.write().overwrite().save(f"{path}/classifier-{i}")
        if iso is not None:
            iso.write().overwrite().save(f"{path}/isotonic-{i}")


def load_operational(spark: SparkSession, spec: VariableSpec, space: str, path: str) -> FittedVariable:
    """What `save_fitted` wrote; ``space`` must be the one that it was fitted in."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    if facts["space"] != space:
        raise ValueError(f"fitted in space {facts['space']}")
    table = lambda name: spark.read.parquet(f"{path}/{name}") if name == "bias" or facts[name] else None
    m = FittedVariable(spec, space, table("bias"), PipelineModel.load(f"{path}/trees"), table("intervals"), facts["bins"], facts["edges"], facts["margin"])
    if facts["leaves"]:
        m.forest, m.leaves = PipelineModel.load(f"{path}/forest"), table("leaves")
    for i, (t, calibrated) in enumerate(facts["classifiers"]):
        m.classifiers[t] = PipelineModel.load(f"{path}/classifier-{i}"), IsotonicRegressionModel.load(f"{path}/isotonic-{i}") if calibrated else None
    return m
