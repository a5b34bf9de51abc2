"""Explanations and intervals of the residual models."""

import pytest
from pyspark.sql import functions as F

from finegrid.functions import scores as S
from finegrid.operators import model as Md
from finegrid.session import scratch_path

SPEC = Md.VariableSpec("rain", "rain_obs", "fc_rain", ("fc_rain", "lead_day", "elev_diff"), lower=None)
FAMILY = {"fc_rain": "forecast", "lead_day": "forecast", "elev_diff": "terrain"}


@pytest.fixture(scope="module")
def fitted(spark, panel):
    """Observations whose spread depends on the terrain, which neither lead nor forecast tells."""
    noise = (F.pmod(F.xxhash64("gp_code", "valid_date"), F.lit(2001)).cast("double") - 1000) / 1000
    df = panel.withColumn("rain_obs", F.col("fc_rain") + F.when(F.col("elev_diff") > 1, 8.0).otherwise(0.5) * noise).checkpoint()
    units = df.select("gp_code", "block_lgd", "latitude", "longitude").distinct()
    train, calib, test = (df.where(w) for w in ("valid_date < '2024-10-01'", "valid_date >= '2024-10-01' AND valid_date < '2024-11-01'", "valid_date >= '2024-11-01'"))
    return Md.fit_point(train, calib, SPEC, "linear", units, 44.0, rounds=4, depth=3), train, calib, test


def test_contributions_sum_to_the_prediction(fitted):
    m, _, _, test = fitted
    df = test.withColumn("fc_rain", F.when(F.dayofmonth("valid_date") % 7 != 0, F.col("fc_rain"))).withColumn("contributions", F.lit("clash"))
    got = Md.tree_contributions(m, df, FAMILY).collect()
    want = {(r.gp_code, r.valid_date): r.r_hat for r in Md.predict_point(m, df).collect()}
    assert len(got) == len(want) == df.count()
    for r in got:
        assert set(r.contributions) == {"base", "forecast", "terrain", "other"}
        assert sum(r.contributions.values()) == pytest.approx(want[r.gp_code, r.valid_date], abs=1e-9)
    assert len({round(r.contributions["base"], 9) for r in got}) == 1 and any(r.contributions["terrain"] for r in got)


def test_contributions_by_hand(spark):
    """A tree of two levels: each step's change goes to the input that it splits on, leaves count from the left."""
    nodes = spark.createDataFrame([(0, 0, 10.0, 0, 1, 2), (0, 1, 4.0, -1, -1, -1), (0, 2, 13.0, 1, 3, 4), (0, 3, 12.0, -1, -1, -1), (0, 4, 20.0, -1, -1, -1), (1, 0, 1.0, -1, -1, -1)], "tree int, id int, value double, feature int, left int, right int")
    got = {(r.tree, r.leaf, r.name): r.value for r in Md.leaf_contributions(nodes, ["a", "b"]).collect()}
    assert got == {(0, 0, "base"): 10, (0, 0, "a"): -6, (0, 1, "base"): 10, (0, 1, "a"): 3, (0, 1, "b"): -1, (0, 2, "base"): 10, (0, 2, "a"): 3, (0, 2, "b"): 7, (1, 0, "base"): 1}


def test_quantiles_follow_the_inputs(fitted):
    """Narrow where the terrain is calm, wide where it isn't; better than quantiles by lead and forecast, and as often right as asked."""
    m, train, calib, test = fitted
    y, cols = F.col("rain_obs"), ("q10", "q50", "q90")
    loss = lambda p: p.agg(*[S.pinball(y, F.col(f"rain_{c}"), a).alias(c) for c, a in zip(cols, (0.1, 0.5, 0.9))]).first()
    binned = loss(Md.predict_intervals(Md.fit_intervals(m, train, calib), test))
    leaves = Md.predict_leaf_intervals(Md.fit_leaf_intervals(m, train, calib, trees=8, depth=4), test).checkpoint()
    by_leaf = loss(leaves)
    assert all(by_leaf[c] < binned[c] for c in ("q10", "q90"))
    assert abs(leaves.agg(S.coverage(y, F.col("rain_q10"), F.col("rain_q90"))).first()[0] - 0.8) < 0.05
    assert leaves.where("rain_q10 > rain_q50 OR rain_q50 > rain_q90").count() == 0 and leaves.count() == test.count()
    width = {r.rough: r.w for r in leaves.groupBy((F.col("elev_diff") > 1).alias("rough")).agg(F.avg(F.col("rain_q90") - F.col("rain_q10")).alias("w")).collect()}
    assert width[True] > 3 * width[False]


def test_a_fitted_model_is_saved_whole(spark, fitted):
    """Points, both kinds of intervals and exceedance probabilities are the same after loading."""
    m, train, calib, test = fitted
    spec = Md.VariableSpec("rain", "rain_obs", "fc_rain", SPEC.features, thresholds=(8.0, 1e9))
    m = Md.FittedVariable(spec, m.space, m.bias, m.point)
    m = Md.fit_exceedance(Md.fit_leaf_intervals(Md.fit_intervals(m, train, calib), train, calib, trees=3, depth=3), train, calib, rounds=2)
    path = scratch_path(spark, "model")
    Md.save_fitted(m, path)
    back = Md.load_operational(spark, spec, "linear", path)
    assert list(back.classifiers) == [8.0] and back.margin == m.margin and back.edges == m.edges
    some = test.where("gp_code IN ('1', '9')")
    for predict in (Md.predict_point, Md.predict_intervals, Md.predict_leaf_intervals, Md.predict_exceedance):
        rows = [sorted(map(str, predict(x, some).drop("hist_bias").collect())) for x in (m, back)]
        assert rows[0] == rows[1] and len(rows[0]) > 50
    with pytest.raises(ValueError):
        Md.load_operational(spark, spec, "log1p", path)


def test_operational_refit_fits_all_rounds(spark, panel, monkeypatch):
    """Rounds that gain less than a hundredth each still add up; the calibration rows keep as many as serve them best."""
    from finegrid.plans import model_queries

    noise = (F.pmod(F.xxhash64("gp_code", "valid_date"), F.lit(2001)).cast("double") - 1000) / 1000
    df = panel.withColumn("rain_obs", F.col("fc_rain") + F.when(F.col("elev_diff") > 1, 0.5).otherwise(-0.5) + 3 * noise).withColumn("calib", F.col("valid_date").between("2024-10-01", "2024-10-31")).checkpoint()
    units = df.select("gp_code", "block_lgd", "latitude", "longitude").distinct()
    given, tried = {}, {}

    def errors_of(model, rows, loss, f=Md.GBTRegressionModel.evaluateEachIteration):
        tried["errors"] = f(model, rows, loss)
        return tried["errors"]

    monkeypatch.setattr(Md.GBTRegressionModel, "evaluateEachIteration", errors_of)
    m = Md.fit_operational(df, "calib", SPEC, "linear", units, 44.0, rounds=12, depth=2)
    trees, errors = m.point.stages[-1], tried["errors"]
    assert len(errors) == 12 and trees.getNumTrees == errors.index(min(errors)) + 1
    stopped = Md.fit_point(df.where("NOT calib"), df.where("calib"), SPEC, "linear", units, 44.0, rounds=12, depth=2).point.stages[-1]
    assert trees.getNumTrees > stopped.getNumTrees  # a stop at the first small gain
    calib = Md.predict_point(m, df.where("calib")).agg(F.avg(F.pow(F.col("rain_obs") - F.col("fc_rain") - F.col("r_hat"), 2))).first()[0]
    assert calib == pytest.approx(min(errors), rel=1e-6)  # a refit of fewer rounds has the first trees of the longer fit

    def fit(*args, **params):
        given.update(params, rounds_of="the fit")
        raise InterruptedError

    monkeypatch.setattr(Md, "fit_operational", fit)
    monkeypatch.setattr(model_queries, "cached", lambda t: df)
    with pytest.raises(InterruptedError):
        model_queries.operational_refit(type("T", (), {"spark": spark, "unit": units}))
    assert given == {"rounds_of": "the fit"}  # the query takes the whole fit, not some rounds of it


def _ridge(rows, k, alpha):
    """Ridge on standardised inputs with numpy, from complete rows; constant inputs get no weight."""
    import numpy as np

    a = np.array(rows, dtype=float)
    x, y = a[:, :k], a[:, k]
    sd = np.where(np.ptp(x, axis=0) > 0, x.std(axis=0), 0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    w = np.linalg.lstsq(np.vstack([z, alpha ** 0.5 * np.eye(k)]), np.r_[y - y.mean(), np.zeros(k)], rcond=None)[0] / np.where(sd > 0, sd, 1)
    return w, y.mean() - w @ x.mean(axis=0)


def test_closed_ridge_against_numpy(spark, panel):
    from finegrid.operators import linear as Ln

    features = ["fc_rain", "lead_day", "elev_diff", "big", "flat"]
    df = panel.withColumns({"big": F.lit(1e6) + F.dayofyear("valid_date"), "flat": F.lit(0.1), "weights": F.lit("clash"),
                            "rain_obs": F.when(F.dayofmonth("valid_date") % 9 != 0, F.col("rain_obs")), "elev_diff": F.when(F.col("gp_code") != "5", F.col("elev_diff"))})
    full = [r for r in df.select(*features, "rain_obs", "block_lgd").collect() if None not in tuple(r)]
    for alpha in (0.0, 1.0, 50.0):
        w, b = _ridge([r[:4] + (r.rain_obs,) for r in full], 4, alpha)
        w = [*w, 0.0]
        got = Ln.fit(df, features, "rain_obs", alpha).first()
        assert list(got.weights) == pytest.approx(list(w), rel=1e-7, abs=1e-9) and got.intercept == pytest.approx(b, rel=1e-6)
    out = Ln.predict(Ln.fit(df, features, "rain_obs"), df, features)
    assert out.columns == [*df.columns, "ridge"] and out.where("(ridge is null) <> (elev_diff is null)").isEmpty()
    # without each parent, from the moments alone
    stats = Ln.stored(Ln.moments(df, ["block_lgd"], features, "rain_obs"), "m")
    for r in Ln.solve(Ln.without_each(stats, 5), 5).collect():
        w, b = _ridge([x[:4] + (x.rain_obs,) for x in full if x.block_lgd != r.block_lgd], 4, 1.0)
        assert list(r.weights) == pytest.approx([*w, 0.0], rel=1e-7, abs=1e-9) and r.intercept == pytest.approx(b, rel=1e-6)


def test_closed_ridge_edges(spark):
    from finegrid.operators import linear as Ln

    schema = "g string, u string, a double, b double, y double, ref double, train boolean, test boolean"
    empty = spark.createDataFrame([], schema)
    assert Ln.fit(empty, ["a", "b"], "y").first().weights is None
    assert Ln.leave_group_out(empty, "g", ["a", "b"], "y", "ref", "train", "test", "u", 1).isEmpty()
    # b repeats a: without penalty there is no single answer, with one the weight is shared
    rows = [("p", f"u{i % 3}", float(i), float(i), 2.0 * i, float(i), i < 6, i >= 6) for i in range(9)]
    rows += [("q", "v", float(i), float(i), 2.0 * i, float(i), False, True) for i in range(3)]
    rows += [(None, "w", float(i), float(i), 2.0 * i, float(i), True, True) for i in range(4)] + [("p", None, None, 1.0, 1.0, 1.0, True, True), ("p", "u0", 1.0, 1.0, None, 1.0, True, True)]
    df = spark.createDataFrame(rows * 2, schema)
    assert Ln.fit(df.where("train"), ["a", "b"], "y", 0.0).first().weights is None
    w = Ln.fit(df.where("train"), ["a", "b"], "y", 1.0).first().weights
    assert w[0] == pytest.approx(w[1]) and 0.8 < w[0] < 1
    got = {r.g: r for r in Ln.leave_group_out(df, "g", ["a"], "y", "ref", "train", "test", "u", 1).collect()}
    # p is scored by the rows without a group alone, q, which has no training rows, by all; rows without a group by none
    assert set(got) == {"p", "q"} and (got["p"].units, got["p"].n, got["q"].n) == (3, 6, 6)
    assert set(r.g for r in Ln.leave_group_out(df, "g", ["a"], "y", "ref", "train", "test", "u", 2).collect()) == {"p"}
    only = df.where("g = 'p'")
    assert Ln.leave_group_out(only, "g", ["a"], "y", "ref", "train", "test", "u", 1).isEmpty()  # nothing else to learn from


def _shares(df):
    """Rows in the largest partition, and in all."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n), sum(n)


def test_rows_of_few_days_are_dealt_to_all_tasks(spark, fitted):
    """One day's rows are few bytes: a shuffle by day or one merged for its size leaves them to one task."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("gp_code"), F.lit("2024-01-08").cast("date").alias("valid_date"))
    one_task = rows.repartition("valid_date")
    assert _shares(one_task)[0] == 20_000
    most, all_rows = _shares(Md._for_fit(one_task))
    assert all_rows == 20_000 and most < 20_000 / 6
    assert Md.dealt(rows, ["gp_code"], 1_000).rdd.getNumPartitions() == 20
    m, train, calib, test = fitted
    m = Md.fit_leaf_intervals(m, train, calib, trees=2, depth=2)
    day = test.where("valid_date = '2024-11-05'").repartition(1)
    got = Md.predict_leaf_intervals(m, day.select(*[c for c in day.columns])).checkpoint()
    assert got.count() == day.count() and got.select(F.spark_partition_id()).distinct().count() > 2


def test_points_of_leaves_are_sorted_as_plain_doubles(spark, fitted):
    """No comparison function per pair of points; a row's quantiles are those of its leaves' points together."""
    m, train, calib, test = fitted
    m = Md.fit_leaf_intervals(m, train, calib, trees=3, depth=2)
    p = Md._with_leaf_interval(m, test)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(flatten(" in plan and "array_sort(flatten(" not in plan
    points = {(r.tree, r.leaf): r.points for r in m.leaves.collect()}
    leaves = Md.with_leaves(m.forest, Md._inputs(Md.with_serving_bias(test, m.bias), [*m.spec.features, "hist_bias"]))
    leaf = {(r.gp_code, r.valid_date): r.leaf for r in leaves.collect()}
    for r in p.collect():
        pool = sorted(x for t, n in enumerate(leaf[r.gp_code, r.valid_date]) for x in points[t, n])
        assert [r._lo, r._mid, r._hi] == [pool[int((len(pool) - 1) * q + 0.5)] for q in (0.1, 0.5, 0.9)]
