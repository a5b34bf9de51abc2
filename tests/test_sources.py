"""Files written and read back, streams drained, models fitted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from finegrid.operators import model as Md
from finegrid.session import scratch_path
from finegrid.sources import features as Ft
from finegrid.sources import geoparquet as Gq
from finegrid.sources import gridfile as Gf
from finegrid.sources import lineage as Ln
from finegrid.sources import tabular as Tb


def test_year_of_rain_round_trip(spark):
    layout = Gf.LAYOUTS["rain"]
    cube = np.arange(365 * layout.rows * layout.cols, dtype="float64").reshape(365, layout.rows, layout.cols) % 50
    cube[3, 4, 5] = np.nan
    content = Gf.encode(cube, layout)
    assert len(content) == layout.bytes_of(365) == 365 * 129 * 135 * 4
    back = Gf.decode(content, layout, 365)
    assert np.isnan(back).sum() == 1 and np.nanmax(np.abs(back - cube)) < 1e-4
    with pytest.raises(ValueError):
        Gf.decode(content[:-4], layout, 365)
    assert [Gf.days_in_year(y) for y in (1900, 2000, 2023, 2024)] == [365, 366, 365, 366]


def test_grid_files_on_disk(spark):
    layout = Gf.GridLayout(2, 3, 18.0, 73.0, 0.25, -999.0)
    cells = spark.createDataFrame([("y.grd", d, i, j, float(d * 10 + i + j)) for d in range(4) for i in range(2) for j in range(3) if (d, i, j) != (1, 1, 1)],
                                  "file string, day int, i int, j int, value double")
    path = scratch_path(spark, "grid")
    sizes = Gf.save_files(Gf.pack_grid_files(cells, layout, lambda n: 4), path).collect()
    assert sizes[0]["bytes"] == layout.bytes_of(4)
    out = Gf.read_grid_files(spark, path, layout, lambda n: 4)
    assert out.count() == 24 and out.where("value is null").select("day", "i", "j").collect() == [(1, 1, 1)]


def test_stations_bad_header_and_values(spark):
    path = scratch_path(spark, "st")
    spark.createDataFrame([("a", 18.0, 73.0, "2025-07-02", "-5"), ("a", 18.0, 73.0, "2025-07-03", "12.5")], "STATION_ID string, latitude double, longitude double, date string, rain_mm string").write.csv(f"{path}/ok", header=True)
    spark.createDataFrame([("a", 1.0)], "station_id string, rain_mm double").write.csv(f"{path}/bad", header=True)
    got = {str(r["valid_date"]): r["rain_mm"] for r in Tb.read_stations(spark, [f"{path}/ok"], morning_day=True).collect()}
    assert got == {"2025-07-01": None, "2025-07-02": 12.5}
    with pytest.raises(ValueError):
        Tb.read_stations(spark, [f"{path}/bad"])


def test_geojson_collection_and_multipolygon(spark):
    path = scratch_path(spark, "gj")
    doc = ('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},'
           '{"type":"Feature","properties":{"code":"2"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[2,2],[3,2],[3,3],[2,2]]]]}}]}')
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    got = {r["code"]: len(r["shape"]) for r in Ft.read_features(spark, path, "code:string", collection=True).collect()}
    assert got == {"1": 1, "2": 2}


def test_manifest_replaces_by_name(spark):
    path = scratch_path(spark, "man")
    spark.range(100).repartition(3).write.parquet(path)
    files = Ln.file_digests(spark, path)
    a = Ln.dataset_entry(files, "x", "s", "l", "p")
    r = Ln.register(Ln.register(a, a.withColumn("licence", F.lit("new"))), a.withColumn("dataset", F.lit("y"))).collect()
    assert {x["dataset"]: x["licence"] for x in r} == {"x": "new", "y": "l"} and all(len(x["sha256"]) == 64 and x["bytes"] > 0 for x in r)


def test_strict_json_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, v double")
    assert [r[0] for r in Tb.strict_json(df).collect()] == ['{"id":1,"v":null}', '{"id":2,"v":null}', '{"id":3,"v":1.5}']


def test_unknown_issue_is_an_error(spark):
    df = spark.createDataFrame([("2025-01-01", 1)], "d string, v int").select(F.col("d").cast("date").alias("issue_date"), "v")
    assert Tb.pick_issue(df).count() == 1
    with pytest.raises(LookupError):
        Tb.pick_issue(df, "2025-01-02")


def test_model_beats_copy(spark, panel):
    spec = Md.VariableSpec("rain", "rain_obs", "fc_rain", ("fc_rain", "elev_diff", "is_monsoon"), lower=0.0, thresholds=(2.5,))
    train, calib, test = (panel.where(c) for c in ("valid_date < '2024-11-01'", "valid_date between '2024-11-01' and '2024-11-30'", "valid_date >= '2024-12-01'"))
    units = panel.select("gp_code", "latitude", "longitude").distinct()
    m = Md.fit_point(train, calib, spec, "linear", units, 18.3, rounds=8, depth=3, step=0.3)
    m = Md.fit_intervals(m, train, calib)
    m = Md.fit_exceedance(m, train, calib, rounds=2)
    out = Md.predict_exceedance(m, Md.predict_intervals(m, test).drop("hist_bias", "r_hat"))
    y = F.col("rain_obs")
    r = out.agg(F.sqrt(F.avg((F.col("rain_pred") - y) ** 2)).alias("m"), F.sqrt(F.avg((F.col("fc_rain") - y) ** 2)).alias("c"),
                F.count_if((F.col("rain_q10") > F.col("rain_q50")) | (F.col("rain_q50") > F.col("rain_q90"))).alias("crossed"),
                F.min("rain_p_ge_2p5").alias("lo"), F.max("rain_p_ge_2p5").alias("hi"), F.avg(((y >= F.col("rain_q10")) & (y <= F.col("rain_q90"))).cast("double")).alias("cov")).first()
    assert r["m"] < 0.8 * r["c"] and r["crossed"] == 0 and 0 <= r["lo"] <= r["hi"] <= 1 and math.isfinite(r["m"]) and r["cov"] > 0.6
    share = Md.importance(m)
    assert sum(share.values()) == pytest.approx(1) and "hist_bias" in share


def test_feature_resolution():
    fam = {"a": ["x", "lat", "x"], "b": ["y", "missing"], "history": ["hist_bias"]}
    assert Md.resolve_features(fam, ["x", "y", "lat"], ["lat"]) == ["x", "y", "hist_bias"]


def test_shapes_in_parquet_round_trip(spark):
    """Holes, parts, empty and null shapes come back; a box reaches the scan and drops what lies outside."""
    pt = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    box = lambda x, y, w: pt((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))
    shapes = [("holes", [[box(0, 0, 9), box(1, 1, 2), box(5, 5, 1)]]), ("parts", [[box(20, 0, 1)], [box(30, 40, 2), box(30.5, 40.5, 0.5)]]), ("none", None), ("empty", []), ("far", [[box(-60, -60, 3)]])]
    df = spark.createDataFrame([(k, s, 7) for k, s in shapes], "id string, ring array<array<array<struct<x:double,y:double>>>>, n int")
    path = scratch_path(spark, "shapes")
    Gq.write_shapes(df, path, "ring")
    flat = lambda s: s and [[[(p["x"], p["y"]) for p in r] for r in g] for g in s]
    got = {r.id: (flat(r.shape), r.n) for r in Gq.read_shapes(spark, path).collect()}
    assert got == {k: (flat(s), 7) for k, s in shapes}
    near = Gq.boxed(spark, path, (8, 8, 25, 25))
    plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(bbox.xmin,25.0)" in plan.partition("PushedFilters")[2] and {r.id for r in near.collect()} == {"holes", "parts"}
    assert {r.id for r in Gq.read_shapes(spark, path, box=(-61, -61, -59, -59)).collect()} == {"far"}


def test_other_forms_of_binary_shapes():
    import struct

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    want = [[[list(p) for p in ring]]]
    plain = lambda got: [[r.tolist() for r in p] for p in got]
    for order, flag in (("<", 1), (">", 0)):
        body = lambda *extra: struct.pack(order + "II", 1, 4) + b"".join(struct.pack(order + f"{2 + len(extra)}d", *p, *extra) for p in ring)  # noqa: E731,B023
        head = lambda kind, *more: struct.pack(order + "BI" + "I" * len(more), flag, kind, *more)  # noqa: E731,B023
        assert plain(Gq.decode(head(3) + body())) == want
        assert plain(Gq.decode(head(1003) + body(9.0))) == plain(Gq.decode(head(3 | Gq.HAS_Z | Gq.HAS_SRID, 4326) + body(9.0))) == want
        assert plain(Gq.decode(head(6, 2) + head(3) + body() + head(3003) + body(1.0, 2.0))) == want * 2
    with pytest.raises(ValueError):
        Gq.decode(struct.pack("<BIdd", 1, 1, 0.0, 0.0))


def _collection(features, spaced=False):
    import json

    head = {"type": "FeatureCollection", "name": 'x "]}', "crs": {"type": "name", "properties": {"name": "urn"}}, "bbox": [[0, 0], [1, 1]]}
    return json.dumps({**head, "features": features, "tail": {"a": [{"b": 1}]}}, indent=1 if spaced else None, ensure_ascii=False)


def test_collection_cut_anywhere(spark):
    """The same features whatever the ranges, with brackets, quotes and backslashes in texts, holes, null geometry, empty objects."""
    import os

    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    notes = ['plain', '}]{["', '\\', '\\"}', 'tail\\\\', 'é ß{', '', '"Feature"', "\n\t", '{"type":"Feature"}' * 20]
    shapes = [{"type": "Polygon", "coordinates": [square, square]}, {"type": "MultiPolygon", "coordinates": [[square], [square]]}, None]
    features = [{"type": "Feature", "properties": {"code": str(i), "note": n}, "geometry": shapes[i % 3]} for i, n in enumerate(notes)]
    path = scratch_path(spark, "cut").removeprefix("file:")
    os.makedirs(path)
    for name, text in (("a.json", _collection(features)), ("b.json", _collection(features[:3], spaced=True) + "\n" + _collection([]) + "\n" + _collection(features[3:])), ("c.json", ""), ("d.json", "{}")):
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    want = sorted((str(i), n, None if i % 3 == 2 else i % 3 + 1) for i, n in enumerate(notes))
    for size in (7, 64, 701, 1 << 20):
        got = Ft.read_features(spark, path, "code:string,note:string", collection=True, range_bytes=size).collect()
        assert sorted((r["code"], r["note"], r["shape"] and len(r["shape"])) for r in got) == sorted(want * 2), size
    bad = scratch_path(spark, "broken").removeprefix("file:")
    os.makedirs(bad)
    with open(f"{bad}/a.json", "w") as f:
        f.write(_collection(features)[:-400])
    with pytest.raises(Exception, match="ends inside a feature"):
        Ft.read_features(spark, bad, "code:string", collection=True, range_bytes=64).collect()


def test_scan_knows_the_state_at_every_cut():
    from finegrid.sources.collection import ESCAPED, INSIDE, OUTSIDE, scan

    text = r'{"a\\":["x\"]{",{}],"\\\"":"é"}'.encode()
    state, inside, escaped = OUTSIDE, False, False
    for cut in range(len(text)):
        assert scan(text[:cut], OUTSIDE)[2] == (ESCAPED if escaped else INSIDE if inside else OUTSIDE) == state
        for size in (1, 3):  # on from the state reached
            assert scan(text[cut:cut + size], state)[2] == scan(text[:cut + size], OUTSIDE)[2]
        c = chr(text[cut])
        escaped, inside = (False, True) if escaped else (inside and c == "\\", inside != (c == '"'))
        state = scan(text[:cut + 1], OUTSIDE)[2]
    at, step, _ = scan(text, OUTSIDE)
    assert step.sum() == 0 and [chr(text[i]) for i in at] == list("{[{}]}")
