"""Queries over checks, projections, set operations and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finegrid.functions import columns as C
from finegrid.operators import panel as P
from finegrid.operators import quality as Q
from finegrid.operators import relational as L
from finegrid.plans.bindings import LEADS, sql
from finegrid.plans.panel_queries import rounded
from finegrid.plans.registry import R, query, r4

_RULES_SQL = {"lead_day": "lead_day NOT IN (1, 2, 3, 4)", "range_rain": "NOT coalesce(rain BETWEEN 0 AND 500, false)", "range_tmax": "NOT coalesce(tmax BETWEEN -5 AND 50, false)",
              "range_tmin": "NOT coalesce(tmin BETWEEN -10 AND 40, false)", "range_rh": "NOT coalesce(rh BETWEEN 0 AND 100, false)",
              "range_wind": "NOT coalesce(wind BETWEEN 0 AND 200, false)", "tmin_above_tmax": "coalesce(tmin > tmax, false)"}


@query("validate_ranges", "Q3 Q4 Q5", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(count(*) AS BIGINT) AS n FROM x WHERE {c} HAVING count(*) > 0" for n, c in _RULES_SQL.items()), "vars",
    x="SELECT *, 1 + user_id % 5 AS lead_day FROM vars"))
def validate_ranges(t):
    return Q.violations(t.vars.withColumn("lead_day", 1 + F.col("user_id") % 5), Q.forecast_rules([1, 2, 3, 4]))


@query("validate_refs", "Q2 U4", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def validate_refs(t):
    known = t.table("supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"))
    return Q.unknown_keys(t.table("lineitem"), known, "l_suppkey")


@query("duplicate_keys", "Q6", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t):
    return L.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc_nulls", "Q8 Q9", sql("""
    , x AS (SELECT CASE WHEN rain BETWEEN 0 AND 150 THEN rain END AS rain, tmax, wind FROM vars)
    SELECT 'rain' AS rule, CAST(count(*) AS BIGINT) AS n FROM x WHERE rain IS NULL UNION ALL SELECT 'tmax', CAST(count(*) AS BIGINT) FROM x WHERE tmax IS NULL UNION ALL
    SELECT 'wind', CAST(count(*) AS BIGINT) FROM x WHERE wind IS NULL""", "vars"))
def qc_nulls(t):
    return Q.null_counts(t.vars.withColumn("rain", C.keep_between(F.col("rain"), 0, 150)), ["rain", "tmax", "wind"])


@query("coverage_sample", "Q10 T2", sql(f"""
    SELECT gp_code, n, {R('share')} AS share FROM (SELECT gp_code, CAST(count(*) AS BIGINT) AS n, count(*) / 30 AS share FROM obs GROUP BY 1) WHERE share < 0.9 ORDER BY gp_code, n LIMIT 5""", "obs"))
def coverage_sample(t):
    g = t.obs.groupBy("gp_code").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / 30)
    return Q.below_coverage(g, F.col("share"), 0.9).select("gp_code", "n", r4("share").alias("share"))


@query("coverage_by_month", "A10", sql(f"""
    , x AS (SELECT CAST(day(d) % 12 + 1 AS INTEGER) AS month, rain, tmax, wind FROM vars)
    SELECT month, unnest(['rain', 'tmax', 'wind']) AS input, unnest([{R('count(rain) / count(*)')}, {R('count(tmax) / count(*)')}, {R('count(wind) / count(*)')}]) AS share FROM x GROUP BY 1""", "vars"))
def coverage_by_month(t):
    return rounded(Q.coverage_by_month(t.vars, F.dayofmonth("d") % 12 + 1, ["rain", "tmax", "wind"]), ["share"])


@query("input_gaps", "Q11", sql(f"""
    , x AS (SELECT CAST(day(d) % 12 + 1 AS INTEGER) AS month, d, rain, tmax, wind FROM vars),
    n AS (SELECT month, unnest(['rain', 'tmax', 'wind']) AS input, unnest([count(rain) / count(*), count(tmax) / count(*), count(wind) / count(*)]) AS norm FROM x GROUP BY 1),
    i AS (SELECT month, unnest(['rain', 'tmax', 'wind']) AS input, unnest([count(rain) / count(*), count(tmax) / count(*), count(wind) / count(*)]) AS now FROM x WHERE d >= DATE '2024-01-20' GROUP BY 1)
    SELECT month, input, {R('now')} AS now, {R('norm')} AS norm FROM i JOIN n USING (month, input) WHERE now < norm - 0.01""", "vars"))
def input_gaps(t):
    month = F.dayofmonth("d") % 12 + 1
    cols = ["rain", "tmax", "wind"]
    out = Q.input_gaps(t.vars.where("d >= '2024-01-20'"), month, cols, Q.coverage_by_month(t.vars, month, cols), 0.01)
    return rounded(out.select("month", "input", "now", "norm"), ["now", "norm"])


@query("agreement_sample", "Q13 T2", """
    SELECT o_orderkey, o_orderstatus, flag FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 'F' ELSE 'O' END AS flag FROM orders)
    WHERE o_orderstatus IS DISTINCT FROM flag ORDER BY o_orderkey LIMIT 25""")
def agreement_sample(t):
    k = F.col("o_custkey") % 3
    o = t.table("orders").select("o_orderkey", "o_orderstatus", F.when(k == 1, "F").when(k == 2, "O").alias("flag"))
    return Q.attribute_agreement(o, "o_orderstatus", "flag", "o_orderkey")


@query("area_balance", "Q14", sql(f"""
    SELECT {R('a.s + b.s')} AS parts, {R('c.s')} AS whole, {R('(a.s + b.s) / c.s')} AS ratio, abs((a.s + b.s) / c.s - 1) <= 0.01 AS balanced
    FROM (SELECT sum(area_km2) AS s FROM unit WHERE user_id % 10 <> 0) a, (SELECT sum(area_km2) AS s FROM unit WHERE user_id % 10 = 0) b, (SELECT sum(area_km2) * 1.02 AS s FROM unit) c""", "unit"))
def area_balance(t):
    parents = t.unit.select((F.col("area_km2") * 1.02).alias("area_km2"))
    out = Q.area_balance(t.unit.where("user_id % 10 <> 0"), t.unit.where("user_id % 10 = 0"), parents, "area_km2")
    return rounded(out, ["parts", "whole", "ratio"])


@query("profile", "A11", sql(f"""
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT gp_code) AS BIGINT) AS units, CAST(count(DISTINCT valid_date) AS BIGINT) AS dates,
      array_to_string(list_sort(list_distinct(list(lead_day))), ',') AS leads, min(valid_date) AS first, max(valid_date) AS last, {R('100 * count(rain_obs) / count(*)')} AS rain_obs_pct FROM panel""", "panel"))
def profile(t):
    return rounded(Q.profile(t.panel, "gp_code", "valid_date", "lead_day", ["rain_obs"]), ["rain_obs_pct"])


@query("category_counts", "A30", sql("""
    SELECT block_lgd, CAST(count(*) AS BIGINT) AS units, array_to_string(list_sort(list_distinct(list(area_km2))), ',') AS sizes FROM unit GROUP BY 1""", "unit"))
def category_counts(t):
    sizes = F.array_join(F.transform(F.sort_array(F.collect_set("area_km2")), lambda v: v.cast("string")), ",")
    return t.unit.groupBy("block_lgd").agg(F.count("*").alias("units"), sizes.alias("sizes"))


@query("parent_summary", "A29", sql(f"""
    SELECT block_lgd, issue_date, lead_day, {R('min(fc_rain)')} AS parent_rain, {R('min(pred)')} AS lo, {R('avg(pred)')} AS mean, {R('max(pred)')} AS hi, CAST(count(DISTINCT gp_code) AS BIGINT) AS units
    FROM scored GROUP BY 1, 2, 3""", "scored"))
def parent_summary(t):
    g = t.scored.groupBy("block_lgd", "issue_date", "lead_day")
    return g.agg(r4(F.first("fc_rain")).alias("parent_rain"), r4(F.min("pred")).alias("lo"), r4(F.avg("pred")).alias("mean"), r4(F.max("pred")).alias("hi"),
                 F.count_distinct("gp_code").alias("units"))


@query("short_range_summary", "A35", sql("""
    , s AS (SELECT CAST(user_id % 5 AS INTEGER) AS block_lgd, d, value * 1.37::DOUBLE AS value, event_type FROM events_d)
    SELECT block_lgd, d, round(sum(value) FILTER (WHERE event_type <> 'view'), 1) AS mm_total, round(max(value) FILTER (WHERE event_type <> 'view'), 1) AS max_step,
      CAST(count(*) AS BIGINT) AS steps, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS missing_steps FROM s GROUP BY 1, 2""", "events_d"))
def short_range_summary(t):
    v = F.when(F.col("event_type") != "view", F.col("value") * 1.37).alias("v")
    s = t.events_d.select((F.col("user_id") % 5).cast("int").alias("block_lgd"), "d", v)
    return P.short_range_summary(s, ["block_lgd", "d"], "v")


@query("star_join_optional", "J4 Q12", sql(f"""
    SELECT u.gp_code, u.elev, {R('o.m')} AS mean_rain, e.n AS events, CAST('soil' AS VARCHAR) AS omitted FROM unit u LEFT JOIN (SELECT gp_code, avg(rain_obs) AS m FROM obs GROUP BY 1) o USING (gp_code)
    LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS gp_code, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) e USING (gp_code)""", "unit", "obs"))
def star_join_optional(t):
    means = t.obs.groupBy("gp_code").agg(F.avg("rain_obs").alias("m"))
    counts = t.events_d.groupBy(F.col("user_id").cast("string").alias("gp_code")).agg(F.count("*").alias("events"))
    out, omitted = Q.star_join(t.unit.select("gp_code", "elev"), "gp_code", {"means": means, "counts": counts, "soil": None})
    return out.select("gp_code", "elev", r4("m").alias("mean_rain"), "events", F.lit(",".join(omitted)).alias("omitted"))


@query("project_prefix_cast", "S1 P1 P8 P9", sql("SELECT gp_code, d, CAST(rain AS FLOAT) AS fc_rain, CAST(tmax AS FLOAT) AS fc_tmax FROM vars", "vars"))
def project_prefix_cast(t):
    df = t.vars.select("gp_code", "d", "rain", "tmax").withColumnsRenamed({c: f"fc_{c}" for c in ("rain", "tmax")})
    return df.select(*[F.col(n).cast("float").alias(n) if ty == "double" else F.col(n) for n, ty in df.dtypes])


@query("filter_masks", "P2 P3 P6", sql("""
    SELECT gp_code, valid_date, lead_day, block_lgd NOT IN (0, 3) AS modelled FROM panel WHERE rain_obs IS NOT NULL AND fc_rain IS NOT NULL AND gp_code IN (SELECT gp_code FROM unit WHERE elev > 800)""", "panel"))
def filter_masks(t):
    high = t.unit.where("elev > 800").select("gp_code")
    ok = t.panel.where(F.col("rain_obs").isNotNull() & F.col("fc_rain").isNotNull()).join(high, "gp_code", "left_semi")
    return ok.select("gp_code", "valid_date", "lead_day", (~F.col("block_lgd").isin(0, 3)).alias("modelled"))


@query("clip_bounds", "P7 F1", sql(f"""
    SELECT gp_code, d, CASE WHEN rain IS NOT NULL THEN least(100.0, greatest(20.0, rain)) END AS rain, {R('ln(1 + tmax)')} AS log_tmax, {R('exp(ln(1 + tmax)) - 1')} AS back,
      round_even(wind, 0) AS wind_even FROM vars""", "vars"))
def clip_bounds(t):
    fwd = C.to_space(F.col("tmax"), "log1p")
    return t.vars.select("gp_code", "d", C.clip(F.col("rain"), 20, 100).alias("rain"), r4(fwd).alias("log_tmax"), r4(C.from_space(fwd, "log1p")).alias("back"),
                         F.bround("wind", 0).alias("wind_even"))


@query("rounding_math", "F1", f"""
    SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_quantity / 2, 0) AS half_even, {R('sqrt(l_extendedprice)')} AS root, {R('pow(l_tax + 1, 2.5)')} AS power, CAST(floor(l_discount * 37) AS BIGINT) AS fl,
      CAST(ceil(l_discount * 37) AS BIGINT) AS ce, abs(l_discount - l_tax) < 0.03 AS near FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem)""")
def rounding_math(t):
    li = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount").distinct()
    return li.select("l_orderkey", "l_linenumber", "l_quantity", F.bround(F.col("l_quantity") / 2, 0).alias("half_even"), r4(F.sqrt("l_extendedprice")).alias("root"),
                     r4(F.pow(F.col("l_tax") + 1, F.lit(2.5))).alias("power"), F.floor(F.col("l_discount") * 37).alias("fl"), F.ceil(F.col("l_discount") * 37).alias("ce"),
                     (F.abs(F.col("l_discount") - F.col("l_tax")) < 0.03).alias("near"))


@query("sample_cap", "P10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def sample_cap(t):
    return L.seeded_sample(t.table("orders").select("o_orderkey", "o_totalprice"), 500, 7, "o_orderkey")


@query("history_window", "P5 U1 W8", sql("""
    , h AS (SELECT block_lgd, issue_date, lead_day, fc_rain, 0 AS pri FROM fc WHERE lead_day = 1 UNION ALL SELECT block_lgd, issue_date, lead_day, fc_rain + 1, 1 FROM fc WHERE lead_day = 1 AND block_lgd < 3)
    SELECT block_lgd, issue_date, fc_rain FROM (SELECT *, row_number() OVER (PARTITION BY block_lgd, issue_date, lead_day ORDER BY pri) AS rn FROM h
      WHERE issue_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-14') WHERE rn = 1""", "fc"))
def history_window(t):
    lead1 = t.fc.where("lead_day = 1 and issue_date between '2024-01-12' and '2024-01-14'").select("block_lgd", "issue_date", "lead_day", "fc_rain")
    live = lead1.where("block_lgd < 3").withColumn("fc_rain", F.col("fc_rain") + 1)
    both = lead1.withColumn("pri", F.lit(0)).unionByName(live.withColumn("pri", F.lit(1)))
    return L.keep_one(both, ["block_lgd", "issue_date", "lead_day"], ["pri"], last=False).select("block_lgd", "issue_date", "fc_rain")


@query("sorted_topk", "T1 T2", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def sorted_topk(t):
    df = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return L.top_k(df, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 25)


@query("set_ops", "U1 U3 U4 U5", """
    SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL
    SELECT 'difference', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL
    SELECT 'intersection', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_ops(t):
    c, s = t.table("customer"), t.table("supplier")
    ck, sk = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    c9, s5 = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    parts = {"union": ck.union(sk).distinct(), "difference": c9.subtract(s5), "intersection": c9.intersect(s5)}
    out = None
    for op, df in parts.items():
        df = df.select(F.lit(op).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@query("exact_rank", "W11 T1", """
    SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS BIGINT) AS rank,
      CAST(count(*) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS total FROM customer""")
def exact_rank(t):
    c = t.table("customer").select("c_custkey", "c_mktsegment", F.md5(F.col("c_custkey").cast("string")).alias("h"))
    return L.exact_rank(c, ["c_mktsegment"], ["h", "c_custkey"], L.bucket_of_md5(F.col("h"))).select("c_custkey", "c_mktsegment", "rank", "total")


@query("exact_quantiles", "A6 A27 M12", f"""
    SELECT l_returnflag, {R('quantile_cont(l_extendedprice, 0.1)')} AS q10, {R('quantile_cont(l_extendedprice, 0.5)')} AS q50, {R('quantile_cont(l_extendedprice, 0.9)')} AS q90 FROM lineitem GROUP BY 1""")
def exact_quantiles(t):
    out = L.exact_quantiles(t.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return rounded(out, ["q10", "q50", "q90"])


@query("contributions_by_family", "A32 M16", sql(f"""
    , s AS (SELECT avg(rain) AS r, avg(tmax) AS x, avg(wind) AS w FROM vars), c AS (SELECT gp_code, d, 0.5 * (rain - r) AS c1, -0.3 * (tmax - x) AS c2, 0.2 * (wind - w) AS c3 FROM vars, s),
    f AS (SELECT gp_code, d, unnest(['water', 'energy']) AS family, unnest([coalesce(c1, 0) + coalesce(c3, 0), coalesce(c2, 0)]) AS v FROM c)
    SELECT family, {R('avg(abs(v))')} AS mean_abs, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1""", "vars"))
def contributions_by_family(t):
    from finegrid.operators.model import family_contributions, linear_contributions
    coef = {"rain": 0.5, "tmax": -0.3, "wind": 0.2}
    c = linear_contributions(t.vars, coef, ["gp_code", "d"])
    fam = family_contributions(c, ["gp_code", "d"], {"rain": "water", "wind": "water", "tmax": "energy"})
    return fam.groupBy("family").agg(r4(F.avg(F.abs("value"))).alias("mean_abs"), F.count("*").alias("n"))


@query("quantile_guard", "W18", sql("""
    SELECT gp_code, d, l[1] AS q10, l[2] AS q50, l[3] AS q90 FROM (SELECT gp_code, d, list_sort([rain, tmax, wind]) AS l FROM vars WHERE rain IS NOT NULL AND tmax IS NOT NULL AND wind IS NOT NULL)""", "vars"))
def quantile_guard(t):
    from finegrid.operators.model import ordered_quantiles
    v = t.vars.where("rain is not null and tmax is not null and wind is not null")
    q = ordered_quantiles(["rain", "tmax", "wind"])
    return v.select("gp_code", "d", *[c.alias(n) for n, c in zip(("q10", "q50", "q90"), q)])


@query("tmin_tmax_fix", "F16", sql(f"""
    SELECT gp_code, d, {R('CASE WHEN tmin > tmax THEN (tmin + tmax) / 2 - 0.05 ELSE tmin END')} AS tmin, {R('CASE WHEN tmin > tmax THEN (tmin + tmax) / 2 + 0.05 ELSE tmax END')} AS tmax FROM vars""", "vars"))
def tmin_tmax_fix(t):
    lo, hi = C.ordered_temperatures(F.col("tmin"), F.col("tmax"))
    return t.vars.select("gp_code", "d", r4(lo).alias("tmin"), r4(hi).alias("tmax"))
