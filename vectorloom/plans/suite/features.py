"""Feature statistics, scaling and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import vec
from ...operators import feature_stats as fs
from ...operators import ordering, preprocess
from .inputs import ORDER_LINES, RAW, embeddings, order_lines, r6, standardized, table, tidy

FULL_SQL = f"""
WITH {ORDER_LINES},
 base AS (SELECT f, avg(x) AS mean, var_pop(x) AS variance, stddev_pop(x) AS std, min(x) AS mn, max(x) AS mx, count(*) AS n,
   quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS med,
   quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95 FROM good GROUP BY f),
 mad AS (SELECT f, quantile_cont(abs(x - med), 0.5) AS mad FROM good JOIN base USING (f) GROUP BY f),
 fen AS (SELECT f, count(*) FILTER (WHERE x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25)) AS outlier_count,
   min(x) FILTER (WHERE x >= p25 - 1.5 * (p75 - p25) AND x <= p75 + 1.5 * (p75 - p25)) AS whisker_min,
   max(x) FILTER (WHERE x >= p25 - 1.5 * (p75 - p25) AND x <= p75 + 1.5 * (p75 - p25)) AS whisker_max
   FROM good JOIN base USING (f) GROUP BY f),
 inv AS (SELECT f, count(*) - count(*) FILTER (WHERE isfinite(x)) AS invalid_count FROM lines GROUP BY f)
"""
STATUS_SQL = """CASE WHEN std <= 1e-12 * greatest(abs(mean), 1) OR mx - mn <= 1e-12 THEN 'constant'
   WHEN variance / max(variance) OVER () < 1e-4 THEN 'near_zero'
   WHEN variance / max(variance) OVER () < 1e-2 THEN 'low_variation' ELSE 'active' END"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("i"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("features"))


def _long(spark, sf):
    return fs.long_values(order_lines(spark, sf))


def fv1(spark, sf):
    return fs.moments(_long(spark, sf)).select("f", "finite_count", "invalid_count")


def fv2(spark, sf):
    return tidy(fs.moments(_long(spark, sf)).select("f", "mean", "variance", "std", "min", "max"), 4)


def fv3(spark, sf):
    return tidy(fs.quantiles(_long(spark, sf)))


def fv4(spark, sf):
    long = _long(spark, sf)
    spread = fs.robust_spread(long, fs.quantiles(long)).join(fs.moments(long).select("f", "std"), "f")
    ratio = F.when(F.col("robust_sigma") > fs.EPSILON, F.col("std") / F.col("robust_sigma"))
    return tidy(spread.select("f", "mad", "robust_sigma", ratio.alias("std_robust_ratio")))


def fv5(spark, sf):
    long = _long(spark, sf)
    return tidy(fs.fences(long, fs.quantiles(long)))


def fv6(spark, sf):
    return tidy(fs.feature_histogram(order_lines(spark, sf), 32), 4)


def fv7(spark, sf):
    return tidy(fs.distribution_sample(_orders(spark, sf), {"distribution_sample_size": 5000}))


def fv8(spark, sf):
    return tidy(fs.feature_variance(order_lines(spark, sf)).select("f", "status", "relative_variance"), 8)


def fv9_top(spark, sf):
    return tidy(fs.top_features(fs.status(fs.moments(fs.long_values(embeddings(spark, sf)))), {"top_k": 20}).select("f", "variance"), 9)


def fv9_summary(spark, sf):
    return tidy(fs.summary(fs.feature_variance(order_lines(spark, sf))), 4)


def fv10(spark, sf):
    return tidy(fs.density(order_lines(spark, sf)), 4)


def agg21(spark, sf):
    v = F.col("features")
    return tidy(embeddings(spark, sf).select("i", vec.row_mean(v).alias("mean"), vec.row_std(v).alias("std"), vec.norm(v).alias("norm")))


def pre1(spark, sf):
    df = embeddings(spark, sf)
    return tidy(vec.unpivot(preprocess.fit(df, "standardized").apply(df), "i"))


def pre1_center(spark, sf):
    df = embeddings(spark, sf)
    return tidy(vec.unpivot(preprocess.fit(df, "center").apply(df), "i"))


def pre2(spark, sf):
    df = embeddings(spark, sf)
    return tidy(vec.unpivot(preprocess.fit_reference(df.where("label < 5")).apply(df.where("label >= 5")), "i"))


def pre3(spark, sf):
    df = embeddings(spark, sf)
    return tidy(vec.unpivot(preprocess.fit_sampling(df, "robust").apply(df), "i"))


def flt5(spark, sf):
    lines = table(spark, sf, "lineitem")
    df = lines.select(F.array("l_quantity", F.lit(7.0), "l_tax", F.lit(1e6)).alias("features"))
    m = fs.moments(fs.long_values(df))
    keep = F.col("std") > vec.RELATIVE_TOLERANCE * F.greatest(F.abs("mean"), F.lit(1.0))
    return m.select("f", keep.alias("kept"))


def flt6(spark, sf):
    return order_lines(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~vec.all_finite(F.col("features"))).alias("refused"))


def fn12(spark, sf):
    """Distance of every vector to its group's mean vector, in three metrics."""
    df = embeddings(spark, sf)
    means = vec.unpivot(df, "label").groupBy("label", "f").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda s: s["m"]).alias("c"))
    joined = df.join(centre, "label")
    a, b = F.col("features"), F.col("c")
    return tidy(joined.select(
        "i", vec.euclidean(a, b).alias("l2"), vec.manhattan(a, b).alias("l1"), vec.cosine(a, b).alias("cos"),
        vec.similarity("euclidean", vec.euclidean(a, b)).alias("sim")))


def agg6(spark, sf):
    return tidy(ordering.histogram(table(spark, sf, "lineitem"), [], "l_extendedprice", 40), 4)


def agg7(spark, sf):
    lines = table(spark, sf, "lineitem")
    base = lines.groupBy("l_returnflag").agg(
        F.min("l_extendedprice").alias("min"), F.max("l_extendedprice").alias("max"), F.avg("l_extendedprice").alias("mean"))
    middle = ordering.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.5], ["median"])
    return tidy(base.join(middle, "l_returnflag"), 4)


def agg8_grid(spark, sf):
    """The bounded-grid form: counters of fixed width and the rank they give."""
    lines = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 100).alias("v"))
    grid = lines.groupBy(F.floor(F.col("v") * 1000.0).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    run = ordering.running_totals(grid.withColumn("_all", F.lit(0)), ["_all"], "slot", "n")
    rank = (F.col("total") - 1) / 2.0
    at = run.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")))
    lowest, highest = lines.agg(F.min("v"), F.max("v")).first()
    mid = (F.greatest(F.col("slot") * 0.001, F.lit(lowest)) + F.least((F.col("slot") + 1) * 0.001, F.lit(highest))) / 2
    return tidy(at.select("total", mid.alias("median")))


def win8(spark, sf):
    return ordering.average_ranks(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select(
        "event_id", "event_type", "rank")


def win7(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    keyed = df.withColumn("key", F.struct("o_totalprice", "o_orderkey"))
    ranked = ordering.average_ranks(df, [], "o_totalprice", "r")
    return tidy(ranked.select("o_orderkey", "r"))


QUERIES = {
    "fv1_finite_counts": fv1, "fv2_moments": fv2, "fv3_quantiles": fv3, "fv4_robust_spread": fv4, "fv5_fences": fv5,
    "fv6_histogram": fv6, "fv7_distribution_sample": fv7, "fv8_status": fv8, "fv9_top_features": fv9_top,
    "fv9_summary": fv9_summary, "fv10_density": fv10, "agg21_row_summary": agg21, "pre1_standardized": pre1,
    "pre1_centered": pre1_center, "pre2_reference_scaling": pre2, "pre3_robust_scaling": pre3,
    "flt5_constant_features": flt5, "flt6_non_finite": flt6, "fn12_vector_distances": fn12, "agg6_histogram": agg6,
    "agg7_summary": agg7, "agg8_grid_median": agg8_grid, "win8_average_ranks": win8, "win8_global_ranks": win7,
}

_HIST = """span AS (SELECT {g} min(x) AS a, max(x) AS b FROM {src} {by}),
 edge AS (SELECT {g} CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM span)"""

SQL = {
    "fv1_finite_counts": f"WITH {ORDER_LINES} SELECT f, count(*) FILTER (WHERE isfinite(x)) AS finite_count, "
    "count(*) FILTER (WHERE NOT isfinite(x)) AS invalid_count FROM lines GROUP BY f",
    "fv2_moments": FULL_SQL + f"SELECT f, {r6('mean', 4)} AS mean, {r6('variance', 4)} AS variance, {r6('std', 4)} AS std, "
    f"{r6('mn', 4)} AS min, {r6('mx', 4)} AS max FROM base",
    "fv3_quantiles": FULL_SQL + f"SELECT f, {r6('p05')} AS p05, {r6('p25')} AS p25, {r6('med')} AS median, {r6('p75')} AS p75, "
    f"{r6('p95')} AS p95, {r6('p75 - p25')} AS iqr FROM base",
    "fv4_robust_spread": FULL_SQL + f"SELECT f, {r6('mad')} AS mad, {r6('1.4826 * mad')} AS robust_sigma, "
    f"{r6('std / (1.4826 * mad)')} AS std_robust_ratio FROM base JOIN mad USING (f)",
    "fv5_fences": FULL_SQL + f"SELECT f, {r6('whisker_min')} AS whisker_min, {r6('whisker_max')} AS whisker_max, outlier_count FROM fen",
    "fv6_histogram": f"""WITH {ORDER_LINES}, {_HIST.format(g='f,', src='good', by='GROUP BY f')},
 c AS (SELECT f, least(floor((x - a) / (b - a) * 32), 31)::INTEGER AS bin, count(*) AS n FROM good JOIN edge USING (f) GROUP BY 1, 2)
 SELECT g.f, g.bin, {r6('g.a + (g.b - g.a) / 32 * g.bin', 4)} AS lo, {r6('g.a + (g.b - g.a) / 32 * (g.bin + 1)', 4)} AS hi, coalesce(n, 0) AS n
 FROM (SELECT f, a, b, unnest(range(0, 32))::INTEGER AS bin FROM edge) g LEFT JOIN c ON g.f = c.f AND g.bin = c.bin""",
    "fv7_distribution_sample": """WITH v AS (SELECT o_orderkey AS i, unnest([o_totalprice, o_custkey::DOUBLE]) AS x, unnest([0, 1]) AS f FROM orders),
 q AS (SELECT f, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v GROUP BY f),
 m AS (SELECT i, f, x, (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a))::INTEGER AS outlier,
   row_number() OVER (PARTITION BY f ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY f) AS n FROM v JOIN q USING (f)),
 o AS (SELECT *, sum(outlier) OVER (PARTITION BY f) AS n_out FROM m),
 w AS (SELECT f, n, least(n, 5000) - max(n_out) AS want FROM o GROUP BY f, n),
 p AS (SELECT f, trunc(k * ((n - 1)::DOUBLE / (want - 1)))::BIGINT AS place FROM (SELECT f, n, want, unnest(range(0, want::BIGINT)) AS k FROM w))
 SELECT o.f, o.i, round(x, 6) + 0.0 AS x, outlier FROM o WHERE outlier = 1 OR EXISTS (SELECT 1 FROM p WHERE p.f = o.f AND p.place = o.place)""",
    "fv8_status": FULL_SQL + f"SELECT f, {STATUS_SQL} AS status, round(variance / max(variance) OVER (), 8) + 0.0 AS relative_variance FROM base",
    "fv9_top_features": f"WITH {RAW}, u AS (SELECT unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS f FROM e) "
    "SELECT f, round(var_pop(x), 9) + 0.0 AS variance FROM u GROUP BY f ORDER BY var_pop(x) DESC, f LIMIT 20",
    "fv9_summary": FULL_SQL + f""", st AS (SELECT f, variance, {STATUS_SQL} AS status, invalid_count FROM base JOIN inv USING (f))
 SELECT round(max(variance), 4) + 0.0 AS max_variance, round(min(variance), 4) + 0.0 AS min_variance, round(median(variance), 4) + 0.0 AS median_variance,
 count(*) FILTER (WHERE status = 'near_zero') AS near_zero_count, count(*) FILTER (WHERE status = 'constant') AS constant_count,
 0::BIGINT AS insufficient_count, count(*) FILTER (WHERE status = 'low_variation') AS low_variation_count,
 count(*) FILTER (WHERE status = 'active') AS active_count, 0::BIGINT AS invalid_count, sum(invalid_count)::BIGINT AS invalid_value_count,
 count(*) FILTER (WHERE status IN ('active', 'low_variation')) AS effective_nonzero_dimensions FROM st""",
    "fv10_density": f"""WITH {ORDER_LINES}, s AS (SELECT f, count(*) AS n, min(x) AS a, max(x) AS b, stddev_pop(x) AS sd FROM good GROUP BY f),
 h AS (SELECT *, greatest(1.06 * sd * pow(n, -0.2), (b - a) / 80) AS h FROM s),
 g AS (SELECT *, unnest(range(0, 80))::INTEGER AS k FROM h),
 c AS (SELECT f, x, count(*) AS c FROM good GROUP BY f, x),
 p AS (SELECT *, a - 3 * h + k * ((b - a + 6 * h) / 79) AS spot FROM g)
 SELECT p.f, k, round(any_value(spot), 4) + 0.0 AS spot,
 round(sum(c * exp(-0.5 * ((spot - x) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * any_value(n) * (any_value(b - a) / 32), 4) + 0.0 AS density
 FROM p JOIN c USING (f) GROUP BY p.f, k""",
    "agg21_row_summary": f"WITH {RAW} SELECT i, {r6('list_avg(v)')} AS mean, {r6('list_stddev_pop(v)')} AS std, "
    f"{r6('sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS norm FROM e",
    "pre1_standardized": f"WITH {RAW}, {standardized('e', 'z')} SELECT i, unnest(range(0, len(v)))::INTEGER AS f, round(unnest(v), 6) + 0.0 AS x FROM z",
    "pre1_centered": f"WITH {RAW}, u AS (SELECT i, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS f FROM e) "
    "SELECT i, f, round(x - avg(x) OVER (PARTITION BY f), 6) + 0.0 AS x FROM u",
    "pre2_reference_scaling": f"WITH {RAW}, {standardized('e', 'z', 'label >= 5', 'label < 5')} "
    "SELECT i, unnest(range(0, len(v)))::INTEGER AS f, round(unnest(v), 6) + 0.0 AS x FROM z",
    "pre3_robust_scaling": f"""WITH {RAW}, u AS (SELECT i, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS f FROM e),
 q AS (SELECT f, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS b FROM u GROUP BY f)
 SELECT i, f, round((x - m) / ((b - a) / 1.349), 6) + 0.0 AS x FROM u JOIN q USING (f)""",
    "flt5_constant_features": """WITH u AS (SELECT unnest([l_quantity, 7.0, l_tax, 1e6]) AS x, unnest([0, 1, 2, 3])::INTEGER AS f FROM lineitem)
 SELECT f, stddev_pop(x) > 1e-12 * greatest(abs(avg(x)), 1) AS kept FROM u GROUP BY f""",
    "flt6_non_finite": "SELECT count(*) AS n, count(*) FILTER (WHERE l_tax = 0) AS refused FROM lineitem",
    "fn12_vector_distances": f"""WITH {RAW}, u AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS f FROM e),
 m AS (SELECT label, f, avg(x) AS m FROM u GROUP BY label, f), c AS (SELECT label, list(m ORDER BY f) AS c FROM m GROUP BY label)
 SELECT i, {r6('list_distance(v, c)')} AS l2, {r6('list_sum(list_transform(range(1, 65), lambda k: abs(v[k] - c[k])))')} AS l1,
 {r6('greatest(1 - list_cosine_similarity(v, c), 0)')} AS cos, {r6('1 / (1 + list_distance(v, c))')} AS sim FROM e JOIN c USING (label)""",
    "agg6_histogram": f"""WITH src AS (SELECT l_extendedprice AS x FROM lineitem), {_HIST.format(g='', src='src', by='')},
 c AS (SELECT least(floor((x - a) / (b - a) * 40), 39)::INTEGER AS bin, count(*) AS n FROM src, edge GROUP BY 1)
 SELECT g.bin, round(a + (b - a) / 40 * g.bin, 4) + 0.0 AS lo, round(a + (b - a) / 40 * (g.bin + 1), 4) + 0.0 AS hi, coalesce(n, 0) AS n
 FROM (SELECT a, b, unnest(range(0, 40))::INTEGER AS bin FROM edge) g LEFT JOIN c USING (bin)""",
    "agg7_summary": "SELECT l_returnflag, round(min(l_extendedprice), 4) + 0.0 AS min, round(max(l_extendedprice), 4) + 0.0 AS max, "
    "round(avg(l_extendedprice), 4) + 0.0 AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS median FROM lineitem GROUP BY 1",
    "agg8_grid_median": """WITH v AS (SELECT l_extendedprice / 100 AS v FROM lineitem), g AS (SELECT floor(v * 1000.0)::BIGINT AS slot, count(*) AS n FROM v GROUP BY 1),
 c AS (SELECT slot, n, sum(n) OVER (ORDER BY slot) AS upto, sum(n) OVER () AS total FROM g)
 SELECT total::BIGINT AS total, round((greatest(slot * 0.001, (SELECT min(v) FROM v)) + least((slot + 1) * 0.001, (SELECT max(v) FROM v))) / 2, 6) + 0.0 AS median
 FROM c WHERE upto > (total - 1) / 2.0 ORDER BY slot LIMIT 1""",
    "win8_average_ranks": """SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
 + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events""",
    "win8_global_ranks": "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders",
}
