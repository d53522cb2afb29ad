"""Clustering and distributed model fitting."""

from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.operators import cluster, density, encode
from gridstrata.operators.blocks import HOUR
from gridstrata.plans.base import DIMENSIONS, VIEWS, grid, long, r6, readings, with_
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.plans.spaces import density_sql
from gridstrata.sources import table

DIMS = [f"d{i}" for i in range(DIMENSIONS)]


def vectors(spark, sf, scale=True):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(DIMENSIONS)]
    )
    return cluster.assemble(rows, DIMS, scale=scale)


@query("kmeans_profiles")
def kmeans_profiles(spark, sf):
    labels, costs = cluster.kmeans(vectors(spark, sf), (3, 5))
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_labels"))
    return sizes.withColumns({f"cost_{k}": F.lit(round(v, 4)) for k, v in costs.items()})


@query("gmm_soft")
def gmm_soft(spark, sf):
    out = cluster.gaussian_mixture(vectors(spark, sf), 4)
    return out.select("vec_id", long("cluster").alias("cluster"), r6("confidence").alias("confidence"))


@query("kshape_profiles")
def kshape_profiles(spark, sf):
    weeks = encode.week_matrix(grid(spark, sf), ["bldg_id"], "ts", "energy", 168, HOUR)
    days = weeks.select("bldg_id", F.posexplode("values").alias("i", "v")).groupBy("bldg_id", (F.col("i") % 24).alias("h")).agg(F.avg("v").alias("v"))
    # Twenty-four entries per building.
    prof = days.groupBy("bldg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda s: s["v"]).alias("x"))
    return rounded(cluster.kshape(prof, "bldg_id", "x", 3, rounds=3), ["bldg_id"])


@query(
    "dbscan_features",
    density_sql("SELECT 0 AS g, bldg_id AS id, avg(energy) AS x, avg(energy) FILTER (hour(ts) BETWEEN 0 AND 5) AS y FROM readings GROUP BY bldg_id", 2.0, 4, readings=VIEWS["readings"])
    + "SELECT pt.id AS bldg_id, CAST(coalesce(cluster, -1) AS BIGINT) AS cluster, CAST(coalesce(core, 0) AS BIGINT) AS core FROM pt LEFT JOIN fo ON fo.x = pt.x AND fo.y = pt.y",
)
def dbscan_features(spark, sf):
    hour = F.hour("ts")
    feats = readings(spark, sf).groupBy("bldg_id").agg(
        F.avg("energy").alias("x"), F.avg(F.when(hour.between(0, 5), F.col("energy"))).alias("y")
    )
    rows = feats.withColumn("all", F.lit(0))
    out = density.density_clusters(rows, ["all"], "bldg_id", "x", "y", 2.0, 4)
    return out.select("bldg_id", long("cluster").alias("cluster"), long("core").alias("core"))


@query("silhouette")
def silhouette(spark, sf):
    labels, _ = cluster.kmeans(vectors(spark, sf), (4,))
    rows = cluster.silhouette_rows(labels, "vec_id")
    per = rows.groupBy("cluster").agg(F.avg("silhouette").alias("mean"), F.min("silhouette").alias("low"), F.count(F.lit(1)).alias("n"))
    return rounded(per.withColumn("overall", F.lit(round(cluster.silhouette_mean(labels), 6))), [])


@query("pca_loadings")
def pca_loadings(spark, sf):
    return rounded(cluster.pca_loadings(vectors(spark, sf), DIMS, 3), [])


@query("soft_cluster_prob")
def soft_cluster_prob(spark, sf):
    labels, _ = cluster.kmeans(vectors(spark, sf), (2,))
    out = cluster.soft_cluster(labels.withColumn("is_one", F.col("cluster").cast("double")), "is_one", "p", 0.3, 0.7)
    return out.select("vec_id", r6("p").alias("p"), "side")


FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


@query(
    "feature_label_correlation",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(corr({c}, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 6) AS correlation FROM lineitem" for n, c in FEATURES.items()) + ")",
)
def feature_label_correlation(spark, sf):
    label = F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)
    rows = table(spark, sf, "lineitem").select(*[F.col(c).alias(n) for n, c in FEATURES.items()], label.alias("label"))
    return rounded(cluster.correlations(rows, list(FEATURES), "label"), [])


def lines(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.col(c).alias(n) for n, c in FEATURES.items()],
        F.when(F.col("l_extendedprice") > 40000 + 400 * F.col("l_quantity"), 1.0).otherwise(0.0).alias("label"),
    )
    return cluster.assemble(rows, list(FEATURES), scale=False)


@query("forest_importance")
def forest_importance(spark, sf):
    importances, _ = cluster.forest(lines(spark, sf), list(FEATURES), "label", trees=10)
    return rounded(importances, [])


@query("forest_predict_raster")
def forest_predict_raster(spark, sf):
    _, scored = cluster.forest(lines(spark, sf), list(FEATURES), "label", trees=10)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", long("prediction").alias("predicted"), r6("p").alias("p"))


HINGE = {
    "r": "SELECT l_suppkey AS bldg_id, l_quantity AS x, l_extendedprice / 997 AS y FROM lineitem",
    "e": "SELECT bldg_id, min(x) + 3 AS a, max(x) - 3 AS z FROM r GROUP BY 1 HAVING min(x) + 3 < max(x) - 3",
    "b": "SELECT bldg_id, CAST(unnest(range(20)) AS INTEGER) AS i, a, z FROM e",
    "t": "SELECT bldg_id, i, a + (z - a) / 20 * i AS t FROM b",
    "f": """SELECT t.bldg_id, i, any_value(t) AS t, regr_slope(y, x) FILTER (x < t) AS slope, regr_intercept(y, x) FILTER (x < t) AS intercept, regr_syy(y, x) FILTER (x < t) AS vy,
            regr_sxy(y, x) FILTER (x < t) AS vxy, coalesce(sum(y * y) FILTER (x >= t), 0) AS above, count(*) AS n, regr_sxx(y, x) FILTER (x < t) AS vx FROM t JOIN r ON r.bldg_id = t.bldg_id GROUP BY 1, 2""",
    "g": "SELECT *, round(sqrt(greatest(vy - slope * vxy + above, 0) / n), 9) AS rmse FROM f WHERE vx > 1e-9",
    "h": "SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY rmse, i) AS rn FROM g",
}


@query(
    "hinge_temperature_fit",
    with_(**HINGE) + "SELECT bldg_id, round(t, 6) AS t, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(rmse, 6) AS rmse FROM h WHERE rn = 1",
)
def hinge_temperature_fit(spark, sf):
    fit = cluster.hinge_fit(pairs(spark, sf), ["bldg_id"], "x", "y")
    return fit.select("bldg_id", r6("t").alias("t"), r6("slope", 5).alias("slope"), r6("intercept", 5).alias("intercept"), r6("rmse").alias("rmse"))


def pairs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("bldg_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 997).alias("y"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("tax"),
    )


@query(
    "linear_fit_group",
    with_(r=HINGE["r"], f="SELECT bldg_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM r GROUP BY 1")
    + """SELECT bldg_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(avg(pow(y - slope * x - intercept, 2))), 6) AS rmse
         FROM r JOIN f USING (bldg_id) GROUP BY bldg_id, slope, intercept, r2""",
)
def linear_fit_group(spark, sf):
    rows = pairs(spark, sf)
    fit = cluster.linear_fit(rows, ["bldg_id"], "x", "y")
    gap = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    out = rows.join(fit, "bldg_id").groupBy("bldg_id", "slope", "intercept", "r2").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return rounded(out, ["bldg_id"])


@query("two_level_residual")
def two_level_residual(spark, sf):
    rows = pairs(spark, sf)
    first = cluster.hinge_predict(rows, cluster.hinge_fit(rows, ["bldg_id"], "x", "y"), ["bldg_id"], "x")
    both = cluster.residual_trees(first, "y", "predicted", ["x", "d", "tax"], rounds=3)
    gap, lone = F.col("y") - F.col("both"), F.col("y") - F.col("predicted")
    return both.groupBy("bldg_id").agg(r6(F.sqrt(F.avg(lone * lone)), 4).alias("rmse_first"), r6(F.sqrt(F.avg(gap * gap)), 4).alias("rmse_both"))


@query("route_hierarchical")
def route_hierarchical(spark, sf):
    rows = vectors(spark, sf).withColumns(
        {
            "kind": (F.col("label") % 2).cast("double"), "com": (F.col("label") % 4 >= 2).cast("double"), "res": (F.col("label") % 3 == 0).cast("double"),
        }
    )
    out = cluster.route(rows, "kind", (0, 1), {0: "com", 1: "res"})
    return out.select("vec_id", long("kind_pred").alias("kind_pred"), long("com_pred").alias("com_pred"), long("res_pred").alias("res_pred"))


@query(
    "seasonal_average_baseline",
    with_("readings", "cal", b="SELECT bldg_id, season, hour, avg(energy) AS b FROM cal GROUP BY ALL")
    + """SELECT bldg_id, round(sqrt(avg(pow(energy - b, 2))), 6) AS rmse, round(max(energy - b), 6) AS worst, count(*) FILTER (energy > 1.5 * b) AS n_above
         FROM cal JOIN b USING (bldg_id, season, hour) GROUP BY 1""",
)
def seasonal_average_baseline(spark, sf):
    slots = {"season": cal.season_cold_hot_mild(F.month("ts")), "hour": F.hour("ts")}
    out = cluster.seasonal_baseline(readings(spark, sf), ["bldg_id"], slots, "energy")
    return out.groupBy("bldg_id").agg(
        r6(F.sqrt(F.avg(F.col("residual") * F.col("residual")))).alias("rmse"), r6(F.max("residual")).alias("worst"),
        F.count_if(F.col("energy") > 1.5 * F.col("baseline")).alias("n_above"),
    )
