"""Clusters and models that run as distributed jobs: MLlib, or sums over the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.functions.arrays import let
from gridstrata.operators.ranks import attach, exact_quantiles
from gridstrata.session import checkpoint


def assemble(df: DataFrame, columns: Sequence[str], scale: bool = True, name: str = "features") -> DataFrame:
    """Columns to a vector column, standardised over the table if wanted.

    The rows are checkpointed once: the trainers below pass over them many times.
    """
    out = checkpoint(VectorAssembler(inputCols=list(columns), outputCol="_raw" if scale else name).transform(df))
    if not scale:
        return out
    scaler = StandardScaler(inputCol="_raw", outputCol=name, withMean=True, withStd=True).fit(out)
    return scaler.transform(out).drop("_raw")


def kmeans(df: DataFrame, ks: Sequence[int], seed: int = 1) -> tuple[DataFrame, dict[int, float]]:
    """Labels of the last k, and the within-cluster sum of squares of each k."""
    costs, labels = {}, None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df)
        costs[k] = float(model.summary.trainingCost)
        labels = model.transform(df)
    return labels, costs


def gaussian_mixture(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Mixture label and the probability of the best component."""
    model = GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="cluster", probabilityCol="_p").fit(df)
    return model.transform(df).withColumn("confidence", F.array_max(vector_to_array("_p"))).drop("_p")


def silhouette_mean(df: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(df)


def silhouette_rows(df: DataFrame, key: str) -> DataFrame:
    """Squared-distance silhouette of each row from cluster sums: no pairs of rows are formed.

    The mean squared distance to a cluster is |x|² − 2 x·mean + mean |x|²; the table of clusters has k entries.
    """
    rows = df.select(key, "cluster", vector_to_array("features").alias("_x"))
    square = F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)
    flat = rows.select("cluster", F.posexplode("_x").alias("_i", "_v"))
    sums = flat.groupBy("cluster", "_i").agg(F.avg("_v").alias("_m"))
    means = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("m"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("s"))
    table = means.join(sizes, "cluster").agg(F.collect_list(F.struct("cluster", "m", "n", "s")).alias("_t"))
    out = attach(rows, [], table).withColumn("_q", square)

    def distance(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col("_x"), c["m"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.col("_q") - 2 * dot + c["s"]

    d = F.transform("_t", lambda c: F.struct(c["cluster"].alias("c"), c["n"].alias("n"), distance(c).alias("d")))
    out = out.withColumn("_d", d)
    own = F.filter("_d", lambda e: e["c"] == F.col("cluster"))[0]
    other = F.array_min(F.transform(F.filter("_d", lambda e: e["c"] != F.col("cluster")), lambda e: e["d"]))
    inner = own["d"] * own["n"] / (own["n"] - 1)
    value = F.when(own["n"] > 1, (other - inner) / F.greatest(other, inner)).otherwise(0.0)
    return out.select(key, "cluster", value.alias("silhouette"))


def pca_loadings(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """One row per component and feature; the model is small, so it comes back as a local table."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(df)
    pc, share = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(i, names[j], float(pc[j][i]), float(share[i])) for i in range(k) for j in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double, explained double")


def soft_cluster(df: DataFrame, label: str, prob: str, low: float, high: float) -> DataFrame:
    """Logistic probability of cluster 1 and its class: winter below the low quantile, summer above the high one."""
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=20).fit(df)
    out = model.transform(df).withColumn(prob, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    cuts = exact_quantiles(out, [], prob, {"_lo": low, "_hi": high})
    side = F.when(F.col(prob) <= F.col("_lo"), "winter").when(F.col(prob) >= F.col("_hi"), "summer").otherwise("both")
    return attach(out, [], cuts).withColumn("side", side).drop("_lo", "_hi")


def correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label, one row per feature; one pass."""
    wide = df.agg(*[F.corr(f, label).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "correlation")


def forest(df: DataFrame, names: Sequence[str], label: str, trees: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Feature importances, and the predictions for all rows."""
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(df)
    rows = [(n, float(model.featureImportances[i])) for i, n in enumerate(names)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table, model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction")


def hinge_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, breaks: int = 20, margin: float = 3.0) -> DataFrame:
    """Per key the break point with the smallest error of a line below it and zero above, and that line.

    Rows are summed by the gap between break points they fall in; the line below each break comes from running sums
    over at most ``breaks + 1`` gaps, so no row is copied per candidate.
    """
    ends = df.groupBy(*keys).agg((F.min(x) + margin).alias("_a"), (F.max(x) - margin).alias("_z"))
    rows = attach(df.select(*keys, x, y), keys, ends.where("_a < _z"))
    step = (F.col("_z") - F.col("_a")) / breaks
    at = lambda i: F.col("_a") + step * i
    xx, yy = F.col(x), F.col(y)
    near = F.floor((xx - F.col("_a")) / step)  # off by one at most, where the division rounds
    last = near + F.when(at(near + 1) <= xx, 1).when(at(near) > xx, -1).otherwise(0)
    gap = F.least(F.greatest(last + 1, F.lit(0)), F.lit(breaks)).cast("int")
    sums = rows.groupBy(*keys, "_a", "_z", gap.alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(xx).alias("sx"), F.sum(yy).alias("sy"), F.sum(xx * xx).alias("sxx"),
        F.sum(xx * yy).alias("sxy"), F.sum(yy * yy).alias("syy"),
    )
    filled = sums.groupBy(*keys, "_a", "_z").agg(F.collect_list(F.struct("_g", "n", "sx", "sy", "sxx", "sxy", "syy")).alias("_l"))
    cand = filled.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(breaks - 1))))
    below = cand.withColumn("_e", F.explode("_l")).withColumn("_in", F.col("_e._g") <= F.col("_i"))
    part = lambda c: F.coalesce(F.sum(F.when(F.col("_in"), F.col(f"_e.{c}"))), F.lit(0.0)).alias(c)
    m = below.groupBy(*keys, "_a", "_z", "_i").agg(
        *[part(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")], F.sum("_e.syy").alias("all_yy"), F.sum("_e.n").alias("all_n")
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vxy, vy = F.col("sxx") - sx * sx / n, F.col("sxy") - sx * sy / n, F.col("syy") - sy * sy / n
    m = m.where((n > 1) & (vx > 1e-9)).withColumns({"slope": vxy / vx, "t": at(F.col("_i"))})
    rmse = F.sqrt(F.greatest(vy - F.col("slope") * vxy + F.col("all_yy") - F.col("syy"), F.lit(0.0)) / F.col("all_n"))
    m = m.withColumns({"intercept": (sy - F.col("slope") * sx) / n, "rmse": F.round(rmse, 9)})
    best = F.min_by(F.struct("t", "slope", "intercept", "rmse"), F.struct("rmse", "_i")).alias("_b")
    return m.groupBy(*keys).agg(best).select(*keys, "_b.*")


def hinge_predict(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    out = df.join(fit, list(keys))
    return out.withColumn("predicted", F.when(F.col(x) < F.col("t"), F.col("slope") * F.col(x) + F.col("intercept")).otherwise(0.0))


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def residual_trees(df: DataFrame, y: str, first: str, columns: Sequence[str], seed: int = 1, rounds: int = 10) -> DataFrame:
    """Boosted trees on what the first model leaves; the two predictions are added."""
    rows = assemble(df.withColumn("_r", F.col(y) - F.col(first)), columns, scale=False)
    model = GBTRegressor(featuresCol="features", labelCol="_r", maxIter=rounds, maxDepth=4, seed=seed, predictionCol="_g").fit(rows)
    return model.transform(rows).withColumn("both", F.col(first) + F.col("_g")).drop("features", "_r", "_g")


def route(df: DataFrame, kind: str, kinds: Sequence[int], targets: dict[int, str]) -> DataFrame:
    """Predict the stock type, send each row to the model of its type; the other types' columns stay null."""
    gate = LogisticRegression(featuresCol="features", labelCol=kind, maxIter=20, predictionCol="kind_pred").fit(df)
    routed = gate.transform(df).drop("probability", "rawPrediction")
    out = None
    for k in kinds:
        t = targets[k]
        model = LogisticRegression(featuresCol="features", labelCol=t, maxIter=20, predictionCol=f"{t}_pred").fit(df.where(F.col(kind) == k))
        part = model.transform(routed.where(F.col("kind_pred") == k)).drop("probability", "rawPrediction")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def seasonal_baseline(df: DataFrame, keys: Sequence[str], slots: dict[str, Column], value: str) -> DataFrame:
    """Mean of the season slot as baseline of each row, and what is above it."""
    rows = df.withColumns(slots)
    means = rows.groupBy(*keys, *slots).agg(F.avg(value).alias("baseline"))
    return rows.join(means, [*keys, *slots]).withColumn("residual", F.col(value) - F.col("baseline"))


def _shift_to(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """The series moved to its best match with the centroid, and the normalised correlation there."""
    norm = np.linalg.norm(x) * np.linalg.norm(c)
    if norm == 0:
        return x, 0.0
    corr = np.correlate(c, x, mode="full") / norm
    best = int(np.argmax(corr))
    lag = best - (len(x) - 1)
    moved = np.zeros_like(x)
    if lag >= 0:
        moved[lag:] = x[: len(x) - lag]
    else:
        moved[:lag] = x[-lag:]
    return moved, float(corr[best])


def kshape(df: DataFrame, key: str, arr: str, k: int, rounds: int = 5, seed: int = 1) -> DataFrame:
    """Shape-based clusters of standardised profiles.

    Each round assigns by the best shifted correlation and takes as new centroid the leading eigenvector of the summed
    outer products. Those are summed by cluster and matrix cell on the executors; the driver sees k · d² numbers.
    """
    def standard(a: Column) -> Column:
        n = F.size(a)
        mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n

        def scale(m: Column) -> Column:
            dev = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / n)
            return let(dev, lambda d: F.transform(a, lambda v: F.when(d > 0, (v - m) / d).otherwise(F.lit(0.0))))

        return let(mean, scale)

    rows = checkpoint(df.select(key, standard(F.col(arr)).alias("x")))
    start = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k).collect()
    centroids = np.array([r["x"] for r in start], float)
    d = centroids.shape[1]
    kind = df.schema[key].dataType.simpleString()

    def assign(c: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                best, moved, score = [], [], []
                for x in pdf["x"]:
                    options = [_shift_to(np.asarray(x, float), one) for one in c]
                    i = int(np.argmax([o[1] for o in options]))
                    best.append(i)
                    moved.append(options[i][0])
                    score.append(options[i][1])
                yield pd.DataFrame({key: pdf[key], "cluster": best, "ncc": score, "x": moved})

        return rows.mapInPandas(run, f"{key} {kind}, cluster int, ncc double, x array<double>")

    centre = np.eye(d) - 1.0 / d
    for _ in range(rounds):
        placed = checkpoint(assign(centroids))
        cells = placed.select("cluster", "x", F.posexplode("x").alias("i", "_a")).select("cluster", "i", "_a", F.posexplode("x").alias("j", "_b"))
        sums = cells.groupBy("cluster", "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("s")).collect()
        firsts = {r["cluster"]: np.array(r["m"]) for r in _mean_shapes(placed).collect()}
        matrices = np.zeros((k, d, d))
        for r in sums:
            matrices[r["cluster"], r["i"], r["j"]] = r["s"]
        fresh = centroids.copy()
        for c in range(k):
            if matrices[c].any():
                vector = np.linalg.eigh(centre @ matrices[c] @ centre)[1][:, -1]
                if c in firsts and vector @ firsts[c] < 0:
                    vector = -vector
                fresh[c] = (vector - vector.mean()) / vector.std()
        if np.allclose(fresh, centroids, atol=1e-9):
            break
        centroids = fresh
    return assign(centroids).drop("x")


def _mean_shapes(placed: DataFrame) -> DataFrame:
    flat = placed.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
    return flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("m"))

