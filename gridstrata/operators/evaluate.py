"""Scores as queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.functions.arrays import let
from gridstrata.operators.blocks import DAY, over_blocks
from gridstrata.operators.cube import by_key
from gridstrata.operators.joins import range_join
from gridstrata.operators.matching import greedy
from gridstrata.operators.ranks import attach, exact_quantiles, value_ranks
from gridstrata.operators.splits import HASH_PRIME, id_hash
from gridstrata.session import checkpoint


def f1_macro(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    """Macro F1 over the classes that occur as truth or prediction."""
    cells = df.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col(true).alias("c"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col(true) == F.col(pred), F.col("_n")).otherwise(0).alias("h")),
        F.struct(F.col(pred).alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )
    classes = cells.select(*keys, F.inline(sides)).groupBy(*keys, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return classes.groupBy(*keys).agg(F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("f1"), F.count(F.lit(1)).alias("n_classes"))


def hierarchical_f1(df: DataFrame, kind_true: str, kind_pred: str, targets: dict[str, Sequence[tuple[str, str]]], alpha: float = 0.4) -> DataFrame:
    """``alpha`` × F1 of the stock type + (1 − alpha) × mean over the types of their mean target F1.

    Targets of a type are scored on the rows whose type is true and predicted alike.
    """
    entries = [F.struct(F.lit("").alias("kind"), F.lit("type").alias("target"), F.col(kind_true).alias("t"), F.col(kind_pred).alias("p"))]
    for kind, pairs in targets.items():
        both = (F.col(kind_true) == kind) & (F.col(kind_pred) == kind)
        for t, p in pairs:
            entry = F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("target"), F.col(t).cast("string").alias("t"), F.col(p).cast("string").alias("p"))
            entries.append(F.when(both, entry))
    rows = df.select(F.inline(F.array_compact(F.array(*entries))))
    scores = f1_macro(rows, ["kind", "target"], "t", "p").groupBy("kind").agg(F.avg("f1").alias("f"))
    level_one = F.max(F.when(F.col("kind") == "", F.col("f")))
    level_two = F.avg(F.when(F.col("kind") != "", F.col("f")))
    return scores.agg(
        level_one.alias("level_1"), level_two.alias("level_2"), (alpha * level_one + (1 - alpha) * level_two).alias("score")
    )


def iou_pairs(true: DataFrame, pred: DataFrame, keys: Sequence[str], width: int = 10 * DAY) -> DataFrame:
    """Overlapping (truth, prediction) pairs with intersection and union seconds.

    A pair overlaps when one starts inside the other; the two cases are joined apart, so each pair comes once.
    """
    t = true.select(*keys, F.col("start").alias("t_start"), F.col("stop").alias("t_stop"), F.col("id").alias("t_id"))
    p = pred.select(*keys, F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), F.col("id").alias("p_id"))
    inside = range_join(t, p, keys, "t_start", "t_stop", "p_start", width)
    around = range_join(p, t, keys, "p_start", "p_stop", "t_start", width).where(F.col("p_start") < F.col("t_start"))
    pairs = inside.unionByName(around)
    sec = {c: F.unix_timestamp(c) for c in ("t_start", "t_stop", "p_start", "p_stop")}
    inter = F.least(sec["t_stop"], sec["p_stop"]) - F.greatest(sec["t_start"], sec["p_start"])
    union = (sec["t_stop"] - sec["t_start"]) + (sec["p_stop"] - sec["p_start"]) - inter
    return pairs.withColumns({"inter": inter, "uni": union}).where(F.col("inter") > 0)


def interval_score(true: DataFrame, pred: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """Greedy match of truths (in order of start) to the free prediction of best IoU, then the weighted score per name.

    (ΣI/ΣU + 2 · mean exp(−|start gap| / τ) + 3 · F0.5) / 6 with τ 10, or 5 for late starts, in units of ``scale``
    seconds. Empty intervals match nothing but count among truths and predictions.
    """
    real = F.col("start") < F.col("stop")
    pairs = iou_pairs(true.where(real), pred.where(real), [key])
    seconds = {c: F.unix_timestamp(c) for c in ("t_start", "t_stop", "p_start", "p_stop")}
    pairs = pairs.select(
        key, "t_id", "p_id", "inter", "uni", F.struct(seconds["t_start"].alias("a"), seconds["t_stop"].alias("z"), F.col("t_id").alias("i")).alias("t_order"),
        F.struct(seconds["p_start"].alias("a"), seconds["p_stop"].alias("z"), F.col("p_id").alias("i")).alias("p_order"),
        seconds["t_start"].alias("place"), (F.col("inter") / F.col("uni")).alias("gain"))
    pairs = checkpoint(pairs)
    matched = greedy(pairs, [key], "place").join(pairs, [key, "t_id", "p_id"])
    gap = F.col("p_order.a") - F.col("place")
    tau = F.when(gap > 0, 5.0).otherwise(10.0)
    matched = matched.select(key, F.lit(1).alias("n"), F.col("inter").alias("i"), F.col("uni").alias("u"), F.exp(-F.abs(gap) / F.lit(float(scale)) / tau).alias("e"))
    both = true.select(key, F.lit(1).alias("is_true")).unionByName(pred.select(key, F.lit(0).alias("is_true")))
    sums = matched.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "i", "u", "e")])
    sizes = both.groupBy(key).agg(F.count_if(F.col("is_true") == 1).alias("n_true"), F.count_if(F.col("is_true") == 0).alias("n_pred"))
    out = sizes.join(sums, key, "left").na.fill(0)
    zero = F.lit(0.0)
    recall = F.coalesce(F.try_divide("n", "n_true"), zero)
    precision = F.coalesce(F.try_divide("n", "n_pred"), zero)
    f_half = F.coalesce(F.try_divide(1.25 * precision * recall, 0.25 * precision + recall), zero)
    iou = F.coalesce(F.try_divide("i", "u"), zero)
    near = F.coalesce(F.try_divide("e", "n"), zero)
    return out.select(
        key, iou.alias("iou"), near.alias("near"), recall.alias("recall"), precision.alias("precision"), f_half.alias("f_half"),
        ((iou + 2 * near + 3 * f_half) / 6).alias("score"),
    )


def mean_interval_score(scores: DataFrame) -> DataFrame:
    """Plain means over the names of all parts of ``interval_score``, and how many names there are."""
    parts = ("iou", "near", "recall", "precision", "f_half", "score")
    return scores.agg(F.count(F.lit(1)).alias("n_names"), *[F.avg(c).alias(c) for c in parts])


def party_cost_score(df: DataFrame, keys: Sequence[str], true: str, pred: str, optimum: float = 6.0, beta: float = 1 / 16) -> DataFrame:
    gap = F.col(pred) - F.col(true)
    error = F.sqrt(F.avg(gap * gap)) + beta * F.abs(F.sum(pred) - optimum)
    return df.groupBy(*keys).agg(error.alias("score"))


def outbreak_fbeta(
    df: DataFrame, keys: Sequence[str], ts: str, outages: str, target: str, pred: str, population: str, step: int,
    thresholds: Sequence[float], gap: int = 4, window: int = 8, beta: float = 2.0,
) -> DataFrame:
    """Precision, recall and Fβ of predicted outbreaks, one row per threshold.

    The truth is a trailing maximum over ``window`` rows read ``gap + 1`` rows ahead, ≥ the threshold and ≥ 0.1 % of
    the population; found where the prediction is ≥ the threshold and ≥ half the target.
    """
    top = lambda w: {"_m": F.max(outages).over(w.rowsBetween(1 - window, 0))}
    ahead = lambda w: {"_f": F.lead("_m", gap + 1).over(w)}
    rows = over_blocks(df, keys, ts, [top, ahead], before=window * step, after=(gap + 1) * step)
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    no, t = F.lit(False), F.col("threshold")
    real = F.coalesce((F.col("_f") >= t) & (F.col("_f") >= 0.001 * F.col(population)), no)
    found = F.coalesce((F.try_divide(F.col(pred), F.col(target)) >= 0.5) & (F.col(pred) >= t), no)
    counts = rows.groupBy("threshold").agg(
        F.count_if(real & found).alias("tp"), F.count_if(found).alias("n_found"), F.count_if(real).alias("n_real")
    )
    zero = F.lit(0.0)
    precision = F.when(F.col("n_real") > 0, F.coalesce(F.try_divide("tp", "n_found"), zero)).otherwise(zero)
    recall = F.coalesce(F.try_divide("tp", "n_real"), zero)
    b = beta * beta
    score = F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), zero)
    return counts.select("threshold", precision.alias("precision"), recall.alias("recall"), score.alias("fbeta"))


def asymmetric_rmse(df: DataFrame, true: str, pred: str, peak: float = 100.0) -> Column:
    """Root mean square of errors; over-estimates just before peaks (fraction .01) halved, misses at peaks doubled."""
    gap = F.col(pred) - F.col(true)
    before = F.abs(F.col(true) % 1 - 0.01) <= 1e-5
    g = F.when(before & (gap > 0), gap / 2).when((F.col(true) >= peak) & (gap < 0), 2 * gap).otherwise(gap)
    return F.sqrt(F.avg(g * g))


def regression_scores(true: str, pred: str, delta: float = 0.01) -> dict[str, Column]:
    r = F.col(pred) - F.col(true)
    huber = F.when(F.abs(r) <= delta, 0.5 * r * r).otherwise(delta * (F.abs(r) - 0.5 * delta))
    return {
        "mae": F.avg(F.abs(r)), "rmse": F.sqrt(F.avg(r * r)), "huber": F.avg(huber), "mae_zero": F.avg(F.abs(F.col(true)))
    }


def ranking_scores(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve, under the precision-recall curve (trapezoids) and Brier score; null without both classes.

    Works on counts per distinct score; the counts above a score are those of the next point of the curve.
    """
    y = F.col(label)
    ranks = value_ranks(df, keys, score, {"pos": y, "se": (F.col(score) - y) * (F.col(score) - y)})
    totals = df.groupBy(*keys).agg(F.sum(label).alias("_P"), F.count(F.lit(1)).alias("_T"))
    r = attach(ranks.drop("total"), keys, totals)
    neg, neg_below = F.col("freq") - F.col("pos"), F.col("below") - F.col("pos_below")
    P, N = F.col("_P"), F.col("_T") - F.col("_P")
    tp_up, fp_up = P - F.col("pos_below") - F.col("pos"), N - neg_below - neg
    tp, fp = P - F.col("pos_below"), N - neg_below
    prec = tp / (tp + fp)
    prec_up = F.when(tp_up + fp_up > 0, tp_up / (tp_up + fp_up)).otherwise(1.0)
    area = F.try_divide(F.col("pos"), P) * (prec + prec_up) / 2
    return r.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (neg_below + neg / 2)), F.max(P) * F.max(N)).alias("auc_roc"), F.sum(area).alias("auc_pr"),
        (F.sum("se") / F.max("_T")).alias("brier"),
    )


#: Distance of the hashes of two resamples (a fixed value of the draw).
RESAMPLE_STEP = 40692


def poisson_steps(top: int = 9) -> list[float]:
    """Distribution function of the Poisson law with mean 1 at 0 … top − 1."""
    out, p = [], exp(-1.0)
    for k in range(top):
        out.append((out[-1] if out else 0.0) + p)
        p /= k + 1
    return out


def bootstrap(df: DataFrame, keys: Sequence[str], ident: str, error: Column, reps: int = 50, seed: int = 7) -> DataFrame:
    """Mean of the error over resamples with 95 % bounds per key.

    A resample that draws no row of a key is left out of that key's numbers; ``n_reps`` counts the others.

    Each row enters resample r with a Poisson(1) weight drawn from its id: no row order, no shuffle of whole samples.
    The draw squares the id's hash, moved by the resample, so that resamples are not rotations of one another.
    """
    moved = (id_hash(ident, seed) + F.col("rep") * RESAMPLE_STEP) % HASH_PRIME
    u = moved * moved % HASH_PRIME / float(HASH_PRIME)
    weight = F.lit(0)
    for upto in poisson_steps():
        weight = weight + (u >= upto).cast("int")
    rows = df.select(*keys, F.col(ident).cast("bigint").alias(ident), error.alias("_e"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)).cast("array<bigint>")))
    means = rows.withColumn("_w", weight).groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("_e")), F.sum("_w")).alias("m"))
    return means.groupBy(*keys).agg(
        F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("m").alias("n_reps")
    )


def episode_shift(df: DataFrame, keys: Sequence[str], order: Sequence[str], pred: str, share: float = 0.96) -> DataFrame:
    """First, last, smallest and largest prediction per episode; flag of shifts at or above the quantile of all shifts."""
    at = F.struct(*order)
    ep = df.groupBy(*keys).agg(
        F.min_by(pred, at).alias("first"), F.max_by(pred, at).alias("last"), F.min(pred).alias("low"), F.max(pred).alias("high")
    ).withColumn("shift", F.col("last") - F.col("first"))
    cut = exact_quantiles(ep, [], "shift", {"cut": share})
    return attach(ep, [], cut).withColumn("big", (F.col("shift") >= F.col("cut")).cast("bigint")).drop("cut")


def conformal_quantile(cal: DataFrame, score: str, alpha: float) -> DataFrame:
    """Order statistic ⌈(n + 1)(1 − α)⌉ of the calibration scores, one row."""
    ranks = value_ranks(cal.select(score), [], score)
    k = F.least(F.ceil((F.col("total") + 1) * (1 - alpha)), F.col("total"))
    return ranks.where((F.col("below") < k) & (k <= F.col("below") + F.col("freq"))).agg(F.max(score).alias("q"))


def conformal_sets(cal: DataFrame, test: DataFrame, label: str, prob: str, alpha: float = 0.1) -> DataFrame:
    """Prediction sets of a two-class model: which classes are kept, the label (−1 where both), and the certainty."""
    truth = F.when(F.col(label) == 1, F.col(prob)).otherwise(1 - F.col(prob))
    q = conformal_quantile(cal.select((1 - truth).alias("_s")), "_s", alpha)
    out = attach(test, [], q)
    keep1, keep0 = (1 - F.col(prob)) <= F.col("q"), F.col(prob) <= F.col("q")
    size = keep1.cast("int") + keep0.cast("int")
    best = F.when(F.col(prob) >= 0.5, 1).otherwise(0)
    return out.withColumns(
        {"set_size": size, "certainty": 2 - size, "predicted": F.when(size == 2, -1).otherwise(best)}
    )


def certainty_band(df: DataFrame, prob: str, certainty: str, bins: int = 1000) -> DataFrame:
    """Mean certainty by score quantile, and the scores between which it is below 1."""
    ranks = value_ranks(df, [], prob, {"sure": F.col(certainty)})
    groups = ranks.withColumn("bin", F.floor(F.col("below") * bins / F.col("total"))).groupBy("bin").agg(
        (F.sum("sure") / F.sum("freq")).alias("certainty"), F.min(prob).alias("low"), F.max(prob).alias("high")
    )
    unsure = F.col("certainty") < 1
    return groups.agg(
        F.coalesce(F.min(F.when(unsure, F.col("low"))), F.lit(0.0)).alias("band_low"),
        F.coalesce(F.max(F.when(unsure, F.col("high"))), F.lit(0.0)).alias("band_high"),
        F.count_if(unsure).alias("n_unsure"), F.count(F.lit(1)).alias("n_bins"),
    )


def dice_binary(truth: DataFrame, pred: DataFrame, sample: str, coords: Sequence[str], samples: DataFrame) -> DataFrame:
    """Dice of sparse voxel sets per sample; 1 where both are empty. One aggregation, no join of the voxels."""
    cols = [sample, *coords]
    a = truth.select(*cols).distinct().withColumns({"a": F.lit(1), "b": F.lit(0)})
    b = pred.select(*cols).distinct().withColumns({"a": F.lit(0), "b": F.lit(1)})
    cells = a.unionByName(b).groupBy(*cols).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = cells.groupBy(sample).agg(
        F.sum("a").alias("n_true"), F.sum("b").alias("n_pred"), F.sum(F.col("a") * F.col("b")).alias("n_both")
    )
    out = samples.join(sums, sample, "left").na.fill(0, ["n_true", "n_pred", "n_both"])
    both = F.col("n_true") + F.col("n_pred")
    return out.withColumn("dice", F.when(both == 0, 1.0).otherwise(2 * F.col("n_both") / both))


def dice_multiclass(df: DataFrame, image: str, true: str, pred: str, background=None, eps: float = 1e-6) -> DataFrame:
    """Mean Dice over the classes of truth or prediction per image."""
    t, p = F.col(true), F.col(pred)
    sides = F.array(
        F.struct(t.alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p"), (t == p).cast("int").alias("h")),
        F.struct(p.alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("h")),
    )
    rows = df.select(image, F.inline(sides))
    if background is not None:
        rows = rows.where(F.col("c") != background)
    classes = rows.groupBy(image, "c").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return classes.groupBy(image).agg(F.avg((2 * F.col("h") + eps) / (F.col("g") + F.col("p") + eps)).alias("dice"))


def mape(df: DataFrame, sample: str, true: str, pred: str) -> DataFrame:
    gap = F.abs(F.col(pred) - F.col(true)) / (F.abs(F.col(true)) + 1e-8)
    return df.groupBy(sample).agg(F.avg(gap).alias("mape"))


def trimmed_mean(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Mean without one smallest and one largest score; sums only, no sort."""
    n = F.count(score)
    mean = F.when(n > 2, (F.sum(score) - F.min(score) - F.max(score)) / (n - 2))
    return df.groupBy(*keys).agg(mean.alias("trimmed_mean"))


def dissimilarity(a: Column, b: Column, n: int) -> Column:
    """Mean Euclidean distance of corresponding sources of two sorted lists; the shorter list decides."""

    def gap(s: Column, t: Column) -> Column:
        parts = [(s[k] - t[k]) * (s[k] - t[k]) for k in ("x", "y", "q")]
        return F.when(s.isNotNull() & t.isNotNull(), F.sqrt(parts[0] + parts[1] + parts[2]))

    known = F.filter(F.zip_with(a, b, gap), lambda d: d.isNotNull())
    return let(known, lambda k: F.aggregate(k, F.lit(0.0), lambda acc, d: acc + d) / F.size(k))


def distinct_candidates(df: DataFrame, sample: str, rank: str, sources: str, tau: float, n_max: int, scale: tuple[float, float, float]) -> DataFrame:
    """Candidates kept in order when farther than ``tau`` from all kept before, at most ``n_max`` per sample.

    Round r keeps the first candidate left of each sample and drops those near it, which is the sequential rule. Samples are
    dealt out once, and rounds are running windows over one sort; a sample with more than ``cube.WHOLE`` rows is worked on by
    many tasks, round by round. All rows with the rank of a kept one are kept; rows without sample or rank never are.
    """
    scaled = F.array_sort(
        F.transform(sources, lambda s: F.struct(*[(s[k] / f).alias(k) for k, f in zip(("x", "y", "q"), scale)]))
    )
    far = lambda kept: dissimilarity(F.col("_s"), kept, n_max) > tau

    def walked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(sample).orderBy(rank)  # up to the current rank and all rows that share it
        rows = rows.withColumns({"_s": scaled, "_left": F.lit(True), "_kept": F.lit(False)})
        for _ in range(n_max):
            rows = rows.withColumn("_k", F.min(F.when(F.col("_left"), F.struct(F.col(rank).alias("rank"), "_s"))).over(order))
            rows = rows.withColumns({
                "_left": F.coalesce(F.when(F.col("_left"), far(F.col("_k._s"))), F.lit(False)),
                "_kept": F.col("_kept") | F.coalesce(F.col(rank) == F.col("_k.rank"), F.lit(False)),
            }).drop("_k")
        return rows.where("_kept").select(*df.columns)

    def in_rounds(rows: DataFrame) -> DataFrame:
        left = rows.select(sample, rank, scaled.alias("_s"))
        kept = []
        for _ in range(n_max):
            first = left.groupBy(sample).agg(F.min(F.struct(rank, "_s")).alias("_k"))
            first = checkpoint(first.select(sample, F.col(f"_k.{rank}").alias(rank), F.col("_k._s").alias("_ks")))
            kept.append(first.select(sample, rank))
            near = left.join(first.select(sample, "_ks"), sample)
            left = checkpoint(near.where(far(F.col("_ks"))).drop("_ks"))
            if left.isEmpty():
                break
        return rows.join(reduce(DataFrame.unionByName, kept), [sample, rank], "left_semi")

    return by_key(df.where(F.col(sample).isNotNull()), [sample], lambda rows, whole: walked(rows) if whole else in_rounds(rows))


def candidate_score(kept: DataFrame, sample: str, loss: str, n_max: int, weight: float) -> DataFrame:
    n = F.count(F.lit(1))
    return kept.groupBy(sample).agg((F.avg(1 / (1 + F.col(loss))) + weight * n / n_max).alias("score"), n.alias("n_valid"))
