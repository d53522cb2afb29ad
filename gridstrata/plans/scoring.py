"""Splits, folds and scores."""

from pyspark.sql import functions as F

from gridstrata.operators import evaluate, splits
from gridstrata.operators.blocks import HOUR
from gridstrata.plans.base import grid, long, r6, scored, with_
from gridstrata.plans.moving import PARTY, party
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table

HASH = "((({c} % 2147483647) * 48271 + {s} * 69621) % 2147483647)"


def hash_sql(col, seed=0):
    return HASH.format(c=col, s=seed)


@query(
    "split_temporal_oot",
    with_(
        s="SELECT l_orderkey, min(date_trunc('day', l_shipdate)) AS f, max(date_trunc('day', l_shipdate)) AS l FROM lineitem GROUP BY 1",
        a="SELECT l, sum(count(*)) OVER (ORDER BY l) / (SELECT count(*) FROM s) AS c FROM s GROUP BY l",
        b="SELECT f, sum(count(*)) OVER (ORDER BY f) / (SELECT count(*) FROM s) AS c FROM s GROUP BY f",
    )
    + """SELECT l_orderkey, CAST(coalesce(l < (SELECT max(l) FROM a WHERE c < 0.8), false) AS BIGINT) AS train,
         CAST(coalesce(l > (SELECT min(f) FROM b WHERE c > 0.85), false) AS BIGINT) AS oot FROM s""",
)
def split_temporal_oot(spark, sf):
    return splits.temporal_out_of_time(table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"), "l_orderkey", "l_shipdate")


@query(
    "split_group_random",
    f"""SELECT c_custkey, CASE WHEN u < 0.64 THEN 'train' WHEN u < 0.64 + 0.2 THEN 'test' WHEN u < 0.64 + 0.2 + 0.08 THEN 'cal' ELSE 'eval' END AS split
        FROM (SELECT c_custkey, {hash_sql('c_custkey', 3)} / 2147483647.0::DOUBLE AS u FROM customer)""",
)
def split_group_random(spark, sf):
    shares = {"train": 0.64, "test": 0.2, "cal": 0.08, "eval": 0.08}
    return splits.random_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", shares, seed=3)


@query("fold_kfold", f"SELECT c_custkey, (row_number() OVER (ORDER BY {hash_sql('c_custkey', 1)}) - 1) % 5 AS fold FROM customer")
def fold_kfold(spark, sf):
    return splits.kfold(table(spark, sf, "customer"), "c_custkey", 5, seed=1)


@query(
    "fold_stratified",
    f"SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hash_sql('c_custkey')}) - 1) % 5 AS fold FROM customer",
)
def fold_stratified(spark, sf):
    return splits.kfold(table(spark, sf, "customer"), "c_custkey", 5, ["c_mktsegment"])


@query(
    "fold_multilabel",
    f"""WITH l AS (SELECT d.doc_id, unnest(['lang ' || lang, 'quality ' || quality, 'toxic ' || toxic]) AS l FROM documents d JOIN labels b ON b.doc_id = d.doc_id),
        c AS (SELECT l, count(*) AS n FROM l GROUP BY 1), r AS (SELECT doc_id, arg_min(l, {{'a': n, 'b': l}}) AS rarest FROM l JOIN c USING (l) GROUP BY 1)
        SELECT doc_id, rarest, (row_number() OVER (PARTITION BY rarest ORDER BY {hash_sql('doc_id')}) - 1) % 5 AS fold FROM r""",
)
def fold_multilabel(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    labels = F.array(*[F.concat_ws(" ", F.lit(c), F.col(c).cast("string")) for c in ("lang", "quality", "toxic")])
    return splits.kfold(splits.rarest_label(rows, "doc_id", labels), "doc_id", 5, ["rarest"])


@query(
    "fold_info_string",
    "SELECT c_custkey, array_to_string(list_transform(range(5), lambda i: CASE WHEN i = c_custkey % 5 THEN 'v' ELSE 't' END), ', ') AS membership FROM customer",
)
def fold_info_string(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", splits.membership_text(F.col("c_custkey") % 5, 5).alias("membership"))


@query(
    "rolling_origin_eval",
    """WITH o AS (SELECT unnest(generate_series(DATE '1997-01-01', DATE '2001-01-01', INTERVAL 120 DAY))::DATE AS origin)
       SELECT strftime(origin, '%Y-%m-%d') AS origin, count(*) FILTER (o_orderdate::DATE <= origin) AS n_train, round(avg(o_totalprice) FILTER (o_orderdate::DATE <= origin), 4) AS train_mean,
         count(*) FILTER (o_orderdate::DATE > origin AND o_orderdate::DATE <= origin + 119) AS n_test, round(avg(o_totalprice) FILTER (o_orderdate::DATE > origin AND o_orderdate::DATE <= origin + 119), 4) AS test_mean
       FROM o, orders GROUP BY 1""",
)
def rolling_origin_eval(spark, sf):
    out = splits.rolling_origins(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "1997-01-01", "2001-01-01", 120, 119)
    return out.select(
        F.col("origin").cast("string").alias("origin"), "n_train", r6("train_mean", 4).alias("train_mean"), "n_test", r6("test_mean", 4).alias("test_mean")
    )


F1 = """SELECT k, avg(f) AS f1, count(*) AS n_classes FROM (SELECT k, c, 2.0 * sum(h) / (sum(t) + sum(p)) AS f FROM (
    SELECT k, t AS c, 1 AS t, 0 AS p, CASE WHEN t = q THEN 1 ELSE 0 END AS h FROM {v} UNION ALL SELECT k, q, 0, 1, 0 FROM {v}) GROUP BY k, c) GROUP BY k"""


@query(
    "score_f1_macro",
    with_("scored", v="SELECT source AS k, y AS t, CAST(p > 0.5 AS INTEGER) AS q FROM scored", f=F1.format(v="v")) + "SELECT k AS source, round(f1, 6) AS f1, n_classes FROM f",
)
def score_f1_macro(spark, sf):
    rows = scored(spark, sf).withColumn("q", (F.col("p") > 0.5).cast("int"))
    return rounded(evaluate.f1_macro(rows, ["source"], "y", "q"), ["source"])


@query(
    "score_hierarchical_f1",
    with_(
        "scored", s="SELECT *, CASE WHEN y = 1 THEN 'com' ELSE 'res' END AS kt, CASE WHEN p > 0.3 THEN 'com' ELSE 'res' END AS kp, CASE WHEN id % 3 = 0 THEN 'en' ELSE lang END AS lp, CASE WHEN id % 4 = 0 THEN 1 - y2 ELSE y2 END AS tp FROM scored",
        v="""SELECT '/type' AS k, kt AS t, kp AS q FROM s UNION ALL SELECT 'com/lang', lang, lp FROM s WHERE kt = 'com' AND kp = 'com'
             UNION ALL SELECT 'com/toxic', CAST(y2 AS VARCHAR), CAST(tp AS VARCHAR) FROM s WHERE kt = 'com' AND kp = 'com' UNION ALL SELECT 'res/lang', lang, lp FROM s WHERE kt = 'res' AND kp = 'res'""",
        f=F1.format(v="v"), g="SELECT split_part(k, '/', 1) AS kind, avg(f1) AS f FROM f GROUP BY 1",
    )
    + """SELECT round(max(f) FILTER (kind = ''), 6) AS level_1, round(avg(f) FILTER (kind <> ''), 6) AS level_2,
         round(0.4 * max(f) FILTER (kind = '') + 0.6 * avg(f) FILTER (kind <> ''), 6) AS score FROM g""",
)
def score_hierarchical_f1(spark, sf):
    rows = scored(spark, sf).withColumns(
        {
            "kt": F.when(F.col("y") == 1, "com").otherwise("res"), "kp": F.when(F.col("p") > 0.3, "com").otherwise("res"),
            "lp": F.when(F.col("id") % 3 == 0, "en").otherwise(F.col("lang")),
            "tp": F.when(F.col("id") % 4 == 0, 1 - F.col("y2")).otherwise(F.col("y2")),
        }
    )
    targets = {"com": [("lang", "lp"), ("y2", "tp")], "res": [("lang", "lp")]}
    return rounded(evaluate.hierarchical_f1(rows, "kt", "kp", targets), [])


@query(
    "score_interval_iou_pairs",
    """WITH i AS (SELECT l_suppkey AS name, epoch(l_shipdate) AS a, epoch(l_shipdate) + l_quantity * 3600 AS z, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_linestatus AS s FROM lineitem)
       SELECT t.name, t.id AS t_id, p.id AS p_id, round((least(t.z, p.z) - greatest(t.a, p.a)) / ((t.z - t.a) + (p.z - p.a) - (least(t.z, p.z) - greatest(t.a, p.a))), 6) AS iou
       FROM i t JOIN i p ON p.name = t.name AND t.s = 'O' AND p.s = 'F' AND least(t.z, p.z) > greatest(t.a, p.a)""",
)
def score_interval_iou_pairs(spark, sf):
    true, pred = interval_sides(spark, sf)
    pairs = evaluate.iou_pairs(true, pred, ["name"])
    return pairs.select("name", "t_id", "p_id", r6(F.col("inter") / F.col("uni")).alias("iou"))


def interval_sides(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("name"), F.col("l_shipdate").alias("start"),
        F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("stop"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linestatus",
    )
    return rows.where("l_linestatus = 'O'").drop("l_linestatus"), rows.where("l_linestatus = 'F'").drop("l_linestatus")


# Truths of a name one after another, each with the predictions it overlaps in the order of its preference.
GREEDY = dict(
    i="SELECT l_suppkey AS name, epoch(l_shipdate) AS a, epoch(l_shipdate) + l_quantity * 3600 AS z, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_linestatus AS s FROM lineitem",
    c="""SELECT t.name, t.a, t.z, t.id, p.id AS p, p.a AS pa, p.z AS pz, least(t.z, p.z) - greatest(t.a, p.a) AS inter,
         (t.z - t.a) + (p.z - p.a) - (least(t.z, p.z) - greatest(t.a, p.a)) AS uni FROM i t JOIN i p ON p.name = t.name AND t.s = 'O' AND p.s = 'F' AND least(t.z, p.z) > greatest(t.a, p.a)""",
    l="SELECT name, a, z, id, list(p ORDER BY inter / uni DESC, pa, pz, p) AS ps FROM c GROUP BY ALL",
    o="SELECT *, row_number() OVER (PARTITION BY name ORDER BY a, z, id) AS k FROM l",
    m="""SELECT name, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS p, []::BIGINT[] AS taken FROM (SELECT DISTINCT name FROM o)
         UNION ALL SELECT m.name, o.k, o.id, list_filter(o.ps, lambda x: NOT list_contains(m.taken, x))[1],
           CASE WHEN len(list_filter(o.ps, lambda x: NOT list_contains(m.taken, x))) > 0 THEN list_append(m.taken, list_filter(o.ps, lambda x: NOT list_contains(m.taken, x))[1]) ELSE m.taken END
         FROM m JOIN o ON o.name = m.name AND o.k = m.k + 1""",
    g="""SELECT c.name, count(*) AS n, sum(inter) AS i, sum(uni) AS u, sum(exp(-abs(pa - c.a) / 3600 / CASE WHEN pa > c.a THEN 5 ELSE 10 END)) AS e
         FROM m JOIN c ON c.name = m.name AND c.id = m.id AND c.p = m.p GROUP BY 1""",
    w="""SELECT i.name, coalesce(any_value(g.n), 0) AS n, coalesce(any_value(g.i / g.u), 0) AS iou, coalesce(any_value(g.e / g.n), 0) AS near,
         count(*) FILTER (s = 'O') AS nt, count(*) FILTER (s = 'F') AS np FROM i LEFT JOIN g ON g.name = i.name WHERE s IN ('O', 'F') GROUP BY 1""",
    q="SELECT name, iou, near, coalesce(n / nullif(nt, 0), 0) AS recall, coalesce(n / nullif(np, 0), 0) AS precision FROM w",
    f="SELECT *, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS f_half FROM q",
)
GREEDY_SQL = with_(**GREEDY).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "score_interval_iou",
    GREEDY_SQL + """SELECT name, round(iou, 6) AS iou, round(near, 6) AS near, round(recall, 6) AS recall, round(precision, 6) AS precision,
        round(f_half, 6) AS f_half, round((iou + 2 * near + 3 * f_half) / 6, 6) AS score FROM f""",
)
def score_interval_iou(spark, sf):
    true, pred = interval_sides(spark, sf)
    return rounded(evaluate.interval_score(true, pred, "name", scale=HOUR), ["name"])


@query(
    "score_interval_iou_mean",
    GREEDY_SQL + """SELECT count(*) AS n_names, round(avg(iou), 6) AS iou, round(avg(near), 6) AS near, round(avg(recall), 6) AS recall,
        round(avg(precision), 6) AS precision, round(avg(f_half), 6) AS f_half, round(avg((iou + 2 * near + 3 * f_half) / 6), 6) AS score FROM f""",
)
def score_interval_iou_mean(spark, sf):
    true, pred = interval_sides(spark, sf)
    return rounded(evaluate.mean_interval_score(evaluate.interval_score(true, pred, "name", scale=HOUR)), [])


@query(
    "score_party_cost",
    with_("grid", **PARTY, w="SELECT bldg_id, cost, cost * (0.8 + (bldg_id % 5) / 10.0::DOUBLE) AS q FROM p WHERE ts >= TIMESTAMP '2024-01-28' AND ts < TIMESTAMP '2024-01-28 16:00:00'")
    + "SELECT bldg_id, round(sqrt(avg(pow(q - cost, 2))) + abs(sum(q) - 6) / 16, 6) AS score FROM w GROUP BY 1",
)
def score_party_cost(spark, sf):
    span = F.col("ts").between(F.to_timestamp(F.lit("2024-01-28")), F.to_timestamp(F.lit("2024-01-28 15:00:00")))
    rows = party(grid(spark, sf)).where(span).withColumn("q", F.col("cost") * (0.8 + (F.col("bldg_id") % 5) / F.lit(10.0)))
    return rounded(evaluate.party_cost_score(rows, ["bldg_id"], "cost", "q"), ["bldg_id"])


LEVELS = (20, 40, 60)


@query(
    "score_outbreak_fbeta",
    with_(
        "grid", m="SELECT *, max(energy) OVER (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m, energy * (0.3 + (bldg_id % 5) / 5.0::DOUBLE) AS q FROM grid",
        f="SELECT *, lead(m, 5) OVER (PARTITION BY bldg_id ORDER BY ts) AS f, unnest([20.0, 40.0, 60.0])::DOUBLE AS t FROM m",
        b="SELECT t, coalesce(f >= t AND f >= 0.001 * (10000 + bldg_id * 500), false) AS r, coalesce(CASE WHEN energy <> 0 THEN q / energy END >= 0.5 AND q >= t, false) AS h FROM f",
        c="SELECT t, count(*) FILTER (r AND h) AS tp, count(*) FILTER (h) AS nf, count(*) FILTER (r) AS nr FROM b GROUP BY 1",
        d="SELECT t, CASE WHEN nr = 0 OR nf = 0 THEN 0.0 ELSE tp / nf END::DOUBLE AS p, CASE WHEN nr = 0 THEN 0.0 ELSE tp / nr END::DOUBLE AS r FROM c",
    )
    + "SELECT t AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN 4 * p + r > 0 THEN round(5 * p * r / (4 * p + r), 6) ELSE 0.0 END AS fbeta FROM d",
)
def score_outbreak_fbeta(spark, sf):
    rows = grid(spark, sf).withColumns(
        {"q": F.col("energy") * (0.3 + (F.col("bldg_id") % 5) / F.lit(5.0)), "people": 10000 + F.col("bldg_id") * 500}
    )
    out = evaluate.outbreak_fbeta(rows, ["bldg_id"], "ts", "energy", "energy", "q", "people", HOUR, LEVELS)
    return rounded(out, ["threshold"])


@query(
    "score_asymmetric_rmse",
    """WITH e AS (SELECT user_id, value AS y, value * 0.5 + 3 AS q FROM events), g AS (SELECT user_id, CASE WHEN abs(y % 1 - 0.01) <= 1e-5 AND q > y THEN (q - y) / 2 WHEN y >= 10 AND q < y THEN 2 * (q - y) ELSE q - y END AS g FROM e)
       SELECT user_id, round(sqrt(avg(g * g)), 6) AS score FROM g GROUP BY 1""",
)
def score_asymmetric_rmse(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("value").alias("y"), (F.col("value") * 0.5 + 3).alias("q"))
    return rows.groupBy("user_id").agg(r6(evaluate.asymmetric_rmse(rows, "y", "q", peak=10.0)).alias("score"))


@query(
    "score_regression",
    """SELECT l_returnflag, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(avg(CASE WHEN abs(r) <= 0.5 THEN 0.5 * r * r ELSE 0.5 * (abs(r) - 0.25) END), 6) AS huber,
       round(avg(y), 6) AS mae_zero FROM (SELECT l_returnflag, l_quantity AS y, l_extendedprice / 2100 - l_quantity AS r FROM lineitem) GROUP BY 1""",
)
def score_regression(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2100).alias("q"))
    return rows.groupBy("l_returnflag").agg(*[r6(c).alias(n) for n, c in evaluate.regression_scores("y", "q", 0.5).items()])


@query(
    "score_auc_brier",
    with_(
        "scored", d="SELECT lang, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY ALL",
        c="SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS pp, sum(neg) OVER (PARTITION BY lang) AS nn FROM d WINDOW w AS (PARTITION BY lang ORDER BY p DESC)",
        b="SELECT lang, avg(pow(p - y, 2)) AS brier FROM scored GROUP BY 1",
    )
    + """SELECT c.lang, round(sum(pos * (nn - fp + neg / 2)) / nullif(max(CAST(pp AS DOUBLE) * nn), 0), 6) AS auc_roc,
         round(sum(pos / nullif(pp, 0) * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1.0 END) / 2), 6) AS auc_pr, round(any_value(brier), 6) AS brier
       FROM c JOIN b ON b.lang = c.lang GROUP BY 1""",
)
def score_auc_brier(spark, sf):
    return rounded(evaluate.ranking_scores(scored(spark, sf), ["lang"], "y", "p"), ["lang"])


@query(
    "score_bootstrap_ci",
    with_(
        "scored", h=f"SELECT lang, pow(p - y, 2) AS e, ((id % {splits.HASH_PRIME}) * {splits.HASH_FACTOR} + 7 * 69621) % {splits.HASH_PRIME} AS h FROM scored",
        r="SELECT lang, e, h, CAST(unnest(range(50)) AS BIGINT) AS rep FROM h",
        v=f"SELECT lang, e, rep, (h + rep * {evaluate.RESAMPLE_STEP}) % {splits.HASH_PRIME} AS v FROM r",
        u=f"SELECT lang, e, rep, v * v % {splits.HASH_PRIME} / {splits.HASH_PRIME}.0::DOUBLE AS u FROM v",
        w="SELECT lang, e, rep, " + " + ".join(f"CAST(u >= {s!r}::DOUBLE AS INTEGER)" for s in evaluate.poisson_steps()) + " AS w FROM u",
        m="SELECT lang, rep, sum(w * e) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL",
    )
    + """SELECT lang, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(m) AS n_reps
         FROM m GROUP BY 1""",
)
def score_bootstrap_ci(spark, sf):
    rows = scored(spark, sf)
    gap = F.col("p") - F.col("y")
    return rounded(evaluate.bootstrap(rows, ["lang"], "id", gap * gap), ["lang"])


@query(
    "score_error_by_region",
    """SELECT n_name, r_name, round(avg(abs(c_acctbal - 4500)), 6) AS mean_error, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""",
)
def score_error_by_region(spark, sf):
    dim = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    error = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.sum(F.abs(F.col("c_acctbal") - 4500)).alias("s"), F.count(F.lit(1)).alias("n")
    )
    out = error.join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name", "r_name").agg(r6(F.sum("s") / F.sum("n")).alias("mean_error"), F.sum("n").alias("n"))


@query(
    "score_by_lead_time",
    "SELECT CAST(l_quantity AS BIGINT) AS hours, round(avg(l_extendedprice / 104950), 6) AS mean_pred, count(*) AS n FROM lineitem GROUP BY 1",
)
def score_by_lead_time(spark, sf):
    return table(spark, sf, "lineitem").groupBy(long("l_quantity").alias("hours")).agg(
        r6(F.avg(F.col("l_extendedprice") / 104950)).alias("mean_pred"), F.count(F.lit(1)).alias("n")
    )


@query(
    "score_episode_shift",
    with_(
        e="SELECT l_orderkey, l_extendedprice / 104950 AS p, {'a': l_shipdate, 'b': l_linenumber, 'c': l_partkey} AS o FROM lineitem",
        s="SELECT l_orderkey, arg_min(p, o) AS first, arg_max(p, o) AS last, min(p) AS low, max(p) AS high FROM e GROUP BY 1",
        q="SELECT quantile_cont(last - first, 0.96) AS cut FROM s",
    )
    + "SELECT l_orderkey, round(first, 6) AS first, round(last, 6) AS last, round(low, 6) AS low, round(high, 6) AS high, round(last - first, 6) AS shift, CAST(last - first >= cut AS BIGINT) AS big FROM s, q",
)
def score_episode_shift(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") / 104950)
    out = evaluate.episode_shift(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"], "p")
    return rounded(out, ["l_orderkey"])


def _tempered(spark, sf):
    """Scores that follow the label, so that prediction sets are not trivial."""
    rows = scored(spark, sf)
    return rows.withColumn("p", F.col("p") * 0.7 + F.col("y") * 0.3)


CONFORMAL = {
    "t": "SELECT id, y, p * 0.7 + y * 0.3 AS p FROM scored",
    "c": "SELECT CASE WHEN y = 1 THEN 1 - p ELSE 1 - (1 - p) END AS s FROM t WHERE id % 2 = 0",
    "r": "SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM c",
    "q": "SELECT max(s) AS q FROM r WHERE rn = least(ceil((n + 1) * (1 - 0.1::DOUBLE)), n)",
    "o": "SELECT id, y, p, CAST(1 - p <= q AS INTEGER) + CAST(p <= q AS INTEGER) AS k FROM t, q WHERE id % 2 = 1",
}


@query(
    "conformal_lac",
    with_("scored", **CONFORMAL)
    + "SELECT id, round(p, 6) AS p, CAST(k AS BIGINT) AS set_size, CAST(2 - k AS BIGINT) AS certainty, CAST(CASE WHEN k = 2 THEN -1 WHEN p >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS predicted FROM o",
)
def conformal_lac(spark, sf):
    rows = _tempered(spark, sf)
    out = evaluate.conformal_sets(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "y", "p")
    return rounded(out.select("id", "p", "set_size", "certainty", "predicted"), ["id"])


@query(
    "conformal_certainty_band",
    with_(
        "scored", **CONFORMAL,
        b="SELECT p, 2 - k AS c, (rank() OVER (ORDER BY p) - 1) * 1000 // count(*) OVER () AS bin FROM o",
        g="SELECT bin, avg(c) AS c, min(p) AS lo, max(p) AS hi FROM b GROUP BY 1",
    )
    + """SELECT coalesce(round(min(lo) FILTER (c < 1), 6), 0.0) AS band_low, coalesce(round(max(hi) FILTER (c < 1), 6), 0.0) AS band_high,
         count(*) FILTER (c < 1) AS n_unsure, count(*) AS n_bins FROM g""",
)
def conformal_certainty_band(spark, sf):
    rows = _tempered(spark, sf)
    out = evaluate.conformal_sets(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "y", "p")
    return rounded(evaluate.certainty_band(out, "p", "certainty"), [])


def voxels(spark, sf, flag):
    rows = table(spark, sf, "lineitem").where(flag)
    return rows.select(
        F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 20).alias("i"), F.col("l_linenumber").alias("x"), (F.col("l_quantity") % 10).alias("t")
    )


@query(
    "score_dice_binary",
    """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 20 AS i, l_linenumber AS x, l_quantity % 10 AS t FROM lineitem WHERE l_linestatus = 'F'),
       b AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 20 AS i, l_linenumber AS x, l_quantity % 10 AS t FROM lineitem WHERE l_returnflag = 'A'),
       na AS (SELECT s, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT s, count(*) AS n FROM b GROUP BY 1), ab AS (SELECT s, count(*) AS n FROM a JOIN b USING (s, i, x, t) GROUP BY 1)
       SELECT s_suppkey AS sample, coalesce(na.n, 0) AS n_true, coalesce(nb.n, 0) AS n_pred, coalesce(ab.n, 0) AS n_both,
         CASE WHEN coalesce(na.n, 0) + coalesce(nb.n, 0) = 0 THEN 1.0 ELSE round(2 * coalesce(ab.n, 0) / (coalesce(na.n, 0) + coalesce(nb.n, 0)), 6) END::DOUBLE AS dice
       FROM supplier LEFT JOIN na ON na.s = s_suppkey LEFT JOIN nb ON nb.s = s_suppkey LEFT JOIN ab ON ab.s = s_suppkey""",
)
def score_dice_binary(spark, sf):
    samples = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"))
    out = evaluate.dice_binary(voxels(spark, sf, "l_linestatus = 'F'"), voxels(spark, sf, "l_returnflag = 'A'"), "sample", ["i", "x", "t"], samples)
    return rounded(out, ["sample"])


@query(
    "score_dice_multiclass",
    """WITH v AS (SELECT l_suppkey AS k, CAST(l_linenumber % 4 AS INTEGER) AS t, CAST(l_partkey % 4 AS INTEGER) AS q FROM lineitem),
       c AS (SELECT k, c, sum(g) AS g, sum(p) AS p, sum(h) AS h FROM (SELECT k, t AS c, 1 AS g, 0 AS p, CASE WHEN t = q THEN 1 ELSE 0 END AS h FROM v UNION ALL SELECT k, q, 0, 1, 0 FROM v) WHERE c <> 2 GROUP BY 1, 2)
       SELECT k AS image, round(avg((2 * h + 1e-6) / (g + p + 1e-6)), 6) AS dice FROM c GROUP BY 1""",
)
def score_dice_multiclass(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("image"), (F.col("l_linenumber") % 4).alias("t"), (F.col("l_partkey") % 4).cast("int").alias("q")
    )
    return rounded(evaluate.dice_multiclass(rows, "image", "t", "q", background=2), ["image"])


@query(
    "score_mape",
    "SELECT l_suppkey, round(avg(abs(l_extendedprice / 2100 - l_quantity) / (abs(l_quantity) + 1e-8)), 6) AS mape FROM lineitem GROUP BY 1",
)
def score_mape(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("q", F.col("l_extendedprice") / 2100)
    return rounded(evaluate.mape(rows, "l_suppkey", "l_quantity", "q"), ["l_suppkey"])


@query(
    "score_trimmed_mean",
    """WITH r AS (SELECT o_custkey, o_totalprice / 997 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS z FROM orders)
       SELECT o_custkey, round(coalesce(avg(s) FILTER (a > 1 AND z > 1), -1), 6) AS trimmed_mean FROM r GROUP BY 1""",
)
def score_trimmed_mean(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", (F.col("o_totalprice") / 997).alias("s"))
    return rounded(evaluate.trimmed_mean(rows, ["o_custkey"], "s").na.fill(-1.0), ["o_custkey"])


def candidates(spark, sf):
    """Repeated candidates are dropped among plain numbers, dealt out by sample; their sources are made after that."""
    plain = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("rank"),
        "l_partkey", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("loss"),
    ).repartition("sample").dropDuplicates(["sample", "rank"])
    one = F.struct((F.col("l_partkey") % 10).cast("double").alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("q"))
    two = F.struct((F.col("l_partkey") % 7).cast("double").alias("x"), (F.col("l_quantity") / 2).alias("y"), F.col("l_tax").alias("q"))
    return plain.select("sample", "rank", F.array(one, two).alias("sources"), "loss")


@query("distinct_candidates")
def distinct_candidates(spark, sf):
    kept = evaluate.distinct_candidates(candidates(spark, sf), "sample", "rank", "sources", 0.15, 3, (10.0, 50.0, 0.1))
    return rounded(evaluate.candidate_score(kept, "sample", "loss", 3, 0.3), ["sample"])


@query(
    "sample_from_distribution",
    f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang, sum(n) OVER (ORDER BY lang) AS z, sum(n) OVER (ORDER BY lang) - n AS a, sum(n) OVER () AS t FROM c),
        u AS (SELECT c_custkey, {hash_sql('c_custkey', 5)} / 2147483647.0::DOUBLE AS u FROM customer)
        SELECT c_custkey, lang FROM u JOIN s ON floor(u * t) >= a AND floor(u * t) < z""",
)
def sample_from_distribution(spark, sf):
    ids = table(spark, sf, "customer").select("c_custkey")
    return splits.draw_labels(ids, "c_custkey", table(spark, sf, "documents"), "lang", seed=5)
