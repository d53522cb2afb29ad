"""Window functions, sorts and top-k."""

from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.functions import tariff
from gridstrata.functions.text import STOP_WORDS, content_words
from gridstrata.operators import lags, topk, windows
from gridstrata.operators.blocks import DAY, HOUR, over_blocks
from gridstrata.operators.ranks import value_ranks, with_group_stats
from gridstrata.plans.base import grid, long, quarters, r6, readings, with_
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table

KEY = ["bldg_id"]
W = "WINDOW w AS (PARTITION BY bldg_id ORDER BY ts)"


def over(rows_back, ahead=0):
    return f"(PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN {rows_back} PRECEDING AND {ahead} FOLLOWING)"


LAGS = {n: k for m, k in {"1": 1, "2": 2, "3": 3, "4": 4, "8": 8, "week": 168, "month": 672}.items() for n, k in ((m, k), (f"m{m}", -k))}


@query(
    "win_lags",
    with_("grid", d="SELECT bldg_id, ts, energy, " + ", ".join(
        f"energy - {'lag' if k > 0 else 'lead'}(energy, {abs(k)}) OVER w AS diff_{n}" for n, k in LAGS.items()) + f" FROM grid {W}")
    + "SELECT bldg_id, ts, round(energy, 6) AS energy, " + ", ".join(
        f"round(diff_{n}, 6) AS diff_{n}, round(abs(diff_{n}), 6) AS abs_{n}, CASE WHEN energy <> 0 THEN round(diff_{n} / energy, 6) END AS pct_{n}"
        for n in LAGS) + " FROM d",
)
def win_lags(spark, sf):
    return rounded(lags.lag_features(grid(spark, sf), KEY, "ts", "energy", LAGS, HOUR), KEY)


@query(
    "win_lag_delta_grid",
    with_("grid", l="SELECT bldg_id, ts, energy, " + ", ".join(f"lag(energy, {k}) OVER w AS l{k}" for k in range(1, 11)) + f" FROM grid {W}")
    + "SELECT bldg_id, ts, round(energy, 6) AS energy, " + ", ".join(
        f"round(l{k}, 6) AS energy_lag{k}, round(energy - l{k}, 6) AS energy_delta{k}" + (f", round(l{k - 1} - l{k}, 6) AS energy_step{k}" if k > 1 else "")
        for k in range(1, 11)) + " FROM l WHERE l10 IS NOT NULL",
)
def win_lag_delta_grid(spark, sf):
    return rounded(windows.lag_grid(grid(spark, sf), KEY, "ts", ["energy"], HOUR), KEY)


@query("win_tendency", with_("grid") + f"SELECT bldg_id, ts, sign(energy - lag(energy) OVER w) * 1.0::DOUBLE AS tendency FROM grid {W}")
def win_tendency(spark, sf):
    out = over_blocks(grid(spark, sf), KEY, "ts", lambda w: {"tendency": F.signum(F.col("energy") - F.lag("energy").over(w))}, before=HOUR)
    return out.drop("energy")


@query(
    "win_runs",
    with_(
        "grid", d=f"SELECT bldg_id, ts, coalesce(energy - lag(energy) OVER w > 0, false) AS r, coalesce(energy - lag(energy) OVER w < 0, false) AS f FROM grid {W}",
        g=f"SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER w AS gr, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER w AS gf FROM d {W}",
    )
    + """SELECT bldg_id, ts, CAST(sum(CASE WHEN r THEN 1 ELSE 0 END) OVER (PARTITION BY bldg_id, gr ORDER BY ts) AS BIGINT) AS n_rises,
         CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY bldg_id, gf ORDER BY ts) AS BIGINT) AS n_falls FROM g""",
)
def win_runs(spark, sf):
    return windows.runs(grid(spark, sf), KEY, "ts", "energy", HOUR).drop("energy")


def _flag_sql(p):
    t = p / 100
    tests = {
        "smooth": f"abs(a) <= {t} AND abs(b) <= {t}", "peak": f"abs(a) >= {t} AND abs(b) >= {t}", "increase": f"a >= {t} AND b >= {t}",
        "decrease": f"a <= -{t} AND b <= -{t}", "ascent": f"a >= {t} AND b <= -{t}", "descent": f"a <= -{t} AND b >= {t}",
    }
    return ", ".join(f"CAST(coalesce({c}, false) AS BIGINT) AS {n}_{p}" for n, c in tests.items())


@query(
    "win_peak_flags",
    with_("grid", d=f"""SELECT bldg_id, ts, CASE WHEN energy <> 0 THEN (energy - lag(energy) OVER w) / energy END AS a,
          CASE WHEN energy <> 0 THEN (energy - lead(energy) OVER w) / energy END AS b FROM grid {W}""")
    + "SELECT bldg_id, ts, " + ", ".join(_flag_sql(p) for p in (2, 15, 30, 45)) + " FROM d",
)
def win_peak_flags(spark, sf):
    return windows.peak_flags(grid(spark, sf), KEY, "ts", "energy", HOUR, (2, 15, 30, 45)).drop("energy")


@query(
    "win_transform_mean",
    with_("grid", d="SELECT *, date_trunc('day', ts) AS day FROM grid")
    + """SELECT bldg_id, ts, round(energy - avg(energy) OVER (PARTITION BY bldg_id, day), 6) AS vs_day,
         round(max(energy) OVER (PARTITION BY bldg_id, day), 6) AS day_max FROM d""",
)
def win_transform_mean(spark, sf):
    df = grid(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    out = with_group_stats(df, ["bldg_id", "day"], _m=F.avg("energy"), day_max=F.max("energy"))
    return out.select("bldg_id", "ts", r6(F.col("energy") - F.col("_m")).alias("vs_day"), r6("day_max").alias("day_max"))


ROLL = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median", "var": "var_samp"}


@query(
    "win_rolling_stats",
    with_("grid") + "SELECT bldg_id, ts, " + ", ".join(
        f"CASE WHEN count(energy) OVER {over(n - 1)} = {n} THEN round({e}(energy) OVER {over(n - 1)}, 6) END AS {s}_{n}" for n in (7, 30) for s, e in ROLL.items())
    + " FROM grid",
)
def win_rolling_stats(spark, sf):
    out = windows.rolling_stats(grid(spark, sf), KEY, "ts", "energy", HOUR, (7, 30), list(ROLL))
    return rounded(out.drop("energy"), KEY)


@query(
    "win_rolling_minperiods",
    with_("grid") + f"""SELECT bldg_id, ts, round(avg(energy) OVER {over(3)}, 6) AS mean_4, round(median(energy) OVER {over(3)}, 6) AS median_4 FROM grid""",
)
def win_rolling_minperiods(spark, sf):
    out = windows.rolling_stats(grid(spark, sf), KEY, "ts", "energy", HOUR, (4,), ("mean", "median"), min_periods=1)
    return rounded(out.drop("energy"), KEY)


ENVELOP = {
    "m": f"SELECT *, CASE WHEN count(*) OVER {over(1, 1)} = 3 THEN max(energy) OVER {over(1, 1)} END AS m FROM grid",
    "n": f"SELECT *, coalesce(CASE WHEN count(m) OVER {over(1, 1)} = 3 THEN avg(m) OVER {over(1, 1)} END, energy) AS e FROM m",
}


@query(
    "win_centered_max_mean",
    with_("grid", **ENVELOP) + "SELECT bldg_id, ts, CASE WHEN energy < 10 AND e < 10 THEN 0.0 ELSE round(e, 6) END AS envelop FROM n",
)
def win_centered_max_mean(spark, sf):
    out = windows.centered_max_mean(grid(spark, sf), KEY, "ts", "energy", HOUR)
    return rounded(out.drop("energy"), KEY)


@query(
    "win_centered_average",
    with_(
        "grid", r="SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY bldg_id) AS n FROM grid",
        k="SELECT *, least(i, n - 1 - i, 6) AS k FROM r",
    )
    + """SELECT a.bldg_id, a.ts, round(avg(b.energy), 6) AS centered FROM k a JOIN k b ON a.bldg_id = b.bldg_id AND b.i BETWEEN a.i - a.k AND a.i + a.k
       GROUP BY 1, 2""",
)
def win_centered_average(spark, sf):
    return rounded(windows.centered_average(grid(spark, sf), KEY, "ts", "energy", HOUR, 6).drop("energy"), KEY)


@query(
    "win_seasonal_smooth",
    with_(
        "grid", h="SELECT *, hour(ts) AS h, date_trunc('day', ts) AS d FROM grid",
        j="SELECT bldg_id, d, h, ts, energy, unnest(range(-3, 4)) AS o FROM h",
        s="""SELECT j.bldg_id, j.ts, any_value(j.energy) AS energy, avg(b.energy) AS s FROM j JOIN h b ON b.bldg_id = j.bldg_id AND b.d = j.d
             AND b.h = least(23, greatest(0, j.h + j.o)) GROUP BY 1, 2""",
    )
    + """SELECT bldg_id, round(1 - sqrt(avg(pow(energy - s, 2))), 6) AS predictability, count(*) FILTER (abs(energy - s) > 2) AS anomalies FROM s GROUP BY 1""",
)
def win_seasonal_smooth(spark, sf):
    out = windows.seasonal_smooth(grid(spark, sf), KEY, "ts", "energy", 7)
    gap = F.col("energy") - F.col("smooth")
    return out.groupBy("bldg_id").agg(
        r6(1 - F.sqrt(F.avg(gap * gap))).alias("predictability"), F.count_if(F.abs(gap) > 2).alias("anomalies")
    )


def _savgol_sql():
    wt = lambda at, x: 1 / 7 + at * x / 28 + (at * at - 4) * (x * x - 4) / 84

    def fit(at):
        terms = []
        for x in range(-3, 4):
            k = at - x
            terms.append(f"{wt(at, x)!r} * {'lag' if k >= 0 else 'lead'}(energy, {abs(k)}) OVER w")
        return " + ".join(terms)

    cases = " ".join(f"WHEN i = {p} THEN {fit(p - 3)} WHEN n - 1 - i = {p} THEN {fit(3 - p)}" for p in range(3))
    return f"CASE {cases} ELSE {fit(0)} END"


@query(
    "win_savgol",
    with_("grid", r="SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY bldg_id) AS n FROM grid")
    + f"SELECT bldg_id, ts, round({_savgol_sql()}, 6) AS savgol FROM r {W}",
)
def win_savgol(spark, sf):
    return rounded(windows.savgol7(grid(spark, sf), KEY, "ts", "energy", HOUR).drop("energy"), KEY)


@query(
    "win_ewm",
    with_("grid", i="SELECT *, CAST(row_number() OVER (PARTITION BY bldg_id ORDER BY ts) AS DOUBLE) AS i FROM grid",
          p="SELECT a.bldg_id, a.ts, sum(pow(0.8, a.i - b.i) * b.energy) / sum(pow(0.8, a.i - b.i)) AS e FROM i a JOIN i b ON a.bldg_id = b.bldg_id AND b.i BETWEEN a.i - 165 AND a.i GROUP BY 1, 2")
    + "SELECT bldg_id, ts, round(e, 6) AS ewm FROM p",
)
def win_ewm(spark, sf):
    return rounded(windows.ewm(grid(spark, sf), KEY, "ts", "energy", HOUR, 0.2).drop("energy"), KEY)


def warm(spark, sf):
    return grid(spark, sf).withColumn("energy", F.col("energy") + 1)


PLUS = {"g": "SELECT bldg_id, ts, energy + 1 AS energy FROM grid"}


@query(
    "win_rolling_trend",
    with_("grid", **PLUS, c=f"SELECT bldg_id, ts, (energy - lag(energy) OVER w) / (lag(energy) OVER w + 1e-10) AS c FROM g {W}")
    + f"SELECT bldg_id, ts, CASE WHEN count(c) OVER {over(7)} = 8 THEN round(avg(c) OVER {over(7)}, 6) END AS trend_8 FROM c",
)
def win_rolling_trend(spark, sf):
    return rounded(windows.rolling_trend(warm(spark, sf), KEY, "ts", "energy", HOUR, 8).drop("energy"), KEY)


def _exog_sql():
    cols = [f"round(lag(energy, {k}) OVER w, 6) AS energy_lag{k}" for k in range(4, 13)]
    for k in (1, 2, 3):
        for n in (4, 8):
            fr = over(n - 1)
            cols.append(f"CASE WHEN count(x{k}) OVER {fr} = {n} THEN round(avg(x{k}) OVER {fr}, 6) END AS energy_lag{k}_mean{n}")
            cols.append(f"CASE WHEN count(r{k}) OVER {fr} = {n} THEN round(avg(r{k}) OVER {fr}, 6) END AS energy_lag{k}_trend{n}")
        for o in (1, 2):
            s = f"lag(x{k}, {o}) OVER w"
            cols.append(f"round(x{k} - {s}, 6) AS energy_lag{k}_diff{o}, round(x{k} / {s}, 6) AS energy_lag{k}_ratio{o}, round(x{k} - {s} / x{k}, 6) AS energy_lag{k}_diffratio{o}")
    return ", ".join(cols)


@query(
    "win_exog_lags",
    with_(
        "grid", **PLUS, a="SELECT *, " + ", ".join(f"lag(energy, {k}) OVER w AS x{k}" for k in (1, 2, 3)) + f" FROM g {W}",
        b="SELECT *, " + ", ".join(f"(x{k} - lag(x{k}) OVER w) / (lag(x{k}) OVER w + 1e-10) AS r{k}" for k in (1, 2, 3)) + f" FROM a {W}",
    )
    + f"SELECT bldg_id, ts, {_exog_sql()} FROM b {W}",
)
def win_exog_lags(spark, sf):
    return rounded(windows.exog_lags(warm(spark, sf), KEY, "ts", ["energy"], HOUR).drop("energy"), KEY)


EVENT = {
    "i": "SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY ts) AS i FROM grid",
    "e": """SELECT bldg_id, ts, i, max(CASE WHEN energy >= 40 THEN i END) OVER (PARTITION BY bldg_id ORDER BY ts) AS p,
            min(CASE WHEN energy >= 40 THEN i END) OVER (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM i""",
}


@query("win_since_last", with_("grid", **EVENT) + "SELECT bldg_id, ts, coalesce(i - p, -1) AS since_last FROM e")
def win_since_last(spark, sf):
    out = windows.distance_to_event(grid(spark, sf), KEY, "ts", F.col("energy") >= 40, HOUR)
    return out.select("bldg_id", "ts", "since_last")


@query("win_until_next", with_("grid", **EVENT) + "SELECT bldg_id, ts, coalesce(n - i, -1) AS until_next FROM e")
def win_until_next(spark, sf):
    out = windows.distance_to_event(grid(spark, sf), KEY, "ts", F.col("energy") >= 40, HOUR)
    return out.select("bldg_id", "ts", "until_next")


@query(
    "win_range_frame_cost",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT)
       RANGE BETWEEN CURRENT ROW AND 13500 FOLLOWING), 6) AS cost FROM events""",
)
def win_range_frame_cost(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    cost = lambda w: {"cost": F.sum("value").over(w.rangeBetween(0, 13500))}
    out = over_blocks(events, ["user_id"], "ts", cost, after=13500, width=7 * DAY, by_seconds=True)
    return out.select("event_id", r6("cost").alias("cost"))


def party(rows, slots=4, step=HOUR):
    """Cost of a party that begins at a stamp and lasts ``slots`` stamps."""
    rows = rows.withColumn("shifted", F.col("ts") - F.expr("INTERVAL 15 MINUTES"))
    cost = tariff.party_load("energy") * tariff.price(F.hour("shifted"))
    rows = rows.withColumn("c", cost)
    return over_blocks(rows, KEY, "ts", lambda w: {"cost": F.sum("c").over(w.rowsBetween(0, slots - 1))}, after=(slots - 1) * step).select(
        "bldg_id", "ts", "cost"
    )


def party_sql(view, slots=4):
    return {
        "pc": f"""SELECT bldg_id, ts, (energy * 0.3 + 0.5) * CASE WHEN hour(ts - INTERVAL 15 MINUTE) IN (18, 19, 20, 21) THEN 0.35 ELSE 0.2 END AS c FROM {view}""",
        "p": f"SELECT bldg_id, ts, sum(c) OVER {over(0, slots - 1)} AS cost FROM pc",
    }


PARTY = party_sql("grid")


@query("win_rolling_cost_16", with_("quarters", **party_sql("quarters", 16)) + "SELECT bldg_id, ts, round(cost, 6) AS cost FROM p")
def win_rolling_cost_16(spark, sf):
    return rounded(party(quarters(spark, sf), 16, 900), KEY)


@query(
    "win_future_max",
    with_("grid") + "SELECT bldg_id, ts, round(max(energy) OVER (PARTITION BY bldg_id ORDER BY ts ROWS BETWEEN 5 FOLLOWING AND 12 FOLLOWING), 6) AS future_max FROM grid",
)
def win_future_max(spark, sf):
    out = over_blocks(grid(spark, sf), KEY, "ts", lambda w: {"future_max": F.max("energy").over(w.rowsBetween(5, 12))}, after=12 * HOUR)
    return rounded(out.drop("energy"), KEY)


@query(
    "win_biggest_raise",
    with_("grid", d=f"SELECT *, energy - lag(energy) OVER w AS d FROM grid {W}")
    + "SELECT bldg_id, ts, " + ", ".join(f"round(max(d) OVER {over(n - 1)}, 6) AS raise_{n}" for n in (6, 24))
    + ", " + ", ".join(f"round(max(energy) OVER {over(n - 1)}, 6) AS max_{n}, round(sum(energy) OVER {over(n - 1)}, 6) AS sum_{n}" for n in (6, 12, 24, 36))
    + " FROM d",
)
def win_biggest_raise(spark, sf):
    diff = lambda w: {"_d": F.col("energy") - F.lag("energy").over(w)}

    def best(w):
        out = {f"raise_{n}": F.max("_d").over(w.rowsBetween(1 - n, 0)) for n in (6, 24)}
        for n in (6, 12, 24, 36):
            out[f"max_{n}"] = F.max("energy").over(w.rowsBetween(1 - n, 0))
            out[f"sum_{n}"] = F.sum("energy").over(w.rowsBetween(1 - n, 0))
        return out

    out = over_blocks(grid(spark, sf), KEY, "ts", [diff, best], before=36 * HOUR)
    return rounded(out.drop("energy", "_d"), KEY)


@query("win_lag_target", with_("grid") + f"SELECT bldg_id, ts, round(lead(energy, 6) OVER w, 6) AS target FROM grid {W}")
def win_lag_target(spark, sf):
    out = over_blocks(grid(spark, sf), KEY, "ts", lambda w: {"target": F.lead("energy", 6).over(w)}, after=6 * HOUR)
    return rounded(out.drop("energy"), KEY)


@query(
    "win_ecdf",
    """SELECT l_suppkey, l_quantity, any_value(c) AS ecdf FROM (SELECT l_suppkey, l_quantity,
       cume_dist() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS c FROM lineitem) GROUP BY 1, 2""",
)
def win_ecdf(spark, sf):
    ranks = value_ranks(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")
    return ranks.select("l_suppkey", "l_quantity", ((F.col("below") + F.col("freq")) / F.col("total")).alias("ecdf"))


@query(
    "win_rank_quantile",
    """SELECT c_acctbal, round(any_value(p), 6) AS pct, any_value(CAST(least(floor(p * 4), 3) AS BIGINT)) AS quartile FROM (
       SELECT c_acctbal, percent_rank() OVER (ORDER BY c_acctbal) AS p FROM customer) GROUP BY 1""",
)
def win_rank_quantile(spark, sf):
    ranks = value_ranks(table(spark, sf, "customer").select("c_acctbal"), [], "c_acctbal")
    p = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0)
    return ranks.select("c_acctbal", r6(p).alias("pct"), F.least(F.floor(p * 4), F.lit(3)).alias("quartile"))


@query("win_row_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index FROM events")
def win_row_index(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return windows.row_index(events, ["user_id"], "ts", ties=["event_id"]).select("event_id", "row_index")


@query(
    "topk_extreme_entities",
    with_("readings", s="SELECT bldg_id, round(sum(energy), 6) AS score FROM readings GROUP BY 1")
    + """(SELECT *, 'high' AS "end" FROM s ORDER BY score DESC, bldg_id LIMIT 3) UNION ALL
         (SELECT *, 'low' FROM s ORDER BY score, bldg_id LIMIT 3)""",
)
def topk_extreme_entities(spark, sf):
    return topk.extremes(readings(spark, sf).groupBy("bldg_id").agg(r6(F.sum("energy")).alias("score")), "bldg_id", "score")


@query(
    "topk_cheapest_window",
    with_("grid", **PARTY, r="SELECT bldg_id, ts, round(cost, 6) AS cost FROM p WHERE hour(ts) BETWEEN 17 AND 20")
    + "SELECT bldg_id, arg_min(ts, {'a': cost, 'b': ts}) AS ts, min(cost) AS cost FROM r GROUP BY 1",
)
def topk_cheapest_window(spark, sf):
    allowed = party(grid(spark, sf)).where(F.hour("ts").between(17, 20)).withColumn("cost", r6("cost"))
    return topk.cheapest(allowed, KEY, "ts", "cost")


@query(
    "topk_best_in_horizon",
    with_(
        "grid", **PARTY, r="SELECT bldg_id, ts, date_trunc('day', ts) AS d, round(cost, 6) AS cost FROM p",
        dd="SELECT DISTINCT bldg_id, d FROM r",
        j="SELECT a.bldg_id, a.d, r.ts, r.cost, r.d AS rd FROM dd a JOIN r ON r.bldg_id = a.bldg_id AND r.d >= a.d AND r.d < a.d + INTERVAL 11 DAY",
    )
    + """SELECT bldg_id, strftime(d, '%Y-%m-%d') AS date, arg_min(ts, {'a': cost, 'b': ts}) AS plan_ts, min(cost) AS plan_cost
       FROM j GROUP BY bldg_id, d HAVING count(DISTINCT rd) = 11""",
)
def topk_best_in_horizon(spark, sf):
    costs = party(grid(spark, sf)).withColumn("cost", r6("cost"))
    return topk.best_in_horizon(costs, KEY, "ts", "cost").withColumn("date", F.col("date").cast("string"))


@query(
    "topk_argmax_day",
    with_("grid", d="SELECT bldg_id, strftime(ts, '%Y-%m-%d') AS day, max(energy) FILTER (hour(ts) = 20) AS e FROM grid GROUP BY ALL")
    + "SELECT bldg_id, arg_min(day, {'a': -e, 'b': day}) AS day, round(max(e), 6) AS energy FROM d GROUP BY 1",
)
def topk_argmax_day(spark, sf):
    rows = grid(spark, sf).where(F.hour("ts") == 20).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    best = topk.row_of_max(rows.select("bldg_id", "day", "energy"), KEY, "energy", ["day"])
    return rounded(best, KEY)


@query(
    "head_per_group",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
)
def head_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return topk.head_per_group(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).drop("o_orderdate")


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '')"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "topk_frequent_words",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS word FROM documents) WHERE word NOT IN ({STOP})
        GROUP BY 1 ORDER BY n DESC, encode(word) LIMIT 50""",
)
def topk_frequent_words(spark, sf):
    return topk.frequent_words(table(spark, sf, "documents"), content_words("text"), 50)


@query(
    "max_by_idx",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
)
def max_by_idx(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return topk.row_of_max(rows, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])
