"""Resampling, interpolation, spectra and shapes of curves."""

from pyspark.sql import functions as F

from gridstrata.functions import calendar as cal
from gridstrata.operators import peaks, signal, windows
from gridstrata.operators.blocks import DAY, HOUR, over_blocks
from gridstrata.operators.resample import spine
from gridstrata.plans.base import grid, hourly, long, quarters, r6, readings, with_
from gridstrata.plans.moving import ENVELOP, KEY, W
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table


@query(
    "resample_interpolate_linear",
    with_(
        "hourly", n="SELECT *, lead(ts) OVER (PARTITION BY bldg_id ORDER BY ts) AS t2, lead(energy) OVER (PARTITION BY bldg_id ORDER BY ts) AS v2 FROM hourly",
        g="SELECT *, unnest(generate_series(ts, coalesce(t2 - INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s FROM n",
    )
    + "SELECT bldg_id, s AS ts, round(CASE WHEN t2 IS NULL THEN energy ELSE energy + (v2 - energy) * (epoch(s) - epoch(ts)) / (epoch(t2) - epoch(ts)) END, 6) AS energy FROM g",
)
def resample_interpolate_linear(spark, sf):
    return rounded(signal.interpolate_linear(hourly(spark, sf), KEY, "ts", "energy", 900), KEY)


@query(
    "join_hour_floor",
    """WITH w AS (SELECT date_trunc('hour', ts) AS h, max(value) AS temp FROM events WHERE event_type = 'view' GROUP BY 1)
       SELECT event_id, temp FROM events LEFT JOIN w ON w.h = date_trunc('hour', ts)""",
)
def join_hour_floor(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", F.date_trunc("hour", "ts").alias("h"))
    weather = events.where("event_type = 'view'").groupBy("h").agg(F.max("value").alias("temp"))
    return events.select("event_id", "h").join(weather, "h", "left").select("event_id", "temp")


@query(
    "spine_complete",
    """SELECT c_custkey AS bldg_id, unnest(generate_series(TIMESTAMP '2024-01-30 20:00:00', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTE)) AS ts FROM customer""",
)
def spine_complete(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("bldg_id"))
    return spine(keys, "2024-01-30 20:00:00", "2024-01-30 23:45:00", "15 minutes")


def _split_sql(moves):
    return with_(
        "grid", g=f"SELECT *, lag(energy) OVER w AS p, lead(energy) OVER w AS n FROM grid {W}",
        ab="SELECT *, CASE WHEN n IS NULL AND p IS NOT NULL THEN p ELSE energy END AS a, CASE WHEN n IS NULL AND p IS NOT NULL THEN energy ELSE coalesce(n, energy) END AS b FROM g",
        q="SELECT bldg_id, ts, energy, unnest([" + ", ".join(f"a - (a - b) * {m}" for m in moves) + "]) AS q, unnest(range(4)) AS i, "
        + " + ".join(f"(a - (a - b) * {m})" for m in moves) + " AS t FROM ab",
    ) + """SELECT bldg_id, ts + to_minutes(CAST(i * 15 AS INTEGER)) AS ts, round(CASE WHEN t <> 0 THEN q * energy / t ELSE energy / 4 END, 6) AS energy FROM q"""


@query("disaggregate_hour", _split_sql((0, 0.5, 0.75, 0.875)))
def disaggregate_hour(spark, sf):
    return rounded(signal.disaggregate_hour(grid(spark, sf), KEY, "ts", "energy", "halving"), KEY)


@query("disaggregate_hour_linear", _split_sql((0, 0.25, 0.5, 0.75)))
def disaggregate_hour_linear(spark, sf):
    return rounded(signal.disaggregate_hour(grid(spark, sf), KEY, "ts", "energy", "linear"), KEY)


@query(
    "fft_group_profile",
    with_(
        "readings", p="SELECT bldg_id, hour(ts) AS h, avg(energy) AS x FROM readings GROUP BY ALL",
        j="SELECT *, row_number() OVER (PARTITION BY bldg_id ORDER BY h) - 1 AS j, count(*) OVER (PARTITION BY bldg_id) AS n FROM p",
    )
    + "SELECT bldg_id, max(n) AS length, " + ", ".join(
        f"CASE WHEN max(n) > {k} THEN round(sqrt(pow(sum(x * cos(j * 2 * pi() * {k} / n)), 2) + pow(sum(x * sin(j * 2 * pi() * {k} / n)), 2)), 6) ELSE -1.0 END AS fft_{k + 1}" for k in range(10))
    + " FROM j GROUP BY 1",
)
def fft_group_profile(spark, sf):
    rows = readings(spark, sf).withColumn("hour", F.hour("ts"))
    return rounded(signal.dft_profile(rows, KEY, "hour", F.avg("energy"), 10), KEY)


@query(
    "spectral_flatness",
    with_(
        "grid", x="SELECT bldg_id, energy, row_number() OVER (PARTITION BY bldg_id ORDER BY ts) - 1 AS j, count(*) OVER (PARTITION BY bldg_id) AS n FROM grid",
        k="SELECT CAST(unnest(range(361)) AS INTEGER) AS k",
        p="SELECT bldg_id, k, pow(sum(energy * cos(2 * pi() * ((j * k) % 720) / 720)), 2) + pow(sum(energy * sin(2 * pi() * ((j * k) % 720) / 720)), 2) AS p FROM x, k GROUP BY ALL",
    )
    + "SELECT bldg_id, round(exp(avg(ln(greatest(p, 1e-300)))) / avg(p), 6) AS flatness FROM p GROUP BY 1",
)
def spectral_flatness(spark, sf):
    return rounded(signal.spectral_flatness(grid(spark, sf), "bldg_id", "ts", "energy"), KEY)


@query(
    "stft_power",
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings),
       h AS (SELECT CAST(unnest(range(16)) AS BIGINT) AS j), f AS (SELECT CAST(unnest(range(9)) AS BIGINT) AS freq),
       s AS (SELECT vec_id, i - j AS time, freq, v * (0.5 - 0.5 * cos(2 * pi() * j / 15)) AS x, 2 * pi() * j * freq / 16 AS a FROM e, h, f WHERE i - j BETWEEN 0 AND n - 16)
       SELECT vec_id, time, freq, round(pow(sum(x * cos(a)), 2) + pow(sum(x * sin(a)), 2), 6) AS power FROM s GROUP BY 1, 2, 3""",
)
def stft_power(spark, sf):
    return rounded(signal.stft_power(table(spark, sf, "embeddings"), "vec_id", "embedding", 16), ["vec_id"])


@query(
    "opening_closing_time",
    with_(
        "quarters",
        d=f"SELECT *, energy - lag(energy) OVER w AS d, energy - lag(energy, 4) OVER w AS up, lead(energy, 3) OVER w - lag(energy) OVER w AS down FROM quarters {W}",
        s="""SELECT bldg_id, season, hour(ts) * 4 + minute(ts) // 15 AS q, round(avg(d), 9) AS d, round(avg(up), 9) AS up, round(avg(down), 9) AS down
             FROM (SELECT *, unnest(['winter', 'all_year']) AS season FROM d WHERE strftime(ts, '%m-%d') NOT IN ('01-01', '01-15') AND isodow(ts) BETWEEN 1 AND 4) GROUP BY ALL""",
        o="""SELECT bldg_id, season, arg_min(q, {'a': -d, 'b': q}) FILTER (q BETWEEN 12 AND 51) AS opening_1, arg_min(q, {'a': -up, 'b': q}) FILTER (q BETWEEN 12 AND 51) AS opening_2,
             arg_min(q, {'a': d, 'b': q}) FILTER (q BETWEEN 56 AND 95) AS closing_1, arg_min(q, {'a': down, 'b': q}) FILTER (q BETWEEN 56 AND 95 AND down IS NOT NULL) AS closing_2 FROM s GROUP BY 1, 2""",
    )
    + """SELECT *, (closing_1 - opening_1) / 4 AS hours_1, (closing_2 - opening_2) / 4 AS hours_2, ((closing_1 + closing_2) / 2 - (opening_1 + opening_2) / 2) / 4 AS hours_3,
         (least(closing_1, closing_2) - greatest(opening_1, opening_2)) / 4 AS hours_min, (greatest(closing_1, closing_2) - least(opening_1, opening_2)) / 4 AS hours_max FROM o""",
)
def opening_closing_time(spark, sf):
    return rounded(signal.opening_hours(quarters(spark, sf), "bldg_id", "ts", "energy"), KEY)


CURVES = ("energy_sum", "energy_std", "energy_min", "energy_max", "diff_sum", "diff_std")


@query(
    "curve_profile_argextrema",
    with_(
        "grid", d=f"SELECT *, energy - lag(energy) OVER w AS d, hour(ts) AS q FROM grid {W}",
        c="""SELECT bldg_id, q, round(sum(energy), 9) AS energy_sum, round(stddev_samp(energy), 9) AS energy_std, round(min(energy), 9) AS energy_min, round(max(energy), 9) AS energy_max,
             round(sum(d), 9) AS diff_sum, round(stddev_samp(d), 9) AS diff_std FROM d GROUP BY ALL""",
        e="SELECT bldg_id, " + ", ".join(f"arg_min(q, {{'a': {n}, 'b': q}}) AS argmin_{n}, arg_min(q, {{'a': -{n}, 'b': q}}) AS argmax_{n}" for n in CURVES) + " FROM c GROUP BY 1",
    )
    + "SELECT *, " + ", ".join(f"CASE WHEN argmax_{n} < argmin_{n} THEN argmax_{n} - argmin_{n} + 24 ELSE argmax_{n} - argmin_{n} END AS between_{n}" for n in CURVES) + " FROM e",
)
def curve_profile_argextrema(spark, sf):
    return rounded(signal.profile_extrema(grid(spark, sf), "bldg_id", "ts", "energy", HOUR, F.hour("ts"), 24), KEY)


def _poly_sql():
    p = signal.polyfit_matrix(24, 5)
    coef = ", ".join(f"sum(z * ([{', '.join(repr(float(x)) for x in p[k])}])[q + 1]) AS coef_{k + 1}" for k in range(6))
    x = "(i * 28.0 / 23)"
    y = " + ".join(f"coef_{k + 1} * pow({x}, {5 - k})" for k in range(6))
    return with_(
        "grid", c="SELECT bldg_id, hour(ts) AS q, sum(energy) AS y FROM grid GROUP BY ALL",
        z="SELECT bldg_id, q, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS z FROM c WINDOW w AS (PARTITION BY bldg_id)",
        f=f"SELECT bldg_id, {coef} FROM z GROUP BY 1",
        y=f"SELECT bldg_id, i, {y} AS y FROM f, (SELECT unnest(range(24)) AS i)",
        s="SELECT bldg_id, i, sign(lead(y, 2) OVER w - 2 * lead(y) OVER w + y) AS s FROM y WINDOW w AS (PARTITION BY bldg_id ORDER BY i)",
        t="SELECT bldg_id, i, s, lag(s) OVER (PARTITION BY bldg_id ORDER BY i) AS p FROM s WHERE i < 22",
        n="SELECT bldg_id, list(i ORDER BY i) FILTER (s <> p AND p <> 0) AS l FROM t GROUP BY 1",
    ) + "SELECT f.bldg_id, " + ", ".join(f"round(coef_{k + 1}, 6) + 0.0 AS coef_{k + 1}" for k in range(6)) + """, coalesce(len(l), 0) AS n_turns,
        CASE WHEN len(l) > 1 THEN list_max(l) - list_min(l) ELSE -1 END AS turn_spread, """ + ", ".join(f"coalesce(l[{i}], -1) AS turn_{i}" for i in range(1, 5)) + " FROM f JOIN n USING (bldg_id)"


@query("curve_polyfit_inflexions", _poly_sql())
def curve_polyfit_inflexions(spark, sf):
    out = rounded(signal.curve_polynomial(grid(spark, sf), "bldg_id", F.hour("ts"), F.sum("energy"), 24), KEY)
    return out.withColumns({f"coef_{k}": F.col(f"coef_{k}") + 0.0 for k in range(1, 7)})


# Peaks in SQL: flat stretches, local maxima, rounds of local winners (six hours apart), next higher hours and least values.
PEAKS = {
    "pos": "MATERIALIZED SELECT bldg_id, CAST(epoch(ts) // 3600 AS BIGINT) AS pos, ts, energy AS x FROM grid",
    "runs": "SELECT * FROM (SELECT *, lag(x) OVER w AS b FROM pos WINDOW w AS (PARTITION BY bldg_id ORDER BY pos)) WHERE b IS NULL OR b <> x",
    "nexts": "SELECT *, lead(pos) OVER w AS np, lead(x) OVER w AS nx FROM runs WINDOW w AS (PARTITION BY bldg_id ORDER BY pos)",
    "maxima": "MATERIALIZED SELECT bldg_id, (pos + np - 1) // 2 AS pos, x FROM nexts WHERE x > b AND x > nx",
    "rounds": """SELECT bldg_id, pos, x, 0 AS s FROM maxima UNION ALL
        SELECT bldg_id, pos, x, CASE WHEN won THEN 1 ELSE 0 END FROM (
          SELECT *, max(CASE WHEN won THEN 1 ELSE 0 END) OVER near AS beaten FROM (
            SELECT bldg_id, pos, x, max({'x': x, 'p': pos}) OVER near = {'x': x, 'p': pos} AS won FROM rounds WHERE s = 0
            WINDOW near AS (PARTITION BY bldg_id ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))
          WINDOW near AS (PARTITION BY bldg_id ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE won OR beaten = 0""",
    "kept": "MATERIALIZED SELECT bldg_id, pos, x FROM rounds WHERE s = 1",
    "higher": """MATERIALIZED SELECT k.bldg_id, k.pos, k.x, coalesce(max(p.pos) FILTER (p.pos < k.pos), -1) AS l, coalesce(min(p.pos) FILTER (p.pos > k.pos), 1152921504606846976) AS r
        FROM kept k LEFT JOIN pos p ON p.bldg_id = k.bldg_id AND p.x > k.x GROUP BY ALL""",
    "lows": """MATERIALIZED SELECT h.bldg_id, h.pos, h.x, min({'v': p.x, 'o': h.pos - p.pos}) FILTER (p.pos <= h.pos) AS a, min({'v': p.x, 'o': p.pos - h.pos}) FILTER (p.pos >= h.pos) AS z
        FROM higher h JOIN pos p ON p.bldg_id = h.bldg_id AND p.pos > h.l AND p.pos < h.r GROUP BY ALL""",
    "tops": """MATERIALIZED SELECT bldg_id, make_timestamp(pos * 3600000000) AS ts, x AS energy, x - greatest(a.v, z.v) AS prominence, a.o AS start_ago, z.o AS end_in
        FROM lows WHERE x - greatest(a.v, z.v) >= 30""",
}


def peaks_sql(**more):
    """The views of the grid, the envelope and the peaks, then further ones."""
    text = with_("grid", **ENVELOP, **PEAKS, **more)
    return text.replace("AS (MATERIALIZED ", "AS MATERIALIZED (").replace("WITH ", "WITH RECURSIVE ", 1)


@query("peak_detect", peaks_sql() + "SELECT bldg_id, ts, round(energy, 6) AS energy, round(prominence, 6) AS prominence, start_ago, end_in FROM tops")
def peak_detect(spark, sf):
    return rounded(peaks.peak_detect(grid(spark, sf), "bldg_id", "ts", "energy"), KEY)


CORRECTED = {
    "v": "MATERIALIZED SELECT bldg_id, ts, energy, CASE WHEN energy < 10 AND e < 10 THEN 0.0 ELSE e END AS envelop FROM n",
    "corrected": """MATERIALIZED SELECT t.bldg_id, t.ts, t.energy, envelop, prominence,
         CAST(CASE WHEN t.energy < 10 OR coalesce(prominence / nullif(envelop, 0) < 0.2, false) OR (envelop < 100 AND coalesce(prominence / nullif(envelop, 0) < 0.5, false))
         OR (envelop < 200 AND prominence / nullif(envelop, 0) < 0.45) OR (envelop < 400 AND prominence / nullif(envelop, 0) < 0.4)
         OR (envelop < 600 AND prominence / nullif(envelop, 0) < 0.35) OR (envelop < 1000 AND prominence / nullif(envelop, 0) < 0.3) THEN 0 ELSE 1 END AS BIGINT) AS peak,
         CASE WHEN t.energy < 10 THEN 0 ELSE start_ago END AS start_ago, CASE WHEN t.energy < 10 THEN 0 ELSE end_in END AS end_in
         FROM tops t JOIN v ON v.bldg_id = t.bldg_id AND v.ts = t.ts""",
}


def corrected(enveloped):
    """Peaks of the enveloped grid with the envelope at their hour, corrected."""
    found = peaks.peak_detect(enveloped, "bldg_id", "ts", "energy")
    return peaks.peak_correct(found.join(enveloped.select(*KEY, "ts", "envelop"), [*KEY, "ts"]), "energy", "envelop", "prominence")


@query(
    "peak_correct",
    peaks_sql(**CORRECTED) + "SELECT bldg_id, ts, round(energy, 6) AS energy, round(prominence, 6) AS prominence, peak, start_ago, end_in FROM corrected",
)
def peak_correct(spark, sf):
    out = corrected(windows.centered_max_mean(grid(spark, sf), KEY, "ts", "energy", HOUR))
    return rounded(out.select(*KEY, "ts", "energy", "prominence", "peak", "start_ago", "end_in"), KEY)


@query(
    "peak_gaussian_envelope",
    peaks_sql(
        **CORRECTED,
        o="""SELECT bldg_id, ts, greatest(1, least(15, round_even(start_ago / 2, 0))) AS sl,
             unnest(generate_series(-CAST(greatest(3, least(36, start_ago)) AS BIGINT), CAST(greatest(3, least(6, end_in)) AS BIGINT))) AS o FROM corrected WHERE peak = 1""",
        r="""MATERIALIZED SELECT bldg_id, ts + to_hours(CAST(o AS INTEGER)) AS ts, max(exp(-(o * o) / (2 * pow(CASE WHEN o < 0 THEN sl ELSE 1 END, 2)))) AS c, bool_or(o < 0) AS l FROM o GROUP BY 1, 2""",
        bells="SELECT v.bldg_id, v.ts, v.energy, envelop * coalesce(c, 0) AS b, coalesce(l, false) AS l FROM v LEFT JOIN r ON r.bldg_id = v.bldg_id AND r.ts = v.ts",
    )
    + "SELECT bldg_id, ts, round(CASE WHEN l AND b > 0 THEN greatest(b, energy) ELSE b END, 6) AS outbreak FROM bells",
)
def peak_gaussian_envelope(spark, sf):
    rows = windows.centered_max_mean(grid(spark, sf), KEY, "ts", "energy", HOUR)
    out = peaks.gaussian_envelope(rows, corrected(rows).where("peak = 1"), KEY, "ts", "energy", "envelop", HOUR)
    return rounded(out.select("bldg_id", "ts", "outbreak"), KEY)


@query(
    "big_low_thresholds",
    with_(
        "readings", m="SELECT bldg_id, month(ts) AS m, max(energy) AS hi, min(energy) AS lo FROM readings WHERE isodow(ts) < 6 GROUP BY ALL",
        l="SELECT bldg_id, " + ", ".join(
            f"min(hi) FILTER (m IN ({ms})) AS b_{n}, max(lo) FILTER (m IN ({ms})) AS l_{n}" for n, ms in (("winter", "1, 2, 12"), ("summer", "7, 8, 9"), ("middle", "5, 6, 11")))
        + " FROM m GROUP BY 1",
    )
    + "SELECT bldg_id, ts, round(energy, 6) AS energy, " + ", ".join(
        f"CAST(coalesce(energy >= b_{n}, false) AS BIGINT) AS big_{n}, CAST(coalesce(energy <= l_{n}, false) AS BIGINT) AS low_{n}" for n in ("winter", "summer", "middle"))
    + " FROM readings JOIN l USING (bldg_id)",
)
def big_low_thresholds(spark, sf):
    return rounded(signal.month_thresholds(readings(spark, sf), "bldg_id", "ts", "energy"), KEY)


@query(
    "intervals_from_extrema",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'max' ELSE 'min' END AS k FROM events),
       p AS (SELECT *, lag(ts) OVER w AS pt, lag(k) OVER w AS pk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT user_id, pt AS start, ts AS stop FROM p WHERE pk <> k UNION ALL SELECT user_id, max(ts), max(ts) FROM e GROUP BY 1""",
)
def intervals_from_extrema(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "max").otherwise("min")
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("k"))
    return peaks.intervals_from_extrema(rows, ["user_id"], "ts", "k", ties=["event_id"])


LINES = "SELECT l_suppkey AS name, l_shipdate AS start, l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS stop, l_orderkey AS a, l_linenumber AS b, l_partkey AS c FROM lineitem"


def intervals(spark, sf):
    stop = F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("l_shipdate"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("name"), F.col("l_shipdate").alias("start"), stop.alias("stop"), F.col("l_orderkey").alias("a"),
        F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"),
    )


@query(
    "interval_gap_stats",
    with_(i=LINES, n="SELECT *, lead(start) OVER (PARTITION BY name ORDER BY start, a, b, c, stop) AS n FROM i")
    + "SELECT name, round(avg(epoch(stop) - epoch(start)), 6) AS mean_length, round(avg(epoch(n) - epoch(stop)), 6) AS mean_gap FROM n WHERE n IS NOT NULL GROUP BY 1",
)
def interval_gap_stats(spark, sf):
    return rounded(peaks.gap_stats(intervals(spark, sf), ["name"], "start", "stop", ties=["a", "b", "c", "stop"]), ["name"])


@query(
    "interval_to_labels",
    with_(
        i=LINES, k="SELECT DISTINCT name FROM i", t="SELECT unnest(generate_series(date_trunc('day', min(start) - INTERVAL 1 SECOND) + INTERVAL 1 DAY, date_trunc('day', max(stop) - INTERVAL 1 SECOND) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS ts FROM i",
        c="SELECT DISTINCT name, unnest(generate_series(date_trunc('day', start - INTERVAL 1 SECOND) + INTERVAL 1 DAY, stop - INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS ts FROM i",
    )
    + "SELECT k.name, t.ts, CAST(c.ts IS NOT NULL AS BIGINT) AS label FROM k CROSS JOIN t LEFT JOIN c ON c.name = k.name AND c.ts = t.ts",
)
def interval_to_labels(spark, sf):
    return peaks.interval_labels(intervals(spark, sf), ["name"], "start", "stop", DAY)


@query(
    "ts_summary",
    with_(
        "grid", m="SELECT *, avg(energy) OVER (PARTITION BY bldg_id) AS m, var_pop(energy) OVER (PARTITION BY bldg_id) AS v, row_number() OVER (PARTITION BY bldg_id ORDER BY ts) AS i FROM grid",
        l=f"SELECT *, lag(energy) OVER w AS p, lag(energy, 24) OVER w AS p24, coalesce(max(CASE WHEN energy <= m THEN i END) OVER w, 0) AS stop FROM m {W}",
    )
    + """SELECT bldg_id, round(sum(energy * energy), 4) AS abs_energy, round(sum(abs(energy - p)), 6) AS abs_changes, round(avg(abs(energy - p)), 6) AS mean_abs_change,
         count(*) FILTER (energy > m) AS n_above_mean, max(i - stop) AS longest_strike, round(sqrt(sum(pow(energy - p, 2))), 6) AS complexity,
         count(*) FILTER ((energy > m) <> (p > m)) AS n_crossings, round(avg((energy - m) * (p - m)) / any_value(v), 6) AS autocorrelation_1,
         round(avg((energy - m) * (p24 - m)) / any_value(v), 6) AS autocorrelation_24 FROM l GROUP BY 1""",
)
def ts_summary(spark, sf):
    out = signal.series_summary(grid(spark, sf), KEY, "ts", "energy", HOUR)
    return rounded(out.withColumn("abs_energy", r6("abs_energy", 4)), KEY)
