"""Projections, filters, casts and cleaning."""

from pyspark.sql import functions as F

from gridstrata.functions import arrays, parse
from gridstrata.operators import clean
from gridstrata.operators.blocks import HOUR
from gridstrata.operators.ranks import exact_quantiles
from gridstrata.plans.base import grid, long, r6, readings, with_
from gridstrata.plans.registry import query
from gridstrata.sources import table


@query("rename_prefix", "SELECT s_suppkey AS bldg_id, s_name AS name_com, s_acctbal AS balance_com FROM supplier")
def rename_prefix(spark, sf):
    names = {"s_suppkey": "bldg_id", "s_name": "name_com", "s_acctbal": "balance_com"}
    return table(spark, sf, "supplier").select(*names).withColumnsRenamed(names)


@query("downcast", "SELECT p_partkey, p_size FROM part")
def downcast(spark, sf):
    return clean.downcast(table(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey", "p_size"]).select(
        long("p_partkey").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size")
    )


@query(
    "select_time_parts",
    with_("readings")
    + """SELECT bldg_id, t AS ts, CAST(month(t) AS BIGINT) AS month, CAST(hour(t) AS BIGINT) AS hour,
         CAST(minute(t) AS BIGINT) AS minute, energy
         FROM (SELECT *, ts - INTERVAL 15 MINUTE AS t FROM readings)
         WHERE month(t) IN (11, 12) AND hour(t) BETWEEN 17 AND 23""",
)
def select_time_parts(spark, sf):
    t = F.col("ts") - F.expr("INTERVAL 15 MINUTES")
    moved = readings(spark, sf).withColumn("ts", t)
    kept = moved.where(F.month("ts").isin(11, 12) & F.hour("ts").between(17, 23))
    parts = {"month": F.month("ts"), "hour": F.hour("ts"), "minute": F.minute("ts")}
    return kept.select("bldg_id", "ts", *[long(c).alias(n) for n, c in parts.items()], "energy")


@query(
    "filter_threshold_notnull",
    "SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND value >= pow(10, 1.5)",
)
def filter_threshold_notnull(spark, sf):
    big = F.col("value").isNotNull() & (F.col("value") >= 10**1.5)
    return table(spark, sf, "events").where(big).select("event_id", "user_id", "value")


@query(
    "filter_frequent_days",
    """SELECT user_id, count(*) AS n_days FROM (
         SELECT user_id, date_trunc('day', ts) AS d FROM events WHERE value >= 5 GROUP BY 1, 2
         HAVING count(*) * 0.25 >= 0.75) GROUP BY 1""",
)
def filter_frequent_days(spark, sf):
    events = table(spark, sf, "events")
    return clean.frequent_days(events, ["user_id"], "ts", "value", at_least=5, hours=0.75)


@query("drop_constant_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_constant_columns(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", F.lit(1).alias("one"), F.length("c_name").alias("len")
    )
    return df.drop(*clean.constant_columns(df))


@query("drop_null_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def drop_null_columns(spark, sf):
    late = F.when(F.col("o_totalprice") > 1000, F.col("o_orderstatus"))
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", late.alias("status"))
    df = df.withColumn("status", F.when(F.col("o_orderkey") % 7 != 0, F.col("status")))
    return df.drop(*clean.null_columns(df))


@query(
    "replace_inf",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_discount = 0 THEN 10000.0 ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem""",
)
def replace_inf(spark, sf):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio"))
    return clean.replace_inf(df, ["ratio"]).withColumn("ratio", r6("ratio"))


@query(
    "impute_group_neighbours",
    with_("grid", holes="SELECT bldg_id, ts, CASE WHEN energy > 0 THEN energy END AS energy FROM grid")
    + """SELECT bldg_id, ts, round(coalesce(energy, (p + n) / 2, p, n, 0.0), 6) AS energy FROM (
         SELECT *, lag(energy) OVER w AS p, lead(energy) OVER w AS n FROM holes
         WINDOW w AS (PARTITION BY bldg_id ORDER BY ts))""",
)
def impute_group_neighbours(spark, sf):
    holes = grid(spark, sf).withColumn("energy", F.when(F.col("energy") > 0, F.col("energy")))
    filled = clean.impute_neighbours(holes, ["bldg_id"], "ts", "energy", HOUR)
    return filled.select("bldg_id", "ts", r6("energy").alias("energy"))


@query(
    "impute_mean",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(nullif(l_discount, 0),
         avg(nullif(l_discount, 0)) OVER (PARTITION BY l_returnflag)), 6) AS discount,
         round(coalesce(nullif(l_tax, 0), avg(nullif(l_tax, 0)) OVER (PARTITION BY l_returnflag)), 6) AS tax
       FROM lineitem""",
)
def impute_mean(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    out = clean.impute_mean(df, ["l_returnflag"], ["discount", "tax"]).drop("l_returnflag")
    return out.withColumns({"discount": r6("discount"), "tax": r6("tax")})


ROW_ARRAY = """SELECT vec_id, v, i, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s,
    min(v) OVER w AS lo, max(v) OVER w AS hi FROM (
      SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
    WINDOW w AS (PARTITION BY vec_id)"""


@query(
    "despike_rowwise_z",
    with_(a=ROW_ARRAY, k="SELECT *, abs((v - m) / s) <= 2 AS ok FROM a", f="SELECT vec_id, avg(v) AS fill FROM k WHERE ok GROUP BY 1")
    + """SELECT k.vec_id, round(sum(CASE WHEN ok THEN v ELSE fill END), 5) AS total,
         CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS spikes,
         round(max(CASE WHEN ok THEN v ELSE fill END), 5) AS peak FROM k JOIN f ON f.vec_id = k.vec_id GROUP BY 1""",
)
def despike_rowwise_z(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    df = df.withColumn("clean", arrays.despike("v", 2.0))
    spikes = F.size(F.filter(arrays.zscores("v"), lambda z: F.abs(z) > 2))
    return df.select(
        "vec_id", r6(arrays.total("clean"), 5).alias("total"), long(spikes).alias("spikes"),
        r6(F.array_max("clean"), 5).alias("peak"),
    )


@query(
    "minmax_per_row",
    with_(a=ROW_ARRAY)
    + """SELECT vec_id, round(sum((v - lo) / (hi - lo)), 5) AS total, round(max((v - lo) / (hi - lo)), 5) AS peak,
         round(min((v - lo) / (hi - lo)), 5) AS low FROM a GROUP BY 1""",
)
def minmax_per_row(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf, "embeddings").select("vec_id", arrays.minmax(v).alias("v"))
    return df.select(
        "vec_id", r6(arrays.total("v"), 5).alias("total"), r6(F.array_max("v"), 5).alias("peak"),
        r6(F.array_min("v"), 5).alias("low"),
    )


@query(
    "fill_unknown",
    """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END, 'Unknown')
       AS grade FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def fill_unknown(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    grade = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return docs.select("doc_id", F.coalesce(grade, F.lit("Unknown")).alias("grade"))


@query(
    "label_by_priority",
    """SELECT p_partkey, CAST(CASE WHEN p_brand = 'Brand#1' OR p_type = 'ECONOMY' THEN 1
       WHEN p_size > 25 THEN 2 ELSE 0 END AS BIGINT) AS label FROM part""",
)
def label_by_priority(spark, sf):
    sure = (F.col("p_brand") == "Brand#1") | (F.col("p_type") == "ECONOMY")
    label = F.when(sure, 1).when(F.col("p_size") > 25, 2).otherwise(0)
    return table(spark, sf, "part").select("p_partkey", long(label).alias("label"))


DAMAGE = """CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || 'K' WHEN 1 THEN
    CAST(o_custkey AS VARCHAR) || '.5M' WHEN 2 THEN 'nan' ELSE CAST(o_custkey AS VARCHAR) || '.75' END"""


@query(
    "parse_damage",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey * 1000 WHEN 1 THEN o_custkey * 1000000 + 500000
       WHEN 2 THEN 0 ELSE o_custkey END AS BIGINT) AS damage FROM orders""",
)
def parse_damage(spark, sf):
    kind, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = (
        F.when(kind == 0, F.concat(n, F.lit("K"))).when(kind == 1, F.concat(n, F.lit(".5M"))).when(kind == 2, "nan")
        .otherwise(F.concat(n, F.lit(".75")))
    )
    return table(spark, sf, "orders").select("o_orderkey", parse.damage_amount(text).alias("damage"))


@query(
    "parse_census",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN round((o_custkey + 0.5) / 100, 6) WHEN 1 THEN 0.0
       WHEN 2 THEN NULL WHEN 3 THEN CAST(1000 + o_custkey % 1000 AS DOUBLE) * 1.0 ELSE CAST(o_custkey AS DOUBLE) END
       AS fact FROM orders""",
)
def parse_census(spark, sf):
    kind, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    thousands = F.concat(F.lit("$1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    text = (
        F.when(kind == 0, F.concat(n, F.lit(".5%"))).when(kind == 1, "Z").when(kind == 2, "S")
        .when(kind == 3, thousands).otherwise(n)
    )
    return table(spark, sf, "orders").select("o_orderkey", r6(parse.census_value(text)).alias("fact"))


@query(
    "parse_flag_digits",
    """SELECT o_orderkey, CAST(CASE WHEN contains(substring(rpad(CAST(o_custkey AS VARCHAR), 6, '0'), 5, 2), '1')
       THEN 1 ELSE 0 END AS BIGINT) AS thunder FROM orders""",
)
def parse_flag_digits(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", long(parse.flag_thunder("o_custkey").cast("int")).alias("thunder")
    )


@query(
    "parse_datetime_parts",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + to_minutes(CAST(l_partkey % 60 AS INTEGER))
         + to_hours(CAST(l_suppkey % 24 AS INTEGER)) AS begin_ts, l_quantity AS duration_hours FROM lineitem""",
)
def parse_datetime_parts(spark, sf):
    clock = F.concat(
        (F.col("l_suppkey") % 24).cast("string"), F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0")
    )
    begin = parse.stamp_from_parts(F.date_format("l_shipdate", "yyyyMM"), F.dayofmonth("l_shipdate"), clock)
    rows = table(spark, sf, "lineitem").withColumn("begin_ts", begin)
    stop = F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("begin_ts"))
    hours = (F.unix_timestamp(stop) - F.unix_timestamp("begin_ts")) / 3600
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "begin_ts", hours.alias("duration_hours"))


@query("kelvin_to_celsius", "SELECT event_id, round(value + 200 - 273.15, 6) AS temp FROM events")
def kelvin_to_celsius(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(F.col("value") + 200 - F.lit(273.15)).alias("temp"))


@query(
    "dedup_keys",
    """SELECT user_id, hour, event_id, value FROM (SELECT user_id, date_trunc('hour', ts) AS hour, event_id, value,
       row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events)
       WHERE rn = 1""",
)
def dedup_keys(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_id", "value")
    return clean.first_per_key(rows, ["user_id", "hour"], ["event_id"])


SIG = """SELECT l_suppkey AS bldg_id, round(avg(l_quantity), 3) AS m, round(max(l_quantity), 3) AS hi,
    round(min(l_quantity), 3) AS lo, round(quantile_cont(l_quantity, 0.5), 3) AS med FROM lineitem"""


@query(
    "dedup_by_signature",
    with_(
        base=SIG + " WHERE l_returnflag = 'A' GROUP BY 1",
        new="SELECT o_custkey AS bldg_id, round(avg(q), 3) AS m, round(max(q), 3) AS hi, round(min(q), 3) AS lo, "
        "round(quantile_cont(q, 0.5), 3) AS med FROM (SELECT o_custkey, 1.0 * (o_orderkey % 50 + 1) AS q FROM orders) GROUP BY 1",
    )
    + """SELECT min(bldg_id) AS bldg_id, m, hi, lo, med FROM new WHERE NOT EXISTS (SELECT 1 FROM base WHERE
         base.m = new.m AND base.hi = new.hi AND base.lo = new.lo AND base.med = new.med) GROUP BY m, hi, lo, med""",
)
def dedup_by_signature(spark, sf):
    def features(df):
        stats = df.groupBy("bldg_id").agg(
            r6(F.avg("q"), 3).alias("m"), r6(F.max("q"), 3).alias("hi"), r6(F.min("q"), 3).alias("lo")
        )
        med = exact_quantiles(df, ["bldg_id"], "q", {"med": 0.5})
        return stats.join(med, "bldg_id").withColumn("med", r6("med", 3))

    lines = table(spark, sf, "lineitem").where("l_returnflag = 'A'")
    base = features(lines.select(F.col("l_suppkey").alias("bldg_id"), F.col("l_quantity").alias("q")))
    new = features(
        table(spark, sf, "orders").select(
            F.col("o_custkey").alias("bldg_id"), (F.lit(1.0) * (F.col("o_orderkey") % 50 + 1)).alias("q")
        )
    )
    return clean.drop_seen_signatures(new, base, ["m", "hi", "lo", "med"], "bldg_id")


@query(
    "frequent_category_values",
    "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 200",
)
def frequent_category_values(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag")
    return clean.frequent_values(rows, "l_suppkey", "l_returnflag", 200)
