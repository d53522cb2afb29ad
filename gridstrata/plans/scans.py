"""Scans and sinks (parquet, CSV, TSV, fixed width, JSON)."""

from pyspark.sql import functions as F

from gridstrata.functions.parse import fips
from gridstrata.operators.blocks import DAY
from gridstrata.plans.base import long, r6
from gridstrata.plans.registry import query
from gridstrata.session import scratch_path
from gridstrata.sources import SCHEMAS, readers, sinks, table


@query(
    "scan_parquet_keys",
    """SELECT 'customer' AS key, c_custkey AS id, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def scan_parquet_keys(spark, sf):
    parts = []
    for name, prefix in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        df = readers.scan_keys(spark, sf, [name], SCHEMAS[name])
        parts.append(df.select("key", F.col(prefix).alias("id"), F.col(prefix[:2] + "acctbal").alias("balance")))
    return parts[0].unionByName(parts[1])


@query(
    "scan_parquet_lazy",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.05",
)
def scan_parquet_lazy(spark, sf):
    late = (F.col("l_shipdate") >= F.to_timestamp(F.lit("1998-01-01"))) & (F.col("l_discount") > 0.05)
    return table(spark, sf, "lineitem").where(late).select("l_orderkey", "l_quantity")


@query(
    "scan_multi_file",
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_cols FROM {t}"
        for t, n in (("orders", 6), ("customer", 5), ("events", 6))
    ),
)
def scan_multi_file(spark, sf):
    return readers.count_tables({t: table(spark, sf, t) for t in ("orders", "customer", "events")})


@query(
    "scan_csv_years",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1999) GROUP BY 1""",
)
def scan_csv_years(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    path = sinks.write_if_absent(
        orders.select("o_orderkey", "o_totalprice", "year"), scratch_path(spark, "years"), "csv", ["year"]
    )
    back = readers.scan_csv_years(spark, path, (1996, 1997, 1999), "o_orderkey BIGINT, o_totalprice DOUBLE, year INT")
    return back.groupBy(long("year").alias("year")).agg(
        F.count("o_orderkey").alias("n"), r6(F.sum("o_totalprice"), 2).alias("total")
    )


@query("scan_csv_typed", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def scan_csv_typed(spark, sf):
    path = sinks.write_if_absent(table(spark, sf, "part"), scratch_path(spark, "typed"), "csv")
    cols = ["p_partkey", "p_size", "p_retailprice"]
    return readers.scan_csv_typed(spark, path, SCHEMAS["part"], cols).withColumn("p_size", long("p_size"))


@query("scan_tsv", "SELECT event_id, event_type, value FROM events")
def scan_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.scan_tsv(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE")


@query(
    "scan_fixed_width",
    """SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(floor(o_totalprice) AS BIGINT) AS price
       FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998""",
)
def scan_fixed_width(spark, sf):
    path = scratch_path(spark, "fixed")
    line = F.concat(
        F.lpad(F.col("o_orderkey").cast("string"), 12, " "),
        F.date_format("o_orderdate", "yyyy"),
        F.lpad(F.floor("o_totalprice").cast("string"), 10, " "),
    )
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    fields = {"id": (1, 12, "bigint"), "year": (13, 4, "bigint"), "price": (17, 10, "bigint")}
    return readers.scan_fixed_width(spark, path, fields, "year", 1997, 1998)


@query(
    "scan_weather_json",
    """SELECT date_trunc('day', ts) AS ts, user_id AS station, value AS temp, event_type AS sky FROM events""",
)
def scan_weather_json(spark, sf):
    path = scratch_path(spark, "weather")
    docs = table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("stamp"),
        F.col("user_id").alias("station"),
        F.array(F.struct(F.col("value").alias("temp"), F.col("event_type").alias("sky"))).alias("data"),
    )
    docs.write.partitionBy("stamp").json(path)
    schema = "station BIGINT, data ARRAY<STRUCT<temp: DOUBLE, sky: STRING>>"
    return readers.scan_weather_json(spark, path, schema, multi_line=False)


@query(
    "explode_param_json",
    """SELECT user_id, date_trunc('hour', ts) AS ts,
         round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS view,
         round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click,
         round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS error
       FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2""",
)
def explode_param_json(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    payload = F.to_json(F.create_map(F.col("event_type"), F.create_map(stamp, F.col("value"))))
    docs = table(spark, sf, "events").select("user_id", payload.alias("payload"))
    params = ["view", "click", "error"]
    wide = readers.explode_params(docs, ["user_id"], "payload", params)
    return wide.select("user_id", "ts", *[r6(p).alias(p) for p in params])


@query(
    "parse_fips",
    """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
       AS fips FROM customer""",
)
def parse_fips(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fips("c_nationkey", F.col("c_custkey") % 1000).alias("fips"))


@query("zfill_key", "SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zone FROM supplier")
def zfill_key(spark, sf):
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("zone")
    )


@query("sink_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def sink_parquet(spark, sf):
    path = scratch_path(spark, "sink")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sinks.write_if_absent(rows, path)
    sinks.write_if_absent(rows.where("false"), path)
    return spark.read.schema("o_orderkey BIGINT, o_totalprice DOUBLE").parquet(path)


@query("sink_csv", "SELECT c_custkey, c_mktsegment FROM customer")
def sink_csv(spark, sf):
    path = sinks.write_if_absent(
        table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), scratch_path(spark, "csv"), "csv"
    )
    return readers.scan_csv_typed(
        spark, path, "c_custkey BIGINT, c_mktsegment STRING", ["c_custkey", "c_mktsegment"]
    )


@query(
    "sink_interval_json",
    """SELECT l_suppkey AS name, CAST(floor(s / 2592000) AS BIGINT) AS block,
         '{"' || l_suppkey || '":' || '[' || string_agg('[' || s || ',' || e || ']', ',' ORDER BY s, e) || ']}' AS json
       FROM (SELECT l_suppkey, CAST(epoch(l_shipdate) AS BIGINT) AS s,
                    CAST(epoch(l_shipdate) AS BIGINT) + 3600 * CAST(l_quantity AS BIGINT) AS e FROM lineitem)
       GROUP BY 1, 2""",
)
def sink_interval_json(spark, sf):
    start = F.unix_timestamp("l_shipdate")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("name"), start.alias("start"), (start + 3600 * long("l_quantity")).alias("stop")
    )
    return sinks.interval_json(rows, "name", "start", "stop", 30 * DAY)


@query("sink_split_parquet", "SELECT o_orderstatus AS split, count(*) AS n FROM orders GROUP BY 1")
def sink_split_parquet(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "split")
    path = sinks.write_split(rows, scratch_path(spark, "split"))
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
