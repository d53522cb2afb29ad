"""Energy-domain views of the given tables, as DataFrames and as the same SQL for the DuckDB twins.

readings  one meter reading per line item: supplier = building, ship date plus a quarter-hour slot = stamp
hourly    events summed by user (= building) and hour
grid      the same on the complete hour axis from the first to the last event, missing hours are 0
quarters  the same by quarter hours
storms    one storm event per line item: begin, end, county, episode, kind, damage
points    customers as points on a plane, stations suppliers on the same plane
cells     one raster cell per order, three bands
scored    labelled documents with a score in (0, 1)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.operators.resample import spine_fill
from gridstrata.sources import table

#: Every hour, and every quarter hour, from the first to the last event.
HOURS = """SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts FROM events"""
QUARTER_HOURS = """SELECT unnest(generate_series(min(time_bucket(INTERVAL 15 MINUTE, ts)), max(time_bucket(INTERVAL 15 MINUTE, ts)), INTERVAL 15 MINUTE)) AS ts
    FROM events"""

# Units of the energy views. They do not divide evenly, so means of few readings never end on a rounding tie.
ENERGY_UNIT = 997
VALUE_UNIT = 0.97

#: Length of an embedding.
DIMENSIONS = 64

VIEWS = {
    "readings": """SELECT l_suppkey AS bldg_id,
        l_shipdate + to_minutes(CAST(15 * ((l_orderkey * 7 + l_linenumber * 13) % 96) AS INTEGER)) AS ts,
        l_extendedprice / 997 AS energy FROM lineitem""",
    "hourly": """SELECT user_id AS bldg_id, date_trunc('hour', ts) AS ts, sum(value) / 0.97 AS energy
        FROM events GROUP BY ALL""",
    "grid": f"""SELECT k.bldg_id, h.ts, coalesce(e.energy, 0.0) AS energy
        FROM (SELECT DISTINCT user_id AS bldg_id FROM events) k
        CROSS JOIN ({HOURS}) h
        LEFT JOIN (SELECT user_id AS bldg_id, date_trunc('hour', ts) AS ts, sum(value) / 0.97 AS energy
                   FROM events GROUP BY ALL) e ON e.bldg_id = k.bldg_id AND e.ts = h.ts""",
    "quarters": f"""SELECT k.bldg_id, h.ts, coalesce(e.energy, 0.0) AS energy
        FROM (SELECT DISTINCT user_id AS bldg_id FROM events) k
        CROSS JOIN ({QUARTER_HOURS}) h
        LEFT JOIN (SELECT user_id AS bldg_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(value) / 0.97 AS energy
                   FROM events GROUP BY ALL) e ON e.bldg_id = k.bldg_id AND e.ts = h.ts""",
    "storms": """SELECT l_orderkey AS episode, l_linenumber AS event_no, l_suppkey AS county,
        l_returnflag || l_linestatus AS kind, l_shipdate AS begin_ts,
        l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS end_ts, l_extendedprice AS damage,
        l_partkey AS part FROM lineitem""",
    "points": """SELECT c_custkey AS pid, c_nationkey AS nation, ((c_custkey * 37) % 1009) / 10.0 AS x,
        ((c_custkey * 91) % 997) / 10.0 AS y, c_acctbal AS weight FROM customer""",
    "stations": """SELECT s_suppkey AS sid, ((s_suppkey * 53) % 1009) / 10.0 AS x,
        ((s_suppkey * 29) % 997) / 10.0 AS y, s_acctbal AS level FROM supplier""",
    "cells": """SELECT o_orderkey % 128 AS col, o_orderkey // 128 AS row, o_totalprice AS price,
        CAST(o_custkey AS DOUBLE) AS cust, CAST(day(o_orderdate) AS DOUBLE) AS dom FROM orders""",
    "scored": """SELECT d.doc_id AS id, d.lang, d.source, l.quality AS y, l.toxic AS y2,
        ((d.n_chars * 7919 + d.doc_id * 104729) % 1000 + 0.5) / 1000.0 AS p
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
}


def calendar_sql(view: str) -> str:
    """The calendar columns of ``functions.calendar.base_columns`` over a view."""
    return f"""SELECT *, date_trunc('day', ts) AS day, month(ts) AS month, week(ts) AS week, isodow(ts) - 1 AS weekday,
        hour(ts) AS hour, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend,
        CASE WHEN month(ts) IN (12, 1, 2) THEN 0 WHEN month(ts) IN (6, 7, 8) THEN 1 ELSE 2 END AS season,
        CASE WHEN hour(ts) IN (13, 14, 15) THEN 1 WHEN hour(ts) IN (16, 17, 18, 19) THEN 2 ELSE 0 END AS tou,
        CASE WHEN strftime(ts, '%m-%d') IN ('01-01', '01-15', '02-19', '05-28', '07-04', '09-03', '10-08', '11-11',
            '11-12', '11-22', '12-25') THEN 1 ELSE 0 END AS holiday FROM {view}"""


VIEWS["cal"] = calendar_sql("readings")
VIEWS["gcal"] = calendar_sql("grid")


def with_(*names: str, **more: str) -> str:
    """``WITH`` clause of the named views and further ones."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ", ".join(parts) + " "


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def long(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    slot = 15 * ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 96)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("bldg_id"),
        F.timestamp_add("MINUTE", slot.cast("int"), F.col("l_shipdate")).alias("ts"),
        (F.col("l_extendedprice") / ENERGY_UNIT).alias("energy"),
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("bldg_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg((F.sum("value") / VALUE_UNIT).alias("energy"))
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("bldg_id"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("energy")
    )
    filled = spine_fill(events, ["bldg_id"], "ts", "energy", "1 hour")
    return filled.withColumn("energy", F.col("energy") / VALUE_UNIT)


def quarters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("bldg_id"), F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).alias("ts"),
        F.col("value").alias("energy"),
    )
    filled = spine_fill(rows, ["bldg_id"], "ts", "energy", "15 minutes")
    return filled.withColumn("energy", F.col("energy") / VALUE_UNIT)


def storms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode"),
        F.col("l_linenumber").alias("event_no"),
        F.col("l_suppkey").alias("county"),
        F.concat("l_returnflag", "l_linestatus").alias("kind"),
        F.col("l_shipdate").alias("begin_ts"),
        F.timestamp_add("HOUR", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("end_ts"),
        F.col("l_extendedprice").alias("damage"),
        F.col("l_partkey").alias("part"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pid"),
        F.col("c_nationkey").alias("nation"),
        (((F.col("c_custkey") * 37) % 1009) / 10.0).alias("x"),
        (((F.col("c_custkey") * 91) % 997) / 10.0).alias("y"),
        F.col("c_acctbal").alias("weight"),
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sid"),
        (((F.col("s_suppkey") * 53) % 1009) / 10.0).alias("x"),
        (((F.col("s_suppkey") * 29) % 997) / 10.0).alias("y"),
        F.col("s_acctbal").alias("level"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 128).alias("col"),
        F.floor(F.col("o_orderkey") / 128).alias("row"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
        F.dayofmonth("o_orderdate").cast("double").alias("dom"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        F.col("quality").alias("y"),
        F.col("toxic").alias("y2"),
        (((F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % 1000 + 0.5) / 1000.0).alias("p"),
    )
