"""Scans: parquet by key, yearly and typed CSV, TSV, fixed-width text, JSON payloads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.functions.parse import fixed_width


def with_file_key(df: DataFrame, pattern: str = r"([^/]+?)(\.[A-Za-z0-9]+)*$", name: str = "key") -> DataFrame:
    """Add the key that the file name or path carries."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def scan_keys(spark: SparkSession, folder: str, keys: Sequence[str], schema: str, ext: str = "parquet") -> DataFrame:
    """One file per key, all of one schema, in a single scan; the key becomes a column."""
    paths = [f"{folder.rstrip('/')}/{k}.{ext}" for k in keys]
    return with_file_key(spark.read.schema(schema).parquet(*paths))


def scan_csv_years(spark: SparkSession, folder: str, years: Iterable[int], schema: str) -> DataFrame:
    """Only the folders of the wanted years are listed and read."""
    paths = [f"{folder.rstrip('/')}/year={y}" for y in years]
    read = spark.read.schema(schema).option("header", True).option("basePath", folder)
    return read.csv(paths)


def scan_csv_typed(spark: SparkSession, path: str | list[str], schema: str, columns: Sequence[str]) -> DataFrame:
    """Declared types; unparsable cells are null and columns outside the list are never parsed."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path).select(*columns)


def scan_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def scan_fixed_width(
    spark: SparkSession, path: str | list[str], fields: dict[str, tuple[int, int, str]], year: str, first: int, last: int
) -> DataFrame:
    """Cut the lines by position; lines outside the years are dropped before the other fields are cut."""
    lines = spark.read.text(path)
    cut = fixed_width("value", fields)
    return lines.where(cut[year].between(first, last)).select(*[c.alias(n) for n, c in cut.items()])


def scan_weather_json(spark: SparkSession, path: str | list[str], schema: str, multi_line: bool = True) -> DataFrame:
    """One JSON document per stamp: top-level fields and the first element of ``data``; the stamp is in the path."""
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    raw = with_file_key(raw, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "stamp")
    top = [c for c in raw.columns if c not in ("data", "stamp")]
    return raw.select(F.to_timestamp("stamp").alias("ts"), *top, F.col("data")[0].alias("_d")).select("ts", *top, "_d.*")


def explode_params(df: DataFrame, keys: Sequence[str], payload: str, params: Sequence[str], step: str = "hour") -> DataFrame:
    """Parameter → (stamp → value) maps to one wide row per key and step, mean of the values of a step."""
    parsed = df.select(*keys, F.from_json(payload, "map<string,map<string,double>>").alias("_m"))
    long = parsed.select(*keys, F.explode("_m").alias("param", "_s")).where(F.col("param").isin(*params))
    long = long.select(*keys, "param", F.explode("_s").alias("_t", "value"))
    long = long.withColumn("ts", F.date_trunc(step, F.to_timestamp("_t")))
    return long.groupBy(*keys, "ts").pivot("param", list(params)).agg(F.avg("value"))


def count_tables(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of a dictionary of frames."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols")
        )
        out = one if out is None else out.unionByName(one)
    return out
