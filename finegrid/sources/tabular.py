"""Parquet, CSV and JSON tables: partitioned writes, folders of small files, station files, hourly payloads."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.functions.columns import keep_between, null_if_nan
from finegrid.operators.quality import ForecastTableError, missing_columns

STATION_REQUIRED = ["station_id", "latitude", "longitude", "date", "rain_mm"]
STATION_NUMBERS = ["latitude", "longitude", "rain_mm", "tmax_c", "tmin_c", "rh_pct"]


def write_partitions(df: DataFrame, path: str, partition: list[str], sort: list[str], rows_per_file: int = 2_000_000) -> None:
    """Replace only the partitions present in ``df``; rows inside a file are sorted, so readers can skip.

    A partition gets a writer for every ``rows_per_file`` of its rows.
    """
    per = df.groupBy(*[F.col(c).alias(f"_{c}") for c in partition]).agg(F.ceil(F.count("*") / F.lit(rows_per_file)).cast("int").alias("_files"))
    sized = df.join(per, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition])).select(*df.columns, "_files")
    spread = sized.repartition(*partition, F.pmod(F.xxhash64(*sort), F.col("_files"))).drop("_files")
    (spread.sortWithinPartitions(*partition, *sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(path))


def read_with_origin(spark: SparkSession, path: str) -> DataFrame:
    """All small files below a folder in one scan, with the file each row came from."""
    return spark.read.parquet(path).withColumn("origin", F.col("_metadata.file_path"))


def compact(spark: SparkSession, source: str, target: str, keys: list[str], files: int) -> None:
    """Rewrite many small files as ``files`` larger ones, sorted by key."""
    spark.read.parquet(source).repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(target)


def read_forecasts(spark: SparkSession, kind: str, path: str, issue_date: str | None = None) -> DataFrame:
    """A forecast table by kind: ``archive`` (partitioned by issue date) or ``csv``; an empty issue is an error."""
    if kind == "archive":
        df = spark.read.parquet(path)
        df = df.where(F.col("issue_date") == F.lit(issue_date).cast("date")) if issue_date else df
    elif kind == "csv":
        raw = spark.read.csv(path, header=True)
        df = raw.toDF(*[c.strip().lower() for c in raw.columns])
        numbers = [c for c in ("lead_day", "rain", "tmax", "tmin", "rh", "wind") if c in df.columns]
        df = df.withColumns({c: F.col(c).cast("int" if c == "lead_day" else "double") for c in numbers})
        if issue_date:
            df = df.withColumn("issue_date", F.lit(issue_date).cast("date")).withColumn("valid_date", F.date_add("issue_date", F.col("lead_day")))
    else:
        raise ValueError(f"unknown forecast source '{kind}'")
    if issue_date and df.isEmpty():
        raise ForecastTableError(f"no forecast issued {issue_date}")
    return df


def read_stations(spark: SparkSession, paths: list[str], morning_day: bool = False) -> DataFrame:
    """Station files with lower-cased headers and optional columns.

    One job reads the first line of every file; files with the same header then share one
    scan, so the number of scans is the number of layouts, not of files.  Numbers that cannot be read and impossible rain
    become missing; ``morning_day`` moves readings taken at 08:30 to the day before.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    place = F.col("_metadata.file_block_start")
    first = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value", place.alias("at")).where("at = 0").groupBy("path").agg(F.first("value").alias("header"))
    for r in first.groupBy("header").agg(F.collect_list("path").alias("paths")).collect():  # names of files, as listing them gives
        layouts[tuple(next(csv.reader([r["header"]])))] = sorted(r["paths"])
    frames = []
    for header, files in layouts.items():
        df = spark.read.csv(files, header=True).toDF(*[c.strip().lower() for c in header])
        missing = missing_columns(df, STATION_REQUIRED)
        if missing:
            raise ForecastTableError(f"{files[0]}: missing columns {missing}")
        frames.append(df)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    df = df.withColumns({c: F.col(c).try_cast("double") for c in STATION_NUMBERS if c in df.columns})
    day = F.to_date(F.col("date"))
    return df.withColumn("valid_date", F.date_sub(day, 1) if morning_day else day).withColumn("rain_mm", keep_between(F.col("rain_mm"), 0, 600)).drop("date")


def extract(df: DataFrame, filters: Column, aliases: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Rows of one area with alternative column names merged; filter and columns reach the scan."""
    present = {out: [F.col(c) for c in names if c in df.columns] for out, names in aliases.items()}
    return df.where(filters).select(*[F.coalesce(*cols).alias(out) for out, cols in present.items()], *keep)


HOURLY_NAMES = {"rain": "precipitation", "temp": "temperature_2m", "rh": "relative_humidity_2m", "wind": "wind_speed_10m"}  # fixed values


def hourly_rows(payloads: DataFrame, keys: list[str], body: str, leads: list[int]) -> DataFrame:
    """Rows of an hourly JSON payload whose arrays run parallel to ``time``, one array per variable and lead.

    Each payload is unfolded where it lies; unreadable numbers become missing.
    """
    arrays = {f"{short}_{k}": f"{long}_previous_day{k}" for short, long in HOURLY_NAMES.items() for k in leads}
    schema = "struct<hourly:struct<time:array<string>," + ",".join(f"`{v}`:array<string>" for v in arrays.values()) + ">>"
    h = F.from_json(F.col(body), schema)["hourly"]
    absent = F.array().cast("array<string>")
    zipped = F.arrays_zip(h["time"].alias("time"), *[F.coalesce(h[v], absent).alias(n) for n, v in arrays.items()])
    flat = payloads.select(*keys, F.explode(zipped).alias("z")).select(*keys, F.to_timestamp_ntz("z.time").alias("time"), *[F.col(f"z.{n}").try_cast("double").alias(n) for n in arrays])
    per_lead = F.array(*[F.struct(F.lit(k).alias("lead_day"), *[F.col(f"{v}_{k}").alias(v) for v in HOURLY_NAMES]) for k in leads])
    return flat.select(*keys, "time", F.explode(per_lead).alias("r")).select(*keys, "time", "r.*")


# --- exports ------------------------------------------------------------------------------

def strict_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text per row: not-a-number and infinities are null, dates ISO, missing fields kept as null."""
    cols = [null_if_nan(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))


def export_rows(df: DataFrame, names: DataFrame, key: str, hidden_prefix: str, digits: int = 3) -> DataFrame:
    """Table for people: names joined, internal columns left out, numbers rounded."""
    shown = [c for c in df.columns if not c.startswith(hidden_prefix)]
    rounded = [F.bround(F.col(c), digits).alias(c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in shown]
    return names.join(df.select(*rounded), key)


def csv_template(parents: DataFrame, key: str, leads: list[int], blanks: list[str]) -> DataFrame:
    """Empty forecast form: every parent and lead day, values to be entered."""
    rows = parents.select(key, F.explode(F.array(*[F.lit(k) for k in leads])).alias("lead_day"))
    return rows.select("*", *[F.lit(None).cast("string").alias(b) for b in blanks])


def issue_payload(df: DataFrame, unit: str, fields: dict[str, str], lead: str = "lead_day") -> DataFrame:
    """Arrays per unit and issue, ordered by lead, two decimals, missing kept as null (one entry per lead day)."""
    row = F.struct(F.col(lead), *[F.bround(F.col(c), 2).alias(k) for k, c in fields.items()])
    g = df.groupBy(unit, "issue_date").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return g.select(unit, "issue_date", *[F.col("_r").getField(k).alias(k) for k in fields])


def issue_index(df: DataFrame) -> DataFrame:
    """Issues, newest first, with a mark on the latest."""
    days = df.select("issue_date").distinct()
    newest = df.agg(F.max("issue_date")).scalar()
    return days.select("issue_date", (F.col("issue_date") == newest).alias("is_latest")).orderBy(F.col("issue_date").desc())


def pick_issue(df: DataFrame, issue_date: str | None = None) -> DataFrame:
    """Rows of the requested issue, or of the latest; an unknown issue is an error."""
    day = issue_date or df.agg(F.max("issue_date")).first()[0]
    out = df.where(F.col("issue_date") == F.lit(day).cast("date"))
    if out.isEmpty():
        raise LookupError(f"issue {issue_date} not found")
    return out
