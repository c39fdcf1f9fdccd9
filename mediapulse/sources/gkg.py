"""Theme files: 15-minute slices of tab-separated lines, plain, gzipped or zipped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from .slices import first_member


def parse_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines to rows (*keep, record_id, date, raw_domain, url, title, themes, tone).

    Lines of fewer than 17 fields, without a readable time or without a url are dropped; only the seven
    fields that are used leave the split array. Quotes are plain characters.
    """
    parts = F.split(F.col(column), "\t", -1)
    field = lambda name: F.get(parts, F.lit(fixed.GKG_FIELDS[name]))
    rows = lines.where(F.size(parts) >= fixed.GKG_LEAST_FIELDS).select(
        *keep, field("record_id").alias("record_id"),
        F.coalesce(text.stamp(field("date")), text.stamp(field("record_id"))).alias("date"),
        F.lower(F.trim(field("source"))).alias("raw_domain"),
        F.trim(field("url")).alias("url"), text.page_title(field("extras")).alias("title"),
        text.theme_list(field("themes")).alias("themes"), text.first_tone(field("tone")).alias("tone"),
    )
    return rows.where("date is not null and raw_domain <> '' and url <> ''")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def _unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            lines = first_member(content)
            yield pd.DataFrame({"path": path, "value": lines or [None], "skipped": lines is None})


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, skipped) of the first member of every zip.

    A zip that cannot be read, whatever is wrong with it, is one skipped row; one whose member has no lines is one row
    without a value.
    """
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.zip")
    return unzipped(files.load(path))


def unzipped(files: DataFrame) -> DataFrame:
    """The lines of archives(path, content) as read_zips() gives them."""
    return files.select("path", "content").mapInPandas(_unzip, "path string, value string, skipped boolean")


def slices(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(slice, file_name) of every 15-minute slice from `first` to `last`, both included."""
    times = spark.sql(
        "select explode(sequence(timestamp(:first), timestamp(:last), interval 15 minutes)) as slice",
        {"first": first, "last": last}
    )
    return times.select(
        "slice", F.concat(F.date_format("slice", "yyyyMMddHHmmss"), F.lit(".gkg.csv")).alias("file_name")
    )


def slices_in_lookback(spark: SparkSession, now: str, minutes: int = 75, lag: int = 7) -> DataFrame:
    """Slices of the lookback that count as published: their boundary lies `lag` minutes back or more."""
    start = F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes")
    ends = spark.range(1).select(
        start.alias("first"), (F.lit(now).cast("timestamp") - F.expr(f"interval {lag} minutes")).alias("last")
    )
    quarter = F.timestamp_seconds(F.ceil(F.unix_timestamp("first") / 900) * 900)
    times = ends.where(quarter <= F.col("last")).select(
        F.explode(F.sequence(quarter, "last", F.expr("interval 15 minutes"))).alias("slice")
    )
    return times.select(
        "slice", F.concat(F.date_format("slice", "yyyyMMddHHmmss"), F.lit(".gkg.csv")).alias("file_name")
    )


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def file_counters(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: files, skipped files, lines, parsed rows, distinct articles."""
    a = raw.agg(
        F.count_distinct("path").alias("files"), F.count_if("skipped").alias("skipped"),
        F.count("value").alias("lines")
    )
    b = rows.agg(F.count("*").alias("rows"), F.count_distinct("raw_domain", "url").alias("articles"))
    return a.join(b, F.lit(True))
