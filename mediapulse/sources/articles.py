"""Article lists and outlet volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .schemas import require_columns


def article_rows(rows: DataFrame) -> DataFrame:
    """Article-list rows with times, languages and two-letter source countries; a missing tone is 0."""
    require_columns(rows, ["url", "title", "seendate", "domain", "language", "sourcecountry"], "article list")
    tone = F.coalesce(F.col("tone").cast("double"), F.lit(0.0)) if "tone" in rows.columns else F.lit(0.0)
    fallback = F.col("query_country") if "query_country" in rows.columns else F.lit(None).cast("string")
    kept = [c for c in ("query_country", "source_kind", "gdelt_themes") if c in rows.columns]
    return rows.select(
        "url", "title", text.publication_time(F.col("seendate")).alias("pub_date"),
        text.host(F.col("domain")).alias("source_domain"),
        text.language_code(F.col("language")).alias("source_language"),
        text.source_country(F.col("sourcecountry"), fallback).alias("source_country"), tone.alias("tone"), *kept,
    )


def with_iso_country(rows: DataFrame, countries: DataFrame, column: str = "source_country") -> DataFrame:
    """A known ISO code stays; another code is read as FIPS; what neither list knows stays as it is."""
    iso = F.broadcast(countries.select(F.col("iso2").alias("_iso")))
    fips = F.broadcast(countries.select(F.col("fips").alias("_fips"), F.col("iso2").alias("_of_fips")))
    joined = rows.join(iso, F.col(column) == F.col("_iso"), "left").join(fips, F.col(column) == F.col("_fips"), "left")
    return joined.withColumn(column, F.coalesce("_iso", "_of_fips", column)).drop("_iso", "_fips", "_of_fips")


def with_fallback(rows: DataFrame, countries: list[str], least: int = 3) -> DataFrame:
    """Primary rows, and fallback rows of the listed countries with fewer than `least` primary rows; the
    first row of each (query_country, url), primary rows before fallback rows."""
    from ..operators.rollup import dedup

    primary = rows.where("source_kind = 'primary'").groupBy("query_country").agg(F.count("*").alias("_n"))
    open_ = rows.join(F.broadcast(primary), "query_country", "left").where(
        (F.col("source_kind") == "primary") | (
            F.col("query_country").isin(countries) & (F.coalesce("_n", F.lit(0)) < least)
        )
    )
    first = open_.withColumn("_kind", F.when(F.col("source_kind") == "primary", 0).otherwise(1))
    return dedup(first, ("query_country", "url"), ("_kind", "pub_date", "title")).drop("_kind", "_n")


def volume_rows(rows: DataFrame, day: str = "datetime") -> DataFrame:
    """(domain, date, volume) from `Article Count`, else `Volume Raw`; unreadable dates or volumes go."""
    volume = next((c for c in ("Article Count", "Volume Raw") if c in rows.columns), None)
    if volume is None:
        raise ValueError("volumes lack the columns Article Count and Volume Raw")
    at = F.to_date(F.col(day).cast("string").try_cast("timestamp"))
    out = rows.select("domain", at.alias("date"), F.col(f"`{volume}`").try_cast("double").cast("long").alias("volume"))
    return out.where("date is not null and volume is not null")
