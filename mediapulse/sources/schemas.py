"""Explicit schemas, and the check that an input has the columns a job needs."""

from __future__ import annotations

from pyspark.sql import DataFrame

GKG_ROWS = "record_id string, date timestamp, raw_domain string, url string, title string, themes array<string>, tone double"
ARTICLE_LIST = "url string, title string, seendate string, domain string, language string, sourcecountry string, tone double, query_country string, source_kind string"
OUTLETS = "domain string, country string, audience_type string, outlet_name string, outlet_type string, languages array<string>, is_state_owned boolean, is_state_aligned boolean, confidence double"
COUNTRIES = "iso2 string, fips string, iso3 string, name string, official_languages array<string>, region string"
ACTIVITY = [
    "country", "date", "audience_type", "today_count", "baseline_mean", "baseline_std", "deviation_ratio", "z_score",
    "level", "confidence", "cold_start"
]
THEME_ROWS = [
    "country", "audience_type", "period_type", "period_start", "period_end", "theme", "article_count", "bucket_total",
    "share", "avg_tone"
]


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df
