"""Deduplication and theme rollups by day, week and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

BUCKET = ["country", "audience_type", "period_type", "period_start", "period_end"]


def dedup(
    articles: DataFrame, keys: tuple[str, ...] = ("domain", "url"), order: tuple[str, ...] = ("date", "record_id")
) -> DataFrame:
    """The first row of each key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return articles.withColumn("_nth", F.row_number().over(at)).where("_nth = 1").drop("_nth")


def ranked(rows: DataFrame, by: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each group, with their rank."""
    return rows.withColumn(
        name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).where(F.col(name) <= most)


def day_partials(articles: DataFrame) -> DataFrame:
    """Additive counts per (country, audience_type, day, theme): articles, tone sum and number of tones.

    Each article also counts under a null theme, so these rows hold the bucket's total, articles without
    themes included, and the facts are read and deduplicated once. Nulls inside a theme list are ignored.
    Weeks and months are sums of days, which leaves one wide shuffle for all granularities.
    """
    named = F.filter(F.coalesce("themes", F.array().cast("array<string>")), lambda x: x.isNotNull())
    rows = articles.select(
        "country", "audience_type", F.to_date("date").alias("day"), "tone",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), named)).alias("theme")
    )
    return rows.groupBy("country", "audience_type", "day", "theme").agg(
        F.count("*").alias("article_count"), F.sum("tone").alias("tone_sum"), F.count("tone").alias("tone_n")
    )


def period_counts(partials: DataFrame, periods: tuple[str, ...] = ("monthly",)) -> DataFrame:
    """Counts of the day partials summed to whole periods."""
    spread = F.explode(F.array(*[text.period_struct(F.col("day"), p) for p in periods])).alias("p")
    sums = ["article_count", "tone_sum", "tone_n"]
    rows = partials.select("country", "audience_type", "theme", *sums, spread).select("*", "p.*")
    return rows.groupBy(*BUCKET, "theme").agg(*[F.sum(c).alias(c) for c in sums])


def top_themes(counts: DataFrame, min_count: int = 2, top: int = 50) -> DataFrame:
    """Theme rows of period counts: share, mean tone, rank; the minimum and the top N of each whole bucket.

    The total's row ranks first in its bucket and hands its count to the others inside the same partition,
    so no join is needed.
    """
    kept = ranked(
        counts.where(F.col("theme").isNull() | (F.col("article_count") >= min_count)), BUCKET,
        [F.col("theme").isNotNull(), F.desc("article_count"), "theme"], top + 1
    )
    total = F.max(F.when(F.col("theme").isNull(), F.col("article_count"))).over(Window.partitionBy(*BUCKET))
    return kept.withColumn("bucket_total", total).where("theme is not null").select(
        *BUCKET, "theme", "article_count", "bucket_total",
        F.round(F.col("article_count") / F.col("bucket_total"), 4).alias("share"),
        F.try_divide("tone_sum", "tone_n").alias("avg_tone"), (F.col("rank") - 1).alias("rank")
    )


def rollup_partials(
    partials: DataFrame, periods: tuple[str, ...] = ("monthly",), min_count: int = 2, top: int = 50
) -> DataFrame:
    """Theme rows per (country, audience, period) of day partials."""
    return top_themes(period_counts(partials, periods), min_count, top)


def theme_rollup(
    articles: DataFrame, periods: tuple[str, ...] = ("monthly",), min_count: int = 2, top: int = 50
) -> DataFrame:
    """Rollup of deduplicated articles(country, audience_type, date, themes, tone)."""
    return rollup_partials(day_partials(articles), periods, min_count, top)
