"""Daily activity: counts, calendars, baselines, deviations and their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import ranked

BUCKET = ["country", "audience_type"]


def daily_counts(articles: DataFrame, keys: list[str] = BUCKET) -> DataFrame:
    return articles.groupBy(*keys, F.to_date("date").alias("date")).agg(F.count("*").alias("today_count"))


def daily_volumes(volumes: DataFrame, outlets: DataFrame) -> DataFrame:
    """Outlet volumes(domain, date, volume) summed per bucket; negative volumes are skipped."""
    return volumes.where("volume >= 0").join(
        outlets.select("domain", *BUCKET), "domain"
    ).groupBy(*BUCKET, "date").agg(F.sum("volume").alias("today_count"))


def top_outlets(articles: DataFrame, most: int = 10) -> DataFrame:
    rows = articles.groupBy(*BUCKET, F.to_date("date").alias("date"), "domain").agg(F.count("*").alias("n"))
    return ranked(rows, [*BUCKET, "date"], [F.desc("n"), "domain"], most)


def top_themes(articles: DataFrame, most: int = 10) -> DataFrame:
    rows = articles.select(
        *BUCKET, F.to_date("date").alias("date"), F.explode("themes").alias("theme")
    ).groupBy(*BUCKET, "date", "theme").agg(F.count("*").alias("n"))
    return ranked(rows, [*BUCKET, "date"], [F.desc("n"), "theme"], most)


def zero_filled(
    daily: DataFrame, keys: list[str] = BUCKET, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Every bucket on every day between the first and the last date (of all rows, or as given).

    Buckets are those that occur; each unnests its own calendar, so there is no cross join.
    """
    ends = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    if first or last:
        ends = ends.select(
            F.lit(first).cast("date").alias("first") if first else "first",
            F.lit(last).cast("date").alias("last") if last else "last"
        )
    buckets = daily.select(*keys).distinct().join(F.broadcast(ends), F.lit(True))
    days = buckets.select(*keys, F.explode(F.sequence("first", "last")).alias("date"))
    return days.join(daily, [*keys, "date"], "left").withColumn(
        "today_count", F.coalesce("today_count", F.lit(0)).cast("long")
    )


def with_baseline(daily: DataFrame, keys: list[str] = BUCKET, days: int = 30) -> DataFrame:
    """Adds mean, population deviation (both to 2 places), minimum, maximum and number of the rows in the
    `days` days before each date. On a zero-filled calendar the silent days count, else only days with rows.
    """
    number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy(*keys).orderBy(number).rangeBetween(-days, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return daily.select(
        "*", F.round(zero(F.avg("today_count").over(before)), 2).alias("baseline_mean"),
        F.round(zero(F.stddev_pop("today_count").over(before)), 2).alias("baseline_std"),
        F.coalesce(F.min("today_count").over(before), F.lit(0)).alias("min_count"),
        F.coalesce(F.max("today_count").over(before), F.lit(0)).alias("max_count"),
        F.count("today_count").over(before).alias("days_sampled"),
    )


def confidence(days: Column, least: int = 7) -> Column:
    return F.when(days >= 21, "HIGH").when(days >= least, "MEDIUM").otherwise("LOW")


def level(ratio: Column, z: Column) -> Column:
    """Extreme scores first, then spikes, then silences, each by ratio and score together."""
    return (
        F.when(z >= 2.5, "red").when((ratio <= 4.0) & (z >= 2.0), "orange").when((ratio <= 2.5) & (z >= 1.5), "amber")
        .when((ratio < 0.3) & (z < -2.0), "deepBlue").when(
            (ratio < 0.5) & (z < -1.5), "steelBlue"
        ).when(ratio < 0.75, "coolGray").otherwise("neutral")
    )


def with_deviation(rows: DataFrame, least: int = 7, warm: int = 21, extreme: float = 10.0) -> DataFrame:
    """Adds deviation_ratio, z_score (3 places), level, confidence and cold_start.

    An unusable baseline is neutral; a zero mean and a zero deviation have cases of their own with a fixed
    extreme score. The level comes from unrounded values.
    """
    today, mean, std = F.col("today_count"), F.col("baseline_mean"), F.col("baseline_std")
    usable, silent, flat = F.col("days_sampled") >= least, F.col("baseline_mean") == 0, F.col("baseline_std") == 0
    ratio = F.when(~usable, 1.0).when(silent, today.cast("double")).when(flat & (today == mean), 1.0).otherwise(
        F.try_divide(today, mean)
    )
    z = (
        F.when(
            ~usable | (silent & (today == 0)), 0.0
        ).when(silent, extreme).when(flat & (today == mean), 0.0).when(flat & (today > mean), extreme).when(flat, -extreme)
        .otherwise(F.try_divide(today - mean, std))
    )
    of_level = (
        F.when(
            ~usable | (silent & (today == 0)), "neutral"
        ).when(silent, "red").when(flat & (today == mean), "neutral").when(flat & (today > mean), "red").when(flat, "deepBlue")
        .otherwise(level(ratio, z))
    )
    return rows.select(
        "*", F.round(ratio, 3).alias("deviation_ratio"), F.round(z, 3).alias("z_score"), of_level.alias("level"),
        confidence(F.col("days_sampled"), least).alias("confidence"),
        (F.col("days_sampled") < warm).alias("cold_start"),
    )


def activity(daily: DataFrame, keys: list[str] = BUCKET, zero_fill: bool = False, warm: int = 21) -> DataFrame:
    """Counts to activity rows: calendar if asked for, baseline, deviation."""
    return with_deviation(with_baseline(zero_filled(daily, keys) if zero_fill else daily, keys), warm=warm)


def gaps(rows: DataFrame, keys: list[str] = BUCKET, most: int = 7) -> DataFrame:
    """Consecutive dates of a bucket more than `most` days apart."""
    last = F.lag("date").over(Window.partitionBy(*keys).orderBy("date"))
    return rows.select(
        *keys, last.alias("from_date"), F.col("date").alias("to_date"), F.datediff("date", last).alias("days")
    ).where(F.col("days") > most)


def silences(rows: DataFrame, holidays: DataFrame | None = None, keys: list[str] = BUCKET) -> DataFrame:
    """Activity rows at half their baseline or less that neither the weekend's own baseline nor a holiday
    (country, date) explains, with a severity."""
    weekend = F.weekday("date") >= 5
    number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy(*keys, weekend).orderBy(number).rangeBetween(-30, -1)
    own = rows.withColumn("segment_mean", F.round(F.coalesce(F.avg("today_count").over(before), F.lit(0.0)), 2))
    quiet = own.where(
        (F.col("deviation_ratio") <= 0.5) & (F.col("days_sampled") >= 7) & ~(
            weekend & (F.col("today_count") >= F.col("segment_mean") * 0.5)
        )
    )
    if holidays is not None:
        quiet = quiet.join(holidays, ["country", "date"], "left_anti")
    ratio = F.col("deviation_ratio")
    return quiet.withColumn(
        "severity",
        F.when(ratio == 0, "TOTAL").when(ratio < 0.2, "SIGNIFICANT").when(ratio < 0.5, "NOTABLE").otherwise("MINOR")
    )


def as_of(
    rows: DataFrame, history: DataFrame, keys: list[str], at: str = "at", since: str = "since", values: list[str] | None = None
) -> DataFrame:
    """rows with the `values` of history(*keys, since, ...) that were valid at their time: those of the last `since` that is
    not after it; null before the first one, for keys without history and for null times.

    A history row is valid until its key's next one. Its validity is spread over the days that it covers, up to the last
    day of rows, so rows find it by an equal join on key and day, which Spark can broadcast or split when a key is
    hot; no key's rows are sorted or held together. Of history rows with one key and time one counts.
    """
    values = [c for c in history.columns if c not in (*keys, since)] if values is None else values
    day = lambda c: F.floor(F.unix_seconds(c) / 86_400)
    once = history.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).cast("timestamp").alias("_since"))
    once = once.agg(*[F.max(F.struct(*values)).alias("_values")])
    until = F.lead("_since").over(Window.partitionBy(*keys).orderBy("_since"))
    last = rows.agg(F.max(day(F.col(at).cast("timestamp"))).alias("_last"))
    spans = once.withColumn("_until", until).join(F.broadcast(last), F.lit(True))
    end = F.least(F.coalesce(day("_until"), "_last"), "_last")
    spans = spans.where(day("_since") <= F.col("_last")).withColumn("_day", F.explode(F.sequence(day("_since"), end)))
    r, h = rows.withColumn("_at", F.col(at).cast("timestamp")).alias("r"), spans.alias("h")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys] + [day("r._at") == F.col("h._day")]
    same += [F.col("r._at") >= F.col("h._since"), F.col("h._until").isNull() | (F.col("r._at") < F.col("h._until"))]
    kept = [F.col(f"r.`{c}`") for c in rows.columns if c not in values]
    return r.join(h, same, "left").select(*kept, *[F.col(f"h._values.{c}").alias(c) for c in values])
