"""Themes that several countries push at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def spikes(
    themes: DataFrame, activity: DataFrame, theme_baseline: DataFrame | None = None, least: int = 7
) -> DataFrame:
    """Top themes(country, audience_type, date, theme, n) with their baseline and ratio.

    The baseline is the bucket's own, or with theme_baseline(…, theme, baseline_mean, days_sampled) the
    theme's; without a usable one the ratio is 0.
    """
    keys = ["country", "audience_type", "date"]
    base = (
        activity.select(*keys, "baseline_mean", "days_sampled") if theme_baseline is None else theme_baseline.select(
            *keys, "theme", "baseline_mean", "days_sampled"
        )
    )
    joined = themes.join(base, keys if theme_baseline is None else [*keys, "theme"], "left")
    ratio = F.when(
        (F.col("days_sampled") >= least) & (F.col("baseline_mean") > 0), F.col("n") / F.col("baseline_mean")
    ).otherwise(0.0)
    return joined.select(
        *keys, "theme", F.col("n").alias("article_count"), F.coalesce("baseline_mean", F.lit(0.0)).alias("baseline"),
        ratio.alias("ratio")
    )


def pair_bonus(countries: Column) -> Column:
    """The bonus of the exact sorted country set, else the best bonus of a pair in it."""
    exact = F.element_at(text.literal_map(fixed.PAIR_BONUSES), F.array_join(countries, ","))
    pairs = [
        F.when(F.array_contains(countries, p[0]) & F.array_contains(countries, p[1]), b).otherwise(0.0) for k,
        b in fixed.PAIR_BONUSES.items() if len(p := k.split(",")) == 2
    ]
    return F.coalesce(exact, F.greatest(*pairs))


def score(countries: Column) -> Column:
    return F.least(pair_bonus(countries) + F.least((F.size(countries) - 1) * 0.15, F.lit(0.45)) + 0.10, F.lit(1.0))


def detect(
    found: DataFrame, surge: float = 2.0, least_countries: int = 2, least_score: float = 0.30,
    keys: list[str] = ["date"]
) -> DataFrame:  # noqa: B006
    """(keys, theme, countries, coordination_score, details) of themes that surge in several countries.

    Countries are distinct and sorted; details have one entry per spike, in order of country and audience.
    """
    entry = F.struct(
        "country", "audience_type", "article_count", "baseline", F.round("ratio", 2).alias("ratio")
    ) if "audience_type" in found.columns else F.struct("country", "article_count", "baseline", F.round("ratio", 2).alias("ratio"))
    groups = found.where(F.col("ratio") >= surge).groupBy(*keys, "theme").agg(
        F.array_sort(F.collect_set("country")).alias("countries"),
        F.array_sort(F.collect_list(entry)).alias("details")
    )
    scored = groups.where(F.size("countries") >= least_countries).withColumn(
        "coordination_score", score(F.col("countries"))
    )
    return scored.where(F.col("coordination_score") >= least_score).withColumn(
        "coordination_score", F.round("coordination_score", 3)
    )


def detect_48h(
    counts: DataFrame, baselines: DataFrame, specificity: DataFrame | None = None, surge: float = 2.0,
    least_countries: int = 2
) -> DataFrame:
    """The two-day variant: counts(date, country, theme, n) of a day and the day before over a theme
    baseline(country, theme, baseline_mean); only exact country sets have a bonus and specificity adds."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    both = counts.withColumn(
        "n2", F.sum("n").over(Window.partitionBy("country", "theme").orderBy(day).rangeBetween(-1, 0))
    )
    hot = both.join(baselines, ["country", "theme"]).where(
        (F.col("baseline_mean") > 0) & (F.col("n2") / F.col("baseline_mean") > surge)
    )
    groups = hot.groupBy("date", "theme").agg(F.array_sort(F.collect_set("country")).alias("countries")).where(
        F.size("countries") >= least_countries
    )
    weight = F.lit(0.5)
    if specificity is not None:
        groups = groups.join(specificity, "theme", "left")
        weight = F.coalesce("specificity", F.lit(0.5))
    exact = F.coalesce(F.element_at(text.literal_map(fixed.PAIR_BONUSES), F.array_join("countries", ",")), F.lit(0.0))
    total = exact + F.least((F.size("countries") - 1) * 0.15, F.lit(0.45)) + weight * 0.2
    return groups.select(
        "date", "theme", "countries", F.round(F.least(total, F.lit(1.0)), 3).alias("coordination_score")
    )


def arcs(events: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """A row for each pair of an event's countries, with its colour, width and height."""
    n = F.size("countries")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.sequence(i + 1, n),
                lambda j: F.struct(
                    F.element_at("countries", i).alias("start_country"),
                    F.element_at("countries", j).alias("end_country")
                )
            )
        )
    )
    s = F.col("coordination_score")
    out = events.where(n >= 2).select("date", "theme", "coordination_score", F.explode(pairs).alias("p")).select(
        "date", "theme", "p.*", "coordination_score",
        F.when(s >= 0.70, "#00E5CC").when(s >= 0.50, "#00BFA5").otherwise("#00897B").alias("color"),
        F.round(1 + s * 3, 3).alias("stroke_width"), F.round(0.3 + s * 0.2, 3).alias("altitude"),
    )
    if countries is None:
        return out
    ends = countries.select("country", "name")
    return out.join(F.broadcast(ends.toDF("start_country", "start_name")), "start_country").join(
        F.broadcast(ends.toDF("end_country", "end_name")), "end_country"
    )
