"""Reports over days, weeks and months: snapshots, digests, lifecycles, cycles and shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rollup import ranked

THEME = ["country", "theme"]


def daily_snapshot(activity: DataFrame, themes: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per date: articles, active countries, spikes, the counts of countries and themes as maps, and with `events`
    the day's coordination events and its silent countries as lists."""
    main = activity.groupBy("date").agg(
        F.sum("today_count").alias("total_articles"), F.count_distinct("country").alias("active_countries"),
        F.count_if(F.col("level").isin("red", "orange")).alias("spikes"),
        F.count_if(F.col("level").isin("deepBlue", "steelBlue")).alias("silences"),
        F.array_sort(
            F.collect_set(F.when(F.col("level").isin("deepBlue", "steelBlue"), F.col("country")))
        ).alias("silent_countries"),
    )

    def per(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        sums = rows.groupBy("date", key).agg(F.sum(value).alias("n"))
        return sums.groupBy("date").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name)
        )

    out = main.join(per(activity, "country", "today_count", "countries"), "date", "left")
    out = out.join(per(themes, "theme", "n", "themes"), "date", "left")
    if events is None:
        return out.drop("silent_countries")
    entry = F.struct("theme", "countries", "coordination_score")
    found = events.groupBy("date").agg(F.array_sort(F.collect_list(entry)).alias("coordinations"))
    return out.join(found, "date", "left")


def weekly_report(
    daily: DataFrame, activity: DataFrame, contradictions: DataFrame, silences: DataFrame, events: DataFrame, week: str
) -> DataFrame:
    """One row: all sections of the digest of the week that starts on `week`, as arrays of rows, with its totals.

    contradictions(date, cluster, country, score), silences(date, country, audience_type, severity) and
    events(date, theme, coordination_score) are cut to the week, to what is significant, and to the section's length.
    """
    start = F.lit(week).cast("date")
    inside = F.col("date").between(start, F.date_add(start, 6))

    def section(rows: DataFrame, name: str, *columns: str | F.Column) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    found = contradictions.where(inside & (F.col("score") >= 0.4)).orderBy(
        F.desc("score"), "date", "cluster", "country"
    ).limit(10)
    quiet = silences.where(inside & F.col("severity").isin("SIGNIFICANT", "TOTAL"))
    joint = events.where(inside & (F.col("coordination_score") >= 0.3)).orderBy(
        F.desc("coordination_score"), "date", "theme"
    ).limit(5)
    totals = activity.where(inside).agg(
        F.coalesce(F.sum("today_count"), F.lit(0)).alias("total_articles"),
        F.count_distinct(F.when(F.col("today_count") > 0, F.col("country"))).alias("countries_active"),
    )
    minus = lambda c: (-F.col(c)).alias("k")
    parts = [
        section(
            weekly_digest(daily, week), "top_themes", minus("this_week"), "theme", "this_week", "last_week",
            "direction"
        ),
        section(
            peak_ratios(activity, week), "spikes", minus("peak_ratio"), "country", "audience_type", "peak_ratio",
            "peak_date"
        ),
        section(found, "contradictions", minus("score"), "date", "cluster", "country", "score"),
        section(quiet, "silences", "date", "country", "audience_type", "severity"),
        section(joint, "coordinations", minus("coordination_score"), "date", "theme", "coordination_score"),
    ]
    out = totals.select(
        start.alias("week_start"), F.date_add(start, 6).alias("week_end"), "total_articles", "countries_active"
    )
    for part in parts:
        out = out.join(part, F.lit(True))
    return out


def weekly_digest(daily: DataFrame, week: str, top: int = 20) -> DataFrame:
    """Theme totals of the week that starts on `week` and of the week before, with change and direction."""
    start = F.lit(week).cast("date")
    this, last = F.col("date").between(start, F.date_add(start, 6)), F.col("date").between(
        F.date_sub(start, 7), F.date_sub(start, 1)
    )
    sums = daily.where(this | last).groupBy("theme").agg(
        F.sum(F.when(this, F.col("n")).otherwise(0)).alias("this_week"),
        F.sum(F.when(last, F.col("n")).otherwise(0)).alias("last_week")
    )
    change = F.round((F.col("this_week") - F.col("last_week")) * 100.0 / F.nullif("last_week", F.lit(0)), 1)
    out = sums.where("this_week > 0").withColumn("change_pct", change).withColumn(
        "direction",
        F.when(F.col("last_week") == 0, "new").when(F.col("change_pct") > 10, "up").when(
            F.col("change_pct") < -10, "down"
        ).otherwise("flat")
    )
    return out.orderBy(F.desc("this_week"), "theme").limit(top)


def peak_ratios(activity: DataFrame, week: str, least: float = 2.0, top: int = 10) -> DataFrame:
    """The highest deviation of each bucket in a week, with its day."""
    start = F.lit(week).cast("date")
    rows = activity.where(F.col("date").between(start, F.date_add(start, 6)) & (F.col("deviation_ratio") > least))
    best = rows.groupBy("country", "audience_type").agg(F.max(F.struct("deviation_ratio", "date")).alias("m")).select(
        "country", "audience_type", F.col("m.deviation_ratio").alias("peak_ratio"), F.col("m.date").alias("peak_date")
    )
    return best.orderBy(F.desc("peak_ratio"), "country", "audience_type").limit(top)


def monthly_report(daily: DataFrame) -> DataFrame:
    """Theme totals by month with rank and change from the month before."""
    sums = daily.groupBy(F.trunc("date", "MM").alias("month"), "theme").agg(F.sum("n").alias("total"))
    before = F.lag("total").over(Window.partitionBy("theme").orderBy("month"))
    rank = F.rank().over(Window.partitionBy("month").orderBy(F.desc("total")))
    return sums.select("month", "theme", "total", rank.alias("rank"), (F.col("total") - before).alias("change"))


def heat_map(daily: DataFrame, months: list[str]) -> DataFrame:
    """Totals per country with a column per month."""
    return daily.withColumn(
        "month", F.date_format("date", "yyyy-MM")
    ).groupBy("country").pivot("month", months).agg(F.sum("n")).na.fill(0)


def emerging(daily: DataFrame, week: str) -> DataFrame:
    """Themes of a country that appear in a week and not in the week before."""
    start = F.lit(week).cast("date")
    now = daily.where(F.col("date").between(start, F.date_add(start, 6))).groupBy(*THEME).agg(F.sum("n").alias("n"))
    past = daily.where(F.col("date").between(F.date_sub(start, 7), F.date_sub(start, 1))).select(*THEME).distinct()
    return now.join(past, THEME, "left_anti")


def topic_silences(daily: DataFrame, as_of: str, least: float = 2.0, share: float = 0.2) -> DataFrame:
    """Themes whose mean of the last 7 days fell under a share of the mean of the 30 days before day -7."""
    day = F.lit(as_of).cast("date")
    recent, past = F.col("date").between(F.date_sub(day, 6), day), F.col("date").between(
        F.date_sub(day, 37), F.date_sub(day, 8)
    )
    sums = daily.where(recent | past).groupBy(*THEME).agg(
        (F.sum(F.when(recent, F.col("n")).otherwise(0)) / 7).alias("recent_daily"),
        (F.sum(F.when(past, F.col("n")).otherwise(0)) / 30).alias("past_daily")
    )
    return sums.where((F.col("past_daily") > least) & (F.col("recent_daily") < F.col("past_daily") * share)).select(
        *THEME, F.round("recent_daily", 4).alias("recent_daily"), F.round("past_daily", 4).alias("past_daily")
    )


def cyclic_months(daily: DataFrame, factor: float = 2.0, months: int = 12) -> DataFrame:
    """Months of the year with more than `factor` times a theme's mean month, where all months occur."""
    per = daily.groupBy(*THEME, F.month("date").alias("month")).agg(F.avg("n").alias("avg_daily"))
    whole = Window.partitionBy(*THEME)
    rows = per.withColumn("overall", F.avg("avg_daily").over(whole)).withColumn("_months", F.count("*").over(whole))
    return rows.where((F.col("_months") >= months) & (F.col("avg_daily") > F.col("overall") * factor)).select(
        *THEME, "month", F.round("avg_daily", 4).alias("avg_daily"),
        F.round(F.col("avg_daily") / F.col("overall"), 4).alias("ratio_to_mean")
    )


def audience_shift(daily: DataFrame, least: float = 0.03, months: int = 3) -> DataFrame:
    """Themes whose international share of domestic and international output drifts month by month."""
    n = lambda a: F.sum(F.when(F.col("audience_type") == a, F.col("n")).otherwise(0))
    per = daily.groupBy(*THEME, F.trunc("date", "MM").alias("month")).agg(
        n("DOMESTIC").alias("dom"), n("INTERNATIONAL").alias("intl")
    ).where("dom + intl > 0")
    per = per.select(
        *THEME, "month", (F.col("intl") / (F.col("dom") + F.col("intl"))).alias("share"),
        (F.row_number().over(Window.partitionBy(*THEME).orderBy("month")) - 1).alias("idx")
    )
    fit = per.groupBy(*THEME).agg(
        F.count("*").alias("months"), F.regr_slope("share", "idx").alias("slope"),
        F.min_by("share", "month").alias("first_share"), F.max_by("share", "month").alias("last_share")
    )
    moved = fit.where((F.col("months") >= months) & (F.abs("slope") > least))
    return moved.select(
        *THEME, "months", F.round(F.col("slope") * 100, 4).alias("slope_pct"),
        F.when(F.col("slope") > 0, "INTERNATIONAL").otherwise("DOMESTIC").alias("toward"),
        F.round("first_share", 4).alias("first_share"), F.round("last_share", 4).alias("last_share")
    )


def lifecycle(series: DataFrame, keys: list[str] = THEME, least: int = 14) -> DataFrame:
    """The stage of every series(keys, date, n) without gaps: smoothed by 3 days, its slope over the last 7,
    peaks and troughs against 3 neighbours a side.

    Smoothed point k is the mean of days k to k + 2. An end point is never a peak, as a missing side
    compares it with itself.
    """
    order = Window.partitionBy(*keys).orderBy("date")
    whole = Window.partitionBy(*keys)
    days = series.select(
        *keys, "date", "n", F.row_number().over(order).alias("k"), F.count("*").over(whole).alias("days")
    )
    sm = days.withColumn("s", F.avg("n").over(order.rowsBetween(0, 2))).withColumn("points", F.col("days") - 2)
    late = F.max(F.when(F.col("k") > F.col("days") - 14, F.col("n"))).over(whole)
    sm = sm.withColumn("late_max", late).where("k <= points")
    at = Window.partitionBy(*keys).orderBy("k")
    left, right = at.rowsBetween(-3, -1), at.rowsBetween(1, 3)
    sm = sm.withColumn("peak", (F.col("s") > F.max("s").over(left)) & (F.col("s") > F.max("s").over(right))).withColumn(
        "trough", (F.col("s") < F.min("s").over(left)) & (F.col("s") < F.min("s").over(right))
    )
    recent = F.col("k") > F.col("points") - 7
    agg = sm.groupBy(*keys).agg(
        F.first("days").alias("days"), F.first("points").alias("points"), F.first("late_max").alias("late_max"),
        F.avg("s").alias("mean"), F.avg(F.when(recent, F.col("s"))).alias("recent"),
        F.regr_slope(F.when(recent, F.col("s")), F.when(recent, F.col("k"))).alias("slope"),
        F.array_sort(F.collect_list(F.when(F.coalesce("peak", F.lit(False)), F.struct("k", "s")))).alias("peaks"),
        F.collect_list(F.when(F.coalesce("trough", F.lit(False)), F.struct("k", "s"))).alias("troughs"),
    )
    last = F.try_element_at("peaks", F.lit(-1))
    before = F.try_element_at("peaks", F.lit(-2))
    deep = F.exists("troughs", lambda t: (t["k"] > before["k"]) & (t["s"] < F.col("mean") * 0.3))
    stage = (
        F.when((F.col("days") < least) | (F.col("points") < 7), "INSUFFICIENT_DATA").when((F.col("mean") < 1.0) & (F.col("recent") > 3.0), "EMERGING").when(
            (F.col("slope") > 0.5) & (F.col("recent") > F.col("mean") * 1.5), "SURGING"
        )
        .when(last["k"] - 1 >= F.col("points") - 4, "PEAKED").when(
            (F.col("slope") < -0.5) & (F.col("recent") < F.col("mean") * 0.7), "DECLINING"
        )
        .when((F.size("peaks") >= 2) & (last["s"] > F.col("mean") * 2) & deep, "RESURGENT").when(
            (F.col("recent") < F.col("mean") * 0.3) & (F.col("late_max") < F.col("mean") * 0.5), "FADED"
        ).otherwise("STABLE")
    )
    return agg.select(
        *keys, "days", stage.alias("stage"), F.round("mean", 4).alias("mean"), F.round("recent", 4).alias("recent"),
        F.round("slope", 4).alias("slope")
    )


def transparency(articles: DataFrame) -> DataFrame:
    """Outlets and theme mentions behind each bucket of a day."""
    return articles.groupBy("country", "audience_type", F.to_date("date").alias("date")).agg(
        F.count_distinct("domain").alias("outlets"), F.sum(F.coalesce(F.size("themes"), F.lit(0))).alias("mentions")
    )
