"""Calendars, baselines and trends over the orders and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import activity, gates, rollup, trends
from ..sources import sinks
from . import driver as d
from .registry import query

_V = f"WITH {d.VOLUMES_SQL}"
_ACT = f"{_V}, {d.baseline_sql('filled', 'based')}, {d.deviation_sql('based', 'act')}"
# a theme of the order tables is the region's audience class; n is its day's count
_THEMES = "themes AS (SELECT country, audience_type AS theme, date, today_count AS n FROM daily)"


def _filled(spark, sf):
    return activity.zero_filled(d.daily_volume(spark, sf))


def _backfill(spark, sf):
    return activity.activity(d.daily_volume(spark, sf), zero_fill=True)


def _themes(spark, sf):
    return d.daily_volume(spark, sf).select(
        "country", F.col("audience_type").alias("theme"), "date", F.col("today_count").alias("n")
    )


@query(
    f"{_V}, o AS (SELECT country, audience_type, domain, date, count(*) AS volume FROM volumes GROUP BY ALL) SELECT country, audience_type, date, CAST(sum(volume) AS BIGINT) AS today_count FROM o WHERE domain <> 'c7.example.com' GROUP BY ALL"
)
def bucket_volumes(spark, sf):
    rows = d.volume_rows(spark, sf)
    volumes = rows.groupBy(
        F.concat_ws("|", "domain", "country", "audience_type").alias("domain"), F.to_date("date").alias("date")
    ).agg(F.count("*").alias("n"))
    volumes = volumes.withColumn(
        "volume", F.when(F.col("domain").startswith("c7.example.com"), -F.col("n")).otherwise(F.col("n"))
    )
    parts = F.split("domain", r"\|")
    outlets = volumes.select("domain", parts[1].alias("country"), parts[2].alias("audience_type")).distinct()
    return activity.daily_volumes(volumes, outlets)


@query(f"{_V} SELECT country, audience_type, date, today_count FROM filled")
def zero_filled_calendar(spark, sf):
    return _filled(spark, sf)


@query(f"{_V}, {d.baseline_sql('filled', 'based')} SELECT * FROM based")
def baseline_zero_filled(spark, sf):
    return activity.with_baseline(_filled(spark, sf))


@query(
    f"{_ACT} SELECT country, audience_type, date, today_count, baseline_mean, baseline_std, days_sampled, deviation_ratio, z_score, level, confidence, days_sampled < 7 AS cold_start FROM act"
)
def activity_backfill(spark, sf):
    rows = activity.activity(d.daily_volume(spark, sf), zero_fill=True, warm=7)
    return rows.select(
        "country", "audience_type", "date", "today_count", "baseline_mean", "baseline_std", "days_sampled",
        "deviation_ratio", "z_score", "level", "confidence", "cold_start"
    )


@query(f"""{_ACT}, w AS (SELECT *, isodow(date) >= 6 AS weekend FROM act),
 s AS (SELECT *, round(coalesce(avg(today_count) OVER (PARTITION BY country, audience_type, weekend ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0), 2) AS segment_mean FROM w)
 SELECT country, audience_type, date, today_count, deviation_ratio, segment_mean, CASE WHEN deviation_ratio = 0 THEN 'TOTAL' WHEN deviation_ratio < 0.2 THEN 'SIGNIFICANT' WHEN deviation_ratio < 0.5 THEN 'NOTABLE' ELSE 'MINOR' END AS severity
 FROM s WHERE deviation_ratio <= 0.5 AND days_sampled >= 7 AND NOT (weekend AND today_count >= segment_mean * 0.5) AND NOT (month(date) = 1 AND day(date) = 1)""")
def silences(spark, sf):
    act = _backfill(spark, sf)
    holidays = act.where("month(date) = 1 and day(date) = 1").select("country", "date").distinct()
    return activity.silences(act, holidays).select(
        "country", "audience_type", "date", "today_count", "deviation_ratio", "segment_mean", "severity"
    )


@query(
    f"""{_V}, w AS (SELECT *, isodow(date) >= 6 AS weekend FROM filled), {d.baseline_sql('w', 'based', 'country, audience_type, weekend')} SELECT * FROM based"""
)
def baseline_by_day_type(spark, sf):
    return activity.with_baseline(
        _filled(spark, sf).withColumn("weekend", F.weekday("date") >= 5), ["country", "audience_type", "weekend"]
    )


@query(
    f"{_V}, k AS (SELECT *, lag(date) OVER (PARTITION BY country, audience_type ORDER BY date) AS before FROM daily) SELECT country, audience_type, before AS from_date, date AS to_date, date - before AS days FROM k WHERE date - before > 1"
)
def date_gaps(spark, sf):
    return activity.gaps(d.daily_volume(spark, sf), most=1).withColumn("days", F.col("days").cast("long"))


@query(f"""{_V}, {_THEMES}, s AS (SELECT theme, CAST(sum(CASE WHEN date BETWEEN DATE '1998-03-02' AND DATE '1998-03-08' THEN n ELSE 0 END) AS BIGINT) AS this_week, CAST(sum(CASE WHEN date BETWEEN DATE '1998-02-23' AND DATE '1998-03-01' THEN n ELSE 0 END) AS BIGINT) AS last_week FROM themes GROUP BY theme)
 SELECT theme, this_week, last_week, round((this_week - last_week) * 100.0 / nullif(last_week, 0), 1) AS change_pct, CASE WHEN last_week = 0 THEN 'new' WHEN change_pct > 10 THEN 'up' WHEN change_pct < -10 THEN 'down' ELSE 'flat' END AS direction FROM s WHERE this_week > 0""")
def weekly_digest(spark, sf):
    return trends.weekly_digest(_themes(spark, sf), "1998-03-02")


@query(f"""{_ACT}, r AS (SELECT *, row_number() OVER (PARTITION BY country, audience_type ORDER BY deviation_ratio DESC, date DESC) AS nth FROM act WHERE date BETWEEN DATE '1998-03-02' AND DATE '1998-03-08' AND deviation_ratio > 1.2)
 SELECT country, audience_type, deviation_ratio AS peak_ratio, date AS peak_date FROM r WHERE nth = 1 ORDER BY peak_ratio DESC, country, audience_type LIMIT 10""")
def weekly_peaks(spark, sf):
    return trends.peak_ratios(_backfill(spark, sf), "1998-03-02", least=1.2)


@query(f"""{_V}, {_THEMES}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, theme, CAST(sum(n) AS BIGINT) AS total FROM themes GROUP BY ALL)
 SELECT month, theme, total, rank() OVER (PARTITION BY month ORDER BY total DESC) AS rank, total - lag(total) OVER (PARTITION BY theme ORDER BY month) AS change FROM m""")
def monthly_report(spark, sf):
    return trends.monthly_report(_themes(spark, sf))


@query(
    f"{_V}, {_THEMES} SELECT country, " + ", ".join(
        f"CAST(sum(CASE WHEN strftime(date, '%Y-%m') = '1998-{m:02d}' THEN n ELSE 0 END) AS BIGINT) AS m{m:02d}" for m in range(1, 13)
    ) + " FROM themes GROUP BY country"
)
def heat_map(spark, sf):
    grid = trends.heat_map(_themes(spark, sf), [f"1998-{m:02d}" for m in range(1, 13)])
    return grid.select("country", *[F.col(f"1998-{m:02d}").alias(f"m{m:02d}") for m in range(1, 13)])


@query(f"""{_V}, dom AS (SELECT country, domain AS theme, date, count(*) AS n FROM volumes GROUP BY ALL)
 SELECT country, theme, CAST(sum(n) AS BIGINT) AS n FROM dom WHERE date BETWEEN DATE '1998-03-02' AND DATE '1998-03-08' AND (country, theme) NOT IN (SELECT (country, theme) FROM dom WHERE date BETWEEN DATE '1998-02-23' AND DATE '1998-03-01') GROUP BY ALL""")
def emerging_themes(spark, sf):
    rows = d.volume_rows(spark, sf).groupBy(
        "country", F.col("domain").alias("theme"), F.to_date("date").alias("date")
    ).agg(F.count("*").alias("n"))
    return trends.emerging(rows, "1998-03-02")


@query(f"""{_V}, {_THEMES}, s AS (SELECT country, theme, sum(CASE WHEN date BETWEEN DATE '2001-07-26' AND DATE '2001-08-01' THEN n ELSE 0 END) / 7 AS r, sum(CASE WHEN date BETWEEN DATE '2001-06-25' AND DATE '2001-07-24' THEN n ELSE 0 END) / 30 AS p FROM themes GROUP BY ALL)
 SELECT country, theme, round(r, 4) AS recent_daily, round(p, 4) AS past_daily FROM s WHERE p > 0.05 AND r < p * 0.9""")
def topic_silences(spark, sf):
    return trends.topic_silences(_themes(spark, sf), "2001-08-01", least=0.05, share=0.9)


@query(f"""{_V}, {_THEMES}, m AS (SELECT country, theme, month(date) AS month, avg(n) AS a FROM themes GROUP BY ALL), w AS (SELECT *, avg(a) OVER (PARTITION BY country, theme) AS o, count(*) OVER (PARTITION BY country, theme) AS k FROM m)
 SELECT country, theme, CAST(month AS INT) AS month, round(a, 4) AS avg_daily, round(a / o, 4) AS ratio_to_mean FROM w WHERE k >= 12 AND a > o * 1.02""")
def cyclic_months(spark, sf):
    return trends.cyclic_months(_themes(spark, sf), factor=1.02)


@query(f"""{_V}, y AS (SELECT country, domain AS theme, CAST(date_trunc('month', date) AS DATE) AS month, count(*) FILTER (WHERE audience_type = 'DOMESTIC') AS dom, count(*) FILTER (WHERE audience_type = 'INTERNATIONAL') AS intl FROM volumes GROUP BY ALL),
 i AS (SELECT country, theme, month, intl / (dom + intl) AS share, row_number() OVER (PARTITION BY country, theme ORDER BY month) - 1 AS idx FROM y WHERE dom + intl > 0),
 f AS (SELECT country, theme, count(*) AS months, regr_slope(share, idx) AS slope, arg_min(share, month) AS a, arg_max(share, month) AS b FROM i GROUP BY ALL)
 SELECT country, theme, months, round(slope * 100, 4) AS slope_pct, CASE WHEN slope > 0 THEN 'INTERNATIONAL' ELSE 'DOMESTIC' END AS toward, round(a, 4) AS first_share, round(b, 4) AS last_share FROM f WHERE months >= 3 AND abs(slope) > 0.002""")
def audience_shift(spark, sf):
    rows = d.volume_rows(spark, sf).groupBy(
        "country", F.col("domain").alias("theme"), "audience_type", F.to_date("date").alias("date")
    ).agg(F.count("*").alias("n"))
    return trends.audience_shift(rows, least=0.002)


@query(f"""{_V}, o AS (SELECT domain, date, count(*) AS volume FROM volumes GROUP BY ALL),
 s AS (SELECT domain, count(*) AS rows, count(DISTINCT date) AS days, CAST(sum(volume) AS BIGINT) AS volume FROM o GROUP BY domain),
 u AS (SELECT DISTINCT 'c' || (c_custkey % 60) || '.example.com' AS domain FROM customer)
 SELECT u.domain, coalesce(rows, 0) AS rows, coalesce(days, 0) AS days, coalesce(volume, 0) AS volume, rows IS NOT NULL AS has_data
 FROM u LEFT JOIN s USING (domain)""")
def source_coverage(spark, sf):
    number = (F.col("c_custkey") % 60).cast("string")
    outlets = d.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), number, F.lit(".example.com")).alias("domain")
    ).distinct()
    volumes = d.volume_rows(spark, sf).groupBy("domain", F.to_date("date").alias("date")).agg(
        F.count("*").alias("volume")
    )
    return gates.source_coverage(outlets, volumes)


@query(f"""{_V}, f AS (SELECT country, audience_type AS theme, date, today_count AS n FROM filled),
 k AS (SELECT *, row_number() OVER p AS k, count(*) OVER (PARTITION BY country, theme) AS days FROM f WINDOW p AS (PARTITION BY country, theme ORDER BY date)),
 s AS (SELECT *, avg(n) OVER (PARTITION BY country, theme ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s, days - 2 AS points, max(CASE WHEN k > days - 14 THEN n END) OVER (PARTITION BY country, theme) AS late_max FROM k),
 q AS (SELECT *, s > max(s) OVER (PARTITION BY country, theme ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND s > max(s) OVER (PARTITION BY country, theme ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS peak,
   s < min(s) OVER (PARTITION BY country, theme ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND s < min(s) OVER (PARTITION BY country, theme ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS trough FROM s WHERE k <= points),
 a AS (SELECT country, theme, any_value(days) AS days, any_value(points) AS points, any_value(late_max) AS late_max, avg(s) AS mean, avg(s) FILTER (WHERE k > points - 7) AS recent, regr_slope(s, k) FILTER (WHERE k > points - 7) AS slope,
   max(k) FILTER (WHERE peak) AS last_k, arg_max(s, k) FILTER (WHERE peak) AS last_s, count(*) FILTER (WHERE peak) AS peaks, list_sort(list(k) FILTER (WHERE peak), 'DESC')[2] AS before_k, list({{'k': k, 's': s}}) FILTER (WHERE trough) AS troughs FROM q GROUP BY ALL)
 SELECT country, theme, days, CASE WHEN days < 14 OR points < 7 THEN 'INSUFFICIENT_DATA' WHEN mean < 1 AND recent > 3 THEN 'EMERGING' WHEN slope > 0.5 AND recent > mean * 1.5 THEN 'SURGING' WHEN last_k - 1 >= points - 4 THEN 'PEAKED' WHEN slope < -0.5 AND recent < mean * 0.7 THEN 'DECLINING'
   WHEN peaks >= 2 AND last_s > mean * 2 AND len(list_filter(troughs, lambda t: t.k > before_k AND t.s < mean * 0.3)) > 0 THEN 'RESURGENT' WHEN recent < mean * 0.3 AND late_max < mean * 0.5 THEN 'FADED' ELSE 'STABLE' END AS stage, round(mean, 4) AS mean, round(recent, 4) AS recent, round(slope, 4) + 0.0 AS slope FROM a""")
def theme_lifecycle(spark, sf):
    rows = _filled(spark, sf).select(
        "country", F.col("audience_type").alias("theme"), "date", F.col("today_count").alias("n")
    )
    return trends.lifecycle(rows).withColumn("slope", F.col("slope") + 0.0)


@query(
    f"{_V} SELECT country, audience_type, date, today_count AS n FROM filled WHERE country = 'ASIA' AND date > DATE '2001-08-01' - 90"
)
def theme_trend(spark, sf):
    return _filled(spark, sf).where("country = 'ASIA' and date > date'2001-08-01' - 90").select(
        "country", "audience_type", "date", F.col("today_count").alias("n")
    )


@query(f"""{_V}, dom AS (SELECT country, domain AS theme, date, count(*) AS today_count FROM volumes GROUP BY ALL), b AS (SELECT DISTINCT country, theme FROM dom),
 days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM dom), (SELECT max(date) FROM dom), INTERVAL 1 DAY)) AS DATE) AS date), g AS (SELECT b.country, b.theme, days.date, coalesce(d.today_count, 0) AS today_count FROM b CROSS JOIN days LEFT JOIN dom d ON d.country = b.country AND d.theme = b.theme AND d.date = days.date),
 {d.baseline_sql('g', 'based', 'country, theme')}, {d.deviation_sql('based', 'act')} SELECT country, theme, date, today_count, baseline_mean, deviation_ratio, level FROM act""")
def theme_deviation(spark, sf):
    rows = d.volume_rows(spark, sf).groupBy(
        "country", F.col("domain").alias("theme"), F.to_date("date").alias("date")
    ).agg(F.count("*").alias("today_count"))
    act = activity.activity(rows, ["country", "theme"], zero_fill=True)
    return act.select("country", "theme", "date", "today_count", "baseline_mean", "deviation_ratio", "level")


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber) = 1),
 r AS (SELECT n_name AS country, month AS period_start, p_type AS t1, p_brand AS t2 FROM a JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
 t AS (SELECT country, period_start, count(*) AS bucket_total FROM r GROUP BY ALL), c AS (SELECT country, period_start, unnest([t1, t2]) AS theme FROM r), k AS (SELECT country, period_start, theme, count(*) AS article_count FROM c GROUP BY ALL HAVING count(*) >= 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY country, period_start ORDER BY article_count DESC, theme) AS rank FROM k)
 SELECT country, period_start, theme, article_count, bucket_total, round(article_count / bucket_total, 4) AS share, rank FROM n JOIN t USING (country, period_start) WHERE rank <= 10""")
def supplier_theme_rollup(spark, sf):
    li = d.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("date")
    )
    part, supplier, nation = (d.table(spark, sf, t) for t in ("part", "supplier", "nation"))
    first = rollup.dedup(li, ("l_suppkey", "l_orderkey", "l_partkey"), ("date", "l_linenumber"))
    place = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("country")
    )
    rows = first.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        place, F.col("l_suppkey") == F.col("s_suppkey")
    )
    rows = rows.select(
        "country", F.lit("ALL").alias("audience_type"), "date", F.array("p_type", "p_brand").alias("themes"),
        F.lit(None).cast("double").alias("tone")
    )
    return rollup.theme_rollup(rows, top=10).select(
        "country", "period_start", "theme", "article_count", "bucket_total", "share", "rank"
    )


@query(f"""{_ACT}, o AS (SELECT country, audience_type, date, today_count FROM daily WHERE date < DATE '2001-01-01'), n AS (SELECT country, audience_type, date, today_count * 10 AS today_count FROM daily WHERE date >= DATE '2000-12-01' AND today_count > 1)
 SELECT * FROM n UNION ALL SELECT * FROM o WHERE (country, audience_type, date) NOT IN (SELECT (country, audience_type, date) FROM n)""")
def keyed_upsert(spark, sf):
    daily = d.daily_volume(spark, sf)
    new = daily.where("date >= '2000-12-01' and today_count > 1").withColumn("today_count", F.col("today_count") * 10)
    return sinks.upserted(daily.where("date < '2001-01-01'"), new, sinks.KEYS["country_activity"])


@query(
    f"{_ACT} SELECT country, audience_type, date, cold_start AND NOT date < DATE '1995-01-15' AS cold_start, cold_start AND date < DATE '1995-01-15' AS cleared FROM act"
)
def clear_cold_start(spark, sf):
    return sinks.clear_cold_start(_backfill(spark, sf), "1995-01-15").select(
        "country", "audience_type", "date", "cold_start", "cleared"
    )


@query(f"{_V} SELECT country, audience_type, date, today_count FROM daily WHERE date >= DATE '2001-08-01' - 30")
def retained_days(spark, sf):
    return sinks.retained(d.daily_volume(spark, sf), "2001-08-01")
