"""Theme rollups, activity, coordination and verdicts over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import activity, claims, coordination, gates, rollup, trends
from . import driver as d
from . import views
from .registry import query

ALL = ["monthly", "weekly", "daily"]
_ROLL = f"WITH {d.ARTICLES_SQL}, {d.rollup_sql(ALL)}"
_COLUMNS = "country, audience_type, period_type, period_start, period_end, theme, article_count, bucket_total, share, round(avg_tone, 9) + 0.0 AS avg_tone, rank"
_DAILY = "daily AS (SELECT country, audience_type, day AS date, count(*) AS today_count FROM articles GROUP BY ALL)"
_ACT = f"WITH {d.ARTICLES_SQL}, {_DAILY}, {d.baseline_sql('daily', 'based')}, {d.deviation_sql('based', 'act')}"
_TOP = "tops AS (SELECT country, audience_type, day AS date, theme, count(*) AS n, row_number() OVER (PARTITION BY country, audience_type, day ORDER BY count(*) DESC, theme) AS rank FROM mentions GROUP BY country, audience_type, day, theme)"
_SPIKE = """spikes AS (SELECT t.country, t.audience_type, t.date, theme, n AS article_count, baseline_mean AS baseline, CASE WHEN days_sampled >= 1 AND baseline_mean > 0 THEN n / baseline_mean ELSE 0 END AS ratio
  FROM tops t JOIN act USING (country, audience_type, date) WHERE rank <= 10)"""


def _bonus_sql(names: str = "names") -> str:
    exact = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.PAIR_BONUSES.items())
    pairs = ", ".join(
        f"CASE WHEN list_contains({names}, '{k[:2]}') AND list_contains({names}, '{k[3:]}') THEN {v} ELSE 0 END" for k,
        v in fixed.PAIR_BONUSES.items() if len(k) == 5
    )
    return f"CASE array_to_string({names}, ',') {exact} ELSE greatest({pairs}) END"


_EVENTS = f"""grouped AS (SELECT date, theme, list_sort(list(DISTINCT country)) AS names, count(*) AS entries FROM spikes WHERE ratio >= 0.6 GROUP BY date, theme),
found AS (SELECT *, round(least({_bonus_sql()} + least((len(names) - 1) * 0.15, 0.45) + 0.10, 1.0), 3) AS coordination_score FROM grouped WHERE len(names) >= 2)"""


def _rollup(spark, sf):
    return rollup.theme_rollup(d.articles(spark, sf), ALL)


def _activity(spark, sf):
    return activity.activity(activity.daily_counts(d.articles(spark, sf)))


def _spikes(spark, sf):
    # one day's themes are a part of the bucket's day, so the events here surge from 0.6 of the baseline on
    return coordination.spikes(activity.top_themes(d.articles(spark, sf)), _activity(spark, sf), least=1)


def _events(spark, sf):
    return coordination.detect(_spikes(spark, sf), surge=0.6)


@query(f"WITH {d.ARTICLES_SQL}, {d.rollup_sql(['monthly'])} SELECT {_COLUMNS} FROM rolled")
def theme_rollup_monthly(spark, sf):
    return rollup.theme_rollup(d.articles(spark, sf)).withColumn("avg_tone", F.round("avg_tone", 9) + 0.0)


@query(f"{_ROLL} SELECT {_COLUMNS} FROM rolled")
def theme_rollup_all_periods(spark, sf):
    return _rollup(spark, sf).withColumn("avg_tone", F.round("avg_tone", 9) + 0.0)


@query(
    f"WITH {d.ARTICLES_SQL} SELECT record_id, domain, url, country, audience_type, day, t1 || ',' || t2 AS themes FROM articles"
)
def dedup_articles(spark, sf):
    return d.articles(spark, sf).select(
        "record_id", "domain", "url", "country", "audience_type", F.to_date("date").alias("day"),
        F.array_join("themes", ",").alias("themes")
    )


@query(f"WITH {d.ARTICLES_SQL}, {_DAILY} SELECT * FROM daily")
def daily_article_counts(spark, sf):
    return activity.daily_counts(d.articles(spark, sf))


@query(f"""WITH {d.ARTICLES_SQL} SELECT * FROM (SELECT country, audience_type, day AS date, domain, count(*) AS n,
  row_number() OVER (PARTITION BY country, audience_type, day ORDER BY count(*) DESC, domain) AS rank FROM articles GROUP BY country, audience_type, day, domain) WHERE rank <= 10""")
def top_outlets_per_day(spark, sf):
    return activity.top_outlets(d.articles(spark, sf))


@query(f"WITH {d.ARTICLES_SQL}, {_TOP} SELECT * FROM tops WHERE rank <= 10")
def top_themes_per_day(spark, sf):
    return activity.top_themes(d.articles(spark, sf))


@query(f"WITH {d.ARTICLES_SQL}, {_DAILY}, {d.baseline_sql('daily', 'based')} SELECT * FROM based")
def baseline_observed_days(spark, sf):
    return activity.with_baseline(activity.daily_counts(d.articles(spark, sf)))


@query(f"{_ACT} SELECT * FROM act")
def activity_live(spark, sf):
    return _activity(spark, sf)


@query(f"""{_ACT}, {_TOP}, outs AS (SELECT country, audience_type, day AS date, count(DISTINCT domain) AS outlets FROM articles GROUP BY ALL),
 best AS (SELECT country, audience_type, date, string_agg(theme || '=' || n, ',' ORDER BY rank) AS top_themes FROM tops WHERE rank <= 10 GROUP BY ALL)
 SELECT country, date, audience_type, today_count, deviation_ratio, z_score, level, top_themes FROM act JOIN best USING (country, audience_type, date)""")
def activity_rows_with_themes(spark, sf):
    keys = ["country", "audience_type", "date"]
    entry = F.concat_ws("=", "theme", F.col("n").cast("string"))
    best = activity.top_themes(d.articles(spark, sf)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("t")).select(
        *keys, F.array_join(F.transform("t", lambda x: x["e"]), ",").alias("top_themes")
    )
    return _activity(spark, sf).join(best, keys).select(
        "country", "date", "audience_type", "today_count", "deviation_ratio", "z_score", "level", "top_themes"
    )


@query(
    f"{_ACT}, {_TOP}, {_SPIKE} SELECT country, audience_type, date, theme, article_count, baseline, round(ratio, 6) AS ratio FROM spikes"
)
def theme_spikes(spark, sf):
    return _spikes(spark, sf).withColumn("ratio", F.round("ratio", 6))


@query(
    f"{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS} SELECT date, theme, array_to_string(names, ',') AS countries, coordination_score, entries FROM found WHERE coordination_score >= 0.3"
)
def coordination_events(spark, sf):
    return _events(spark, sf).select(
        "date", "theme", F.array_join("countries", ",").alias("countries"), "coordination_score",
        F.size("details").cast("long").alias("entries")
    )


@query(f"""{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS}, ends AS (SELECT date, theme, coordination_score, unnest(names) AS country FROM found WHERE coordination_score >= 0.3)
 SELECT a.date, a.theme, a.country AS start_country, b.country AS end_country, a.coordination_score,
   CASE WHEN a.coordination_score >= 0.7 THEN '#00E5CC' WHEN a.coordination_score >= 0.5 THEN '#00BFA5' ELSE '#00897B' END AS color,
   round(1 + a.coordination_score * 3, 3) AS stroke_width, round(0.3 + a.coordination_score * 0.2, 3) AS altitude
 FROM ends a JOIN ends b ON a.date = b.date AND a.theme = b.theme AND a.country < b.country""")
def coordination_arcs(spark, sf):
    return coordination.arcs(_events(spark, sf))


@query(f"""{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS}, v AS (SELECT *, date = DATE '2024-01-01' OR date = DATE '2024-01-26' AS strong, len(names) >= 3 AND coordination_score >= 0.6 AS high FROM found WHERE coordination_score >= 0.3)
 SELECT date, theme, array_to_string(names, ',') AS countries, CASE WHEN strong THEN 'SUPPRESS' WHEN high THEN 'ESCALATE' ELSE 'PUBLISH_WITH_CAVEAT' END AS verdict,
   round(CASE WHEN strong THEN 0.2 WHEN high THEN coordination_score ELSE coordination_score * 0.7 END, 3) AS claim_confidence,
   round(least(1.0, coordination_score * (0.7 + 0.1 * least(len(names), 3))), 3) AS quality_score, CASE WHEN strong THEN 5 ELSE 4 END AS n_hypotheses, CASE WHEN len(names) >= 4 THEN 'MANY_COUNTRIES' ELSE '' END AS flags FROM v""")
def coordination_verdicts(spark, sf):
    rows = claims.coordination_verdicts(_events(spark, sf))
    return rows.select(
        "date", "theme", F.array_join("countries", ",").alias("countries"), "verdict", "claim_confidence",
        "quality_score", F.size("hypotheses").alias("n_hypotheses"), F.array_join("flags", ",").alias("flags")
    )


@query(f"""{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS}
 SELECT date, theme, array_to_string(names, ',') AS countries, coordination_score, CASE WHEN len(names) >= 4 THEN 'URGENT' ELSE 'HIGH' END AS severity, 'PENDING' AS review_status
 FROM found WHERE len(names) >= 3 AND coordination_score >= 0.6 AND date NOT IN (DATE '2024-01-01', DATE '2024-01-26')""")
def escalation_rows(spark, sf):
    return claims.escalations(claims.coordination_verdicts(_events(spark, sf))).withColumn(
        "countries", F.array_join("countries", ",")
    )


@query(f"""WITH {d.ARTICLES_SQL}, c AS (SELECT country, theme, day AS date, count(*) AS n FROM mentions GROUP BY ALL),
 t AS (SELECT *, sum(n) OVER (PARTITION BY country, theme ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n2 FROM c),
 b AS (SELECT country, theme, avg(n) AS baseline_mean FROM c GROUP BY ALL),
 g AS (SELECT date, theme, list_sort(list(DISTINCT country)) AS names FROM t JOIN b USING (country, theme) WHERE n2 / baseline_mean > 2.0 GROUP BY ALL HAVING count(DISTINCT country) >= 2)
 SELECT date, theme, array_to_string(names, ',') AS countries, round(least(CASE array_to_string(names, ',') {" ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.PAIR_BONUSES.items())} ELSE 0 END + least((len(names) - 1) * 0.15, 0.45) + 0.1, 1.0), 3) AS coordination_score FROM g""")
def coordination_two_days(spark, sf):
    counts = d.articles(spark, sf).select(
        "country", F.to_date("date").alias("date"), F.explode("themes").alias("theme")
    ).groupBy("country", "theme", "date").agg(F.count("*").alias("n"))
    base = counts.groupBy("country", "theme").agg(F.avg("n").alias("baseline_mean"))
    return coordination.detect_48h(counts, base).withColumn("countries", F.array_join("countries", ","))


@query(f"""{_ACT} SELECT country, audience_type, date,
  CASE WHEN days_sampled < 7 THEN 'PUBLISH_WITH_CAVEAT' WHEN days_sampled < 21 AND level IN ('red', 'deepBlue') THEN 'PUBLISH_WITH_CAVEAT' WHEN level IN ('red', 'deepBlue') AND confidence = 'LOW' THEN 'SUPPRESS'
       WHEN level IN ('red', 'deepBlue') AND confidence = 'MEDIUM' THEN 'PUBLISH_WITH_CAVEAT' ELSE 'PUBLISH' END AS verdict,
  CASE WHEN days_sampled < 7 THEN 0.4 WHEN level IN ('red', 'deepBlue') AND days_sampled < 21 THEN 0.6 WHEN confidence = 'HIGH' THEN 0.95 WHEN confidence = 'MEDIUM' THEN 0.65 ELSE 0.3 END AS claim_confidence,
  concat_ws(',', CASE WHEN days_sampled < 14 THEN 'SMALL_SAMPLE' END, CASE WHEN abs(z_score) >= 10 THEN 'SENTINEL_Z' END, CASE WHEN deviation_ratio > 2 AND abs(z_score) < 2 THEN 'HIGH_RATIO_LOW_Z' END,
    CASE WHEN baseline_std = 0 AND baseline_mean > 0 THEN 'ZERO_VARIANCE' END, CASE WHEN days_sampled < 7 THEN 'COLD_START' END) AS flags, days_sampled < 21 AS warming FROM act""")
def deviation_verdicts(spark, sf):
    return claims.deviation_verdicts(_activity(spark, sf)).select(
        "country", "audience_type", "date", "verdict", "claim_confidence", F.array_join("flags", ",").alias("flags"),
        "warming"
    )


@query(f"""{_ACT} SELECT 'DEVIATION' AS claim_type, country || '/' || audience_type || '/' || CAST(date AS VARCHAR) AS claim_key,
  CASE WHEN days_sampled < 7 OR level IN ('red', 'deepBlue') AND days_sampled < 21 THEN 'PUBLISH_WITH_CAVEAT' ELSE 'PUBLISH' END AS verdict,
  CASE WHEN confidence = 'HIGH' THEN 0.95 WHEN confidence = 'MEDIUM' THEN 0.65 ELSE 0.3 END AS quality_score FROM act""")
def claim_rows(spark, sf):
    key = F.concat_ws("/", "country", "audience_type", F.col("date").cast("string"))
    return claims.claim_rows(claims.deviation_verdicts(_activity(spark, sf)), "DEVIATION", key).select(
        "claim_type", "claim_key", "verdict", "quality_score"
    )


@query(f"{_ACT} SELECT count(*) AS rows, count(DISTINCT country) AS countries, count(DISTINCT date) AS dates, count(*) FILTER (WHERE cold_start) AS cold_starts, min(date) AS first_date, max(date) AS last_date, "
       + ", ".join(f"count(*) FILTER (WHERE audience_type = '{a}') AS n_{a.lower()}" for a in fixed.AUDIENCES) + ", " + ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS n_{x.lower()}" for x in fixed.LEVELS) + " FROM act")
def activity_summary(spark, sf):
    return gates.activity_summary(_activity(spark, sf))


@query(f"{_ROLL} SELECT count(*) AS rows, count(DISTINCT country) AS countries, count(DISTINCT period_type || CAST(period_start AS VARCHAR)) AS periods, CAST(sum(article_count) AS BIGINT) AS articles, count(DISTINCT theme) AS themes, "
       + ", ".join(f"count(*) FILTER (WHERE audience_type = '{a}') AS n_{a.lower()}" for a in fixed.AUDIENCES) + " FROM rolled")
def theme_summary(spark, sf):
    return gates.theme_summary(_rollup(spark, sf))


@query(f"""{_ROLL}, m AS (SELECT * FROM rolled WHERE period_type = 'monthly') SELECT theme, CAST(sum(article_count) AS BIGINT) AS articles, count(DISTINCT country) AS countries FROM m
 WHERE period_start = (SELECT max(period_start) FROM m) GROUP BY theme ORDER BY articles DESC, theme LIMIT 8""")
def trending_themes(spark, sf):
    return views.trending_themes(_rollup(spark, sf))


_VIEW = f"""{_ACT}, day AS (SELECT * FROM act WHERE date = (SELECT max(date) FROM act)),
 sides AS (SELECT country, date, {", ".join(f"max({c}) FILTER (WHERE audience_type = '{a}') AS {a}_{c}" for a in fixed.AUDIENCES for c in ('deviation_ratio', 'z_score', 'level', 'today_count'))}, bool_or(cold_start) AS cold_start FROM day GROUP BY ALL),
 view AS (SELECT country, date, coalesce(DOMESTIC_deviation_ratio, 1.0) AS domestic_ratio, coalesce(INTERNATIONAL_deviation_ratio, DIASPORA_deviation_ratio, 1.0) AS international_ratio,
   coalesce(DOMESTIC_z_score, 0.0) AS domestic_z, coalesce(INTERNATIONAL_z_score, DIASPORA_z_score, 0.0) AS international_z, coalesce(DOMESTIC_level, 'neutral') AS domestic_level,
   coalesce(INTERNATIONAL_level, DIASPORA_level, 'neutral') AS international_level, coalesce(DOMESTIC_today_count, 0) + coalesce(INTERNATIONAL_today_count, DIASPORA_today_count, 0) AS articles, cold_start FROM sides),
 both_view AS (SELECT *, CASE WHEN abs(domestic_z) > abs(international_z) THEN domestic_level ELSE international_level END AS both_level FROM view)"""


@query(f"{_VIEW} SELECT * FROM both_view")
def country_view(spark, sf):
    return views.country_view(_activity(spark, sf))


@query(
    f"{_VIEW} SELECT *, greatest(abs(domestic_z), abs(international_z)) AS score FROM both_view ORDER BY score DESC, articles DESC, country LIMIT 5"
)
def top_movers(spark, sf):
    return views.movers(views.country_view(_activity(spark, sf)))


@query(f"""WITH {d.ARTICLES_SQL} SELECT country, record_id, url, CASE WHEN audience_type = 'DIASPORA' THEN 'INTERNATIONAL' ELSE audience_type END AS audience_type, upper(split_part(domain, '.', 1)) AS outlet_name, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC, record_id) AS rank FROM articles) WHERE rank <= 20""")
def headlines(spark, sf):
    return views.headlines(d.articles(spark, sf), d.outlets_of_users(spark, sf)).select(
        "country", "record_id", "url", "audience_type", "outlet_name", "rank"
    )


@query(f"""{_ROLL} SELECT country, audience_type, period_type, period_start, theme, article_count, round(article_count / max(article_count) OVER (PARTITION BY country, audience_type, period_type, theme), 4) AS height,
 CASE WHEN avg_tone < -3 THEN 'hostile' WHEN avg_tone < -1 THEN 'negative' WHEN avg_tone <= 1 THEN 'neutral' ELSE 'positive' END AS bar FROM rolled""")
def theme_history(spark, sf):
    return views.theme_history(_rollup(spark, sf)).select(
        "country", "audience_type", "period_type", "period_start", "theme", "article_count", "height", "bar"
    )


@query(f"""{_ROLL}, k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY period_start DESC, article_count DESC, audience_type, period_type, theme) AS nth FROM rolled)
 SELECT country, audience_type, period_type, period_start, string_agg(theme, ',' ORDER BY article_count DESC, theme) AS themes FROM k WHERE nth <= 500 GROUP BY ALL""")
def country_period_themes(spark, sf):
    return views.period_themes(_rollup(spark, sf)).withColumn("themes", F.array_join("themes", ","))


@query(f"""{_ROLL}, p AS (SELECT country, period_type, period_start, audience_type, sum(article_count) AS m, max(bucket_total) AS a FROM rolled GROUP BY ALL)
 SELECT country, period_type, period_start, CAST(sum(m) AS BIGINT) AS mentions, CAST(sum(a) AS BIGINT) AS articles FROM p GROUP BY ALL""")
def period_totals(spark, sf):
    return views.period_totals(_rollup(spark, sf))


@query(
    f"{_ROLL} SELECT country, audience_type, period_type, period_start, theme, article_count FROM rolled WHERE contains(lower(theme), 'ur')"
)
def theme_search(spark, sf):
    return views.theme_search(_rollup(spark, sf), "UR").select(
        "country", "audience_type", "period_type", "period_start", "theme", "article_count"
    )


@query(f"{_ROLL} SELECT country, audience_type, count(*) AS rows, max(period_start) AS latest FROM rolled GROUP BY ALL")
def bucket_counts(spark, sf):
    return gates.bucket_counts(_rollup(spark, sf))


@query(
    f"WITH {d.ARTICLES_SQL} SELECT country, audience_type, day AS date, count(DISTINCT domain) AS outlets, 2 * count(*) AS mentions FROM articles GROUP BY ALL"
)
def transparency(spark, sf):
    return trends.transparency(d.articles(spark, sf))


@query(f"""{_ROLL}, x AS (SELECT *, row_number() OVER (PARTITION BY country, audience_type, period_type, period_start ORDER BY article_count DESC, theme) AS nth FROM rolled),
 s AS (SELECT country, audience_type, period_type, period_start, round(sum(share), 4) AS top_share, avg(avg_tone) AS tone FROM x WHERE nth <= 3 GROUP BY ALL)
 SELECT country, audience_type, period_type, period_start, top_share, CASE WHEN tone IS NULL THEN 'unknown' WHEN tone < -4 THEN 'hostile' WHEN tone < -1 THEN 'negative' WHEN tone <= 1 THEN 'neutral' WHEN tone <= 4 THEN 'positive' ELSE 'celebratory' END AS tone_class,
 CASE WHEN top_share > 0.45 THEN 'dominated' WHEN top_share > 0.3 THEN 'led' WHEN top_share > 0.15 THEN 'anchored' ELSE 'scattered' END AS lead FROM s""")
def narrative_classes(spark, sf):
    return views.narratives(_rollup(spark, sf)).drop("narrative")


@query(f"""{_ROLL} SELECT 'audience_type' AS rule, 0::BIGINT AS rows UNION ALL SELECT 'negative_count', count(*) FILTER (WHERE article_count < 0 OR bucket_total < 0) FROM rolled UNION ALL SELECT 'share', count(*) FILTER (WHERE share > 1 OR share < 0) FROM rolled
 UNION ALL SELECT 'date_format', 0 UNION ALL SELECT 'date_order', count(*) FILTER (WHERE period_end < period_start) FROM rolled UNION ALL SELECT 'excluded_country', count(*) FILTER (WHERE country = 'UK') FROM rolled
 UNION ALL SELECT 'alignment', count(*) FILTER (WHERE period_type = 'monthly' AND day(period_start) <> 1 OR period_type = 'weekly' AND isodow(period_start) <> 1) FROM rolled UNION ALL SELECT 'theme_size', count(*) FILTER (WHERE strlen(theme) > 256) FROM rolled""")
def theme_gates(spark, sf):
    return gates.violations(_rollup(spark, sf), gates.theme_rules())


@query(f"""{_ACT}, bad AS (SELECT *, CASE WHEN today_count % 5 = 0 THEN -1 ELSE today_count END AS t, CASE WHEN country = 'RU' THEN 'purple' ELSE level END AS l FROM act)
 SELECT 'today_count' AS rule, count(*) FILTER (WHERE t < 0) AS rows FROM bad UNION ALL SELECT 'level', count(*) FILTER (WHERE l = 'purple') FROM bad UNION ALL SELECT unnest(['baseline_mean', 'baseline_std', 'confidence', 'audience_type', 'cold_start', 'excluded_country']), 0""")
def activity_gates(spark, sf):
    bad = _activity(spark, sf).withColumn("level", F.when(F.col("country") == "RU", "purple").otherwise(F.col("level"))).withColumn(
        "today_count", F.when(F.col("today_count") % 5 == 0, -1).otherwise(F.col("today_count"))
    )
    return gates.violations(bad, gates.activity_rules())


@query(
    f"""{_ACT} SELECT count(*) AS rows, 0::BIGINT AS null_keys, 0::BIGINT AS bad_enums, (SELECT count(*) FROM (SELECT unnest({d._CODES}) AS c) WHERE c NOT IN (SELECT country FROM act)) AS missing_countries FROM act"""
)
def post_run_checks(spark, sf):
    expected = spark.range(1).select(F.explode(F.array(*map(F.lit, d.CODES))).alias("country"))
    return gates.run_checks(_activity(spark, sf), expected)


@query(f"""{_ACT}, e AS (SELECT DISTINCT date, country, audience_type FROM act WHERE today_count > 2 * baseline_mean UNION ALL SELECT DATE '2030-01-01', 'RU', 'DOMESTIC')
 SELECT date, country, audience_type, today_count, deviation_ratio, z_score, level FROM e LEFT JOIN act USING (date, country, audience_type)""")
def known_event_lookup(spark, sf):
    act = _activity(spark, sf)
    events = act.where("today_count > 2 * baseline_mean").select("date", "country", "audience_type").union(
        spark.sql("select date'2030-01-01', 'RU', 'DOMESTIC'")
    )
    return gates.known_events(act, events).select(
        "date", "country", "audience_type", "today_count", "deviation_ratio", "z_score", "level"
    )


@query("""WITH s AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS slice FROM events), w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:45:00', INTERVAL 15 MINUTE)) AS slice)
 SELECT strftime(slice, '%Y%m%d%H%M%S') || '.gkg.csv' AS file_name FROM w WHERE slice NOT IN (SELECT slice FROM s)""")
def missing_slices(spark, sf):
    from ..sources import gkg

    have = d.table(spark, sf, "events").select(
        F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900).alias("slice")
    ).distinct()
    return gkg.missing(
        gkg.slices(spark, "2024-01-01 00:00:00", "2024-01-31 23:45:00"), have, "slice"
    ).select("file_name")
