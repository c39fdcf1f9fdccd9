"""Paragraphs, digests, snapshots, searches and limits over the events, documents and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity, claims, gates, trends
from . import driver as d
from . import views
from .registry import query
from .theme_queries import _ACT, _EVENTS, _ROLL, _SPIKE, _TOP, _activity, _events, _rollup

_KEYS = "country, audience_type, period_type, period_start"


def _buckets(spark, sf):
    """Every bucket with an article, whether its themes are frequent enough to be listed or not."""
    spans = F.array(
        *[
            F.struct(F.lit(kind).alias("period_type"), start.cast("date").alias("period_start"))
            for kind,
            start in (
                ("monthly", F.trunc("date", "MM")), ("weekly", F.trunc("date", "WEEK")), ("daily", F.to_date("date"))
            )
        ]
    )
    return d.articles(spark, sf).select("country", "audience_type", F.inline(spans)).distinct()


@query(f"""{_ROLL}, b AS (SELECT DISTINCT {_KEYS} FROM p_articles),
 x AS (SELECT *, upper(theme[1]) || lower(theme[2:]) AS label, row_number() OVER (PARTITION BY {_KEYS} ORDER BY article_count DESC, theme) AS nth FROM rolled),
 s AS (SELECT {_KEYS}, count(*) AS n, round(sum(share) FILTER (WHERE nth <= 3), 4) AS top_share, avg(avg_tone) FILTER (WHERE nth <= 3) AS tone,
   list(label || ' ' || CAST(round(share * 100) AS INT) || '%' ORDER BY nth) FILTER (WHERE nth <= 3) AS names, list(label ORDER BY nth) FILTER (WHERE nth BETWEEN 4 AND 6) AS others FROM x GROUP BY ALL),
 c AS (SELECT *, CASE WHEN tone IS NULL THEN 'unknown' WHEN tone < -4 THEN 'hostile' WHEN tone < -1 THEN 'negative' WHEN tone <= 1 THEN 'neutral' WHEN tone <= 4 THEN 'positive' ELSE 'celebratory' END AS tone_class,
   CASE WHEN top_share > 0.45 THEN 'dominated' WHEN top_share > 0.3 THEN 'led' WHEN top_share > 0.15 THEN 'anchored' ELSE 'scattered' END AS lead FROM s)
 SELECT {_KEYS}, top_share, tone_class, lead, country || ' ' || lower(audience_type) || ', ' || strftime(period_start, '%Y-%m-%d') || ': ' || coalesce(n, 0) || ' themes.'
   || CASE WHEN n IS NULL THEN '' ELSE ' First ' || array_to_string(names, ', ') || '; together ' || CAST(round(top_share * 100) AS INT) || '% of articles (' || lead || '), tone ' || tone_class || '.'
   || CASE WHEN n > 3 THEN ' Then ' || array_to_string(others, ', ') || '.' ELSE '' END END AS narrative
 FROM b LEFT JOIN c USING ({_KEYS})""")  # fmt: skip
def narrative_paragraphs(spark, sf):
    return views.narratives(_rollup(spark, sf), _buckets(spark, sf))


@query(
    f"""{_ROLL} SELECT {_KEYS}, count(*) FILTER (WHERE contains(lower(theme), 'ur')) AS shown, count(*) FILTER (WHERE NOT contains(lower(theme), 'ur')) AS hidden FROM rolled GROUP BY ALL"""
)
def theme_search_hidden(spark, sf):
    return views.theme_search_hidden(_rollup(spark, sf), " UR ")


@query(f"""{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS}, c AS (SELECT date, CAST(sum(today_count) AS BIGINT) AS total_articles, count(DISTINCT country) AS active_countries,
   count(*) FILTER (WHERE level IN ('red', 'orange')) AS spikes, count(*) FILTER (WHERE level IN ('deepBlue', 'steelBlue')) AS silences,
   coalesce(array_to_string(list_sort(list(DISTINCT country) FILTER (WHERE level IN ('deepBlue', 'steelBlue'))), ','), '') AS silent_countries FROM act GROUP BY date),
 k AS (SELECT date, string_agg(country || '=' || n, ',' ORDER BY country) AS countries FROM (SELECT date, country, CAST(sum(today_count) AS BIGINT) AS n FROM act GROUP BY ALL) GROUP BY date),
 t AS (SELECT date, string_agg(theme || '=' || n, ',' ORDER BY theme) AS themes FROM (SELECT date, theme, CAST(sum(n) AS BIGINT) AS n FROM tops WHERE rank <= 10 GROUP BY ALL) GROUP BY date),
 e AS (SELECT date, string_agg(theme || ':' || array_to_string(names, '+') || ':' || format('{{:.3f}}', coordination_score), ',' ORDER BY theme) AS coordinations FROM found WHERE coordination_score >= 0.3 GROUP BY date)
 SELECT c.*, countries, themes, coalesce(coordinations, '') AS coordinations FROM c JOIN k USING (date) JOIN t USING (date) LEFT JOIN e USING (date)""")  # fmt: skip
def daily_snapshot(spark, sf):
    def flat(c: str):
        return F.array_join(
            F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ","
        ).alias(c)

    rows = trends.daily_snapshot(_activity(spark, sf), activity.top_themes(d.articles(spark, sf)), _events(spark, sf))
    said = F.transform(
        "coordinations",
        lambda x: F.concat_ws(
            ":", x["theme"], F.array_join(x["countries"], "+"), F.format_string("%.3f", x["coordination_score"])
        )
    )
    return rows.select(
        "date", "total_articles", "active_countries", "spikes", "silences",
        F.array_join("silent_countries", ",").alias("silent_countries"),
        flat("countries"), flat("themes"), F.coalesce(F.array_join(said, ","), F.lit("")).alias("coordinations"),
    )


# a bucket's day with a score of its own stands for a contradiction, as the events have no titles
_WEEK = "date BETWEEN DATE '2024-01-15' AND DATE '2024-01-21'"


@query(f"""{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS}, dt AS (SELECT date, theme, CAST(sum(n) AS BIGINT) AS n FROM tops WHERE rank <= 10 GROUP BY ALL),
 w AS (SELECT theme, CAST(sum(CASE WHEN {_WEEK} THEN n ELSE 0 END) AS BIGINT) AS this_week, CAST(sum(CASE WHEN date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN n ELSE 0 END) AS BIGINT) AS last_week FROM dt GROUP BY theme),
 p AS (SELECT country, audience_type, max(deviation_ratio) AS peak FROM act WHERE {_WEEK} AND deviation_ratio > 2 GROUP BY ALL ORDER BY peak DESC, country, audience_type LIMIT 10),
 q AS (SELECT date, country, audience_type FROM act WHERE {_WEEK} AND days_sampled >= 7 AND deviation_ratio < 0.2),
 x AS (SELECT date, country || '/' || audience_type AS cluster, country, round(today_count % 10 / 10.0, 1) AS score FROM act WHERE {_WEEK} AND today_count % 10 >= 4 ORDER BY score DESC, date, cluster, country LIMIT 10),
 f AS (SELECT date, theme, coordination_score FROM found WHERE {_WEEK} AND coordination_score >= 0.3 ORDER BY coordination_score DESC, date, theme LIMIT 5)
 SELECT DATE '2024-01-15' AS week_start, DATE '2024-01-21' AS week_end, (SELECT CAST(sum(today_count) AS BIGINT) FROM act WHERE {_WEEK}) AS total_articles,
   (SELECT count(DISTINCT country) FROM act WHERE {_WEEK} AND today_count > 0) AS countries_active,
   (SELECT string_agg(theme || '=' || this_week || '/' || last_week, ',' ORDER BY this_week DESC, theme) FROM (SELECT * FROM w WHERE this_week > 0 ORDER BY this_week DESC, theme LIMIT 20)) AS top_themes,
   (SELECT string_agg(country || '/' || audience_type || '=' || format('{{:.3f}}', peak), ',' ORDER BY peak DESC, country, audience_type) FROM p) AS spikes,
   (SELECT string_agg(cluster || '=' || format('{{:.1f}}', score), ',' ORDER BY score DESC, date, cluster) FROM x) AS contradictions, (SELECT count(*) FROM q) AS silences,
   (SELECT string_agg(theme || '=' || format('{{:.3f}}', coordination_score), ',' ORDER BY coordination_score DESC, date, theme) FROM f) AS coordinations""")  # fmt: skip
def weekly_report(spark, sf):
    act, tops = _activity(spark, sf), activity.top_themes(d.articles(spark, sf))
    daily = tops.groupBy("date", "theme").agg(F.sum("n").alias("n"))
    told = act.select(
        "date", F.concat_ws("/", "country", "audience_type").alias("cluster"), "country",
        (F.col("today_count") % 10 / 10).alias("score")
    )
    severity = F.when(F.col("deviation_ratio") == 0, "TOTAL").when(
        F.col("deviation_ratio") < 0.2, "SIGNIFICANT"
    ).otherwise("MINOR")
    quiet = act.where("days_sampled >= 7").select("date", "country", "audience_type", severity.alias("severity"))
    r = trends.weekly_report(daily, act, told, quiet, _events(spark, sf), "2024-01-15")

    def joined(c: str, f):
        said = F.array_join(F.transform(c, f), ",")
        return F.when(F.size(c) > 0, said).alias(c)

    return r.select(
        "week_start", "week_end", "total_articles", "countries_active",
        joined(
            "top_themes",
            lambda x: F.concat(
                x["theme"], F.lit("="), x["this_week"].cast("string"), F.lit("/"), x["last_week"].cast("string")
            )
        ),
        joined(
            "spikes",
            lambda x: F.concat(
                x["country"], F.lit("/"), x["audience_type"], F.format_string("=%.3f", x["peak_ratio"])
            )
        ),
        joined("contradictions", lambda x: F.concat(x["cluster"], F.format_string("=%.1f", x["score"]))),
        F.size("silences").cast("long").alias("silences"),
        joined("coordinations", lambda x: F.concat(x["theme"], F.format_string("=%.3f", x["coordination_score"]))),
    )


@query("""WITH p AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'ALL' ELSE 'DOMESTIC' END AS audience_type FROM pages)
 SELECT 'audience_type' AS rule, count(*) FILTER (WHERE audience_type = 'ALL') AS rows FROM p UNION ALL SELECT 'name_size', count(*) FILTER (WHERE strlen(html) > 1024) FROM p
 UNION ALL SELECT 'notes_size', count(*) FILTER (WHERE strlen(html) > 4096) FROM p UNION ALL SELECT 'domain_size', count(*) FILTER (WHERE url IS NULL OR strlen(url) > 253) FROM p""")
def outlet_gates(spark, sf):
    kind = F.when(F.col("page_id") % 7 == 0, "ALL").otherwise("DOMESTIC")
    rows = d.table(spark, sf, "pages").select(
        kind.alias("audience_type"), F.col("html").alias("outlet_name"), F.col("html").alias("notes"),
        F.col("url").alias("domain")
    )
    return gates.violations(rows, gates.outlet_rules())


@query("""SELECT 'audience_type' AS rule, count(*) AS rows FROM documents WHERE source IS NULL OR source NOT IN ('DOMESTIC', 'INTERNATIONAL', 'DIASPORA') UNION ALL
 SELECT 'title_size', count(*) FILTER (WHERE strlen(text) > 65536) FROM documents UNION ALL SELECT 'url_size', count(*) FILTER (WHERE text IS NULL OR strlen(text) > 8192) FROM documents""")
def article_gates(spark, sf):
    rows = d.table(spark, sf, "documents").select(
        F.col("source").alias("audience_type"), F.col("text").alias("title"), F.col("text").alias("url")
    )
    return gates.violations(rows, gates.article_rules())


@query(f"""{_ROLL}, bad AS (SELECT *, CASE WHEN period_type = 'daily' AND article_count % 2 = 0 THEN period_end + 1 ELSE period_end END AS pe FROM rolled)
 SELECT 'one_day' AS rule, count(*) FILTER (WHERE period_type = 'daily' AND pe <> period_start) AS rows FROM bad UNION ALL SELECT unnest(['audience_type', 'negative_count', 'share', 'date_format', 'date_order', 'excluded_country', 'alignment', 'theme_size']), 0""")
def daily_theme_gates(spark, sf):
    late = (F.col("period_type") == "daily") & (F.col("article_count") % 2 == 0)
    rows = _rollup(spark, sf).withColumn(
        "period_end", F.when(late, F.date_add("period_end", 1)).otherwise(F.col("period_end"))
    )
    return gates.violations(rows, gates.daily_theme_rules())


@query(f"""{_ACT}, {_TOP}, {_SPIKE}, {_EVENTS} SELECT date, theme, array_to_string(names, ',') AS countries FROM found
 WHERE coordination_score >= 0.3 AND (date IN (DATE '2024-01-01', DATE '2024-01-26') OR len(names) < 3 OR coordination_score < 0.6) AND date NOT IN (DATE '2024-01-01', DATE '2024-01-26')""")
def published_claims(spark, sf):
    rows = claims.published(claims.coordination_verdicts(_events(spark, sf)))
    return rows.select("date", "theme", F.array_join("countries", ",").alias("countries"))


