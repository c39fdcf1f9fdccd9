"""Reports of imports and runs, gates inside a write, and quantiles merged from daily sketches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import claims, gates, resolve
from ..operators.graph import scratch_path
from ..sources import sinks
from . import driver as d
from .registry import query
from .theme_queries import _ACT, _ROLL, _activity, _rollup

_OUT = f"""WITH {d.ARTICLES_SQL}, outlets AS (SELECT DISTINCT domain, country, audience_type FROM raw)"""
_KINDS = ", ".join(f"count_if(audience_type = '{a}') AS n_{a.lower()}" for a in fixed.AUDIENCES)


@query(f"{_ACT} SELECT country, count(*) AS rows FROM act GROUP BY country ORDER BY rows DESC, country LIMIT 10")
def activity_top_countries(spark, sf):
    return gates.top_by_rows(_activity(spark, sf), "country")


@query(f"{_ROLL} SELECT theme, count(*) AS rows FROM rolled GROUP BY theme ORDER BY rows DESC, theme LIMIT 10")
def theme_top_rows(spark, sf):
    return gates.top_by_rows(_rollup(spark, sf), "theme")


@query(
    f"WITH {d.ARTICLES_SQL} SELECT country, audience_type, count(*) AS articles FROM articles WHERE day BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY ALL"
)
def recent_article_counts(spark, sf):
    return gates.recent_counts(d.articles(spark, sf), dt.date(2024, 1, 20))


@query(f"""{_OUT} SELECT count(*) AS rows, count_if(country IN ('US','GB','UK','CA','AU','NZ')) AS excluded, {_KINDS} FROM outlets""")
def outlet_report(spark, sf):
    return gates.outlet_report(d.outlets_of_users(spark, sf))


@query(f"{_OUT} SELECT audience_type, count(*) AS outlets FROM outlets GROUP BY audience_type")
def outlets_per_audience(spark, sf):
    return resolve.outlets_per_audience(d.outlets_of_users(spark, sf))


@query(f"""WITH {d.VOLUMES_SQL}, o AS (SELECT DISTINCT 'c' || (c_custkey % 60) || '.example.com' AS domain FROM customer),
 v AS (SELECT domain, date, count(*) AS volume FROM volumes GROUP BY ALL), k AS (SELECT o.domain, v.domain IS NOT NULL AS has FROM o LEFT JOIN (SELECT DISTINCT domain FROM v) v ON v.domain = o.domain)
 SELECT count_if(domain >= 'c2') AS queried, count_if(domain >= 'c2' AND has) AS with_data, count_if(domain >= 'c2' AND NOT has) AS empty, count_if(domain < 'c2') AS skipped,
   (SELECT count(DISTINCT date) FROM v WHERE domain >= 'c2' AND domain IN (SELECT domain FROM o)) AS days, (SELECT count(*) FROM v WHERE domain >= 'c2' AND domain IN (SELECT domain FROM o)) AS rows FROM k""")
def source_run(spark, sf):
    number = (F.col("c_custkey") % 60).cast("string")
    outlets = d.table(spark, sf, "customer").select(F.concat(F.lit("c"), number, F.lit(".example.com")).alias("domain"))
    volumes = d.volume_rows(spark, sf).groupBy("domain", F.to_date("date").alias("date")).agg(F.count("*").alias("volume"))
    return gates.source_run(outlets, volumes, "c2")


@query(f"""{_ACT}, a AS (SELECT * FROM articles WHERE day = DATE '2024-01-15'), r AS (SELECT * FROM act WHERE date = DATE '2024-01-15'),
 last AS (SELECT CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 1 ELSE 0 END AS ok FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
 SELECT check_name, found, passed FROM (
  SELECT 'articles' AS check_name, (SELECT count(*) FROM a) AS found, (SELECT count(*) FROM a) > 0 AS passed
  UNION ALL SELECT 'null_countries', 0, true UNION ALL SELECT 'null_audiences', 0, true UNION ALL SELECT 'bad_audiences', 0, true
  UNION ALL SELECT 'activity_rows', (SELECT count(*) FROM r), (SELECT count(*) FROM r) > 0 UNION ALL SELECT 'bad_levels', 0, true
  UNION ALL SELECT 'missing_countries', n, n = 0 FROM (SELECT count(*) AS n FROM (SELECT unnest({d._CODES}) AS c) WHERE c NOT IN (SELECT country FROM r))
  UNION ALL SELECT 'deviation_claims', (SELECT count(*) FROM r), (SELECT count(*) FROM r) > 0
  UNION ALL SELECT 'coordination_claims', 0, true UNION ALL SELECT 'latest_run', ok, ok > 0 FROM last)""")
def run_report(spark, sf):
    """One day's report: a deviation claim for each activity row, the events as runs whose latest one counts."""
    act = _activity(spark, sf)
    found = claims.deviation_verdicts(act).select("date", F.lit("DEVIATION").alias("claim_type"))
    runs = d.table(spark, sf, "events").select(
        F.struct("ts", "event_id").alias("started_at"),
        F.when(F.col("event_type").isin("purchase", "view"), "SUCCESS").otherwise("FAILED").alias("outcome")
    )
    expected = spark.createDataFrame([(c,) for c in d.CODES], "country string")
    return gates.run_report(d.articles(spark, sf), act, found, runs, expected, dt.date(2024, 1, 15))


@query(f"""{_ROLL} SELECT 'rolled' AS source, 'a' AS first, 'b' AS second, TIMESTAMP '2026-04-09 12:00:00' AS imported_at, count(*) AS rows, 'country_theme' AS target FROM rolled""")
def import_manifest(spark, sf):
    """The manifest of an import, written as JSON and read again."""
    folder = scratch_path(spark, "manifest")
    about = gates.manifest(
        _rollup(spark, sf), "rolled", {"first": "a", "second": "b"}, "country_theme", dt.datetime(2026, 4, 9, 12)
    )
    sinks.write_manifest(about, folder)
    back = spark.read.schema(about.schema).json(folder)
    return back.select(
        "source", F.col("metadata")["first"].alias("first"), F.col("metadata")["second"].alias("second"),
        F.col("imported_at").cast("timestamp_ntz").alias("imported_at"), "rows", "target"
    )


@query(f"{_ROLL} SELECT count(*) AS rows, count(*) <= 5000000 AS passed FROM rolled")
def theme_volume_gate(spark, sf):
    return gates.volume_gate(_rollup(spark, sf), gates.MAX_THEME_ROWS)


_DAMAGED = f"""{_ROLL}, bad AS (SELECT * REPLACE (CASE WHEN article_count % 5 = 0 THEN 'OTHER' ELSE audience_type END AS audience_type,
   CASE WHEN bucket_total % 4 = 0 THEN share + 1 ELSE share END AS share, CASE WHEN country = 'RU' THEN 'us' ELSE country END AS country) FROM rolled),
 k AS (SELECT audience_type = 'OTHER' AS audience, share NOT BETWEEN 0 AND 1 AS outside, country = 'us' AS excluded FROM bad)"""


@query(f"""{_DAMAGED} SELECT unnest(['rows', 'quarantined', 'good', 'audience_type', 'negative_count', 'share', 'date_format', 'date_order', 'excluded_country', 'alignment', 'theme_size']) AS rule,
   unnest([count(*), count_if(audience OR outside OR excluded), count_if(NOT (audience OR outside OR excluded)), count_if(audience), 0, count_if(outside), 0, 0, count_if(excluded), 0, 0]) AS rows FROM k""")
def gated_write(spark, sf):
    """Damaged theme rows through the writing gate: its counts, and the rows that it lets pass."""
    rows = _rollup(spark, sf).withColumns(
        {
            "audience_type": F.when(F.col("article_count") % 5 == 0, "OTHER").otherwise(F.col("audience_type")),
            "share": F.when(F.col("bucket_total") % 4 == 0, F.col("share") + 1).otherwise(F.col("share")),
            "country": F.when(F.col("country") == "RU", "us").otherwise(F.col("country")),
        }
    )
    folder = scratch_path(spark, "gated")
    counts = gates.write_gated(rows, gates.theme_rules(), folder)
    counts["good"] = spark.read.parquet(folder).where("not quarantined").count()
    return spark.createDataFrame(list(counts.items()), "rule string, rows long")


@query("""WITH q AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, value FROM events)
 SELECT week, count(*) AS n, level, true AS within FROM q, (SELECT unnest([0.05, 0.5, 0.95]) AS level) GROUP BY week, level""")
def merged_quantiles(spark, sf):
    """Daily sketches merged to weeks: whether each quantile's rank is off by less than 3 % of the week's rows."""
    e = d.table(spark, sf, "events").select("value", F.to_date("ts").alias("day"))
    week = F.date_trunc("week", "day").cast("date").alias("week")
    kept = resolve.sketches(e, ["day"], "value").withColumn("week", week)
    found = resolve.merged_quantiles(kept, ["week"], [0.05, 0.5, 0.95]).alias("f")
    below = e.select("value", week).join(found, "week").groupBy("week", "level", "n").agg(
        F.avg((F.col("value") < F.col("quantile")).cast("int")).alias("low"),
        F.avg((F.col("value") <= F.col("quantile")).cast("int")).alias("high"),
    )
    near = (F.col("low") <= F.col("level") + 0.03) & (F.col("high") >= F.col("level") - 0.03)
    return below.select("week", "n", "level", near.alias("within"))
