"""The library's inputs as derived from the driver's tables, in Spark and in SQL, by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: a country for each user number modulo 25; the last one is excluded from monitoring.
CODES = [
    "RU", "CN", "IR", "VE", "CU", "BY", "TR", "EG", "SA", "QA", "AE", "SY", "KP", "VN", "UZ", "KZ", "IN", "BR", "ZA",
    "RS", "DE", "FR", "ES", "JP", "UK"
]
AUDIENCES = ["DOMESTIC", "INTERNATIONAL", "DIASPORA"]
_CODES = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"

ARTICLES_SQL = f"""
raw AS (
  SELECT event_id AS record_id, ts AS date, CAST(ts AS DATE) AS day, 'u' || user_id || '.example.com' AS domain,
         'https://u' || user_id || '.example.com/' || (event_id % 997) AS url, {_CODES}[CAST(user_id % 25 AS INT) + 1] AS country,
         ['DOMESTIC', 'INTERNATIONAL', 'DIASPORA'][CAST(user_id % 3 AS INT) + 1] AS audience_type,
         event_type AS t1, 'K' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS t2, (value - 50) / 50 AS tone
  FROM events),
articles AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY date, record_id) AS nth FROM raw) WHERE nth = 1 AND country NOT IN ('US','GB','UK','CA','AU','NZ')),
mentions AS (SELECT country, audience_type, day, record_id, tone, unnest([t1, t2]) AS theme FROM articles)"""

VOLUMES_SQL = """
volumes AS (
  SELECT r_name AS country, ['DOMESTIC', 'INTERNATIONAL', 'DIASPORA'][CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END] AS audience_type,
         'c' || (o_custkey % 50) || '.example.com' AS domain, CAST(o_orderdate AS DATE) AS date
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
daily AS (SELECT country, audience_type, date, count(*) AS today_count FROM volumes GROUP BY ALL),
filled AS (
  SELECT b.country, b.audience_type, d.date, coalesce(v.today_count, 0) AS today_count
  FROM (SELECT DISTINCT country, audience_type FROM daily) b
  CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date) d
  LEFT JOIN daily v ON v.country = b.country AND v.audience_type = b.audience_type AND v.date = d.date)"""


def baseline_sql(source: str, name: str, keys: str = "country, audience_type", date: str = "date") -> str:
    w = f"(PARTITION BY {keys} ORDER BY {date} RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    return f"""
{name} AS (
  SELECT *, round(coalesce(avg(today_count) OVER {w}, 0), 2) AS baseline_mean, round(coalesce(stddev_pop(today_count) OVER {w}, 0), 2) AS baseline_std,
         coalesce(min(today_count) OVER {w}, 0) AS min_count, coalesce(max(today_count) OVER {w}, 0) AS max_count, count(today_count) OVER {w} AS days_sampled
  FROM {source})"""


def deviation_sql(source: str, name: str) -> str:
    return f"""
{name}_raw AS (
  SELECT *, CASE WHEN days_sampled < 7 THEN 1.0 WHEN baseline_mean = 0 THEN today_count WHEN baseline_std = 0 AND today_count = baseline_mean THEN 1.0 ELSE today_count / baseline_mean END AS ratio,
    CASE WHEN days_sampled < 7 OR (baseline_mean = 0 AND today_count = 0) THEN 0.0 WHEN baseline_mean = 0 THEN 10.0 WHEN baseline_std = 0 THEN CASE WHEN today_count = baseline_mean THEN 0.0 WHEN today_count > baseline_mean THEN 10.0 ELSE -10.0 END
         ELSE (today_count - baseline_mean) / baseline_std END AS z
  FROM {source}),
{name} AS (
  SELECT * EXCLUDE (ratio, z), round(ratio, 3) AS deviation_ratio, round(z, 3) AS z_score,
    CASE WHEN days_sampled < 7 OR (baseline_mean = 0 AND today_count = 0) THEN 'neutral' WHEN baseline_mean = 0 THEN 'red'
         WHEN baseline_std = 0 THEN CASE WHEN today_count = baseline_mean THEN 'neutral' WHEN today_count > baseline_mean THEN 'red' ELSE 'deepBlue' END
         WHEN z >= 2.5 THEN 'red' WHEN ratio <= 4 AND z >= 2 THEN 'orange' WHEN ratio <= 2.5 AND z >= 1.5 THEN 'amber' WHEN ratio < 0.3 AND z < -2 THEN 'deepBlue' WHEN ratio < 0.5 AND z < -1.5 THEN 'steelBlue'
         WHEN ratio < 0.75 THEN 'coolGray' ELSE 'neutral' END AS level,
    CASE WHEN days_sampled >= 21 THEN 'HIGH' WHEN days_sampled >= 7 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, days_sampled < 21 AS cold_start
  FROM {name}_raw)"""


def rollup_sql(kinds: list[str]) -> str:
    start = {
        "monthly": "CAST(date_trunc('month', day) AS DATE)", "weekly": "CAST(date_trunc('week', day) AS DATE)",
        "daily": "day"
    }
    end = {
        "monthly": "last_day(day)", "weekly": "CAST(date_trunc('week', day) + INTERVAL 6 DAY AS DATE)", "daily": "day"
    }
    spread = lambda t: " UNION ALL ".join(
        f"SELECT *, '{k}' AS period_type, {start[k]} AS period_start, {end[k]} AS period_end FROM {t}" for k in kinds
    )
    keys = "country, audience_type, period_type, period_start, period_end"
    return f"""
p_mentions AS ({spread('mentions')}),
p_articles AS ({spread('articles')}),
totals AS (SELECT {keys}, count(*) AS bucket_total FROM p_articles GROUP BY ALL),
counted AS (SELECT {keys}, theme, count(*) AS article_count, sum(tone) / count(tone) AS avg_tone FROM p_mentions GROUP BY ALL HAVING count(*) >= 2),
rolled AS (
  SELECT {keys}, theme, article_count, bucket_total, round(article_count / bucket_total, 4) AS share, avg_tone, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY article_count DESC, theme) AS rank FROM counted) JOIN totals USING ({keys}) WHERE rank <= 50)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles(record_id, date, domain, url, country, audience_type, themes, tone) of the events, repeats included."""
    host = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example.com"))
    k = (F.get_json_object("props", "$.k").cast("int") % 10).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), F.col("ts").cast("timestamp").alias("date"), host.alias("domain"),
        F.concat(F.lit("https://"), host, F.lit("/"), (F.col("event_id") % 997).cast("string")).alias("url"),
        pick(CODES, F.col("user_id") % 25).alias("country"),
        pick(AUDIENCES, F.col("user_id") % 3).alias("audience_type"),
        F.array("event_type", F.concat(F.lit("K"), k)).alias("themes"), ((F.col("value") - 50) / 50).alias("tone"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each (domain, url), excluded countries left out."""
    from ..operators.gates import excluded
    from ..operators.rollup import dedup

    return dedup(raw_articles(spark, sf_dir).where(~excluded()))


def outlets_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_articles(spark, sf_dir).select("domain", "country", "audience_type").distinct()
    return rows.withColumn("outlet_name", F.upper(F.regexp_extract("domain", "^[^.]+", 0)))


def volume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is one article of a customer group's outlet; its bucket is region and order status."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    place = c.join(
        F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("country"))
    status = F.when(F.col("o_orderstatus") == "F", "DOMESTIC").when(
        F.col("o_orderstatus") == "O", "INTERNATIONAL"
    ).otherwise("DIASPORA")
    return o.join(place, F.col("o_custkey") == F.col("c_custkey")).select(
        "country", status.alias("audience_type"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example.com")).alias("domain"),
        F.col("o_orderdate").cast("timestamp").alias("date")
    )


def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.activity import daily_counts

    return daily_counts(volume_rows(spark, sf_dir))
