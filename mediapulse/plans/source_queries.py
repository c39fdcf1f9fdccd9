"""Sources, sinks, dimensions and small views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import gates, resolve
from ..sources import articles as article_lists
from ..sources import dims, gkg, sinks
from . import driver as d
from . import views
from .registry import query
from .theme_queries import _ACT, _ROLL, _activity, _rollup


@query("""WITH o AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'c' || (c_custkey % 400) || '.example.com' END AS domain, ['RU','CN','US','IR'][CAST(c_nationkey % 4 AS INT) + 1] AS country,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'DOMESTIC' WHEN 'MACHINERY' THEN 'INTERNATIONAL' WHEN 'HOUSEHOLD' THEN 'OTHER' ELSE 'DIASPORA' END AS audience_type, c_name AS outlet_name FROM customer)
 SELECT domain, country, audience_type, outlet_name, 1.0 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY position DESC) AS nth FROM o WHERE domain IS NOT NULL AND audience_type <> 'OTHER' AND country <> 'US') WHERE nth = 1""")
def outlet_dimension(spark, sf):
    c = d.table(spark, sf, "customer")
    domain = F.when(
        F.col("c_custkey") % 9 != 0,
        F.concat(F.lit("https://WWW.C"), (F.col("c_custkey") % 400).cast("string"), F.lit(".example.com/"))
    )
    audience = F.when(F.col("c_mktsegment") == "BUILDING", "domestic").when(
        F.col("c_mktsegment") == "MACHINERY", "International"
    ).when(F.col("c_mktsegment") == "HOUSEHOLD", "OTHER").otherwise("DIASPORA")
    none = lambda kind: F.lit(None).cast(kind)
    rows = c.select(
        F.col("c_custkey").alias("position"), domain.alias("domain"),
        F.lower(d.pick(["RU", "CN", "US", "IR"], F.col("c_nationkey") % 4)).alias("country"),
        audience.alias("audience_type"), F.col("c_name").alias("outlet_name"), none("string").alias("outlet_type"),
        none("array<string>").alias("languages"), none("boolean").alias("is_state_owned"),
        none("boolean").alias("is_state_aligned"), none("double").alias("confidence"),
    )
    return dims.clean_outlets(rows).select("domain", "country", "audience_type", "outlet_name", "confidence")


@query(
    """SELECT 'c' || (o_custkey % 50) AS domain, CAST(o_orderdate AS DATE) AS date, CAST(trunc(o_totalprice / 1000) AS BIGINT) AS volume FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"""
)
def landed_volumes(spark, sf):
    o = d.table(spark, sf, "orders")
    day = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    volume = F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise((F.col("o_totalprice") / 1000).cast("string"))
    rows = o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("domain"), day.alias("datetime"),
        volume.alias("Volume Raw"), F.lit("9").alias("All Articles")
    )
    return article_lists.volume_rows(rows)


_FALL = """rows AS (SELECT o_orderkey, 'u' || (o_orderkey % 3000) AS url, 'N' || (o_custkey % 40) AS query_country, CASE WHEN o_orderstatus = 'F' AND o_custkey % 40 < 30 THEN 'primary' ELSE 'fallback' END AS source_kind, o_orderdate AS pub_date FROM orders),
 n AS (SELECT query_country, count(*) AS n FROM rows WHERE source_kind = 'primary' GROUP BY 1), k AS (SELECT rows.*, row_number() OVER (PARTITION BY rows.query_country, url ORDER BY source_kind DESC, pub_date, o_orderkey) AS nth
 FROM rows LEFT JOIN n USING (query_country) WHERE source_kind = 'primary' OR query_country IN ('N35', 'N36', 'N1', 'N2') AND coalesce(n, 0) < 3)"""


@query(f"WITH {_FALL} SELECT query_country, url, source_kind, o_orderkey AS title FROM k WHERE nth = 1")
def fallback_rows(spark, sf):
    o = d.table(spark, sf, "orders")
    kind = F.when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 40 < 30), "primary").otherwise("fallback")
    rows = o.select(
        F.col("o_orderkey").alias("title"),
        F.concat(F.lit("u"), (F.col("o_orderkey") % 3000).cast("string")).alias("url"),
        F.concat(F.lit("N"), (F.col("o_custkey") % 40).cast("string")).alias("query_country"),
        kind.alias("source_kind"), F.col("o_orderdate").alias("pub_date")
    )
    return article_lists.with_fallback(rows, ["N35", "N36", "N1", "N2"]).select(
        "query_country", "url", "source_kind", "title"
    )


@query(
    """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'RU' WHEN 1 THEN 'RS' WHEN 2 THEN 'DE' ELSE 'QQ' END AS source_country FROM customer"""
)
def country_codes(spark, sf):
    # RS is a country of its own although it is also the FIPS code of RU; GM is only a FIPS code
    countries = spark.createDataFrame([("RU", "RS"), ("RS", "RI"), ("DE", "GM")], "iso2 string, fips string")
    rows = d.table(spark, sf, "customer").select(
        "c_custkey", d.pick(["RU", "RS", "GM", "QQ"], F.col("c_nationkey") % 4).alias("source_country")
    )
    return article_lists.with_iso_country(rows, countries)


@query(
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Label ' || p_size ELSE 'Size Of ' || upper(p_type[1]) || lower(p_type[2:]) END AS label FROM part"
)
def theme_labels(spark, sf):
    rows = d.table(spark, sf, "part").select(
        "p_partkey", "p_size", F.concat(F.lit("SIZE_OF_"), "p_type").alias("theme")
    )
    labels = rows.where("p_size % 2 = 0").select(
        "p_size", F.concat(F.lit("Label "), F.col("p_size").cast("string")).alias("known")
    ).distinct()
    return rows.join(F.broadcast(labels), "p_size", "left").select(
        "p_partkey", text.theme_label(F.col("theme"), F.col("known")).alias("label")
    )


@query(
    """SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'big,small' ELSE 'z,a' END AS themes, CASE c_custkey % 3 WHEN 0 THEN 'x.com=3' ELSE NULL END AS outlets FROM customer"""
)
def json_top_lists(spark, sf):
    c = d.table(spark, sf, "customer")
    themes = F.when(F.col("c_custkey") % 2 == 0, '{"small": 1, "tiny": 0, "big": 7}').otherwise(
        '[{"theme": "z", "count": 1}, {"theme": "a", "count": 5}, {"theme": "b", "count": 2}]'
    )
    outlets = F.when(F.col("c_custkey") % 3 == 0, '[{"domain": "x.com", "count": 3}]')
    listed = F.transform(text.json_outlets(outlets), lambda x: F.concat_ws("=", x["domain"], x["count"].cast("string")))
    return c.select(
        "c_custkey", F.array_join(F.transform(text.json_themes(themes, 2), lambda x: x["key"]), ",").alias("themes"),
        F.array_join(listed, ",").alias("outlets")
    )


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'n_1') ORDER BY n_name LIMIT 50")
def country_search(spark, sf):
    rows = d.table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_name").alias("name"), F.col("n_name").alias("iso2")
    )
    return views.country_search(rows, "N_1").select("n_nationkey", F.col("name").alias("n_name"))


@query(
    "SELECT n_nationkey, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')"
)
def region_filter(spark, sf):
    rows = d.table(spark, sf, "nation").join(
        F.broadcast(d.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("region"))
    return views.in_regions(rows, ["ASIA", "EUROPE"])


@query("""WITH s AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS slice FROM events), e AS (SELECT max(slice) AS now FROM s)
 SELECT strftime(slice, '%Y%m%d%H%M%S') || '.gkg.csv' AS file_name, slice IN (SELECT slice FROM s) AS present FROM (SELECT unnest(generate_series(now - INTERVAL 75 MINUTE, now - INTERVAL 7 MINUTE, INTERVAL 15 MINUTE)) AS slice FROM e)""")
def lookback_slices(spark, sf):
    have = d.table(spark, sf, "events").select(
        F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900).alias("slice")
    ).distinct()
    now = have.agg(F.date_format(F.max("slice"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return gkg.slices_in_lookback(spark, now).join(have.withColumn("here", F.lit(True)), "slice", "left").select(
        "file_name", F.coalesce("here", F.lit(False)).alias("present")
    )


@query(
    """SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 11 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0)) AS rows, count(*) FILTER (WHERE event_id % 11 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0)) AS articles, 1::BIGINT AS files, 0::BIGINT AS skipped FROM events"""
)
def file_counters(spark, sf):
    from .text_queries import gkg_lines

    raw = gkg_lines(spark, sf).select(F.lit("one").alias("path"), "value", F.lit(False).alias("skipped"))
    return gkg.file_counters(raw, gkg.parse_lines(raw))


@query(f"{_ACT} SELECT count(*) AS rows, count(*) <= 200000 AS passed FROM act")
def activity_volume_gate(spark, sf):
    return gates.volume_gate(_activity(spark, sf), gates.MAX_ACTIVITY_ROWS)


@query(f"{_ROLL} SELECT count(*) FILTER (WHERE period_start > DATE '2024-01-20') AS forward_dated FROM rolled")
def forward_dated_periods(spark, sf):
    return gates.forward_dated(_rollup(spark, sf), "2024-01-20")


@query(f"""{_ACT.replace("WITH ", "WITH ", 1)} SELECT domain, expected, found, coalesce(expected = found, false) AS passed FROM (SELECT * FROM (VALUES ('u1.example.com', 'INTERNATIONAL'), ('u2.example.com', 'DOMESTIC'), ('none.example.com', 'DOMESTIC')) v(domain, expected))
 LEFT JOIN (SELECT DISTINCT domain, audience_type AS found FROM raw) USING (domain)""")
def outlet_spot_checks(spark, sf):
    spots = spark.createDataFrame(
        [("u1.example.com", "INTERNATIONAL"), ("u2.example.com", "DOMESTIC"), ("none.example.com", "DOMESTIC")],
        "domain string, audience_type string"
    )
    return gates.outlet_checks(d.outlets_of_users(spark, sf), spots)


@query(
    f"{_ACT} SELECT country, audience_type, date, today_count, level FROM act WHERE date = (SELECT max(date) FROM act)"
)
def latest_activity(spark, sf):
    return views.latest(_activity(spark, sf)).select("country", "audience_type", "date", "today_count", "level")


@query(
    f"{_ACT} SELECT country, audience_type, date, today_count FROM act WHERE country = 'RU' AND audience_type = 'DOMESTIC' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15'"
)
def bucket_day_window(spark, sf):
    rows = _activity(spark, sf).where(
        "country = 'RU' and audience_type = 'DOMESTIC' and date between '2024-01-05' and '2024-01-15'"
    )
    return rows.select("country", "audience_type", "date", "today_count")


@query(f"""{_ROLL}, n AS (SELECT * FROM rolled WHERE period_start >= DATE '2024-01-15' AND article_count > 3), o AS (SELECT * FROM rolled WHERE period_start < DATE '2024-01-22')
 SELECT country, audience_type, period_type, period_start, theme, article_count FROM n UNION ALL SELECT country, audience_type, period_type, period_start, theme, article_count FROM o WHERE (period_type, period_start) NOT IN (SELECT (period_type, period_start) FROM n)""")
def recomputed_periods(spark, sf):
    rows = _rollup(spark, sf).select(
        "country", "audience_type", "period_type", "period_start", "theme", "article_count"
    )
    return sinks.replaced_periods(
        rows.where("period_start < '2024-01-22'"), rows.where("period_start >= '2024-01-15' and article_count > 3")
    )


@query(
    """SELECT round(avg((event_type = 'purchase')::INT), 6) AS hit_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events"""
)
def hit_rate_and_quantiles(spark, sf):
    found = resolve.hit_rate(
        d.table(spark, sf, "events"), F.col("event_type") == "purchase", "value", {"p50": 0.5, "p95": 0.95}
    )
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])
