"""Hosts, outlets, languages, theme lines and event clusters over pages, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import classify, claims, gates, resolve
from ..sources import articles as article_lists
from ..sources import gkg
from . import driver as d
from .registry import query

_HOST = """hosts AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*?://', ''), '^[^/@]*@', ''), '[/?#].*$', ''), ':.*$', ''), '^\\.+|\\.+$', '', 'g'), '^www\\.', '') AS host FROM pages)"""
# registered: the last three labels of hosts whose smallest page is even
_OUTLETS = """parts AS (SELECT page_id, host, string_split(host, '.') AS p FROM hosts), bases AS (SELECT array_to_string(p[-3:], '.') AS domain, min(page_id) AS first FROM parts GROUP BY 1),
outlets AS (SELECT domain, ['RU','CN','IR','VE','CU'][CAST(first % 5 AS INT) + 1] AS country, ['DOMESTIC', 'INTERNATIONAL', 'DIASPORA'][CAST(first % 3 AS INT) + 1] AS audience_type FROM bases WHERE first % 2 = 0)"""


def _pages(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", "url", text.host(F.col("url")).alias("host"))


def _outlets(spark, sf):
    base = F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".")
    rows = _pages(spark, sf).where("host <> ''").withColumn(
        "domain", F.when(F.size(F.split("host", r"\.")) >= 3, base).otherwise(F.col("host"))
    ).groupBy("domain").agg(F.min("page_id").alias("first"))
    return rows.where("first % 2 = 0").select(
        "domain", d.pick(["RU", "CN", "IR", "VE", "CU"], F.col("first") % 5).alias("country"),
        d.pick(d.AUDIENCES, F.col("first") % 3).alias("audience_type")
    )


@query(f"WITH {_HOST} SELECT page_id, host FROM hosts")
def host_names(spark, sf):
    return _pages(spark, sf).select("page_id", "host")


@query(
    f"WITH {_HOST}, s AS (SELECT page_id, string_split(host, '.') AS p FROM hosts) SELECT page_id, i - 1 AS place, array_to_string(p[i:], '.') AS domain FROM s, range(1, 8) t(i) WHERE i <= len(p) - 1"
)
def parent_domains(spark, sf):
    return _pages(spark, sf).select(
        "page_id", F.posexplode(text.parents(F.col("host"))).alias("place", "domain")
    ).withColumn("place", F.col("place").cast("long"))


@query(
    f"WITH {_HOST}, {_OUTLETS} SELECT page_id, domain, country, audience_type FROM parts JOIN outlets ON domain = array_to_string(p[-3:], '.')"
)
def outlet_resolution(spark, sf):
    return resolve.with_outlet(_pages(spark, sf).select("page_id", "url"), _outlets(spark, sf), "url").select(
        "page_id", "domain", "country", "audience_type"
    )


@query(f"WITH {_HOST}, {_OUTLETS} SELECT country, count(*) AS outlets FROM outlets GROUP BY country")
def outlet_coverage(spark, sf):
    return resolve.outlet_coverage(_outlets(spark, sf))


@query(
    f"WITH {_HOST}, {_OUTLETS} SELECT country, 3 AS floor, coalesce(n, 0) AS outlets, coalesce(n, 0) >= 3 AS covered FROM (SELECT unnest(['RU','CN','IR','KP']) AS country) LEFT JOIN (SELECT country, count(*) AS n FROM outlets GROUP BY 1) USING (country)"
)
def outlet_floors(spark, sf):
    floors = spark.createDataFrame([(c, 3) for c in ("RU", "CN", "IR", "KP")], "country string, floor int")
    return resolve.outlet_coverage(_outlets(spark, sf), floors)


@query(f"""WITH {_HOST}, {_OUTLETS} SELECT domain, country, audience_type FROM outlets WHERE domain >= 'thi'""")
def resume_outlets(spark, sf):
    return resolve.from_domain(_outlets(spark, sf), "thi")[0]


@query(f"""WITH {_HOST}, h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN host WHEN 1 THEN 'm.vk.com' WHEN 2 THEN replace(host, '.com', '.ru') ELSE 'news.t.me' END AS host FROM hosts)
 SELECT page_id, host, CASE WHEN page_id % 4 = 1 THEN 'DOMESTIC' END AS platform, CASE WHEN page_id % 4 = 1 THEN 0.9 ELSE 0.0 END AS platform_confidence,
  CASE WHEN split_part(host, '.', -1) IN ({", ".join(f"'{x}'" for x in fixed.DOMESTIC_TLDS)}) THEN 'DOMESTIC' WHEN split_part(host, '.', -1) IN ({", ".join(f"'{x}'" for x in fixed.INTERNATIONAL_TLDS)}) THEN 'INTERNATIONAL' ELSE 'UNKNOWN' END AS tld FROM h""")
def host_signals(spark, sf):
    host = F.when(F.col("page_id") % 4 == 0, F.col("host")).when(F.col("page_id") % 4 == 1, "m.vk.com").when(
        F.col("page_id") % 4 == 2, F.replace("host", F.lit(".com"), F.lit(".ru"))
    ).otherwise("news.t.me")
    rows = _pages(spark, sf).select("page_id", host.alias("host"))
    return rows.select(
        "page_id", "host", classify.by_platform(F.col("host"))["audience"].alias("platform"),
        classify.by_platform(F.col("host"))["confidence"].alias("platform_confidence"),
        classify.by_tld(F.col("host"))["audience"].alias("tld")
    )


_COUNTRIES = [
    ("RU", "RS", ["ru"]), ("CN", "CH", ["zh"]), ("IR", "IR", ["fa"]), ("DE", "GM", ["de"]), ("FR", "FR", ["fr"]),
    ("ES", "SP", ["es"]), ("RS", "RI", ["sr"])
]
_LANG = "doc AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'de' ELSE 'Klingon' END AS language, ['RU', 'CN', 'IR', 'GM', 'FR', 'SP', 'XX', 'UNITED STATES'][CAST(doc_id % 8 AS INT) + 1] AS raw, ['a.ru', 'b.com', 'vk.com', 'noname'][CAST(doc_id % 4 AS INT) + 1] AS domain FROM documents)"
_CLASS = f"""{_LANG}, norm AS (SELECT doc_id, domain, CASE language WHEN 'English' THEN 'en' WHEN 'French' THEN 'fr' WHEN 'de' THEN 'de' END AS language, CASE raw WHEN 'GM' THEN 'DE' WHEN 'SP' THEN 'ES' WHEN 'UNITED STATES' THEN 'RS' ELSE raw END AS country FROM doc),
 signals AS (SELECT *, CASE WHEN language IS NULL OR country = 'XX' THEN NULL WHEN (country, language) IN (('DE', 'de'), ('FR', 'fr')) THEN 'DOMESTIC' WHEN (country, language) IN (('RU', 'de'), ('RU', 'fr'), ('IR', 'en'), ('IR', 'de'), ('IR', 'fr')) THEN 'DIASPORA' ELSE 'INTERNATIONAL' END AS l,
   CASE domain WHEN 'vk.com' THEN 'DOMESTIC' END AS p, CASE domain WHEN 'a.ru' THEN 'DOMESTIC' WHEN 'b.com' THEN 'INTERNATIONAL' WHEN 'vk.com' THEN 'INTERNATIONAL' END AS t FROM norm),
 scores AS (SELECT *, CASE WHEN l = 'DOMESTIC' THEN 0.75 * 0.8::DOUBLE ELSE 0 END + CASE WHEN p = 'DOMESTIC' THEN 0.9 * 0.7::DOUBLE ELSE 0 END + CASE WHEN t = 'DOMESTIC' THEN 0.6 * 0.3::DOUBLE ELSE 0 END AS sd,
   CASE WHEN l = 'INTERNATIONAL' THEN 0.85 * 0.8::DOUBLE ELSE 0 END + CASE WHEN t = 'INTERNATIONAL' THEN 0.4 * 0.3::DOUBLE ELSE 0 END AS si, CASE WHEN l = 'DIASPORA' THEN 0.7 * 0.8::DOUBLE ELSE 0 END AS sp FROM signals),
 best AS (SELECT *, greatest(sd, si, sp) AS top, CASE WHEN sd = greatest(sd, si, sp) THEN 'DOMESTIC' WHEN si = greatest(sd, si, sp) THEN 'INTERNATIONAL' ELSE 'DIASPORA' END AS b FROM scores),
 done AS (SELECT doc_id, CASE WHEN top <= 0 THEN 'UNKNOWN' WHEN b = 'INTERNATIONAL' AND sp > 0 AND sp >= si * 0.95 THEN 'DIASPORA' ELSE b END AS audience_type,
   CASE WHEN top <= 0 THEN 0.0 ELSE round(CASE WHEN (l = b)::INT + coalesce(p = b, false)::INT + coalesce(t = b, false)::INT < 2 OR l IS NULL AND coalesce(p = b, false)::INT + coalesce(t = b, false)::INT < 2 THEN least(top / 1.8, 0.55) ELSE top / 1.8 END, 3) END AS confidence FROM best)"""


def _classified(spark, sf):
    countries = spark.createDataFrame(_COUNTRIES, "iso2 string, fips string, official_languages array<string>")
    rows = d.table(spark, sf, "documents").select(
        "doc_id", F.lit("").alias("url"), F.lit("").alias("title"), F.lit("20240101000000").alias("seendate"),
        d.pick(["a.ru", "b.com", "vk.com", "noname"], F.col("doc_id") % 4).alias("domain"),
        F.when(
            F.col("lang") == "en", "English"
        ).when(F.col("lang") == "fr", "French").when(F.col("lang") == "de", "de").otherwise("Klingon").alias("language"),
        d.pick(
            ["RU", "CN", "IR", "GM", "FR", "SP", "XX", "UNITED STATES"], F.col("doc_id") % 8
        ).alias("sourcecountry"),
        F.lit("RS").alias("query_country"),
    )
    named = article_lists.article_rows(rows.withColumn("source_kind", F.col("doc_id").cast("string")))
    known = article_lists.with_iso_country(named, countries)
    return classify.classified(known, countries).withColumn("doc_id", F.col("source_kind").cast("long"))


@query(f"WITH {_CLASS} SELECT * FROM done")
def audience_classes(spark, sf):
    return _classified(spark, sf).select("doc_id", "audience_type", "confidence")


@query(f"""WITH {_CLASS} SELECT doc_id, audience_type, CASE WHEN audience_type = 'UNKNOWN' THEN 'SUPPRESS' WHEN confidence >= 0.85 THEN 'PUBLISH' ELSE 'PUBLISH_WITH_CAVEAT' END AS verdict,
 CASE WHEN audience_type = 'UNKNOWN' THEN 0.0 ELSE greatest(0.1, confidence) END AS quality_score, concat_ws(',', CASE WHEN confidence < 0.55 THEN 'LOW_CONFIDENCE' END, CASE WHEN audience_type = 'UNKNOWN' THEN 'UNKNOWN_AUDIENCE' END) AS flags FROM done""")
def classification_verdicts(spark, sf):
    return claims.classification_verdicts(_classified(spark, sf)).select(
        "doc_id", "audience_type", "verdict", "quality_score", F.array_join("flags", ",").alias("flags")
    )


@query(f"""WITH {_CLASS} SELECT count(*) AS received, count(*) FILTER (WHERE audience_type <> 'UNKNOWN') AS classified, count(*) FILTER (WHERE audience_type = 'UNKNOWN') AS suppressed, 0::BIGINT AS escalated,
 {", ".join(f"count(*) FILTER (WHERE audience_type = '{a}') AS n_{a.lower()}" for a in fixed.AUDIENCES)} FROM done""")
def run_counters(spark, sf):
    return gates.run_counters(claims.classification_verdicts(_classified(spark, sf)))


_WORDS = {
    "COMMON": ["the ", "and ", "tion", "zzzz", "edre"], "FRENCH": ["eau", "que ", "tion", "ouai"],
    "RARE": ["licensed under", "gnu general", "qqqq"]
}


@query(
    "WITH s AS (" + " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS theme, ({' + '.join(f'contains(lower(text), $${w}$$)::INT' for w in ws)}) / {len(ws)} AS share FROM documents" for k,
        ws in _WORDS.items()
    ) + ") SELECT doc_id, theme, round(least(share * 1.5, 1.0), 2) AS confidence FROM s WHERE share >= 0.2"
)
def narrative_scores(spark, sf):
    return classify.narrative_scores(d.table(spark, sf, "documents"), narratives=_WORDS)


@query(f"""WITH s AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS theme, ({' + '.join(f'contains(lower(text), $${w}$$)::INT' for w in ws)}) / {len(ws)} AS share FROM documents" for k, ws in _WORDS.items())}), k AS (SELECT doc_id, theme, round(least(share * 1.5, 1.0), 2) AS confidence FROM s WHERE share >= 0.2),
 m AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'FRENCH' ELSE 'RARE' END AS theme FROM documents WHERE lang IN ('fr', 'de')) SELECT * FROM k UNION ALL SELECT doc_id, theme, 0.6 FROM m WHERE (doc_id, theme) NOT IN (SELECT (doc_id, theme) FROM k)""")
def narrative_scores_with_codes(spark, sf):
    docs = d.table(spark, sf, "documents")
    mapping = spark.createDataFrame([("fr", "FRENCH"), ("de", "RARE")], "code string, theme string")
    return classify.with_mapped_codes(
        classify.narrative_scores(docs, narratives=_WORDS), docs.select("doc_id", F.col("lang").alias("code")),
        mapping
    )


def gkg_lines(spark, sf, *more):
    """Lines of a theme file made of the events; every 11th is short, every 13th has no readable time."""
    e = d.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k")
    date = F.when(F.col("event_id") % 13 == 0, "garbage").otherwise(F.date_format("t", "yyyyMMddHHmmss"))
    rid = F.when(F.col("event_id") % 26 == 0, F.concat(F.date_format("t", "yyyyMMddHHmmss"), F.lit("-7"))).otherwise(
        F.col("event_id").cast("string")
    )
    themes = F.concat(F.lit("B_"), k, F.lit("; "), F.upper("event_type"), F.lit(";B_"), k, F.lit(";;"))
    tone = F.when(F.col("event_id") % 7 == 0, "").otherwise(
        F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit(",1.1,4.3"))
    )
    extras = F.concat(
        F.lit("<PAGE_LINKS></PAGE_LINKS><page_title> A &amp; &lt;"), F.col("event_type"),
        F.lit("&gt; &quot;x&#39; </page_title>")
    )
    fields = [
        rid, date, F.lit("1"), F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(".Example.com")),
        F.concat(F.lit("https://e/"), F.col("event_id").cast("string")), F.lit(""), F.lit(""), themes,
        *[F.lit("")] * 7, tone, *[F.lit("")] * 10, extras
    ]
    short = F.concat_ws("\t", *fields[:10])
    return e.select(
        F.when(F.col("event_id") % 11 == 0, short).otherwise(F.concat_ws("\t", *fields)).alias("value"), *more
    )


@query("""SELECT 'u' || user_id || '.example.com' AS raw_domain, 'https://e/' || event_id AS url, date_trunc('second', ts) AS date, 'A & <' || event_type || '> "x''' AS title,
 array_to_string(list_sort(list_distinct(['B_' || json_extract_string(props, '$.k'), upper(event_type)])), ';') AS themes, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS tone
 FROM events WHERE event_id % 11 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0)""")
def theme_file_rows(spark, sf):
    rows = gkg.parse_lines(gkg_lines(spark, sf))
    return rows.select(
        "raw_domain", "url", F.col("date").cast("timestamp_ntz").alias("date"), "title",
        F.array_join("themes", ";").alias("themes"), "tone"
    )


@query("""SELECT event_id, upper(event_type) || '|A|B' AS n FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT event_id, upper(event_type) || '|X' FROM events WHERE event_id % 2 = 1""")
def legacy_theme_lists(spark, sf):
    # lists keep the order of first occurrence
    e = d.table(spark, sf, "events")
    even = F.concat(F.col("event_type"), F.lit("; a ;b;;A"))
    odd = F.concat(F.col("event_type"), F.lit(", x,, "))
    themes = text.mixed_theme_list(
        F.when(F.col("event_id") % 2 == 0, even).otherwise(odd),
        F.when(F.col("event_id") % 3 == 0, F.upper("event_type"))
    )
    return e.select("event_id", F.array_join(themes, "|").alias("n"))


@query(
    """SELECT event_id, date_trunc('second', ts) AS t FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, date_trunc('day', ts) FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2"""
)
def publication_times(spark, sf):
    e = d.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("t", "yyyyMMddHHmmss")).when(
        F.col("event_id") % 3 == 1, F.date_format("t", "yyyy-MM-dd")
    ).otherwise("soon")
    return e.select("event_id", text.publication_time(raw).cast("timestamp_ntz").alias("t"))


@query(f"""SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(o_orderdate) AS month_end, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
 CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end, CASE strftime(o_orderdate, '%-m-%-d') {" ".join("WHEN '" + f"{m}-{x}" + "' THEN '" + n.replace("'", "''") + "'" for (m, x), n in fixed.ANNIVERSARIES.items())} END AS anniversary FROM orders""")
def period_bounds(spark, sf):
    day = d.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    m, w = text.period_struct(F.col("day"), "monthly"), text.period_struct(F.col("day"), "weekly")
    return day.select(
        "day", m["period_start"].alias("month_start"), m["period_end"].alias("month_end"),
        w["period_start"].alias("week_start"), w["period_end"].alias("week_end"),
        text.anniversary(F.col("day")).alias("anniversary")
    )


@query("""WITH t AS (SELECT part.*, ['NATURAL_DISASTER_FLOOD_', 'WB_2024_ANTI_', 'ELECTION_', 'ELECTIONS_', 'TAX_WORLDMAMMALS_'][CAST(p_partkey % 5 AS INT) + 1] || p_type AS theme, p_size / 5.0 - 5 AS tone FROM part)
 SELECT p_partkey, theme, p_partkey % 5 IN (0, 2) AS generic, CASE WHEN tone < -4 THEN 'hostile' WHEN tone < -1 THEN 'negative' WHEN tone <= 1 THEN 'neutral' WHEN tone <= 4 THEN 'positive' ELSE 'celebratory' END AS tone_class,
 CASE WHEN tone < -3 THEN 'hostile' WHEN tone < -1 THEN 'negative' WHEN tone <= 1 THEN 'neutral' ELSE 'positive' END AS bar, CASE WHEN p_size % 2 = 0 THEN 'red' ELSE 'neutral' END AS level FROM t""")
def theme_and_tone_classes(spark, sf):
    theme = F.concat(
        d.pick(
            ["NATURAL_DISASTER_FLOOD_", "WB_2024_ANTI_", "ELECTION_", "ELECTIONS_", "TAX_WORLDMAMMALS_"],
            F.col("p_partkey") % 5
        ),
        F.col("p_type")
    )
    rows = d.table(spark, sf, "part").select(
        "p_partkey", theme.alias("theme"), (F.col("p_size") / 5.0 - 5).alias("tone"),
        F.when(F.col("p_size") % 2 == 0, "red").otherwise("purple").alias("raw")
    )
    return rows.select(
        "p_partkey", "theme", text.is_generic(F.col("theme")).alias("generic"),
        text.tone_class(F.col("tone")).alias("tone_class"), text.bar_class(F.col("tone")).alias("bar"),
        text.known_level(F.col("raw")).alias("level")
    )
