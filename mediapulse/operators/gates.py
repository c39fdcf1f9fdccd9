"""Quality gates and summaries: each gate is one pass over its rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import fixed

MAX_ACTIVITY_ROWS, MAX_THEME_ROWS = 200_000, 5_000_000


def _no(c: Column) -> Column:
    """Not true, null included."""
    return ~F.coalesce(c, F.lit(False))


def activity_rules() -> dict[str, Column]:
    return {
        "today_count": _no(F.col("today_count") >= 0), "baseline_mean": _no(F.col("baseline_mean") >= 0),
        "baseline_std": _no(F.col("baseline_std") >= 0), "level": _no(F.col("level").isin(fixed.LEVELS)),
        "confidence": _no(F.col("confidence").isin(fixed.CONFIDENCES)),
        "audience_type": _no(F.col("audience_type").isin(fixed.AUDIENCES)),
        "cold_start": F.col("cold_start").isNull(), "excluded_country": excluded(),
    }


def theme_rules() -> dict[str, Column]:
    start, end = F.col(
        "period_start"
    ).cast("string").try_cast("date"), F.col("period_end").cast("string").try_cast("date")
    return {
        "audience_type": _no(F.col("audience_type").isin(fixed.AUDIENCES)),
        "negative_count": _no((F.col("article_count") >= 0) & (F.col("bucket_total") >= 0)),
        "share": _no(F.col("share").between(0, 1)),
        "date_format": start.isNull() | end.isNull(), "date_order": F.coalesce(end < start, F.lit(False)),
        "excluded_country": excluded(),
        "alignment": F.when(F.col("period_type") == "monthly", _no(F.dayofmonth(start) == 1)).when(
            F.col("period_type") == "weekly", _no(F.weekday(start) == 0)
        ).otherwise(False),
        "theme_size": F.octet_length("theme") > 256,
    }


def daily_theme_rules() -> dict[str, Column]:
    """The rules of theme rows, and that a day's period is that day."""
    same = F.when(F.col("period_type") == "daily", _no(F.col("period_start") == F.col("period_end"))).otherwise(False)
    return theme_rules() | {"one_day": same}


def outlet_rules() -> dict[str, Column]:
    """Limits of the outlet table: audience, bytes of name, notes and domain (the longest DNS name)."""
    return {
        "audience_type": _no(F.col("audience_type").isin(fixed.AUDIENCES)),
        "name_size": F.octet_length("outlet_name") > 1024,
        "notes_size": F.octet_length("notes") > 4096, "domain_size": _no(F.octet_length("domain") <= 253),
    }


def article_rules() -> dict[str, Column]:
    """Limits of the article table: audience, bytes of title and url."""
    return {
        "audience_type": _no(F.col("audience_type").isin(fixed.AUDIENCES)),
        "title_size": F.octet_length("title") > 65536,
        "url_size": _no(F.octet_length("url") <= 8192),
    }


def excluded() -> Column:
    return F.coalesce(F.upper("country").isin(fixed.EXCLUDED_COUNTRIES), F.lit(False))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows) for every rule, those without a violation too."""
    counts = rows.agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])).alias("r")
    ).select("r.*")


def samples(rows: DataFrame, rules: dict[str, Column], most: int = 10) -> DataFrame:
    """Up to `most` violating rows with the names of the rules they break; a report, so a limit."""
    broken = F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).where(F.size("broken") > 0).limit(most)


def volume_gate(rows: DataFrame, ceiling: int) -> DataFrame:
    return rows.agg(F.count("*").alias("rows")).select("rows", (F.col("rows") <= ceiling).alias("passed"))


def forward_dated(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.agg(F.count_if(F.col("period_start") > F.lit(as_of).cast("date")).alias("forward_dated"))


def known_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Listed (date, country, audience_type, description) with what the rows say of them; null where nothing."""
    keys = ["date", "country", "audience_type"]
    return events.join(rows.select(*keys, "today_count", "deviation_ratio", "z_score", "level"), keys, "left")


def run_checks(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: rows, null keys, invalid enums and expected countries that are missing."""
    main = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(
            F.col("country").isNull() | F.col("date").isNull() | F.col("audience_type").isNull()
        ).alias("null_keys"),
        F.count_if(
            ~F.coalesce(
                F.col("level").isin(fixed.LEVELS) & F.col("audience_type").isin(fixed.AUDIENCES), F.lit(False)
            )
        ).alias("bad_enums"),
    )
    absent = expected.join(rows.select("country").distinct(), "country", "left_anti").agg(
        F.count("*").alias("missing_countries")
    )
    return main.join(absent, F.lit(True))


def outlet_checks(outlets: DataFrame, spots: DataFrame) -> DataFrame:
    """(domain, expected, found, passed) of the spot checks (domain, audience_type)."""
    found = outlets.select("domain", F.col("audience_type").alias("found"))
    return spots.select("domain", F.col("audience_type").alias("expected")).join(found, "domain", "left").withColumn(
        "passed", F.coalesce(F.col("expected") == F.col("found"), F.lit(False))
    )


def activity_summary(rows: DataFrame) -> DataFrame:
    """One row: rows, countries, dates, cold starts, range, rows per audience and level."""
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("country").alias("countries"),
        F.count_distinct("date").alias("dates"), F.count_if("cold_start").alias("cold_starts"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *[F.count_if(F.col("audience_type") == a).alias(f"n_{a.lower()}") for a in fixed.AUDIENCES],
        *[F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in fixed.LEVELS],
    )


def theme_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("country").alias("countries"),
        F.count_distinct("period_type", "period_start").alias("periods"), F.sum("article_count").alias("articles"),
        F.count_distinct("theme").alias("themes"),
        *[F.count_if(F.col("audience_type") == a).alias(f"n_{a.lower()}") for a in fixed.AUDIENCES],
    )


def run_counters(classified: DataFrame) -> DataFrame:
    """One row of received, classified, suppressed and per-audience counts."""
    return classified.agg(
        F.count("*").alias("received"), F.count_if(F.col("audience_type") != "UNKNOWN").alias("classified"),
        F.count_if(F.col("verdict") == "SUPPRESS").alias("suppressed"),
        F.count_if(F.col("verdict") == "ESCALATE").alias("escalated"),
        *[F.count_if(F.col("audience_type") == a).alias(f"n_{a.lower()}") for a in fixed.AUDIENCES],
    )


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country", "audience_type").agg(
        F.count("*").alias("rows"), F.max("period_start").alias("latest")
    )


def source_coverage(outlets: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per outlet of the dimension: days, rows and total volume; one without data has zeros."""
    sums = volumes.groupBy("domain").agg(
        F.count("*").alias("rows"), F.count_distinct("date").alias("days"), F.sum("volume").alias("volume")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return outlets.select("domain").join(sums, "domain", "left").select(
        "domain", zero("rows"), zero("days"), zero("volume"), F.col("rows").isNotNull().alias("has_data")
    )


def top_by_rows(rows: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The `most` values of a column with the most rows; a report, so a limit. Ties go to the smaller value."""
    return rows.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column).limit(most)


def recent_counts(articles: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Articles per country and audience over the `days` days before `as_of`, that day included."""
    since = as_of - dt.timedelta(days=days - 1)
    recent = articles.where(F.to_date("date").between(F.lit(since), F.lit(as_of)))
    return recent.groupBy("country", "audience_type").agg(F.count("*").alias("articles"))


def outlet_report(outlets: DataFrame) -> DataFrame:
    """One row of the outlet dimension: rows, rows of excluded countries, and outlets per audience."""
    return outlets.agg(
        F.count("*").alias("rows"), F.count_if(excluded()).alias("excluded"),
        *[F.count_if(F.col("audience_type") == a).alias(f"n_{a.lower()}") for a in fixed.AUDIENCES],
    )


def source_run(outlets: DataFrame, volumes: DataFrame, resume_from: str = "") -> DataFrame:
    """One row of a volume run: outlets queried, with data, empty and skipped by the resume cutoff; days and rows covered.

    An outlet without a row of positive volume is empty, which is no error.
    """
    data = volumes.where("volume > 0").groupBy("domain").agg(F.count("*").alias("rows"))
    known = outlets.select("domain").distinct().join(data, "domain", "left")
    queried = F.col("domain") >= resume_from
    runs = known.agg(
        F.count_if(queried).alias("queried"), F.count_if(queried & F.col("rows").isNotNull()).alias("with_data"),
        F.count_if(queried & F.col("rows").isNull()).alias("empty"), F.count_if(~queried).alias("skipped"),
    )
    own = volumes.where(queried).join(known.select("domain"), "domain", "left_semi")
    return runs.join(own.agg(F.count_distinct("date").alias("days"), F.count("*").alias("rows")), F.lit(True))


def run_report(
    articles: DataFrame, rows: DataFrame, claims: DataFrame, runs: DataFrame, expected: DataFrame, day: dt.date
) -> DataFrame:
    """(check_name, found, passed) for one day after a run, a row for each check.

    articles(date, country, audience_type), rows(date, country, level), claims(claim_type, date), runs(started_at, outcome),
    expected(country). Articles, activity rows and DEVIATION claims of the day must exist, nulls, unknown values and
    missing countries must not; COORDINATION claims may be none; the latest run must be a SUCCESS.
    """
    on = lambda df: df.where(F.to_date("date") == F.lit(day))
    some, none = lambda n: n > 0, lambda n: n == 0
    a = on(articles).agg(
        F.count("*").alias("articles"), F.count_if(F.col("country").isNull()).alias("null_countries"),
        F.count_if(F.col("audience_type").isNull()).alias("null_audiences"),
        F.count_if(~F.col("audience_type").isin(fixed.AUDIENCES)).alias("bad_audiences"),
    )
    b = on(rows).agg(F.count("*").alias("activity_rows"), F.count_if(_no(F.col("level").isin(fixed.LEVELS))).alias("bad_levels"))
    absent = expected.join(on(rows).select("country").distinct(), "country", "left_anti")
    c = on(claims).agg(
        F.count_if(F.col("claim_type") == "DEVIATION").alias("deviation_claims"),
        F.count_if(F.col("claim_type") == "COORDINATION").alias("coordination_claims"),
    )
    last = F.coalesce(F.max_by("outcome", "started_at") == "SUCCESS", F.lit(False)).cast("long")
    one = a.join(b, F.lit(True)).join(absent.agg(F.count("*").alias("missing_countries")), F.lit(True))
    one = one.join(c, F.lit(True)).join(runs.agg(last.alias("latest_run")), F.lit(True))
    rule = {
        "articles": some, "null_countries": none, "null_audiences": none, "bad_audiences": none, "activity_rows": some,
        "bad_levels": none, "missing_countries": none, "deviation_claims": some, "coordination_claims": lambda n: n >= 0,
        "latest_run": some,
    }
    checks = [F.struct(F.lit(k).alias("check_name"), F.col(k).alias("found"), f(F.col(k)).alias("passed")) for k, f in rule.items()]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def write_gated(rows: DataFrame, rules: dict[str, Column], path: str) -> dict[str, int]:
    """Write rows to path/quarantined=false, rows that break a rule to path/quarantined=true with the names of these
    rules, and return the number of rows and of breaches of each rule: one job reads the rows once.

    The counts are metrics observed by the writing job; on a retried task they count its rows once.
    """
    broken = F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())
    seen = Observation()
    marked = rows.withColumn("broken", broken)
    counts = [F.count_if(F.array_contains("broken", n)).alias(n) for n in rules]
    marked = marked.observe(seen, F.count("*").alias("rows"), F.count_if(F.size("broken") > 0).alias("quarantined"), *counts)
    marked = marked.withColumn("quarantined", F.size("broken") > 0)
    marked.write.mode("overwrite").partitionBy("quarantined").parquet(path)
    return seen.get


def manifest(rows: DataFrame, source: str, metadata: dict[str, str], target: str, at: dt.datetime) -> DataFrame:
    """One row: what an import wrote, from where, with which metadata, when, and into which table."""
    about = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast("map<string,string>")
    return rows.agg(F.count("*").alias("rows")).select(
        F.lit(source).alias("source"), about.alias("metadata"), F.lit(at).cast("timestamp").alias("imported_at"), "rows",
        F.lit(target).alias("target"),
    )
