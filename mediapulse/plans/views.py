"""Read-side views over activity, theme and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.rollup import ranked


def latest(rows: DataFrame, column: str = "date") -> DataFrame:
    """All rows of the latest date or period."""
    top = rows.agg(F.max(column).alias(column))
    return rows.join(F.broadcast(top), column).select(*rows.columns)


def country_view(activity: DataFrame) -> DataFrame:
    """One row per country of the latest date: domestic and international side by side.

    International is the INTERNATIONAL row, else the DIASPORA row; an absent side is neutral with ratio 1.
    """
    day = latest(activity)
    side = lambda a, c: F.max(F.when(F.col("audience_type") == a, F.col(c)))
    rows = day.groupBy("country", "date").agg(
        *[
            side(a, c).alias(f"{a}_{c}") for a in fixed.AUDIENCES for c in (
                "deviation_ratio", "z_score", "level", "today_count"
            )
        ],
        F.max("cold_start").alias("cold_start")
    )
    abroad = lambda c: F.when(F.col("INTERNATIONAL_level").isNotNull(), F.col(f"INTERNATIONAL_{c}")).otherwise(
        F.col(f"DIASPORA_{c}")
    )
    home = lambda c: F.col(f"DOMESTIC_{c}")
    out = rows.select(
        "country", "date",
        *[
            F.coalesce(f("deviation_ratio"), F.lit(1.0)).alias(f"{n}_ratio") for n,
            f in (("domestic", home), ("international", abroad))
        ],
        *[
            F.coalesce(f("z_score"), F.lit(0.0)).alias(f"{n}_z") for n,
            f in (("domestic", home), ("international", abroad))
        ],
        *[
            F.coalesce(f("level"), F.lit("neutral")).alias(f"{n}_level") for n,
            f in (("domestic", home), ("international", abroad))
        ],
        (F.coalesce(home("today_count"), F.lit(0)) + F.coalesce(abroad("today_count"), F.lit(0))).alias("articles"),
        "cold_start",
    )
    return out.withColumn(
        "both_level",
        F.when(F.abs("domestic_z") > F.abs("international_z"), F.col("domestic_level")).otherwise(
            F.col("international_level")
        )
    )


def movers(view: DataFrame, top: int = 5) -> DataFrame:
    """The countries with the largest score on either side."""
    return view.withColumn("score", F.greatest(F.abs("domestic_z"), F.abs("international_z"))).orderBy(
        F.desc("score"), F.desc("articles"), "country"
    ).limit(top)


def trending_themes(rows: DataFrame, top: int = 8) -> DataFrame:
    """Themes of the latest month over all countries and audiences."""
    sums = latest(rows.where("period_type = 'monthly'"), "period_start").groupBy("theme").agg(
        F.sum("article_count").alias("articles"), F.count_distinct("country").alias("countries")
    )
    return sums.orderBy(F.desc("articles"), "theme").limit(top)


def headlines(articles: DataFrame, outlets: DataFrame | None = None, top: int = 20) -> DataFrame:
    """The latest articles of every country, with the first six themes; diaspora shows as international."""
    rows = ranked(articles, ["country"], [F.desc("date"), "record_id"], top)
    shown = F.when(F.col("audience_type") == "DIASPORA", "INTERNATIONAL").otherwise(F.col("audience_type"))
    rows = rows.withColumn("audience_type", shown).withColumn("themes", F.slice("themes", 1, 6))
    if outlets is None:
        return rows
    return rows.join(outlets.select("domain", "outlet_name"), "domain", "left").withColumn(
        "outlet_name", F.coalesce("outlet_name", "domain")
    )


def theme_history(rows: DataFrame) -> DataFrame:
    """Each theme's periods with the bar height relative to its largest count and the bar's colour class."""
    top = F.max("article_count").over(Window.partitionBy("country", "audience_type", "period_type", "theme"))
    return rows.withColumn("height", F.round(F.col("article_count") / top, 4)).withColumn(
        "bar", text.bar_class(F.col("avg_tone"))
    )


def period_themes(rows: DataFrame, most: int = 500) -> DataFrame:
    """Per country the newest and largest theme rows, grouped by audience and period."""
    kept = ranked(
        rows.drop("rank"), ["country"],
        [F.desc("period_start"), F.desc("article_count"), "audience_type", "period_type", "theme"], most
    )
    entry = F.struct((-F.col("article_count")).alias("k"), "theme", "article_count")
    return kept.groupBy("country", "audience_type", "period_type", "period_start").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["theme"]).alias("themes")
    )


def period_totals(rows: DataFrame) -> DataFrame:
    """Mentions and articles of a period over the audiences."""
    per = rows.groupBy("country", "period_type", "period_start", "audience_type").agg(
        F.sum("article_count").alias("mentions"), F.max("bucket_total").alias("articles")
    )
    return per.groupBy("country", "period_type", "period_start").agg(
        F.sum("mentions").alias("mentions"), F.sum("articles").alias("articles")
    )


def theme_search(rows: DataFrame, words: str) -> DataFrame:
    """Rows whose theme or label contains the words, whatever their case."""
    q = words.lower()
    return rows.where(F.lower("theme").contains(q) | F.lower(text.theme_label(F.col("theme"))).contains(q))


def country_search(countries: DataFrame, words: str, most: int = 50) -> DataFrame:
    q = words.lower()
    return countries.where(F.lower("name").contains(q) | F.lower("iso2").contains(q)).orderBy("name").limit(most)


def in_regions(rows: DataFrame, regions: list[str] | None) -> DataFrame:
    """All rows for None, none for an empty list."""
    return rows if regions is None else rows.where(F.col("region").isin(regions) if regions else F.lit(False))


def theme_search_hidden(rows: DataFrame, words: str) -> DataFrame:
    """Per bucket the rows that a search shows and those it hides."""
    q = words.strip().lower()
    shown = F.lower("theme").contains(q) | F.lower(text.theme_label(F.col("theme"))).contains(q)
    keys = ("country", "audience_type", "period_type", "period_start")
    return rows.groupBy(*keys).agg(F.count_if(shown).alias("shown"), F.count_if(~shown).alias("hidden"))


def narratives(rows: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """A paragraph of facts on each bucket: number of themes, the leading three with their shares, how much they hold
    together and how concentrated that is, the class of their tone, and the next three.

    `buckets` names the (country, audience_type, period_type, period_start) that get one; those without themes
    are said to have none.
    """
    keys = ["country", "audience_type", "period_type", "period_start"]
    label = text.theme_label(F.col("theme")).alias("label")
    entry = F.struct((-F.col("article_count")).alias("k"), "theme", "share", "avg_tone", label)
    b = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    if buckets is not None:
        b = buckets.select(*keys).distinct().join(b, keys, "left")
    top = F.slice("t", 1, 3)
    share = F.aggregate(top, F.lit(0.0), lambda a, x: a + x["share"])
    tones = F.filter(F.transform(top, lambda x: x["avg_tone"]), lambda x: x.isNotNull())
    tone = F.when(F.size(tones) > 0, F.aggregate(tones, F.lit(0.0), lambda a, x: a + x) / F.size(tones))
    b = b.withColumn("top_share", F.round(share, 4))
    there = F.col("t").isNotNull()
    b = b.withColumn("lead", F.when(there, text.concentration_class(F.col("top_share"))))
    b = b.withColumn("tone_class", F.when(there, text.tone_class(tone)))
    percent = lambda x: F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))
    first = F.array_join(F.transform(top, lambda x: F.concat(x["label"], F.lit(" "), percent(x["share"]))), ", ")
    after = F.array_join(F.transform(F.slice("t", 4, 3), lambda x: x["label"]), ", ")
    n = F.coalesce(F.size(F.when(there, F.col("t"))), F.lit(0))
    head = F.concat(
        "country", F.lit(" "), F.lower("audience_type"), F.lit(", "), F.date_format("period_start", "yyyy-MM-dd"), F.lit(": "),
        n.cast("string"), F.lit(" themes."),
    )
    facts = F.concat(
        F.lit(" First "), first, F.lit("; together "), percent(F.col("top_share")), F.lit(" of articles ("), "lead",
        F.lit("), tone "), "tone_class", F.lit("."),
        F.when(n > 3, F.concat(F.lit(" Then "), after, F.lit("."))).otherwise(F.lit("")),
    )
    said = F.concat(head, F.when(there, facts).otherwise(F.lit("")))
    return b.select(*keys, "top_share", "tone_class", "lead", said.alias("narrative"))
