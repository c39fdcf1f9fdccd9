"""Verdicts on classifications, deviations and coordination events, and the rows they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

VERDICTS = ["PUBLISH", "PUBLISH_WITH_CAVEAT", "SUPPRESS", "ESCALATE"]


def _flags(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold."""
    return F.filter(F.array(*[F.when(c, name) for c, name in pairs]), lambda x: x.isNotNull())


def classification_verdicts(rows: DataFrame) -> DataFrame:
    """Adds verdict, quality_score, flags to rows(audience_type, confidence)."""
    unknown, c = F.col("audience_type") == "UNKNOWN", F.col("confidence")
    return rows.select(
        "*", F.when(unknown, "SUPPRESS").when(c >= 0.85, "PUBLISH").otherwise("PUBLISH_WITH_CAVEAT").alias("verdict"),
        F.when(unknown, 0.0).otherwise(c).alias("claim_confidence"),
        F.when(unknown, 0.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), c))).alias("quality_score"),
        _flags((c < 0.55, "LOW_CONFIDENCE"), (unknown, "UNKNOWN_AUDIENCE")).alias("flags"),
        F.when(unknown, "unknown audience").when(
            c >= 0.85, "outlet or several signals"
        ).when(c >= 0.55, "moderate confidence").otherwise("low confidence").alias("verdict_reason"),
    )


def deviation_verdicts(rows: DataFrame) -> DataFrame:
    """Adds verdict, claim_confidence, quality_score, flags, warming to activity rows.

    Under 7 days of history everything is published with a caveat; from 7 to 20 days extreme levels are;
    later, extreme levels are suppressed at LOW and caveated at MEDIUM confidence.
    """
    days, z, ratio = F.col("days_sampled"), F.col("z_score"), F.col("deviation_ratio")
    extreme, label = F.col("level").isin("red", "deepBlue"), F.col("confidence")
    quality = F.when(label == "HIGH", 0.95).when(label == "MEDIUM", 0.65).otherwise(0.3)
    cold, warming = days < 7, (days >= 7) & (days < 21)
    flags = _flags(
        (days < 14, "SMALL_SAMPLE"), (F.abs(z) >= 10, "SENTINEL_Z"),
        ((ratio > 2) & (F.abs(z) < 2), "HIGH_RATIO_LOW_Z"),
        ((F.col("baseline_std") == 0) & (F.col("baseline_mean") > 0), "ZERO_VARIANCE"),
        (cold, "COLD_START"), (~cold & ~warming & extreme & (label == "LOW"), "EXTREME_AT_LOW_CONFIDENCE"),
    )
    return rows.select(
        "*",
        F.when(cold, "PUBLISH_WITH_CAVEAT").when(warming & extreme, "PUBLISH_WITH_CAVEAT").when(extreme & (label == "LOW"), "SUPPRESS").when(
            extreme & (label == "MEDIUM"), "PUBLISH_WITH_CAVEAT"
        ).otherwise("PUBLISH").alias("verdict"),
        F.when(cold, 0.4).when(warming & extreme, 0.6).when(extreme & (label == "LOW"), 0.2).when(
            extreme & (label == "MEDIUM"), 0.6
        ).otherwise(quality).alias("claim_confidence"),
        quality.alias("quality_score"), flags.alias("flags"), (cold | warming).alias("warming"),
        F.when(cold, F.format_string("cold start: %d days of history", days)).when(warming & extreme, "baseline still warming up").otherwise(
            F.format_string("level %s with %s confidence", "level", "confidence")
        ).alias("verdict_reason"),
    )


def hypotheses(day: Column) -> Column:
    """Competing explanations of an event with their scores; an anniversary adds a strong one."""
    entry = lambda name, s, verdict: F.struct(
        F.lit(name).alias("id"), F.lit(s).alias("score"), F.lit(verdict).alias("verdict")
    )
    first = [
        entry("H1_DELIBERATE_COORDINATION", 0.0, "UNSUPPORTED"),
        entry("H2_MAJOR_EVENT_REACTION", 0.5, "CANNOT_RULE_OUT"), entry("H3_WIRE_SYNDICATION", 0.4, "CANNOT_RULE_OUT")
    ]
    last = entry("H5_PUBLISHING_CYCLE", 0.3, "UNLIKELY_BUT_POSSIBLE")
    yearly = F.when(text.anniversary(day).isNotNull(), entry("H4_ANNIVERSARY_PATTERN", 0.9, "LIKELY_ALTERNATIVE"))
    return F.filter(F.array(*first, yearly, last), lambda x: x.isNotNull())


def coordination_verdicts(events: DataFrame) -> DataFrame:
    """Adds hypotheses, verdict, claim_confidence, quality_score, flags to coordination events."""
    n, s = F.size("countries"), F.col("coordination_score")
    rows = events.withColumn("hypotheses", hypotheses(F.col("date")))
    strong = F.exists("hypotheses", lambda h: (h["id"] != "H1_DELIBERATE_COORDINATION") & (h["score"] >= 0.7))
    escalate = (n >= 3) & (s >= 0.6)
    return rows.select(
        "*", F.when(strong, "SUPPRESS").when(escalate, "ESCALATE").otherwise("PUBLISH_WITH_CAVEAT").alias("verdict"),
        F.round(F.when(strong, 0.2).when(escalate, s).otherwise(s * 0.7), 3).alias("claim_confidence"),
        F.round(F.least(F.lit(1.0), s * (0.7 + 0.1 * F.least(n, F.lit(3)))), 3).alias("quality_score"),
        _flags((n >= 4, "MANY_COUNTRIES"), (text.is_generic(F.col("theme")), "GENERIC_THEME")).alias("flags"),
        F.when(
            strong,
            F.concat(
                F.lit("strong alternative: "),
                F.coalesce(text.anniversary(F.col("date")), F.lit("other explanations"))
            )
        ).when(escalate, "three countries or more: needs review").otherwise("published with caveat").alias("verdict_reason"),
    )


def published(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("verdict").isin("PUBLISH", "PUBLISH_WITH_CAVEAT"))


def claim_rows(rows: DataFrame, kind: str, key: Column, all_verdicts: bool = True, most: int = 4096) -> DataFrame:
    """Rows of the claims table; classifications that are simply published leave none."""
    kept = rows if all_verdicts else rows.where("verdict <> 'PUBLISH'")
    return kept.select(
        F.lit(kind).alias("claim_type"), key.alias("claim_key"), "verdict",
        F.round("claim_confidence", 3).alias("confidence"), F.round("quality_score", 3).alias("quality_score"),
        F.array_join("flags", ",").alias("red_team_flags"),
        F.substring("verdict_reason", 1, most).alias("verdict_reason"),
    )


def escalations(rows: DataFrame) -> DataFrame:
    """Events to review, urgent from four countries on."""
    return rows.where("verdict = 'ESCALATE'").select(
        "date", "theme", "countries", "coordination_score",
        F.when(F.size("countries") >= 4, "URGENT").otherwise("HIGH").alias("severity"),
        F.lit("PENDING").alias("review_status")
    )
