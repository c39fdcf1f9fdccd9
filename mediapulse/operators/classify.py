"""Audiences from outlets, languages, platforms and top-level domains; narratives from keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def by_language(language: Column, country: Column, official: Column) -> Column:
    """(audience, confidence): official languages are domestic, known diaspora languages are diaspora."""
    lang, code = F.lower(F.nullif(F.trim(language), F.lit(""))), F.upper(country)
    known = lang.isNotNull() & code.isNotNull() & (F.coalesce(F.size(official), F.lit(0)) > 0)
    hints = text.literal_map({f"{c}:{x}": True for c, langs in fixed.DIASPORA_LANGUAGES.items() for x in langs})
    home = F.array_contains(F.transform(official, F.lower), lang)
    away = F.coalesce(F.element_at(hints, F.concat_ws(":", code, lang)), F.lit(False))
    pick = lambda a, b, c: F.when(
        ~F.coalesce(known, F.lit(False)), a[3]
    ).when(home, a[0]).when(away, a[1]).otherwise(a[2])
    return F.struct(
        pick(["DOMESTIC", "DIASPORA", "INTERNATIONAL", "UNKNOWN"], 0, 0).alias("audience"),
        pick([0.75, 0.70, 0.85, 0.0], 0, 0).alias("confidence")
    )


def by_platform(host: Column) -> Column:
    """(audience, confidence) of the most specific known platform host; null without one."""
    known = {k: v for k, v in fixed.PLATFORMS.items() if v[0] != "VARIES"}
    hit = F.get(F.filter(text.parents(host), lambda d: d.isin(list(known))), F.lit(0))
    return F.struct(
        F.element_at(text.literal_map({k: v[0] for k, v in known.items()}), hit).alias("audience"),
        F.coalesce(
            F.element_at(text.literal_map({k: v[1] for k, v in known.items()}), hit), F.lit(0.0)
        ).alias("confidence")
    )


def by_tld(host: Column) -> Column:
    tld = F.when(F.contains(host, F.lit(".")), F.element_at(F.split(host, r"\."), -1))
    home, away = tld.isin(fixed.DOMESTIC_TLDS), tld.isin(fixed.INTERNATIONAL_TLDS)
    return F.struct(
        F.when(home, "DOMESTIC").when(away, "INTERNATIONAL").otherwise("UNKNOWN").alias("audience"),
        F.when(home, 0.60).when(away, 0.40).otherwise(0.0).alias("confidence")
    )


def combined(
    outlet_audience: Column, outlet_confidence: Column, language: Column, platform: Column, tld: Column
) -> Column:
    """(audience, confidence): a known outlet decides; else the best weighted sum of the three signals.

    Confidence is the best sum over all weights; a single signal gives 0.55 at most; diaspora wins over
    international within five hundredths; without any signal the audience is UNKNOWN.
    """
    signals = [(language, 0.8), (platform, 0.7), (tld, 0.3)]
    names = ["DOMESTIC", "INTERNATIONAL", "DIASPORA"]
    score = {
        n: sum(
            (F.when(s["audience"] == n, s["confidence"] * w).otherwise(0.0) for s, w in signals), F.lit(0.0)
        ) for n in names
    }
    fired = {n: sum((F.when(s["audience"] == n, 1).otherwise(0) for s, w in signals), F.lit(0)) for n in names}
    top = F.greatest(*score.values())
    best = F.when(score["DOMESTIC"] == top, "DOMESTIC").when(
        score["INTERNATIONAL"] == top, "INTERNATIONAL"
    ).otherwise("DIASPORA")
    n_best = F.when(best == "DOMESTIC", fired["DOMESTIC"]).when(
        best == "INTERNATIONAL", fired["INTERNATIONAL"]
    ).otherwise(fired["DIASPORA"])
    share = top / F.lit(sum(w for _, w in signals))
    share = F.round(F.least(F.when(n_best < 2, F.least(share, F.lit(0.55))).otherwise(share), F.lit(1.0)), 3)
    tie = (best == "INTERNATIONAL") & (score["DIASPORA"] > 0) & (score["DIASPORA"] >= score["INTERNATIONAL"] * 0.95)
    known = outlet_audience.isNotNull()
    own = F.least(F.greatest(F.coalesce(outlet_confidence, F.lit(1.0)), F.lit(0.0)), F.lit(0.95))
    return F.struct(
        F.when(
            known, outlet_audience
        ).when(top <= 0, "UNKNOWN").when(tie, "DIASPORA").otherwise(best).alias("audience"),
        F.when(known, own).when(top <= 0, 0.0).otherwise(share).alias("confidence"),
    )


def classified(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Adds audience_type and confidence to rows(source_domain, source_language, source_country[, outlet_audience, outlet_confidence])."""
    official = F.broadcast(
        countries.select(F.col("iso2").alias("_iso"), F.col("official_languages").alias("_official"))
    )
    own = [F.col(c) if c in rows.columns else F.lit(None) for c in ("outlet_audience", "outlet_confidence")]
    joined = rows.join(official, F.upper("source_country") == F.col("_iso"), "left")
    # each signal is a column of its own, so that it is computed once and not wherever the combination reads it
    signals = joined.withColumn("_host", text.host(F.col("source_domain")))
    signals = signals.withColumn(
        "_language", by_language(F.col("source_language"), F.col("source_country"), F.col("_official"))
    ).withColumn("_platform", by_platform(F.col("_host"))).withColumn("_tld", by_tld(F.col("_host")))
    got = signals.withColumn(
        "_got",
        combined(own[0].cast("string"), own[1].cast("double"), F.col("_language"), F.col("_platform"), F.col("_tld"))
    )
    return got.withColumn("audience_type", F.col("_got.audience")).withColumn("confidence", F.col("_got.confidence")).drop(
        "_got", "_iso", "_official", "_host", "_language", "_platform", "_tld"
    )


def narrative_scores(
    rows: DataFrame, key: str = "doc_id", column: str = "text", narratives: dict[str, list[str]] | None = None,
    least: float = 0.2
) -> DataFrame:
    """(key, theme, confidence): share of a narrative's keywords that the text holds, scaled by 1.5.

    One pass over the texts; keywords are matched in lower-cased text as they are written, so a keyword
    with capitals never matches.
    """
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    shares = [
        F.struct(
            F.lit(name).alias("theme"),
            (
                sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) / len(words)
            ).alias("share")
        )
        for name, words in (narratives or fixed.NARRATIVES).items()
    ]
    found = rows.select(key, F.explode(F.filter(F.array(*shares), lambda x: x["share"] >= least)).alias("n"))
    return found.select(key, "n.theme", F.round(F.least(F.col("n.share") * 1.5, F.lit(1.0)), 2).alias("confidence"))


def with_mapped_codes(scores: DataFrame, codes: DataFrame, mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds themes that an article's codes(key, code) map to (code, theme) at 0.60, where not scored already."""
    mapped = codes.join(mapping, "code").select(key, "theme").distinct()
    return scores.unionByName(
        mapped.join(scores.select(key, "theme"), [key, "theme"], "left_anti").withColumn("confidence", F.lit(0.60))
    )
