"""Hosts, themes, tones, times, languages and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def host(c: Column | str) -> Column:
    """The bare host of a URL or host name: no scheme, user, path, port, outer dots or leading www."""
    d = F.lower(F.regexp_replace(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), r"^\s+|\s+$", ""))
    for pattern in (r"(?s)^.*?://", r"^[^/@]*@", r"(?s)[/?#].*$", r"(?s):.*$", r"^\.+|\.+$", r"^www\."):
        d = F.regexp_replace(d, pattern, "")
    return F.regexp_replace(d, r"\.{2,}", ".")


def parents(h: Column, least: int = 2) -> Column:
    """The host and its parent domains of at least `least` labels, the most specific first."""
    parts = F.split(h, r"\.")
    n = F.size(parts)
    chain = F.transform(F.sequence(F.lit(1), n - (least - 1)), lambda k: F.array_join(F.slice(parts, k, n), "."))
    return F.when((h != "") & (n >= least), chain).otherwise(F.array().cast("array<string>"))


def theme_list(c: Column) -> Column:
    """Distinct themes of a list separated by semicolons, sorted."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def mixed_theme_list(*columns: Column) -> Column:
    """Themes of several fields split at semicolons, else commas; upper case, distinct, in order."""
    def split(c: Column) -> Column:
        s = F.coalesce(c, F.lit(""))
        return F.when(
            F.contains(s, F.lit(";")), F.split(s, ";")
        ).when(F.contains(s, F.lit(",")), F.split(s, ",")).otherwise(F.array(s))

    every = F.transform(F.concat(*map(split, columns)), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def first_tone(c: Column) -> Column:
    return F.trim(F.get(F.split(c, ","), F.lit(0))).try_cast("double")


def page_title(c: Column) -> Column:
    title = F.nullif(
        F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), "(?i)<PAGE_TITLE>([^<]*)</PAGE_TITLE>", 1)), F.lit("")
    )
    for entity, mark in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        title = F.replace(title, F.lit(entity), F.lit(mark))
    return title


def stamp(c: Column) -> Column:
    """Time of the first 14 digits, null if there are none."""
    return F.try_to_timestamp(F.left(c, F.lit(14)), F.lit("yyyyMMddHHmmss"))


def publication_time(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(r"^\d{14}$"), stamp(s)).otherwise(s.try_cast("timestamp"))


def language_code(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.rlike(r"^\p{L}{2}$"), s).otherwise(
        F.element_at(literal_map(fixed.LANGUAGES), F.nullif(s, F.lit("")))
    )


def period_struct(day: Column, kind: str) -> Column:
    """(period_type, period_start, period_end) of a day: its month, its week from Monday, or itself."""
    start = {"monthly": F.trunc(day, "MM"), "weekly": F.date_trunc("week", day).cast("date"), "daily": day}[kind]
    end = {
        "monthly": F.last_day(day), "weekly": F.date_add(F.date_trunc("week", day).cast("date"), 6), "daily": day
    }[kind]
    return F.struct(F.lit(kind).alias("period_type"), start.alias("period_start"), end.alias("period_end"))


def theme_label(theme: Column, label: Column | None = None) -> Column:
    """The dictionary's label, else the code with words capitalised."""
    made = F.initcap(F.lower(F.replace(theme, F.lit("_"), F.lit(" "))))
    return made if label is None else F.coalesce(label, made)


def tone_class(tone: Column) -> Column:
    return F.when(
        tone.isNull(), "unknown"
    ).when(tone < -4, "hostile").when(tone < -1, "negative").when(tone <= 1, "neutral").when(tone <= 4, "positive").otherwise("celebratory")


def bar_class(tone: Column) -> Column:
    """Colour class of a timeline bar."""
    return F.when(
        tone.isNull(), "none"
    ).when(tone < -3, "hostile").when(tone < -1, "negative").when(tone <= 1, "neutral").otherwise("positive")


def concentration_class(top_share: Column) -> Column:
    return F.when(
        top_share > 0.45, "dominated"
    ).when(top_share > 0.30, "led").when(top_share > 0.15, "anchored").otherwise("scattered")


def known_level(level: Column) -> Column:
    return F.when(level.isin(fixed.LEVELS), level).otherwise("neutral")


def is_generic(theme: Column) -> Column:
    """An exact generic theme or one below it, unless a specific prefix overrides."""
    specific = F.lit(False)
    for p in fixed.SPECIFIC_PREFIXES:
        specific = specific | theme.startswith(p)
    generic = theme.isin(fixed.GENERIC_THEMES)
    for g in fixed.GENERIC_THEMES:
        generic = generic | theme.startswith(f"{g}_")
    return F.coalesce(~specific & generic, F.lit(False))


def anniversary(day: Column) -> Column:
    """Name of the observance that falls on a day, null for other days."""
    names = literal_map({f"{m}-{d}": name for (m, d), name in fixed.ANNIVERSARIES.items()})
    return F.element_at(names, F.concat_ws("-", F.month(day), F.dayofmonth(day)))


def source_country(raw: Column, fallback: Column, code_system: str = "mixed") -> Column:
    """Two-letter codes stay for the country join; longer text gives way to the queried country."""
    code = F.upper(F.trim(raw))
    return F.when(F.length(code) == 2, code).otherwise(fallback)


def json_outlets(c: Column, most: int = 5) -> Column:
    return F.slice(F.from_json(c, "array<struct<domain:string,count:bigint>>"), 1, most)


def json_themes(c: Column, most: int = 10) -> Column:
    """Themes of a JSON object, by count; or of an array, as it stands."""
    by_count = F.array_sort(
        F.map_entries(F.from_json(c, "map<string,bigint>")), lambda a,
        b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(
            a["key"] < b["key"], -1
        ).otherwise(1)
    )
    listed = F.transform(
        F.from_json(c, "array<struct<theme:string,count:bigint>>"),
        lambda x: F.struct(x["theme"].alias("key"), x["count"].alias("value"))
    )
    return F.slice(F.when(F.ltrim(c).startswith("{"), by_count).otherwise(listed), 1, most)
