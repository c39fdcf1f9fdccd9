"""Decision tables, order independence and equivalences of the library's own operators."""

import datetime as dt
import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mediapulse.functions import fixed, text
from mediapulse.operators import activity, claims, classify, clusters, coordination, gates, resolve, rollup, trends
from mediapulse.operators.graph import connected_components, scratch_path
from mediapulse.plans import driver, views
from mediapulse.plans.stream_queries import write_drop
from mediapulse.sources import articles, dims, gkg, keyed, schemas, sinks, slices
from mediapulse.streaming import jobs


def column(spark, expr, values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


HOSTS = {
    "https://rt.com/article/123": "rt.com", "http://www.rt.com/": "rt.com", "m.rt.com": "m.rt.com",
    "rt.com:443": "rt.com", "rt.com.": "rt.com", "rt.com?utm=foo": "rt.com", "rt.com#x": "rt.com",
    "  RT.COM  ": "rt.com",
    "user:pass@rt.com/x": "rt.com", "https://u@www.rt.com": "rt.com", "rt.com/@handle": "rt.com",
    "a..b.com": "a.b.com", ".rt.com": "rt.com", "tass.ru": "tass.ru", "": "", None: "", "   ": "",
    "HTTPS://WWW.Xinhua.NET:8080/a?b#c": "xinhua.net", "www.www.com": "www.com",
}


def test_host_names(spark):
    assert column(spark, text.host, list(HOSTS)) == list(HOSTS.values())


def test_parents_and_single_labels(spark):
    assert column(spark, lambda c: text.parents(c), ["a.b.c", "com", ""]) == [["a.b.c", "b.c"], [], []]
    assert column(spark, lambda c: text.parents(c, 1), ["a.b", "com"]) == [["a.b", "b"], ["com"]]


def test_theme_lists_tones_titles_times(spark):
    assert column(spark, text.theme_list, ["B; A;;B ", None, ";"]) == [["A", "B"], [], []]
    assert column(spark, text.mixed_theme_list, ["b;a,c;b", "x, y,X", " one ", None]) == [
        ["B", "A,C"], ["X", "Y"], ["ONE"], []
    ]
    assert column(spark, text.first_tone, ["-3.2,1", "garbled,1", "", None]) == [-3.2, None, None, None]
    assert column(spark, text.page_title, ["<page_title> a &amp;lt; b &#39;c&quot; </PAGE_TITLE>", "none", None]) == [
        "a < b 'c\"", None, None
    ]
    assert column(spark, text.stamp, ["20260409120000-0", "2026", None]) == [dt.datetime(2026, 4, 9, 12), None, None]
    assert column(spark, text.language_code, ["Chinese", "RU", " de ", "Klingon", "", None]) == [
        "zh", "ru", "de", None, None, None
    ]
    assert column(
        spark, text.is_generic, ["TERROR", "TERROR_X", "TERRORS", "WB_2024_ANTI_ELECTION", "ELECTION_FRAUD", None]
    ) == [True, True, False, False, True, False]


@pytest.mark.parametrize(
    "day,month,week",
    [
        ("2026-12-31", ("2026-12-01", "2026-12-31"), ("2026-12-28", "2027-01-03")),
        ("2024-02-29", ("2024-02-01", "2024-02-29"), ("2024-02-26", "2024-03-03")),
        ("2026-04-06", ("2026-04-01", "2026-04-30"), ("2026-04-06", "2026-04-12")),
        ("2026-04-05", ("2026-04-01", "2026-04-30"), ("2026-03-30", "2026-04-05"))
    ]
)
def test_periods(spark, day, month, week):
    d = F.lit(day).cast("date")
    r = spark.range(1).select(
        text.period_struct(d, "monthly").alias("m"), text.period_struct(d, "weekly").alias("w"),
        text.period_struct(d, "daily").alias("d")
    ).first()
    assert (
        str(r.m.period_start), str(r.m.period_end)
    ) == month and (str(r.w.period_start), str(r.w.period_end)) == week and str(r.d.period_start) == day


DEVIATIONS = [
    # today, mean, std, days -> ratio, z, level, confidence
    (130, 100.0, 10.0, 30, 1.3, 3.0, "red", "HIGH"), (120, 100.0, 10.0, 21, 1.2, 2.0, "orange", "HIGH"),
    (115, 100.0, 10.0, 20, 1.15, 1.5, "amber", "MEDIUM"), (100, 100.0, 10.0, 7, 1.0, 0.0, "neutral", "MEDIUM"),
    (70, 100.0, 20.0, 30, 0.7, -1.5, "coolGray", "HIGH"),
    (20, 100.0, 30.0, 30, 0.2, -2.667, "deepBlue", "HIGH"), (45, 100.0, 30.0, 30, 0.45, -1.833, "steelBlue", "HIGH"),
    (50, 10.0, 0.0, 30, 5.0, 10.0, "red", "HIGH"), (10, 10.0, 0.0, 30, 1.0, 0.0, "neutral", "HIGH"),
    (5, 10.0, 0.0, 30, 0.5, -10.0, "deepBlue", "HIGH"),
    (0, 0.0, 0.0, 30, 0.0, 0.0, "neutral", "HIGH"), (4, 0.0, 0.0, 30, 4.0, 10.0, "red", "HIGH"),
    (99, 1.0, 1.0, 6, 1.0, 0.0, "neutral", "LOW"),
]


def test_deviation_table(spark):
    rows = spark.createDataFrame(
        [(k, *r[:4]) for k, r in enumerate(DEVIATIONS)],
        "k int, today_count long, baseline_mean double, baseline_std double, days_sampled long"
    )
    got = activity.with_deviation(rows).orderBy("k").collect()
    assert [(r.deviation_ratio, r.z_score, r.level, r.confidence) for r in got] == [r[4:] for r in DEVIATIONS]


@pytest.mark.parametrize("zero_fill", [True, False])
def test_baseline_is_the_days_before(spark, zero_fill):
    days = {dt.date(2026, 1, 1) + dt.timedelta(k): (k * 7) % 5 for k in range(50) if k % 6}
    daily = spark.createDataFrame(
        [("RU", "DOMESTIC", d, n) for d, n in days.items()],
        "country string, audience_type string, date date, today_count long"
    ).repartition(5)
    rows = activity.with_baseline(activity.zero_filled(daily) if zero_fill else daily).collect()
    first, last = min(days), max(days)
    assert len(rows) == ((last - first).days + 1 if zero_fill else len(days))
    for r in rows:
        window = [r.date - dt.timedelta(k) for k in range(1, 31)]
        own = [days.get(d, 0) for d in window if (first <= d if zero_fill else d in days)]
        mean = sum(own) / len(own) if own else 0.0
        std = math.sqrt(sum((x - mean) ** 2 for x in own) / len(own)) if own else 0.0
        assert r.days_sampled == len(own) and abs(r.baseline_mean - mean) <= 0.0051 and abs(
            r.baseline_std - std
        ) <= 0.0051


CLASSES = [
    # domain, language, country, outlet -> audience, confidence
    ("a.com", "ru", "RU", "DIASPORA", "DIASPORA", 0.95), ("a.ru", "ru", "RU", None, "DOMESTIC", 0.433),
    ("x.vk.com", "ru", "RU", None, "DOMESTIC", 0.683), ("nohost", "ru", "RU", None, "DOMESTIC", 0.333),
    ("a.com", "en", "RU", None, "INTERNATIONAL", 0.444),
    ("a.xyz", "de", "RU", None, "DIASPORA", 0.311), ("t.me", "", "RU", None, "UNKNOWN", 0.0),
    ("tiktok.com", "en", "CN", None, "INTERNATIONAL", 0.756), ("a.xyz", "en", "ZZ", None, "UNKNOWN", 0.0),
    (None, None, None, None, "UNKNOWN", 0.0),
]


def test_classifier_table(spark):
    rows = spark.createDataFrame(
        [(k, *r[:4]) for k, r in enumerate(CLASSES)],
        "k int, source_domain string, source_language string, source_country string, outlet_audience string"
    )
    countries = spark.createDataFrame([("RU", ["ru"]), ("CN", ["zh"])], "iso2 string, official_languages array<string>")
    got = classify.classified(rows, countries).orderBy("k").collect()
    assert [(r.audience_type, r.confidence) for r in got] == [(r[4], r[5]) for r in CLASSES]


@pytest.mark.parametrize(
    "names,score",
    [
        (["CN", "RU"], 0.55), (["CN", "IR", "RU"], 0.9), (["BR", "ZA"], 0.25), (["BR", "CN", "RU"], 0.7),
        (["BR", "DE", "ES", "FR"], 0.55), (["BR", "CN", "IR", "RU", "ZA"], 0.85)
    ]
)
def test_coordination_score(spark, names, score):
    assert spark.range(1).select(F.round(coordination.score(F.array(*map(F.lit, names))), 3)).first()[0] == score


def test_events_need_two_countries_and_order_does_not_matter(spark):
    rows = [
        ("RU", "DOMESTIC", "T", 3.0), ("RU", "INTERNATIONAL", "T", 2.5), ("CN", "DOMESTIC", "T", 2.0),
        ("RU", "DOMESTIC", "ALONE", 9.0), ("IR", "DOMESTIC", "T", 1.9)
    ]
    found = [
        Row(
            date=dt.date(2026, 5, 9), country=c, audience_type=a, theme=t, article_count=5, baseline=1.0, ratio=r
        ) for c,
        a, t, r in rows
    ]
    one, two = (coordination.detect(spark.createDataFrame(x)).collect() for x in (found, found[::-1]))
    assert one == two and len(one) == 1 and one[0].countries == ["CN", "RU"] and [
        d.country for d in one[0].details
    ] == ["CN", "RU", "RU"] and one[0].coordination_score == 0.55
    (v,) = claims.coordination_verdicts(spark.createDataFrame(one)).collect()
    assert v.verdict == "SUPPRESS" and len(v.hypotheses) == 5 and v.verdict_reason == "strong alternative: Victory Day"
    later = spark.createDataFrame(one).withColumn("date", F.lit("2026-05-10").cast("date"))
    (v,) = claims.coordination_verdicts(later).collect()
    assert (v.verdict, v.claim_confidence, v.quality_score) == ("PUBLISH_WITH_CAVEAT", 0.385, 0.495)


VERDICTS = [
    (3, "red", "LOW", "PUBLISH_WITH_CAVEAT", 0.4), (10, "red", "MEDIUM", "PUBLISH_WITH_CAVEAT", 0.6),
    (10, "neutral", "MEDIUM", "PUBLISH", 0.65), (25, "red", "HIGH", "PUBLISH", 0.95),
    (25, "deepBlue", "LOW", "SUPPRESS", 0.2), (25, "red", "MEDIUM", "PUBLISH_WITH_CAVEAT", 0.6)
]


def test_deviation_verdicts(spark):
    rows = spark.createDataFrame(
        [(k, *r[:3], 1.0, 1.0, 5.0, 1.0) for k, r in enumerate(VERDICTS)],
        "k int, days_sampled long, level string, confidence string, deviation_ratio double, z_score double, baseline_mean double, baseline_std double"
    )
    assert [(r.verdict, r.claim_confidence) for r in claims.deviation_verdicts(rows).orderBy("k").collect()] == [
        r[3:] for r in VERDICTS
    ]


def test_gates_count_each_rule(spark):
    rows = spark.createDataFrame(
        [
            ("RU", "DOMESTIC", "monthly", "2026-04-01", "2026-04-30", "T", 5, 10, 0.5),
            ("us", "HOME", "monthly", "2026-04-02", "2026-04-01", "T", -1, 10, 1.5),
            ("RU", None, "weekly", "2026-04-07", "soon", "T", 1, 1, None)
        ],
        "country string, audience_type string, period_type string, period_start string, period_end string, theme string, article_count int, bucket_total int, share double"
    )
    got = {r.rule: r.rows for r in gates.violations(rows, gates.theme_rules()).collect()}
    assert got == {
        "audience_type": 2, "negative_count": 1, "share": 2, "date_format": 1, "date_order": 1, "excluded_country": 1,
        "alignment": 2, "theme_size": 0
    }
    assert len(gates.samples(rows, gates.theme_rules()).collect()) == 2
    assert gates.volume_gate(rows, 2).first().passed is False and gates.forward_dated(
        rows, "2026-04-01"
    ).first()[0] == 2
    with pytest.raises(ValueError, match="lacks the columns x"):
        schemas.require_columns(rows, ["x", "share"])
    spots = spark.createDataFrame([("a.ru", "DOMESTIC"), ("b.ru", "DOMESTIC")], "domain string, audience_type string")
    assert [r.passed for r in gates.outlet_checks(spots.limit(1), spots).orderBy("domain").collect()] == [True, False]


def test_rollup_of_days_equals_direct_counts_in_any_order(spark):
    rows = [
        (
            f"r{k}", dt.datetime(2026, 4, 1) + dt.timedelta(hours=7 * k), "RU" if k % 3 else "CN", "DOMESTIC",
            ["A", "B"] if k % 2 else (["A"] if k % 5 else []), float(k % 4) if k % 7 else None
        ) for k in range(90)
    ]
    table = spark.createDataFrame(
        rows,
        "record_id string, date timestamp, country string, audience_type string, themes array<string>, tone double"
    )
    got = sorted(map(tuple, rollup.theme_rollup(table, ("weekly", "monthly")).collect()), key=str)
    assert got == sorted(
        map(tuple, rollup.theme_rollup(table.repartition(7).orderBy(F.rand(1)), ("weekly", "monthly")).collect()),
        key=str
    )
    april = {r[5]: r for r in got if r[0] == "RU" and r[2] == "monthly" and str(r[3]) == "2026-04-01"}
    ru = [r for r in rows if r[2] == "RU" and r[1].month == 4]
    tones = [r[5] for r in ru if "A" in r[4] and r[5] is not None]
    assert april["A"][6:9] == (
        sum("A" in r[4] for r in ru), len(ru), round(sum("A" in r[4] for r in ru) / len(ru), 4)
    ) and april["A"][9] == pytest.approx(sum(tones) / len(tones))
    assert rollup.theme_rollup(table.limit(0)).count() == 0


def test_resolution_prefers_the_longest_parent(spark):
    outlets = spark.createDataFrame(
        [("rt.com", "RU", "INTERNATIONAL"), ("russian.rt.com", "RU", "DOMESTIC"), ("ru", "RU", "DOMESTIC")],
        "domain string, country string, audience_type string"
    )
    hosts = spark.createDataFrame(
        [("https://www.russian.rt.com/x",), ("de.rt.com",), ("tass.ru",), (None,), ("other.org",)],
        "raw_domain string"
    )
    assert {(r.raw_domain, r.domain) for r in resolve.with_outlet(hosts, outlets).collect()} == {
        ("https://www.russian.rt.com/x", "russian.rt.com"), ("de.rt.com", "rt.com")
    }
    assert resolve.with_outlet(hosts, outlets, least=1).count() == 3 and resolve.with_outlet(
        hosts, outlets, keep_all=True
    ).count() == 5


@pytest.mark.parametrize("least,keep_all", [(1, False), (2, True), (2, False)])
def test_suffix_lookups_equal_the_join_of_parents(spark, least, keep_all):
    rng = random.Random(6)
    name = lambda n: ".".join(rng.choice(["a", "b", "c", "co", "uk"]) for _ in range(n))
    domains = sorted({name(rng.randint(1, 5)) for _ in range(60)})
    outlets = spark.createDataFrame([(x, f"C{k}", k) for k, x in enumerate(domains)], "domain string, country string, rank int")
    hosts = [(k, name(rng.randint(1, 6)), "x") for k in range(400)] + [(900, None, "x"), (901, "", "x"), (902, "http://u@.a..b./p", "x")]
    rows = spark.createDataFrame(hosts, "id int, raw_domain string, country string")
    walked = resolve.with_outlet(rows, outlets, least=least, keep_all=keep_all)
    joined = resolve.with_outlet(rows, outlets, least=least, keep_all=keep_all, small=0)
    columns = ["id", "raw_domain", "domain", "country", "rank"]
    results = [sorted(map(tuple, x.select(*columns).collect()), key=str) for x in (walked, joined)]
    assert results[0] == results[1] and len(results[0]) > 100
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_zip_slices(spark, tmp_path):
    line = "\t".join(
        [
            "20260409120000-0", "20260409120000", "1", "Tass.ru", "https://tass.ru/1", "", "", "A;B", *[""] * 7,
            "-3.2,1", *[""] * 10, "<PAGE_TITLE>T</PAGE_TITLE>"
        ]
    )
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a.csv", line.encode() + b"\n\xff short\n")
        z.writestr("b.csv", "never read")
    (tmp_path / "a.zip").write_bytes(good.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    raw = gkg.read_zips(spark, str(tmp_path))
    rows = gkg.parse_lines(raw)
    (r,) = rows.collect()
    assert (r.raw_domain, r.themes, r.tone, r.title, r.date) == (
        "tass.ru", ["A", "B"], -3.2, "T", dt.datetime(2026, 4, 9, 12)
    )
    assert gkg.file_counters(raw, rows).first().asDict() == {
        "files": 2, "skipped": 1, "lines": 2, "rows": 1, "articles": 1
    }
    (tmp_path / "x.csv").write_text(line + "\n")
    assert gkg.read_text(spark, str(tmp_path / "x.csv")).count() == 1


def test_slices(spark):
    assert [r.file_name for r in gkg.slices_in_lookback(spark, "2026-04-09 12:10:00").orderBy("slice").collect()] == [
        f"20260409{t}00.gkg.csv" for t in ("1100", "1115", "1130", "1145", "1200")
    ]
    assert gkg.slices_in_lookback(spark, "2026-04-09 12:06:00", 75, 7).count() == 4
    assert gkg.slices(spark, "2026-04-09 00:00:00", "2026-04-09 23:45:00").count() == 96


def test_article_lists_and_fallback(spark):
    rows = spark.createDataFrame(
        [
            (
                f"u{k % 4}", "t", "20260409120000", "www.A.ru", "Russian", "RS" if k % 2 else "RUSSIA", "RU",
                "primary" if k < 2 else "fallback"
            ) for k in range(6)
        ],
        "url string, title string, seendate string, domain string, language string, sourcecountry string, query_country string, source_kind string"
    )
    countries = spark.createDataFrame([("RU", "RS"), ("RS", "RI")], "iso2 string, fips string")
    clean = articles.with_iso_country(articles.article_rows(rows), countries)
    assert {(r.source_country, r.source_language, r.source_domain, r.tone) for r in clean.collect()} == {
        ("RS", "ru", "a.ru", 0.0), ("RU", "ru", "a.ru", 0.0)
    }
    assert articles.with_fallback(clean, ["RU"]).count() == 4 and articles.with_fallback(
        clean, ["RU"], least=2
    ).count() == 2 and articles.with_fallback(clean, ["CN"]).count() == 2
    volumes = spark.createDataFrame(
        [("a", "2026-04-09", "12"), ("a", "bad", "1"), ("a", "2026-04-10", "x")],
        "domain string, datetime string, `Volume Raw` string"
    )
    assert [tuple(r) for r in articles.volume_rows(volumes).collect()] == [("a", dt.date(2026, 4, 9), 12)]


def test_dimensions(spark, tmp_path):
    (tmp_path / "o.json").write_text(
        '{"outlets": [{"domain": "WWW.A.ru", "country": "ru", "audience_type": "domestic"}, {"domain": "b.com", "country": "US", "audience_type": "DOMESTIC"}, {"domain": "a.ru", "country": "RU", "audience_type": "DIASPORA"}, {"domain": null, "country": "RU", "audience_type": "DOMESTIC"}, {"domain": "c.ru", "country": "RU", "audience_type": "ALL"}]}'
    )
    assert [
        (r.domain, r.country, r.audience_type, r.confidence) for r in dims.read_outlets(
            spark, str(tmp_path / "o.json")
        ).collect()
    ] == [("a.ru", "RU", "DIASPORA", 1.0)]
    (tmp_path / "c.json").write_text(
        '{"countries": {"RU": {"fips": "RS", "iso2": "RU", "official_languages": ["ru"]}, "RS": {"fips": "RI", "iso2": "RS"}}}'
    )
    countries = dims.read_countries(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in dims.fips_index(countries).collect()} == {("RS", "RU"), ("RI", "RS")}
    (tmp_path / "t.json").write_text('{"themes": {"A": {"label": "Alpha", "description": "d"}}}')
    assert [
        tuple(r) for r in dims.read_theme_labels(spark, str(tmp_path / "t.json")).collect()
    ] == [("A", "Alpha", "d")]


def test_upserts_are_idempotent(spark, tmp_path):
    shape, path = "date date, country string, n long", str(tmp_path / "t")
    one = spark.createDataFrame(
        [(dt.date(2026, 1, 1), "RU", 1), (dt.date(2026, 1, 1), "CN", 2), (dt.date(2026, 1, 2), "RU", 3)], shape
    )
    two = spark.createDataFrame(
        [(dt.date(2026, 1, 1), "RU", 7), (dt.date(2026, 1, 1), "RU", 9), (dt.date(2026, 1, 3), "RU", 4)], shape
    )
    for new in (one, two, two):
        sinks.write_upsert(new, path, ["date", "country"], "date", [F.desc("n")])
    got = sorted((str(r.date), r.country, r.n) for r in spark.read.parquet(path).collect())
    assert got == [("2026-01-01", "CN", 2), ("2026-01-01", "RU", 9), ("2026-01-02", "RU", 3), ("2026-01-03", "RU", 4)]
    sinks.export(one, str(tmp_path / "e"), {"run": "x"}, ["date"])
    assert sinks.reload(spark, str(tmp_path / "e")).count() == 3 and spark.read.json(
        str(tmp_path / "e/metadata")
    ).first().rows == 3
    sinks.export(one.limit(0), str(tmp_path / "f"), {})
    with pytest.raises(Exception, match="no rows|UNABLE_TO_INFER"):
        sinks.reload(spark, str(tmp_path / "f"))
    assert sinks.public_columns(
        one.withColumn("_x", F.lit(1)).withColumn("verdict_reason", F.lit("y" * 5000))
    ).select(F.length("verdict_reason")).first()[0] == 4096
    assert sinks.replaced_periods(
        one.withColumnRenamed("date", "period_start"), two.withColumnRenamed("date", "period_start"), ["period_start"]
    ).count() == 4


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100 + k, 101) for k in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 130)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_against_all_pairs(spark):
    words = "summit leaders border talks grain export missile drill election court".split()
    rng = random.Random(2)
    titles = [
        (
            k, " ".join(rng.choice(words[: 4 + k % 7]) for _ in range(4 + k % 3)),
            dt.datetime(2026, 1, 1) + dt.timedelta(hours=5 * k), ["x", f"e{k % 3}"] if k % 4 else []
        ) for k in range(40)
    ]
    titles += [
        (40 + k, titles[k % 3][1], titles[k % 3][2] + dt.timedelta(hours=7 * k), titles[k % 3][3]) for k in range(12)
    ] + [(60 + k, "the of and", titles[0][2], ["x"]) for k in range(2)]
    at = {t[0]: t for t in titles}
    table = spark.createDataFrame(titles, "id long, title string, at timestamp, entities array<string>")
    vectors = clusters.title_vectors(table)
    v = {}
    for r in vectors.collect():
        v.setdefault(r.id, {})[r.term] = r.w
    dot = lambda a, b: sum(w * v[b].get(t, 0) for t, w in v[a].items())
    near = lambda a, b: abs((at[a][2] - at[b][2]).total_seconds()) <= 86400
    want = {(a, b) for a in v for b in v if a < b and near(a, b) and dot(a, b) >= 0.3}
    assert {(r.a, r.b) for r in clusters.similar_pairs(vectors, table, 0.3).collect()} == want and want
    overlap = lambda a, b: len(set(at[a][3]) & set(at[b][3])) / len(
        set(at[a][3]) | set(at[b][3])
    ) if at[a][3] and at[b][3] else 0
    edges = [
        (a, b) for a in v for b in v if a < b and near(a, b) and dot(a, b) >= 0.05 and dot(a, b) + 0.3 * overlap(a, b) >= 0.35
    ]
    low = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {r.id: r.cluster for r in clusters.event_clusters(table).collect()} == low and len(set(low.values())) > 1


def test_contradiction_score(spark):
    rows = spark.createDataFrame(
        [(1, 0, "RU", "DOMESTIC", 4.0), (2, 0, "RU", "INTERNATIONAL", -4.0), (3, 1, "RU", "DOMESTIC", 1.0)],
        "id long, cluster long, country string, audience_type string, tone double"
    )
    vectors = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0)], "id long, term string, w double")
    (r,) = clusters.contradictions(rows, vectors).collect()
    assert (r.cluster, r.score, r.significant, r.severity) == (0, 0.7, True, "MAJOR")


SERIES = {
    "EMERGING": [0] * 54 + [2, 5, 8, 9, 9, 9], "SURGING": [5] * 20 + [6, 8, 10, 12, 14, 16, 18, 20, 22, 24],
    "DECLINING": [20] * 20 + [16, 14, 12, 10, 8, 6, 4, 2, 1, 0], "STABLE": [5] * 30, "INSUFFICIENT_DATA": [1] * 10,
    "FADED": [9] * 40 + [0] * 16,
    "PEAKED": [5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 7, 9, 7, 5, 5],
}


def test_lifecycle_stages(spark):
    rows = [(s, "t", dt.date(2026, 1, 1) + dt.timedelta(k), n) for s, xs in SERIES.items() for k, n in enumerate(xs)]
    got = {
        r.country: r.stage for r in trends.lifecycle(
            spark.createDataFrame(rows, "country string, theme string, date date, n long")
        ).collect()
    }
    assert got == {s: s for s in SERIES}


def test_narrative_paragraph(spark):
    shape = "country string, audience_type string, period_type string, period_start date, theme string, article_count long, share double, avg_tone double"
    themes = (("ARMED_CONFLICT", 8), ("TAX", 4), ("OIL", 2), ("GAS", 1), ("ART", 1))
    rows = spark.createDataFrame(
        [("RU", "DOMESTIC", "monthly", dt.date(2026, 4, 1), t, n, n / 20, -5.0) for t, n in themes], shape
    )
    rows = rows.union(
        spark.createDataFrame(
            [("CN", "INTERNATIONAL", "monthly", dt.date(2026, 4, 1), t, 1, 0.05, None) for t in ("A", "B", "C", "D")],
            shape
        )
    )
    empty = spark.createDataFrame(
        [("SY", "DOMESTIC", "monthly", dt.date(2025, 1, 1))],
        "country string, audience_type string, period_type string, period_start date"
    )
    said = {r.country: r.narrative for r in views.narratives(rows, rows.select(*empty.columns).union(empty)).collect()}
    assert said["RU"] == (
        "RU domestic, 2026-04-01: 5 themes. First Armed Conflict 40%, Tax 20%, Oil 10%; "
        "together 70% of articles (dominated), tone hostile. Then Art, Gas."
    )
    assert said["CN"].endswith("together 15% of articles (scattered), tone unknown. Then D.")
    assert said["SY"] == "SY domestic, 2025-01-01: 0 themes."
    assert views.narratives(rows).count() == 2


def test_views_and_json(spark):
    top = spark.createDataFrame(
        [('{"B": 2, "A": 2, "C": 9}', '[{"domain": "x", "count": 3}]'), ('[{"theme": "Z", "count": 1}]', None)],
        "t string, o string"
    ).select(text.json_themes(F.col("t"), 2).alias("t"), text.json_outlets(F.col("o")).alias("o")).collect()
    assert [x.key for x in top[0].t] == ["C", "A"] and top[0].o[0].domain == "x" and top[1].t[0].key == "Z"
    countries = spark.createDataFrame(
        [("RU", "Russia", "East"), ("CN", "China", "Asia")], "iso2 string, name string, region string"
    )
    assert [
        r.iso2 for r in views.country_search(countries, "RU").collect()
    ] == ["RU"] and views.country_search(countries, "").count() == 2
    assert (
        views.in_regions(countries, None).count(), views.in_regions(countries, []).count(),
        views.in_regions(countries, ["Asia"]).count()
    ) == (2, 0, 1)


def brute_edges(titles, least=0.35, boost=0.3, hours=24):
    """titles: {id: (vector, entities, seconds)}"""
    found = set()
    for a, (va, ea, ta) in titles.items():
        for b, (vb, eb, tb) in titles.items():
            if a < b and abs(ta - tb) <= hours * 3600 and set(va) & set(vb):
                sim = sum(w * vb.get(t, 0) for t, w in va.items())
                overlap = len(ea & eb) / len(ea | eb) if ea and eb else 0
                if sim + boost * overlap >= least and sim >= least - boost:
                    found.add((a, b))
    return found


def test_boosted_pairs_are_few_and_lose_none(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(260):
        title = " ".join(rng.choice(words[: rng.choice([4, 60])]) for _ in range(rng.randint(3, 9)))
        size = rng.choice([0, 1, 2, 2, 3, 5])
        entities = [rng.choice(["lang", "lang", "x", "y", "z", "q"]) for _ in range(size)]
        rows.append((k, title, dt.datetime(2026, 4, 1) + dt.timedelta(minutes=rng.randrange(4000)), sorted(set(entities))))
    table = spark.createDataFrame(rows, "id long, title string, at timestamp, e array<string>")
    vectors = clusters.title_vectors(table).persist()
    by = {r[0]: {} for r in rows}
    for r in vectors.collect():
        by[r.id][r.term] = r.w
    want = brute_edges({r[0]: (by[r[0]], set(r[3]), r[2].timestamp()) for r in rows})
    pairs = clusters.similar_pairs(vectors, table, 0.35, 24, "id", table.select("id", "e"), 0.3).collect()
    sets = {r[0]: set(r[3]) for r in rows}
    overlap = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert {(r.a, r.b) for r in pairs if r.sim + 0.3 * overlap(r.a, r.b) >= 0.35} == want
    spans = clusters._spans(table, 24, "id")
    found = clusters.boosted_pairs(vectors, spans, table.select("id", "e"), 0.35, 0.3, 24, "id").count()
    single = clusters._prefixes(vectors, 0.05, "id").join(table.select("id", F.explode("e").alias("entity")), "id")
    before = clusters._meeting(single.withColumn("p", F.lit(0)).join(spans, "id"), ["entity", "term"], 24, "id", 0.0).count()
    assert 4 * found < before, (found, before)


def test_late_duplicates_do_not_change_the_stream(spark, sf):
    folder = scratch_path(spark, "late")
    rows = driver.raw_articles(spark, sf).where("country <> 'UK'")
    write_drop(rows, f"{folder}/drop", 4)
    rows.sample(0.2, seed=1).coalesce(1).write.mode("append").parquet(f"{folder}/drop")  # read a second time, late
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/drop")
    jobs.start_rollup(stream, f"{folder}/store", f"{folder}/table", f"{folder}/check").awaitTermination()
    key = ["country", "audience_type", "period_type", "theme", "article_count", "bucket_total"]
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/table").select(*key).collect()))
    assert got == sorted(
        map(
            tuple,
            rollup.theme_rollup(driver.articles(spark, sf), ("daily", "weekly", "monthly")).select(*key).collect()
        )
    )


def test_frozen_days_go_aside(spark, sf):
    folder = scratch_path(spark, "frozen")
    rows = driver.raw_articles(spark, sf)
    rows.coalesce(1).write.parquet(f"{folder}/drop")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/drop")
    jobs.start_rollup(
        stream, f"{folder}/store", f"{folder}/table", f"{folder}/check", ("daily",), frozen_before="2024-01-10"
    ).awaitTermination()
    assert spark.read.parquet(f"{folder}/store_late").count() == rows.where("date < '2024-01-10'").count()
    assert str(
        spark.read.parquet(f"{folder}/table").agg(F.min(F.col("period_start").cast("date"))).first()[0]
    ) >= "2024-01-10"


KEY = ["country", "audience_type", "period_type", "theme", "article_count", "bucket_total"]


def batch_themes(articles, periods=("daily", "weekly", "monthly")):
    return sorted(map(tuple, rollup.theme_rollup(rollup.dedup(articles), periods).select(*KEY).collect()))


def stream_themes(spark, folder):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/table").select(*KEY).collect()))


@pytest.mark.parametrize("step", ["_put_periods", "_drop_empty"])
def test_a_batch_that_dies_between_its_writes_is_not_added_twice(spark, sf, monkeypatch, step):
    folder = scratch_path(spark, "dies")
    rows = driver.raw_articles(spark, sf).where("country <> 'UK'")
    write_drop(rows, f"{folder}/drop", 3)
    calls, real = [], getattr(jobs, step)

    def dies(*args):
        calls.append(1)
        real(*args)
        if len(calls) == 3:
            raise RuntimeError("lost driver")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/drop")
        jobs.start_rollup(stream, f"{folder}/store", f"{folder}/table", f"{folder}/check").awaitTermination()

    monkeypatch.setattr(jobs, step, dies)
    with pytest.raises(Exception, match="lost driver"):
        run()
    monkeypatch.setattr(jobs, step, real)
    run()
    assert stream_themes(spark, folder) == batch_themes(rows)


def test_earlier_copies_that_come_later_take_over(spark):
    folder = scratch_path(spark, "earlier")
    day = lambda k: dt.datetime(2026, 4, k, 5)
    shape = "record_id long, date timestamp, domain string, url string, country string, audience_type string, themes array<string>, tone double"
    batches = [
        [(1, day(9), "a", "1", "RU", "DOMESTIC", ["X", "Y"], 1.0), (2, day(9), "a", "2", "RU", "DOMESTIC", ["X"], None)],
        [(3, day(3), "a", "1", "CN", "DOMESTIC", ["X"], 2.0), (4, day(9), "a", "2", "RU", "DOMESTIC", ["Z"], 3.0)],
        [(5, day(1), "a", "1", "RU", "DOMESTIC", [], -1.0), (6, None, "a", "9", "RU", "DOMESTIC", ["X"], 0.0)],
        [(1, day(9), "a", "1", "RU", "DOMESTIC", ["X", "Y"], 1.0), (7, day(1), None, None, "RU", "DOMESTIC", None, 1.0)],
    ]
    read = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(f"{folder}/drop")
        stream = spark.readStream.schema(shape).parquet(f"{folder}/drop")
        run = jobs.start_rollup(
            stream, f"{folder}/store", f"{folder}/table", f"{folder}/check", ("daily", "monthly"), min_count=1, parts=4
        )
        run.awaitTermination()
        read.append(run.lastProgress["numInputRows"])
        so_far = [r for b in batches[: k + 1] for r in b if r[1]]
        want = rollup.theme_rollup(rollup.dedup(spark.createDataFrame(so_far, shape)), ("daily", "monthly"), 1)
        want = sorted(map(tuple, want.select(*KEY, "avg_tone").collect()), key=str)
        got = spark.read.parquet(f"{folder}/table").select(*KEY, "avg_tone").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert read == [2, 2, 2, 2]


def test_articles_that_time_has_passed_are_forgotten():
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    clock = type("", (), {"now": 0, "getCurrentProcessingTimeInMs": lambda self: self.now})()
    first = jobs.FirstSeen(kept=100)
    first.state = Held()
    row = lambda url, date: {"domain": "d", "url": url, "date": date, "record_id": 1, "country": "RU", "audience_type": "DOMESTIC", "themes": ["é"], "tone": 1.5}
    feed = lambda *rows: [tuple(x) for x in first.handleInputRows((1,), iter(rows), clock)]
    assert [x[0] for x in feed(row("1", 5), row("1", 4), row("1", 6))] == [1]
    clock.now = 60
    assert [(x[0], x[3]) for x in feed(row("1", 3), row("2", 9))] == [(-1, 4), (1, 3), (1, 9)] and feed(row("1", 3)) == []
    clock.now = 165
    feed(row("3", 1))
    assert [x[1] for x in json.loads(first.state.value[0])] == ["3"]


def test_values_as_of_a_time(spark):
    at = lambda d, h=0: dt.datetime(2026, 4, d, h)
    history = [("a", at(2), 1.0), ("a", at(5, 12), 2.0), ("a", at(5, 18), 3.0), ("a", at(5, 18), 3.0), ("b", at(20), 9.0), (None, at(1), 7.0), ("a", None, 8.0)]
    rows = [(k, key, t) for k, (key, t) in enumerate([
        ("a", at(1)), ("a", at(2)), ("a", at(4, 23)), ("a", at(5, 12)), ("a", at(5, 13)), ("a", at(5, 18)), ("a", at(9)),
        ("b", at(9)), ("c", at(9)), (None, at(9)), ("a", None),
    ])]
    h = spark.createDataFrame(history, "key string, since timestamp, v double")
    r = spark.createDataFrame(rows, "id int, key string, at timestamp")
    want = [None, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0, None, None, 7.0, None]
    assert [x.v for x in activity.as_of(r, h, ["key"]).orderBy("id").collect()] == want
    assert activity.as_of(r.limit(0), h, ["key"]).count() == 0
    assert [x.v for x in activity.as_of(r, h.limit(0), ["key"]).collect()] == [None] * len(rows)


def test_keyed_tables_keep_the_old_state_until_the_new_one_is_whole(spark, monkeypatch):
    path = scratch_path(spark, "keyed")
    shape = "url string, n int, note string"
    put = lambda rows: keyed.upsert(spark.createDataFrame(rows, shape), path, ["url"], [F.desc("n")], buckets=16)
    now = lambda version=None: sorted(map(tuple, keyed.read(spark, path, version).collect()), key=str)
    put([(f"u{k}", k, "old") for k in range(200)] + [(None, 1, "null"), ("u3", 7, "wins")])
    first = now()
    assert ("u3", 7, "wins") in first and (None, 1, "null") in first and len(first) == 201
    real = keyed._commit
    monkeypatch.setattr(keyed, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver")))
    with pytest.raises(RuntimeError, match="lost driver"):
        put([("u1", 500, "new")])
    assert now() == first
    monkeypatch.setattr(keyed, "_commit", real)
    assert put([("u1", 500, "new"), (None, 2, "again"), ("v", 1, "added")]) <= 3
    after = now()
    assert {x for x in after if x not in first} == {("u1", 500, "new"), (None, 2, "again"), ("v", 1, "added")}
    assert len(after) == 202 and now(1) == first
    state = keyed.manifest(spark, path)
    with pytest.raises(RuntimeError, match="another writer"):
        keyed._commit(spark, path, state)
    with pytest.raises(ValueError, match="keys"):
        keyed.upsert(spark.createDataFrame([("a", 1, "x")], shape), path, ["n"])
    assert keyed.vacuum(spark, path) >= 2 and now() == after


def put_slice(folder, at, content):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", content)
    (folder / f"{at}.gkg.csv.zip").write_bytes(held.getvalue())
    return held.getvalue()


def test_the_slice_drop_waits_for_late_slices_and_counts_the_rest(spark, tmp_path):
    spark.dataSource.register(slices.SliceDrop)
    drop = tmp_path / "drop"
    drop.mkdir()
    whole = put_slice(drop, "20260409120000", "a\nb\u2028c\r\nd")
    put_slice(drop, "20260409121500", "")
    (drop / "20260409123000.gkg.csv.zip").write_bytes(whole[: len(whole) // 2])
    (drop / "20260409130000.gkg.csv.zip").write_bytes(whole[:40] + b"\xff\xff\xff" + whole[43:])

    def run(now):
        options = {"path": drop.as_uri(), "first": "2026-04-09T11:50:00", "now": now}
        stream = spark.readStream.format("slices").options(**options).load()
        writer = stream.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        writer.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(slices.SCHEMA).parquet(str(tmp_path / "out"))
        own = {f"{r.slice:%H%M}": (r.status, r.lines) for r in rows.where("status is not null").collect()}
        assert rows.where("status is not null").count() == len(own)
        return own, sorted(r.value for r in rows.where("value is not null").collect()), slices.counters(rows).first()

    base = {"1200": ("read", 3), "1215": ("read", 0), "1230": ("corrupt", 0)}
    assert run("2026-04-09T12:51:00")[0] == base  # 12:45 is not due before 12:52
    assert run("2026-04-09T13:08:00")[0] == base | {"1300": ("corrupt", 0)}
    put_slice(drop, "20260409124500", "late")
    own, values, _ = run("2026-04-09T13:08:00")
    assert own["1245"] == ("read", 1) and values == ["a", "b\u2028c", "d", "late"]
    put_slice(drop, "20260409131500", "on time")
    own, values, counts = run("2026-04-09T15:08:00")
    assert own["1315"] == ("read", 1) and own["1330"] == ("missing", 0) and "1345" not in own
    assert counts.asDict() == {"attempted": 7, "fetched": 4, "missing": 1, "errored": 2, "lines": 5}
    put_slice(drop, "20260409133000", "after its lookback")
    assert run("2026-04-09T15:08:00")[0] == own
    options = {"path": str(drop), "first": "2026-04-09T13:30:00", "last": "2026-04-09T13:45:00"}
    back = spark.read.format("slices").options(**options).load().collect()
    assert sorted((r.status or "", r.value or "") for r in back) == [("", "after its lookback"), ("missing", ""), ("read", "")]


def test_fixed_values_are_consistent():
    assert set(fixed.DIASPORA_LANGUAGES["RU"]) == {"de", "fr", "es", "he"} and len(fixed.LEVELS) == 7 and all(
        len(v) == 2 for v in fixed.LANGUAGES.values()
    )
