"""Articles on one event, and how a country's audiences hear of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .graph import connected_components, written


def title_vectors(articles: DataFrame, key: str = "id", title: str = "title", features: int | None = None) -> DataFrame:
    """(key, term, w): L2-normalised smoothed TF-IDF of the titles' words and word pairs without stop words.

    With `features` only the most frequent terms count; ties go to the smaller term.
    """
    words = articles.select(
        key,
        F.filter(
            F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 1
        ).alias("words")
    )
    clean = StopWordsRemover(
        inputCol="words", outputCol="clean", stopWords=fixed.STOP_WORDS, locale="en_US"
    ).transform(words)
    pairs = NGram(n=2, inputCol="clean", outputCol="pairs").transform(clean)
    counts = pairs.select(key, F.explode(F.concat("clean", "pairs")).alias("term")).groupBy(key, "term").agg(
        F.count("*").alias("tf")
    )
    n = articles.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_total"))
    if features:
        df = df.orderBy(F.desc("_total"), "term").limit(features)
    idf = df.join(F.broadcast(n), F.lit(True)).select(
        "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    raw = counts.join(idf, "term").select(key, "term", "df", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "df", (F.col("w") / norm).alias("w"))


#: A (term, bucket) with more vectors than this is dealt as pairs of parts of that size.
HOT = 2048


def _spans(times: DataFrame, hours: int, key: str) -> DataFrame:
    """(key, lo, hi, bucket): the span of each vector in seconds and the time bucket it begins in."""
    hi = F.unix_timestamp("until" if "until" in times.columns else "at")
    spans = times.select(key, F.unix_timestamp("at").alias("lo"), hi.alias("hi"))
    return spans.withColumn("bucket", F.floor(F.col("lo") / (hours * 3600)))


def _meeting(rows: DataFrame, on: list[str], hours: int, key: str, least: Callable | float) -> DataFrame:
    """(a, b) of rows(key, *on, rest, p, lo, hi, bucket) that agree in `on`, lie at most `hours` apart and may reach a
    cosine of `least`, a number or a function of both sides' p; each pair once.

    `rest` is the squared norm of a vector from the shared term on, so at the first term that two vectors share their cosine is at
    most the root of both rests' product. Spans reach at most two buckets ahead, so one side goes to five buckets and
    the other to its own. A group that holds more than HOT of the latter is cut into parts by hash, which the
    former go to as copies: no task gets a whole group, and every pair still meets in one place.
    """
    at = rows.withColumn(
        "bucket", F.explode(F.transform(F.array(*map(F.lit, range(-2, 3))), lambda k: F.col("bucket") + k))
    )
    parts = F.ceil(F.count("*") / HOT).cast("int").alias("parts")
    hot = rows.groupBy(*on, "bucket").agg(parts).where("parts > 1")
    n = F.coalesce("parts", F.lit(1))
    own = rows.join(hot, [*on, "bucket"], "left").withColumn("part", F.pmod(F.xxhash64(key), n).cast("int"))
    all_parts = F.explode(F.sequence(F.lit(0), n - 1))
    copied = at.join(hot, [*on, "bucket"], "left").withColumn("part", all_parts)
    side = lambda df, k: df.select(
        F.col(key).alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("lo", "hi", "rest", "p")), *on, "bucket", "part"
    )
    near = F.greatest(F.col("lo_a") - F.col("hi_b"), F.col("lo_b") - F.col("hi_a")) <= hours * 3600
    need = least(F.col("p_a"), F.col("p_b")) if callable(least) else F.lit(least)
    may = F.sqrt(F.col("rest_a") * F.col("rest_b")) >= need - 1e-9
    pairs = side(copied, "a").join(side(own, "b"), [*on, "bucket", "part"])
    return pairs.where((F.col("a") < F.col("b")) & near & may).select("a", "b").distinct()


def _prefixes(vectors: DataFrame, least: float, key: str) -> DataFrame:
    """(key, term, rest) of each vector's terms from rare to frequent, up to the point where the rest has a norm below
    `least`; rest is the squared norm from the term on."""
    order = Window.partitionBy(key).orderBy("df", "term")
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return vectors.withColumn("rest", rest).where(F.col("rest") >= least * least - 1e-9).select(key, "term", "rest")


#: Bounds of a cosine fall into classes of this width.
_STEP = 0.05


def boosted_pairs(
    vectors: DataFrame, spans: DataFrame, sets: DataFrame, least: float, boost: float, hours: int, key: str
) -> DataFrame:
    """(a, b) that may reach `least` by their cosine and `boost` times the overlap of their sets(key, e).

    What the cosine must reach follows from the overlap. Only equal sets go down to least - boost; they meet under the whole
    set and a term. Other sets of p and q members overlap by at most min / max, or (p - 1) / (p + 1) of equal
    size, so a pair has a bound of its own: it meets under a common member, a term and the class of that bound, with
    the prefixes that this class needs. Sets of one member each that differ have no overlap.
    """
    sets = sets.where(F.size("e") > 0).withColumn("p", F.size("e"))
    rows = _prefixes(vectors, least - boost, key).join(sets, key).join(spans, key)
    equal = _meeting(rows, ["e", "term"], hours, key, least - boost)

    def bound(p, q):
        smaller, larger = F.least(p, q), F.greatest(p, q)
        return least - boost * F.when(p == q, (p - 1) / (p + 1)).otherwise(smaller / larger)

    level = lambda x: F.floor(x / _STEP + 1e-6).cast("int")
    first = level(least - boost * F.col("p") / (F.col("p") + 1))
    last = F.least(level(F.sqrt("rest") + 1e-9), level(F.lit(least - 1e-4)))
    classes = rows.where(last >= first).withColumn("level", F.explode(F.sequence(first, last)))
    classes = classes.withColumn("entity", F.explode("e")).drop("e")
    meet = lambda p, q: F.when(level(bound(p, q)) == F.col("level"), bound(p, q)).otherwise(2.0)
    return equal.union(_meeting(classes, ["entity", "term", "level"], hours, key, meet)).distinct()


def _with_cosine(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    listed = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"))
    both = pairs.join(listed.toDF("a", "va"), "a").join(listed.toDF("b", "vb"), "b")
    value = lambda t: F.coalesce(F.element_at("va", t) * F.element_at("vb", t), F.lit(0.0))
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, t: s + value(t))
    return both.select("a", "b", dot.alias("sim"))


def similar_pairs(
    vectors: DataFrame, times: DataFrame, least: float, hours: int = 24, key: str = "id",
    sets: DataFrame | None = None, boost: float = 0.0,
) -> DataFrame:
    """(a, b, sim) of all pairs at most `hours` apart whose cosine is `least` or more, and of those that may reach it with
    `boost` times the overlap of their sets(key, e).

    times(key, at[, until]) gives moments, or spans no longer than `hours`, whose distance is that of their
    nearest ends. Terms stand from rare to frequent. What follows a vector's prefix has a norm below the bound,
    so a pair that reaches it shares a term of both sides' prefixes: only prefixes are joined, in neighbouring
    time buckets, and the pairs found take the exact product.
    """
    spans = _spans(times, hours, key)
    plain = _prefixes(vectors, least, key).withColumn("p", F.lit(0)).join(spans, key)
    pairs = _meeting(plain, ["term"], hours, key, least)
    if sets is not None:
        pairs = pairs.union(boosted_pairs(vectors, spans, sets, least, boost, hours, key)).distinct()
    return _with_cosine(pairs, vectors, key).where(F.col("sim") >= least - boost)


def event_clusters(
    articles: DataFrame, least: float = 0.35, boost: float = 0.3, hours: int = 24, features: int | None = None
) -> DataFrame:
    """(id, cluster) of articles(id, title, at, entities) that share an event with another one.

    An edge is a title cosine plus `boost` times the entities' overlap of `least` or more; the overlap alone
    never makes one: a pair reaches `least` by its titles alone, or has a common entity and a cosine of least - boost. Clusters are components of two or more,
    named by their smallest id. Articles with one title and the same entities inside half the time band are
    one vertex, a span from the first to the last of them, so a headline that everybody prints adds one
    vertex per half band and not a pair for every two articles.
    """
    rows = articles.select(
        "id", "title", "at",
        F.array_sort(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>")))).alias("e")
    )
    half = F.floor(F.unix_timestamp("at") / (hours * 1800))
    rows = rows.select("id", "title", "at", "e", half.alias("half"))
    groups = rows.groupBy("title", "e", "half").agg(
        F.min("id").alias("rep"), F.min("at").alias("at"), F.max("at").alias("until"), F.count("*").alias("n")
    )
    groups = written(groups, "headlines")
    vectors = title_vectors(articles, features=features).join(
        groups.select(F.col("rep").alias("id")), "id", "left_semi"
    )
    vectors = written(vectors, "title_vectors")
    sets = groups.select(F.col("rep").alias("id"), "e")
    times = groups.select(F.col("rep").alias("id"), "at", "until")
    pairs = similar_pairs(vectors, times, least, hours, "id", sets, boost)
    both = pairs.join(groups.select(F.col("rep").alias("a"), F.col("e").alias("ea")), "a").join(
        groups.select(F.col("rep").alias("b"), F.col("e").alias("eb")), "b"
    )
    overlap = F.when(
        (F.size("ea") > 0) & (F.size("eb") > 0),
        F.size(F.array_intersect("ea", "eb")) / F.size(F.array_union("ea", "eb"))
    ).otherwise(0.0)
    edges = both.where(F.col("sim") + overlap * boost >= least).select("a", "b")
    found = connected_components(edges)
    worded = groups.where("n > 1").join(
        vectors.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi"
    ).select("rep", F.col("rep").alias("own"))
    named = found.join(worded, found["node"] == worded["rep"], "full_outer").select(
        F.coalesce("node", "rep").alias("rep"), F.coalesce("component", "own").alias("cluster")
    )
    members = rows.join(
        groups,
        (rows["title"].eqNullSafe(groups["title"])) & (rows["e"] == groups["e"]) & (rows["half"] == groups["half"])
    ).select("id", "rep")
    return members.join(named, "rep").select("id", "cluster")


def contradictions(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per (cluster, country) with domestic and international articles: the divergence of their coverage.

    rows(id, cluster, country, audience_type, tone). Little overlap of the ten heaviest terms and a tone gap
    count 0.25 each, a volume ratio above 3 and dissimilar headlines 0.20 each. The mean cosine between the
    sides is the product of their summed vectors over the numbers of articles, so no pairs are formed.
    """
    keys = ["cluster", "country", "audience_type"]
    sides = rows.where(F.col("audience_type").isin("DOMESTIC", "INTERNATIONAL"))
    base = sides.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("tone").alias("tone"))
    weights = sides.select("id", *keys).join(vectors.select("id", "term", "w"), "id").groupBy(*keys, "term").agg(
        F.sum("w").alias("w")
    )
    best = weights.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("w", 9)), "term"))
    ).where("_r <= 10").groupBy(*keys).agg(F.collect_set("term").alias("top"))
    d, i = weights.where("audience_type = 'DOMESTIC'").alias("d"), weights.where(
        "audience_type = 'INTERNATIONAL'"
    ).alias("i")
    same = (F.col("d.cluster") == F.col("i.cluster")) & (F.col("d.country") == F.col("i.country")) & (
        F.col("d.term") == F.col("i.term")
    )
    dots = d.join(i, same).groupBy(F.col("d.cluster").alias("cluster"), F.col("d.country").alias("country")).agg(
        F.sum(F.col("d.w") * F.col("i.w")).alias("dot")
    )
    side = base.join(best, keys, "left")
    pick = lambda a, p: side.where(F.col("audience_type") == a).select(
        "cluster", "country", F.col("n").alias(f"{p}_n"), F.col("tone").alias(f"{p}_tone"),
        F.coalesce("top", F.array().cast("array<string>")).alias(f"{p}_top")
    )
    both = pick("DOMESTIC", "d").join(pick("INTERNATIONAL", "i"), ["cluster", "country"]).join(
        dots, ["cluster", "country"], "left"
    )
    overlap = F.coalesce(
        F.try_divide(F.size(F.array_intersect("d_top", "i_top")), F.size(F.array_union("d_top", "i_top"))), F.lit(0.0)
    )
    sim = F.coalesce(F.col("dot"), F.lit(0.0)) / (F.col("d_n") * F.col("i_n"))
    ratio = F.greatest("d_n", "i_n") / F.least("d_n", "i_n")
    points = F.when(overlap < 0.3, 0.25).otherwise(0.0) + F.when(
        F.abs(F.col("d_tone") - F.col("i_tone")) > 3, 0.25
    ).otherwise(0.0) + F.when(ratio > 3, 0.20).otherwise(0.0) + F.when(sim < 0.25, 0.20).otherwise(0.0)
    s = F.round(F.least(points, F.lit(1.0)), 2)
    severity = F.when(s < 0.2, "NONE").when(s < 0.4, "MINOR").when(
        s < 0.6, "SIGNIFICANT"
    ).when(s < 0.8, "MAJOR").otherwise("DIRECT")
    return both.select(
        "cluster", "country", F.col("d_n").alias("domestic"), F.col("i_n").alias("international"), s.alias("score"),
        (s >= 0.4).alias("significant"), severity.alias("severity")
    )


def desk_comparison(rows: DataFrame) -> DataFrame:
    """Events that several language desks of one country cover: rows(cluster, country, language)."""
    return rows.groupBy("cluster", "country").agg(
        F.count_distinct("language").alias("languages"), F.count("*").alias("articles")
    ).where("languages > 1")
