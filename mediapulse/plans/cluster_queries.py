"""Events over the pages: the titles of pages as headlines, a page's number as its minute."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import clusters
from . import driver as d
from .registry import query

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in fixed.STOP_WORDS) + "]"
# vectors, edges and components by their definitions, over all pairs
_SQL = f"""WITH RECURSIVE t AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'D' || (page_id % 5) AS desk, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages),
 w AS (SELECT id, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)) AS words FROM t),
 m AS (SELECT id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS term FROM w),
 c AS (SELECT id, term, count(*) AS tf FROM m GROUP BY ALL), f AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
 raw AS (SELECT id, term, tf * idf AS w FROM c JOIN f USING (term)), v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
 dots AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS sim FROM v x JOIN v y USING (term) WHERE x.id < y.id AND y.id - x.id <= 1440 GROUP BY ALL HAVING sum(x.w * y.w) >= 0.05),
 e AS (SELECT a, b FROM dots JOIN t p ON p.id = a JOIN t q ON q.id = b
   WHERE sim + 0.3 * len(list_intersect([p.desk, p.lang], [q.desk, q.lang])) / len(list_distinct([p.desk, p.lang, q.desk, q.lang])) >= 0.35),
 both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT x.b, r.root FROM r JOIN both_ways x ON x.a = r.node),
 found AS (SELECT node AS id, min(root) AS cluster FROM r GROUP BY node)"""


def _titled(spark, sf):
    desk = F.concat(F.lit("D"), (F.col("page_id") % 5).cast("string"))
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    return d.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.timestamp_seconds(F.col("page_id") * 60).alias("at"), F.array(desk, lang).alias("entities"),
    )


@query(f"{_SQL} SELECT id, cluster FROM found")
def event_clusters(spark, sf):
    return clusters.event_clusters(_titled(spark, sf))


@query(f"""{_SQL}, rows AS (SELECT id, cluster, CASE WHEN id % 2 = 0 THEN 'd' ELSE 'i' END AS side, CAST(id % 10 - 5 AS DOUBLE) AS tone FROM found),
 n AS (SELECT cluster, side, count(*) AS n, avg(tone) AS tone FROM rows GROUP BY ALL), s AS (SELECT cluster, side, term, sum(w) AS w FROM rows JOIN v USING (id) GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY cluster, side ORDER BY round(w, 9) DESC, term) AS nth FROM s), top AS (SELECT cluster, side, list(term) AS terms FROM k WHERE nth <= 10 GROUP BY ALL),
 dot AS (SELECT x.cluster, sum(x.w * y.w) AS dot FROM s x JOIN s y ON x.cluster = y.cluster AND x.term = y.term AND x.side = 'd' AND y.side = 'i' GROUP BY x.cluster),
 b AS (SELECT x.cluster, x.n AS domestic, y.n AS international, x.tone AS dt, y.tone AS it, len(list_intersect(p.terms, q.terms)) / len(list_distinct(p.terms || q.terms)) AS overlap, coalesce(dot, 0) / (x.n * y.n) AS sim
   FROM n x JOIN n y ON x.cluster = y.cluster AND x.side = 'd' AND y.side = 'i' JOIN top p ON p.cluster = x.cluster AND p.side = 'd' JOIN top q ON q.cluster = x.cluster AND q.side = 'i' LEFT JOIN dot ON dot.cluster = x.cluster),
 z AS (SELECT *, round(least(CASE WHEN overlap < 0.3 THEN 0.25 ELSE 0 END + CASE WHEN abs(dt - it) > 3 THEN 0.25 ELSE 0 END
   + CASE WHEN greatest(domestic, international) / least(domestic, international) > 3 THEN 0.2 ELSE 0 END + CASE WHEN sim < 0.25 THEN 0.2 ELSE 0 END, 1.0), 2) AS score FROM b)
 SELECT cluster, 'XX' AS country, domestic, international, score, score >= 0.4 AS significant,
   CASE WHEN score < 0.2 THEN 'NONE' WHEN score < 0.4 THEN 'MINOR' WHEN score < 0.6 THEN 'SIGNIFICANT' WHEN score < 0.8 THEN 'MAJOR' ELSE 'DIRECT' END AS severity FROM z""")
def contradictions(spark, sf):
    titled = _titled(spark, sf)
    side = d.pick(d.AUDIENCES, F.col("id") % 2)
    rows = clusters.event_clusters(titled).join(titled, "id")
    rows = rows.select(
        "id", "cluster", F.lit("XX").alias("country"), side.alias("audience_type"),
        (F.col("id") % 10 - 5).cast("double").alias("tone")
    )
    return clusters.contradictions(rows, clusters.title_vectors(titled))


@query(
    f"{_SQL} SELECT cluster, 'XX' AS country, count(DISTINCT id % 3) AS languages, count(*) AS articles FROM found GROUP BY cluster HAVING count(DISTINCT id % 3) > 1"
)
def desk_comparison(spark, sf):
    titled = _titled(spark, sf)
    language = d.pick(["en", "fr", "es"], F.col("id") % 3)
    rows = clusters.event_clusters(titled).join(titled, "id")
    return clusters.desk_comparison(rows.select("cluster", F.lit("XX").alias("country"), language.alias("language")))
