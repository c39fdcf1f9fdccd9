"""Streaming jobs over the events, replayed as a file drop; their tables must equal the batch results."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.graph import scratch_path, written
from ..sources import gkg, slices
from ..streaming import jobs
from . import driver as d
from .registry import query
from .theme_queries import _ROLL


def put_spans(rows, path: str, slices: int = 6):
    """Append the rows to a folder by equal spans of time, and yield after each one.

    The rows are dealt into spans by one job, whose folders are then copied. A span is as many files as it was read from
    tasks, each with rows of all its time; one without rows is an empty file.
    """
    spark = rows.sparkSession
    first, last = (x.timestamp() if x else 0.0 for x in rows.agg(F.min("date"), F.max("date")).first())
    step = (last - first) / slices
    at = F.floor((F.col("date").cast("double") - first) / max(step, 1e-9))
    spans = scratch_path(spark, "spans")
    table = rows.withColumn("span", F.least(at, F.lit(slices - 1)).cast("int"))
    table.write.partitionBy("span").parquet(spans)
    dealt = spark.read.schema(table.schema).parquet(spans)
    for k in range(slices):
        dealt.where(F.col("span") == k).select(*rows.columns).write.mode("append").parquet(path)
        yield


def write_drop(rows, path: str, slices: int = 6) -> None:
    """All spans at once, for streams that may read the files in any order."""
    for _ in put_spans(rows, path, slices):
        pass


def _rows(spark, sf):
    return d.raw_articles(spark, sf).where("country <> 'UK'")


def _replay(rows, folder: str, closing: bool = False):
    """The rows as a stream for each span, which is to be run before the next span comes.

    A run reads its whole span as one batch, so no row is late by accident: with a number of files for each batch the first ones of
    a span would raise the watermark above the rows of its others. A closing row without a country, a month after the
    last one, ends all windows.
    """
    spark, drop = rows.sparkSession, f"{folder}/drop"
    stream = spark.readStream.schema(rows.schema).parquet
    for _ in put_spans(rows, drop, 3):
        yield stream(drop)
    if closing:
        end = rows.agg(
            (F.max("date") + F.expr("interval 31 days")).alias("date"), F.array(F.lit("end")).alias("themes")
        )
        empty = end.select(
            *[
                F.col(f.name) if f.name in end.columns else F.lit(None).cast(
                    f.dataType
                ).alias(f.name) for f in rows.schema
            ]
        )
        for _ in range(2):  # windows close in the batch after the one that ends them
            empty.write.mode("append").parquet(drop)
            yield stream(drop)


@query(
    f"{_ROLL} SELECT country, audience_type, period_type, period_start, theme, article_count, bucket_total, share FROM rolled"
)
def stream_theme_rollup(spark, sf):
    folder, rows = scratch_path(spark, "rollup"), _rows(spark, sf)
    write_drop(rows, f"{folder}/drop")
    drop = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/drop")
    jobs.start_rollup(drop, f"{folder}/store", f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    table = spark.read.parquet(f"{folder}/table")
    return table.select(
        "country", "audience_type", "period_type", F.col("period_start").cast("date").alias("period_start"), "theme",
        "article_count", "bucket_total", "share"
    )


@query(
    f"WITH {d.ARTICLES_SQL} SELECT country, audience_type, day AS date, count(*) AS today_count FROM raw WHERE country <> 'UK' GROUP BY ALL"
)
def stream_daily_counts(spark, sf):
    folder = scratch_path(spark, "counts")
    for span in _replay(_rows(spark, sf), folder):
        jobs.start_daily_counts(span, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select(
        "country", "audience_type", F.col("date").cast("date").alias("date"), "today_count"
    )


@query(f"""WITH {d.ARTICLES_SQL}, m AS (SELECT country, date, unnest([t1, t2]) AS theme FROM raw WHERE country <> 'UK'), b AS (SELECT country, theme, count(*) / 30.0 AS baseline_mean FROM m GROUP BY ALL),
 w AS (SELECT country, theme, time_bucket(INTERVAL 1 HOUR, date) - i * INTERVAL 1 HOUR AS window_start FROM m, range(24) t(i)), c AS (SELECT country, theme, window_start, count(*) AS article_count FROM w GROUP BY ALL)
 SELECT country, theme, window_start, article_count, round(article_count / baseline_mean, 6) AS ratio FROM c JOIN b USING (country, theme) WHERE article_count / baseline_mean >= 3.0""")
def stream_surges(spark, sf):
    folder, rows = scratch_path(spark, "surges"), _rows(spark, sf)
    counts = rows.select("country", F.explode("themes").alias("theme")).groupBy("country", "theme")
    counts = written(counts.agg((F.count("*") / 30.0).alias("baseline_mean")), "baselines")
    for span in _replay(rows, folder, closing=True):
        jobs.start_surges(span, counts, f"{folder}/table", f"{folder}/checkpoint", surge=3.0).awaitTermination()
    return jobs.surges(spark, f"{folder}/table").select(
        "country", "theme", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "article_count",
        F.round("ratio", 6).alias("ratio")
    )


_HISTORY = """h AS (SELECT country, theme, CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AS since, avg(n) OVER (PARTITION BY country, theme ORDER BY day ROWS UNBOUNDED PRECEDING) AS baseline_mean
   FROM (SELECT country, theme, CAST(date AS DATE) AS day, count(*) AS n FROM m GROUP BY ALL))"""


@query(f"""WITH {d.ARTICLES_SQL}, m AS (SELECT country, date, unnest([t1, t2]) AS theme FROM raw WHERE country <> 'UK'), {_HISTORY},
 w AS (SELECT country, theme, time_bucket(INTERVAL 1 HOUR, date) - i * INTERVAL 1 HOUR AS window_start FROM m, range(24) t(i)), c AS (SELECT country, theme, window_start, count(*) AS article_count FROM w GROUP BY ALL)
 SELECT c.country, c.theme, window_start, article_count, round(baseline_mean, 6) AS baseline_mean FROM c ASOF JOIN h ON h.country = c.country AND h.theme = c.theme AND c.window_start >= h.since
 WHERE article_count / baseline_mean >= 2.0""")
def stream_surges_as_of(spark, sf):
    """Closed windows against the mean of the days before them, from a history with a row for each day of a theme."""
    folder, rows = scratch_path(spark, "history"), _rows(spark, sf)
    days = rows.where("date is not null").select(
        "country", F.explode("themes").alias("theme"), F.to_date("date").alias("day")
    ).groupBy("country", "theme", "day").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("country", "theme").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    history = days.select(
        "country", "theme", F.date_add("day", 1).cast("timestamp").alias("since"), F.avg("n").over(so_far).alias("baseline_mean")
    )
    history.write.parquet(f"{folder}/history")
    known = lambda s: s.read.parquet(f"{folder}/history")
    for span in _replay(rows, folder, closing=True):
        jobs.start_surges(span, known, f"{folder}/table", f"{folder}/checkpoint", surge=2.0).awaitTermination()
    return jobs.surges(spark, f"{folder}/table").select(
        "country", "theme", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "article_count",
        F.round("baseline_mean", 6).alias("baseline_mean")
    )


def _put_slices(folder: str, batches):
    """Write each slice's lines as a zip file of its name; a tried-again task writes the same bytes."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    for b in batches:
        for name, broken, lines in zip(*(b.column(c).to_pylist() for c in ("name", "broken", "lines"))):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(zipfile.ZipInfo(name), "\n".join(sorted(lines)))
            content = held.getvalue()
            with store.open_output_stream(f"{path}/{name}.zip") as f:
                f.write(content[: len(content) // 2] if broken else content)
        yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])


_HOURS3 = 10_800
_SLICES = """WITH e AS (SELECT epoch(time_bucket(INTERVAL 3 HOUR, ts))::BIGINT // 10800 AS n, event_id % 11 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0) AS good FROM events),
 c AS (SELECT n, count(*) AS seen, count(*) FILTER (WHERE good) AS good FROM e GROUP BY n),
 s AS (SELECT n, coalesce(seen, 0) AS seen, coalesce(good, 0) AS good, n >= (SELECT max(n) FROM c) - 40 AS recent FROM (SELECT unnest(range((SELECT min(n) FROM c), (SELECT max(n) FROM c) + 1)) AS n) LEFT JOIN c USING (n))"""


def _slice_drop(spark, sf):
    """(folder, put, first, last) of the events' lines in zip files of three hours; every seventh file is cut short, and
    put(which) writes the files whose numbers satisfy a condition."""
    from .text_queries import gkg_lines

    spark.dataSource.register(slices.SliceDrop)
    number = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / _HOURS3)
    files = gkg_lines(spark, sf, number.alias("n")).groupBy("n").agg(F.collect_list("value").alias("lines"))
    at = F.timestamp_seconds(F.col("n") * _HOURS3)
    files = files.select(
        "n", F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit(".gkg.csv")).alias("name"),
        (F.col("n") % 7 == 0).alias("broken"), "lines"
    )
    folder = f"{scratch_path(spark, 'slices')}/drop"
    put = lambda which: files.where(which).mapInArrow(lambda b: _put_slices(folder, b), "name string").count()
    first, last = files.agg(F.min(at), F.max(at)).first()
    return folder, put, first, last


def _options(folder, first, last):
    return {"path": folder, "minutes": 180, "first": f"{first:%Y-%m-%dT%H:%M:%S}", "last": f"{last:%Y-%m-%dT%H:%M:%S}"}


@query(f"""{_SLICES}, r AS (SELECT n, seen, good, CASE WHEN seen = 0 OR n % 11 = 0 AND (NOT recent OR n % 2 = 0) THEN CASE WHEN recent THEN 'waiting' ELSE 'missing' END WHEN n % 7 = 0 THEN 'corrupt' ELSE 'read' END AS status FROM s)
 SELECT n, status, CASE WHEN status = 'read' THEN seen ELSE 0 END AS lines, CASE WHEN status = 'read' THEN good ELSE 0 END AS rows FROM r WHERE status <> 'waiting'""")
def stream_slices(spark, sf):
    """The slice drop as a stream in two runs: every eleventh slice is absent in the first one, some of them come before
    the second; what came too late or not at all is missing once its lookback of five days has passed."""
    folder, put, first, last = _slice_drop(spark, sf)
    options = _options(folder, first, last) | {"lookback": 5 * 1440, "now": f"{last:%Y-%m-%dT%H}:07:00"}
    for which in ("n % 11 <> 0", "n % 11 = 0 and n % 2 = 1"):
        put(which)
        stream = spark.readStream.format("slices").options(**options).load()
        few = stream.coalesce(spark.sparkContext.defaultParallelism)  # so many files, not one for each slice
        run = few.writeStream.option("checkpointLocation", f"{folder}_checkpoint").option("path", f"{folder}_rows")
        run.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(slices.SCHEMA).parquet(f"{folder}_rows")
    parsed = gkg.parse_lines(rows, keep=("slice",)).groupBy("slice").agg(F.count("*").alias("rows"))
    own = rows.where("status is not null").join(parsed, "slice", "left")
    return own.select(
        F.floor(F.unix_timestamp("slice") / _HOURS3).alias("n"), "status", "lines", F.coalesce("rows", F.lit(0)).alias("rows")
    )


@query(f"""{_SLICES}, r AS (SELECT *, CASE WHEN seen = 0 OR n % 11 = 0 THEN 'missing' WHEN n % 7 = 0 THEN 'corrupt' ELSE 'read' END AS status FROM s)
 SELECT count(*) AS attempted, count_if(status = 'read') AS fetched, count_if(status = 'missing') AS missing, count_if(status = 'corrupt') AS errored,
   coalesce(sum(CASE WHEN status = 'read' THEN seen END), 0)::BIGINT AS lines FROM r""")
def slice_range_counters(spark, sf):
    folder, put, first, last = _slice_drop(spark, sf)
    put("n % 11 <> 0")
    return slices.counters(spark.read.format("slices").options(**_options(folder, first, last)).load())
