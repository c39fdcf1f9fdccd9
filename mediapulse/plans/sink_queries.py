"""What sources and sinks write, read back; each query must return what its SQL reads from the driver's tables."""

from __future__ import annotations

import zipfile
from io import BytesIO

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.graph import scratch_path
from ..sources import gkg, keyed, schemas, sinks
from ..streaming import jobs
from . import driver as d
from .registry import query
from .theme_queries import _ACT, _activity

_COLUMNS = "country, audience_type, date, today_count, level"


@query(f"{_ACT} SELECT {_COLUMNS} FROM act UNION ALL SELECT {_COLUMNS} FROM act WHERE level = 'red'")
def appended_rows(spark, sf):
    path, rows = scratch_path(spark, "appended"), _activity(spark, sf).select(*_COLUMNS.split(", "))
    sinks.append(rows, path)
    sinks.append(rows.where("level = 'red'"), path)
    return spark.read.parquet(path)


@query(f"{_ACT} SELECT {_COLUMNS}, (SELECT count(*) FROM act) AS rows, 'activity' AS source FROM act")
def exported_rows(spark, sf):
    path = scratch_path(spark, "exported")
    sinks.export(_activity(spark, sf).select(*_COLUMNS.split(", ")), path, {"source": "activity"}, ["country"])
    about = spark.read.schema("rows long, source string").json(f"{path}/metadata")
    return sinks.reload(spark, path).join(about, F.lit(True)).select(*_COLUMNS.split(", "), "rows", "source")


@query("SELECT event_id, left(repeat(event_type, 600), 4096) AS verdict_reason FROM events")
def public_claim_columns(spark, sf):
    rows = d.table(spark, sf, "events").select(
        "event_id", F.repeat("event_type", 600).alias("verdict_reason"), F.lit(1).alias("_inner"),
        F.lit(2).alias("days_sampled")
    )
    return sinks.public_columns(rows)


@query(
    f"""{_ACT} SELECT missing, count(*) AS rows FROM act, (VALUES ('confidence'), ('none')) v(missing) GROUP BY ALL"""
)
def required_columns(spark, sf):
    """Rows of an input that has all columns of the activity table, and of one that lacks one of them."""
    act, out = _activity(spark, sf), None
    for lost in ("confidence", "none"):
        rows = act.drop(lost)
        try:
            named = schemas.require_columns(rows, schemas.ACTIVITY).select(F.lit("none").alias("missing"))
        except ValueError as e:
            named = rows.select(F.lit(str(e).rsplit(" ", 1)[-1]).alias("missing"))
        out = named if out is None else out.union(named)
    return out.groupBy("missing").agg(F.count("*").alias("rows"))


def _zipped(batches):
    """A zip archive of each slice's lines; slices divisible by seven are broken files."""
    for b in batches:
        files = []
        for number, lines in zip(b.column("slice").to_pylist(), b.column("lines").to_pylist()):
            held = BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(f"{number}.csv", "\n".join(sorted(lines)))
            files.append(b"broken" if number % 7 == 0 else held.getvalue())
        yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(files, pa.binary())], names=["slice", "content"])


@query("""WITH r AS (SELECT *, event_id % 11 <> 0 AND (event_id % 13 <> 0 OR event_id % 26 = 0) AS good, (event_id % 96) % 7 = 0 AS broken FROM events)
 SELECT (SELECT count(DISTINCT event_id % 96) FROM r) AS files, (SELECT count(DISTINCT event_id % 96) FROM r WHERE broken) AS skipped, count(*) FILTER (WHERE NOT broken) AS lines,
   count(*) FILTER (WHERE good AND NOT broken) AS rows, count(*) FILTER (WHERE good AND NOT broken) AS articles FROM r""")
def zipped_slices(spark, sf):
    """Counters over the lines of the events in 96 zip archives, some of them broken."""
    from .text_queries import gkg_lines

    lines = gkg_lines(spark, sf, (F.col("event_id") % 96).cast("long").alias("slice"))
    files = lines.groupBy("slice").agg(F.collect_list("value").alias("lines"))
    files = files.mapInArrow(_zipped, "slice long, content binary")
    raw = gkg.unzipped(files.select(F.concat(F.col("slice").cast("string"), F.lit(".zip")).alias("path"), "content"))
    return gkg.file_counters(raw, gkg.parse_lines(raw.where("not skipped")))


@query(
    f"""WITH {d.ARTICLES_SQL} SELECT CAST(date AS DATE) AS day, count(*) AS rows FROM raw WHERE country <> 'UK' AND date < TIMESTAMP '2024-01-10' GROUP BY ALL"""
)
def frozen_days(spark, sf):
    """Rows of days before the first open one go to the side table of the streaming rollup."""
    folder, rows = scratch_path(spark, "frozen"), d.raw_articles(spark, sf).where("country <> 'UK'")
    rows.write.parquet(f"{folder}/drop")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/drop")
    run = jobs.start_rollup(
        stream, f"{folder}/store", f"{folder}/table", f"{folder}/check", ("daily",), frozen_before="2024-01-10"
    )
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/store_late").groupBy(F.to_date("date").alias("day")).agg(
        F.count("*").alias("rows")
    )


@query(
    f"""WITH {d.ARTICLES_SQL} SELECT url, record_id, country, date FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY record_id % 5 DESC, record_id DESC) AS last FROM raw) WHERE last = 1"""
)
def articles_by_url(spark, sf):
    """Five upserts of articles by url, the last writer wins; the second of them is tried again."""
    path, rows = scratch_path(spark, "by_url"), d.raw_articles(spark, sf).select("url", "record_id", "country", "date")
    for part in (0, 1, 1, 2, 3, 4):
        keyed.upsert(rows.where(F.col("record_id") % 5 == part), path, ["url"], [F.desc("record_id")], buckets=8)
    return keyed.read(spark, path).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    f"""WITH {d.ARTICLES_SQL} SELECT domain, max(record_id) AS record_id, count(*) > 0 AS known FROM raw GROUP BY domain"""
)
def outlets_by_domain(spark, sf):
    """Outlets by domain: a first load, then the outlets of the second half of the records alone."""
    path, rows = scratch_path(spark, "by_domain"), d.raw_articles(spark, sf).select("domain", "record_id")
    half = rows.agg(F.max("record_id") / 2).first()[0]
    for part in (F.col("record_id") <= half, F.col("record_id") > half):
        keyed.upsert(rows.where(part), path, ["domain"], [F.desc("record_id")])
    return keyed.read(spark, path).withColumn("known", F.lit(True))
