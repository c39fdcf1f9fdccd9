"""Streaming jobs: the theme rollup from the file drop, daily counts and sliding surge windows."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import activity, rollup
from ..operators.graph import discard, written
from ..sources import sinks


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


#: Milliseconds that an article stays in the state after its last change; parts of the state, fixed for a checkpoint.
KEPT, PARTS = 70 * 24 * 3600 * 1000, 1024
#: What a rollup needs of an article: its key, and its first sighting's time and number.
_KEY, _FIRST = ["domain", "url"], ["date", "record_id", "country", "audience_type", "themes", "tone"]
_CHANGE = Row("sign", *_KEY, *_FIRST)
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Keeps the first row of each (domain, url) as state with a time to live, and reports what changes.

    A new article is one row of sign 1. A copy with an earlier time takes its place: the old row is taken back with sign -1. Later
    copies and replays change nothing; the order of arrival does not matter while an article is kept. Rows before
    `frozen`, in microseconds, pass with sign 0. A part of the state holds the articles of one hash, so that a batch
    reads the parts that its articles fall into and asks the state store once for each, not once for each article.
    """

    def __init__(self, kept: int = KEPT, frozen: int | None = None):
        self.kept, self.frozen = kept, frozen

    def init(self, handle) -> None:
        self.state = handle.getValueState("firsts", "firsts string", self.kept)

    def handleInputRows(self, key, rows, timers):
        now = timers.getCurrentProcessingTimeInMs()
        held = self.state.get()
        old = {(x[0], x[1]): x[2:] for x in json.loads(held[0])} if held else {}
        new = dict(old)
        for r in rows:
            row = [r[c] for c in _FIRST]
            if self.frozen is not None and row[0] < self.frozen:
                yield _CHANGE(0, *(r[c] for c in _KEY), *row)
                continue
            own = r["domain"], r["url"]
            if own not in new or _order(row) < _order(new[own]):
                new[own] = [*row, now]
        changed = {k: v for k, v in new.items() if old.get(k) is not v}
        for k, v in changed.items():
            if k in old:
                yield _CHANGE(-1, *k, *old[k][:-1])
            yield _CHANGE(1, *k, *v[:-1])
        if changed:
            alive = [[*k, *v] for k, v in new.items() if v[-1] > now - self.kept]
            self.state.update((json.dumps(alive, ensure_ascii=False),))

    def close(self) -> None:
        pass


def _order(row: list) -> tuple:
    """By date, then record number, nulls first."""
    return row[0], row[1] is not None, row[1]


def first_seen(rows: DataFrame, kept: int = KEPT, parts: int = PARTS, frozen_before: str | None = None) -> DataFrame:
    """(sign, domain, url, date, record_id, country, audience_type, themes, tone): the changes that a stream of rows makes to the
    set of first sightings. Rows without a date are left out, as they belong to no period."""
    frozen = None
    if frozen_before:
        frozen = int(dt.datetime.fromisoformat(frozen_before).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    rows = rows.where("date is not null").select(*_KEY, *_FIRST).withColumn("date", F.unix_micros("date"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    keyed = rows.withColumn("part", F.pmod(F.xxhash64(*_KEY), F.lit(parts))).groupBy("part")
    changes = keyed.transformWithState(FirstSeen(kept, frozen), f"sign int, {shape}", "Update", "ProcessingTime")
    return changes.withColumn("date", F.timestamp_micros("date"))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _periods_of(spark: SparkSession, table: str, periods: list[Row], like: DataFrame) -> DataFrame:
    """The rows of some periods of a table that is partitioned by them; only these folders are listed."""
    found = []
    for p in periods:
        path, fs = _path(spark, f"{table}/period_type={p.period_type}/period_start={p.period_start}")
        if fs.exists(path):
            found.append(str(path))
    if not found:
        return like.limit(0)
    rows = spark.read.schema(like.schema).option("basePath", table).parquet(*found)
    return rows.withColumn("period_start", F.to_date("period_start")).select(like.columns)


def _put_periods(rows: DataFrame, table: str) -> None:
    dealt = rows.hint("rebalance", "period_type", "period_start")
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period_type", "period_start").parquet(table)


def _signed(changes: DataFrame) -> DataFrame:
    """Day partials of changes: what they add to the counts of their days, and take from them."""
    rows = rollup.day_partials(changes.where("sign > 0"))
    gone = rollup.day_partials(changes.where("sign < 0"))
    less = [(-F.col(c)).alias(c) for c in ("article_count", "tone_sum", "tone_n")]
    return rows.unionByName(gone.select("country", "audience_type", "day", "theme", *less))


def start_rollup(
    rows: DataFrame, store: str, table: str, checkpoint: str, periods: tuple[str, ...] = ("daily", "weekly", "monthly"),
    min_count: int = 2, top: int = 50, frozen_before: str | None = None, kept: int = KEPT, parts: int = PARTS,
) -> StreamingQuery:
    """Keep the theme table up to date from a stream of resolved rows.

    The stream's state knows the first sighting of each (domain, url). A batch turns the changes of that set into additive
    counts, adds them to the counts of the periods that they touch, and writes these periods' theme rows; no article is
    read twice, and rows that are read grow with the batch. Every period's counts carry the number of their last batch, so
    a batch that is replayed after a failure is not added again. Copies may come in any order within `kept`
    milliseconds. Rows of days before `frozen_before` change nothing and go to a side table.
    """
    spark = rows.sparkSession
    counts = f"{store}/counts"

    def put(batch: DataFrame, number: int) -> None:
        changes = written(batch, "changes")  # once: each reading would run the state's batch again
        if frozen_before:
            late = changes.where("sign = 0").drop("sign").withColumn("batch", F.lit(number)).write.mode("overwrite")
            late.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}_late")
        more = rollup.period_counts(_signed(changes), periods).withColumn("batch", F.lit(number).cast("long"))
        more = written(more.withColumn("tone_sum", F.col("tone_sum").cast("double")), "counts")
        touched = more.select("period_type", "period_start").distinct().collect()
        if not touched:
            discard(changes, more)
            return
        held = _periods_of(spark, counts, touched, more)
        done = held.where(F.col("batch") >= number).select("period_type", "period_start").distinct()
        fresh = more.join(F.broadcast(done), ["period_type", "period_start"], "left_anti").select(held.columns)
        sums = [F.sum(c).alias(c) for c in ("article_count", "tone_sum", "tone_n")]
        now = held.unionByName(fresh).groupBy(*rollup.BUCKET, "theme").agg(*sums, F.lit(number).cast("long").alias("batch"))
        now = written(now, "periods")
        _put_periods(now, counts)
        _put_periods(rollup.top_themes(now.where("article_count > 0"), min_count, top), table)
        _drop_empty(now.where(F.col("theme").isNotNull() & (F.col("article_count") >= min_count)), touched, table)
        discard(changes, more, now)

    # the state store of these queries, and no batches without rows, which processing time would bring without end
    settings = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        changes = first_seen(rows, kept, parts, frozen_before)
        writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drop_empty(rows: DataFrame, touched: list[Row], table: str) -> None:
    """Delete the folders of periods that changed and have no rows any more."""
    spark = rows.sparkSession
    kept = set(rows.select("period_type", "period_start").distinct().collect())
    for p in set(touched) - kept:
        path, fs = _path(spark, f"{table}/period_type={p.period_type}/period_start={p.period_start}")
        if fs.exists(path):
            fs.delete(path, True)


def start_daily_counts(rows: DataFrame, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Articles per day, country and audience in update mode, upserted by key; late rows raise their day."""
    spark = rows.sparkSession
    counts = rows.withWatermark("date", late).groupBy(
        F.window("date", "1 day").alias("w"), "country", "audience_type"
    ).count()

    def put(batch: DataFrame, number: int) -> None:
        new = batch.select(
            F.to_date("w.start").alias("date"), "country", "audience_type", F.col("count").alias("today_count")
        )
        sinks.write_upsert(new, table, ["date", "country", "audience_type"], "date")

    return counts.writeStream.outputMode("update").foreachBatch(put).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


_SURGES = (
    "window_start timestamp, window_end timestamp, country string, theme string, article_count long, baseline_mean double, "
    "ratio double, batch int"
)


def surges(spark: SparkSession, table: str) -> DataFrame:
    """The table of start_surges; without a surge so far it has no file that could tell its columns."""
    return spark.read.schema(_SURGES).parquet(table)


def start_surges(
    rows: DataFrame, baselines: DataFrame | Callable[[SparkSession], DataFrame], table: str, checkpoint: str,
    window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour", surge: float = 2.0
) -> StreamingQuery:
    """Sliding counts per country and theme against daily baselines(country, theme, baseline_mean[, since]);
    windows that closed with a surge are appended. surges() reads the table.

    With `since` a window is compared with the baseline that was valid when it began. A function of the session is asked for the
    baselines at each batch, so it can read those that were written since the last one.
    """
    counts = rows.withWatermark("date", late).select("date", "country", F.explode("themes").alias("theme")).groupBy(
        F.window("date", window, slide).alias("w"), "country", "theme"
    ).count()

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("window_start", F.col("w.start"))
        known = baselines(batch.sparkSession) if callable(baselines) else baselines
        if "since" in known.columns:
            hot = activity.as_of(batch, known, ["country", "theme"], "window_start", values=["baseline_mean"])
        else:
            hot = batch.join(known, ["country", "theme"])
        hot = hot.withColumn("ratio", F.col("count") / F.col("baseline_mean"))
        hot = hot.where((F.col("baseline_mean") > 0) & (F.col("ratio") >= surge))
        hot.select(
            "window_start", F.col("w.end").alias("window_end"), "country", "theme",
            F.col("count").alias("article_count"), F.col("baseline_mean").cast("double"), F.col("ratio").cast("double"),
            F.lit(number).alias("batch")
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return counts.writeStream.outputMode("append").foreachBatch(put).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
