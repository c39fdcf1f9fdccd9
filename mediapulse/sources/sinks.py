"""Keyed upserts, appends, retention and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import discard, written

KEYS = {
    "articles": ["url"], "country_activity": ["country", "date", "audience_type"],
    "themes": ["country", "audience_type", "period_type", "period_start", "theme"],
    "outlets": ["domain"], "snapshots": ["date"],
}


def last_rows(new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """One row of each key: the first by `order`, or any."""
    if not order:
        return new.dropDuplicates(keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """old with the rows of new put in by key; the last row of a key inside new (by `order`) wins."""
    new = last_rows(new, keys, order)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def replaced_periods(old: DataFrame, new: DataFrame, keys: list[str] = ["period_type", "period_start"]) -> DataFrame:  # noqa: B006
    """old without the periods that new recomputes, and new: rows that fell out of the top N go with them."""
    touched = new.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(new.select(*old.columns))


def write_upsert(new: DataFrame, path: str, keys: list[str], partition: str, order: list | None = None) -> None:
    """Upsert into a Parquet table partitioned by a key column; only the partitions of new are rewritten."""
    spark = new.sparkSession
    days = [r[0] for r in new.select(partition).distinct().collect()]
    try:
        old = spark.read.parquet(path).where(F.col(partition).isin(days))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = spark.createDataFrame([], new.schema)
    # the partitions are read and overwritten by one job, so the new state is written beside them first
    staged = written(upserted(old, new, keys, order), "staged")
    writer = staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(path)
    discard(staged)


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table; repeats are the reader's to tell apart."""
    rows.write.mode("append").parquet(path)


def write_manifest(about: DataFrame, path: str) -> None:
    """Add an import's manifest, gates.manifest(), to a folder of JSON lines; one file for each import."""
    about.coalesce(1).write.mode("append").json(path)


def export(rows: DataFrame, path: str, metadata: dict[str, str], partition: list[str] | None = None) -> None:
    """A result set with a one-row table of metadata beside it."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{path}/rows")
    about = rows.agg(F.count("*").alias("rows")).select("rows", *[F.lit(v).alias(k) for k, v in metadata.items()])
    about.write.mode("overwrite").json(f"{path}/metadata")


def reload(spark: SparkSession, path: str) -> DataFrame:
    """A result set that export() wrote; an empty one is an error."""
    rows = spark.read.parquet(f"{path}/rows")
    if not rows.limit(1).count():
        raise ValueError(f"{path} holds no rows")
    return rows


def public_columns(rows: DataFrame, reason: str = "verdict_reason", most: int = 4096) -> DataFrame:
    """Without internal columns; reasons cut to what the table takes."""
    kept = rows.select(*[c for c in rows.columns if not c.startswith("_") and c not in ("days_sampled", "period_type")])
    return kept.withColumn(reason, F.substring(reason, 1, most)) if reason in kept.columns else kept


def clear_cold_start(rows: DataFrame, before: str) -> DataFrame:
    """cold_start off for rows dated before a day; `cleared` marks the rows that change."""
    hit = (F.col("date") < F.lit(before).cast("date")) & F.col("cold_start")
    return rows.withColumn("cleared", hit).withColumn("cold_start", F.when(hit, False).otherwise(F.col("cold_start")))


def retained(rows: DataFrame, as_of: str, column: str = "date", days: int = 30) -> DataFrame:
    return rows.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))
