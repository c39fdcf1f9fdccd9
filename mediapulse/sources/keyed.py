"""Tables keyed by columns that are no partitions, such as articles by url or outlets by domain.

Rows lie in buckets by the hash of their key. An upsert rewrites the buckets that its keys fall into, beside the old
ones, and then puts down a manifest that names each bucket's folder; until that file is there, readers see the old
state whole, and after it the new one. Old rows are not shuffled: they are read bucket by bucket, lose the keys that
come new (a join that Spark broadcasts while these are few), and are written where they were read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or the last one; None before the first upsert."""
    versions = [int(x[:-5]) for x in _listed(spark, f"{path}/state") if x.endswith(".json") and x[:-5].isdigit()]
    if not versions:
        return None
    name = max(versions) if version is None else version
    return json.loads(spark.read.text(f"{path}/state/{name}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Write a manifest under a hidden name and rename it; a writer that finds its version taken has lost the race."""
    target, fs = _fs(spark, f"{path}/state/{state['version']}.json")
    held, _ = _fs(spark, f"{path}/state/_{uuid.uuid4().hex}")
    out = fs.create(held, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(held, target):
        fs.delete(held, False)
        raise RuntimeError(f"another writer has made version {state['version']} of {path}")


def _rows(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
    """Rows of some buckets, or all, with their bucket."""
    folders = {int(k): g for k, g in state["folders"].items() if buckets is None or int(k) in buckets}
    parts = [f"{path}/data/{g}/bucket={k}" for k, g in sorted(folders.items())]
    if not parts:
        return None
    rows = spark.read.schema(state["schema"]).parquet(*parts)
    return rows.withColumn("bucket", F.regexp_extract(F.input_file_name(), "/bucket=([0-9]+)/", 1).cast("int"))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as its last upsert left it, or an earlier version that is still kept."""
    state = manifest(spark, path, version)
    if state is None:
        raise FileNotFoundError(f"no table at {path}")
    rows = _rows(spark, path, state)
    return spark.createDataFrame([], state["schema"]) if rows is None else rows.drop("bucket")


def upsert(new: DataFrame, path: str, keys: list[str], order: list | None = None, buckets: int = BUCKETS) -> int:
    """Put new rows into the table, in the place of rows with their keys; returns the number of buckets rewritten.

    Of new rows with one key the first by `order` counts. Null keys are keys. The number of buckets is set by the first
    upsert; later ones must bring the same columns.
    """
    spark = new.sparkSession
    state = manifest(spark, path)
    if state is None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        state = {"version": 0, "buckets": buckets, "keys": keys, "schema": schema, "folders": {}}
    if state["keys"] != keys:
        raise ValueError(f"the table's keys are {state['keys']}")
    columns = new.columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(state["buckets"])).cast("int")
    fresh = sinks.written(sinks.last_rows(new, keys, order).withColumn("bucket", bucket), "fresh")
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    whole = fresh.repartition("bucket")
    old = _rows(spark, path, state, touched)
    if old is not None:
        a, b = old.alias("a"), fresh.select(*keys).alias("b")
        gone = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        whole = a.join(b, gone, "left_anti").select(*columns, "bucket").unionByName(whole)
    folder = f"v{state['version'] + 1}-{uuid.uuid4().hex[:8]}"
    whole.write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    state["version"] += 1
    state["folders"] |= {str(k): folder for k in touched}
    _commit(spark, path, state)
    sinks.discard(fresh)
    return len(touched)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete versions before the last one, and folders of upserts that never ended; not beside running readers or
    writers. Returns the number of folders deleted."""
    state = manifest(spark, path)
    used = {f"{g}/bucket={k}" for k, g in state["folders"].items()}
    gone = 0
    for g in _listed(spark, f"{path}/data"):
        for part in _listed(spark, f"{path}/data/{g}"):
            if part.startswith("bucket=") and f"{g}/{part}" not in used:
                folder, fs = _fs(spark, f"{path}/data/{g}/{part}")
                fs.delete(folder, True)
                gone += 1
    for name in _listed(spark, f"{path}/state"):
        if name != f"{state['version']}.json":
            file, fs = _fs(spark, f"{path}/state/{name}")
            fs.delete(file, False)
    return gone
