"""Scratch tables in the shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch paths of this process by application, for clear_scratch().
_MADE: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    A local session without one gets a folder of its own; a cluster must name one, as a folder of the driver's
    machine would be another folder on every executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="mediapulse-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that written() made, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)
            made = _MADE.get(df.sparkSession.sparkContext.applicationId, [])
            if path in made:
                made.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables of this application, once its results are stored; returns their number.

    A returned DataFrame may still read its operator's last tables, so operators cannot delete those.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges(a, b), a written table; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which takes a number of rounds
    that grows with the square of the logarithm of the nodes, whatever the diameter. Each round is plain
    grouping and joins, so a node with many links is split by the skew-join rule, and its edges are
    written to the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "edges")
    seen = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(pairs)
        pairs = after
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = nodes.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = written(nodes, "components")
    discard(pairs)
    return out
