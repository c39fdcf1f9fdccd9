"""Outlets, countries and theme labels: small tables that joins broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .schemas import OUTLETS


def clean_outlets(rows: DataFrame) -> DataFrame:
    """Lower-case domains, upper-case codes, defaults; malformed and excluded entries go; the last entry
    (by column `position`) of a domain wins."""
    domain, country, audience = text.host(F.col("domain")), F.upper(F.trim("country")), F.upper(F.trim("audience_type"))
    last = Window.partitionBy("domain").orderBy(F.desc("position"))
    out = rows.select(
        domain.alias("domain"), country.alias("country"), audience.alias("audience_type"),
        F.coalesce("outlet_name", domain).alias("outlet_name"),
        F.coalesce("outlet_type", F.lit("unknown")).alias("outlet_type"),
        F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        F.coalesce("is_state_owned", F.lit(False)).alias("is_state_owned"),
        F.coalesce("is_state_aligned", F.lit(False)).alias("is_state_aligned"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "position",
    ).where((F.col("domain") != "") & F.col("country").isNotNull() & F.col("audience_type").isin(fixed.AUDIENCES))
    kept = out.where(~F.col("country").isin(fixed.EXCLUDED_COUNTRIES))
    return kept.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "position")


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    """Outlets of a JSON file {"outlets": [...]}."""
    rows = spark.read.schema(f"outlets array<struct<{OUTLETS}>>").json(path, multiLine=True)
    return clean_outlets(rows.select(F.posexplode("outlets").alias("position", "o")).select("position", "o.*"))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    entry = "struct<fips:string,iso2:string,iso3:string,name:string,official_languages:array<string>,region:string>"
    rows = spark.read.schema(f"countries map<string,{entry}>").json(path, multiLine=True)
    return rows.select(F.explode("countries").alias("iso", "c")).select("c.*")


def fips_index(countries: DataFrame) -> DataFrame:
    return countries.where("fips is not null").groupBy("fips").agg(F.min("iso2").alias("iso2"))


def read_theme_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("themes map<string,struct<label:string,description:string>>").json(path, multiLine=True)
    return rows.select(F.explode("themes").alias("theme", "t")).select("theme", "t.*")
