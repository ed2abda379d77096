"""File and record sources, and the views that stand in for recorded traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 4, split: int = 128 << 20) -> DataFrame:
    """``df`` dealt over all cores unless its files have a split of full size for each: small ones may be a single row group, which is one task's work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * split else df.repartition(cores * per_core)


def walk(spark: SparkSession, folder: str, max_size: int = 100_000) -> DataFrame:
    """(path, content) of all files below a folder but hidden ones; larger files keep an empty content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return df.where(~name.startswith(".")).select("path", F.when(F.col("length") <= max_size, F.col("content").cast("string")).otherwise("").alias("content"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(text, source, target): whole files to scan, the source being the file's name."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    path = F.col("_metadata.file_path")
    return df.select(F.col("value").alias("text"), F.regexp_extract(path, r"([^/]*)$", 1).alias("source"), path.alias("target"))


def runtime(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recorded visits, one nested row each."""
    return spark.read.schema(schemas.RUNTIME).format(fmt).load(path)


def requests(events: DataFrame) -> DataFrame:
    """Request records made from the events table: (page, seq, url, method, resource_type, status_code)."""
    t = F.col("event_type")
    path = F.when(t == "signup", "/register").when(t == "purchase", "/api/admin/orders").when(t == "error", "/oauth/token").when(t == "click", "/login?next=/home").otherwise("/graphql")
    site = F.concat(F.lit("https://api"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com"))
    return events.select(site.alias("page"), F.col("event_id").alias("seq"), F.concat(site, path).alias("url"), F.when(t.isin("signup", "purchase", "error"), "POST").otherwise("GET").alias("method"), F.lit("fetch").alias("resource_type"), F.when(t == "error", 500).otherwise(200).alias("status_code"))


def dependencies(part: DataFrame) -> DataFrame:
    """Package rows made from the part table."""
    k = F.col("p_partkey")
    names = ("lodash", "express", "axios", "next-auth", "minimatch", "left-pad")
    version = F.concat_ws(".", (k % 5).cast("string"), F.col("p_size").cast("string"), (k % 25).cast("string"))
    return part.select(F.element_at(F.array(*map(F.lit, names)), (k % 6 + 1).cast("int")).alias("name"), version.alias("version"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("source"))
