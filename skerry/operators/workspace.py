"""Workspaces as rows: identity, integrity, state; snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import schemas

FOLDERS = ("assets", "reports", "logs", "cache", "screenshots", "snapshots", "db")


def content_hash() -> Column:
    """SHA-256 of id, name, target, root and version."""
    return F.sha2(F.concat_ws("|", "id", "name", "target", "root", F.col("version").cast("string")), 256)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The workspaces under ``root``, newest first; unreadable ones are skipped."""
    df = spark.read.schema(schemas.WORKSPACE + ", _bad string").option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(f"{root}/*/meta.json")
    return df.where("_bad is null and id is not null").drop("_bad").orderBy(F.desc("created_at"))


def write(workspaces: DataFrame, path: str) -> None:
    workspaces.write.mode("overwrite").partitionBy("id").json(path)


def create(spark: SparkSession, name: str, target: str, root: str) -> DataFrame:
    if not name or not target:
        raise ValueError("a workspace needs a name and a target")
    now = F.current_timestamp()
    row = spark.range(1).select(F.expr("uuid()").alias("id"), F.lit(name).alias("name"), F.lit(target).alias("target"), F.lit(root).alias("root"), F.lit(1).alias("version"), F.lit("").alias("hash"), F.lit("idle").alias("status"), now.alias("created_at"), now.alias("modified_at"), F.lit(None).cast("timestamp").alias("last_scan_at"), F.lit(0).alias("scan_count"))
    return row.withColumn("hash", content_hash())


def get(workspaces: DataFrame, id_: str) -> DataFrame:
    found = workspaces.where(F.col("id") == id_)
    if found.isEmpty():
        raise KeyError(id_)
    return found


def checked(workspaces: DataFrame, folders: DataFrame) -> DataFrame:
    """With ``status`` after a check: idle if all folders are there (id, folder) and the hash is right, else error."""
    there = folders.where(F.col("folder").isin(*FOLDERS)).groupBy("id").agg(F.count_distinct("folder").alias("there"))
    ok = (F.coalesce("there", F.lit(0)) == len(FOLDERS)) & (F.col("hash") == content_hash())
    return workspaces.join(there, "id", "left").withColumn("status", F.when(ok, "idle").otherwise("error")).drop("there")


def _changed(workspaces: DataFrame, id_: str, **values: Column) -> DataFrame:
    mine = F.col("id") == id_
    out = workspaces.withColumns({k: F.when(mine, v).otherwise(F.col(k)) for k, v in values.items()})
    return out.withColumn("hash", F.when(mine, content_hash()).otherwise(F.col("hash")))


def scanned(workspaces: DataFrame, id_: str) -> DataFrame:
    return _changed(workspaces, id_, scan_count=F.col("scan_count") + 1, last_scan_at=F.current_timestamp(), modified_at=F.current_timestamp())


def with_status(workspaces: DataFrame, id_: str, status: str) -> DataFrame:
    return _changed(workspaces, id_, status=F.lit(status), modified_at=F.current_timestamp())


def updated(workspaces: DataFrame, id_: str) -> DataFrame:
    return _changed(workspaces, id_, modified_at=F.current_timestamp())


def deleted(workspaces: DataFrame, id_: str) -> DataFrame:
    get(workspaces, id_)
    return workspaces.where(F.col("id") != id_)


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys with ``change``: added, removed or changed between two snapshots of one schema; equal rows are left out."""
    rest = [c for c in new.columns if c not in key]
    digest = F.xxhash64(*[F.col(c) for c in rest]) if rest else F.lit(0).cast("bigint")
    a, b = old.select(*key, digest.alias("before")), new.select(*key, digest.alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).where("change is not null")


def migrated(applied: DataFrame, available: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The migrations that are still to run, in order of their numbers."""
    at = applied.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    return sorted(m for m in available if m[0] > at)
