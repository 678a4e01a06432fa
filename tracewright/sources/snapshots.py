"""Writing snapshots of a project's graph, keyed tables, and results kept by content.

A publication replaces several tables of some projects as one. Its rows go to partitions of a new version first; then one
file of the manifest says which version each project is at. Readers follow the manifest, so a writer that fails anywhere
before leaves the old snapshot whole, and what it wrote is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "project_id long, version string, published long"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share (a temporary one only in local sessions without it)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"{tempfile.gettempdir()}/tracewright"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(project_id, version): what each project was last published at; of equal numbers the larger version counts."""
    rows = spark.read.schema(MANIFEST).option("ignoreMissingFiles", "true").parquet(f"{folder}/manifest")
    return rows.groupBy("project_id").agg(F.max_by("version", F.struct("published", "version")).alias("version"))


def begin(spark: SparkSession, folder: str) -> None:
    """An empty snapshot folder: its manifest names no project."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{folder}/manifest")


def publish(tables: dict[str, DataFrame], projects: DataFrame, folder: str) -> str:
    """Replace the rows of ``projects`` (project_id) in all tables, each with a project_id, and give the version's name.

    A project without rows in a table has none there afterwards. Rows of other projects are refused by a failing write.
    """
    spark, version = projects.sparkSession, uuid.uuid4().hex
    own = projects.select(F.col("project_id").cast("long").alias("project_id")).distinct()
    for name, df in tables.items():
        known = df.join(own.withColumn("known", F.lit(True)), "project_id", "left")
        checked = known.withColumn("version", F.when(F.col("known"), F.lit(version)).otherwise(F.raise_error(F.lit(f"{name} has rows of a project that is not published"))))
        checked.drop("known").write.mode("append").partitionBy("version", "project_id").parquet(f"{folder}/{name}")
    last = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.coalesce(F.max("published"), F.lit(0))).first()[0]
    own.select("project_id", F.lit(version).alias("version"), F.lit(last + 1).cast("long").alias("published")).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows as the manifest has them; versions that were replaced, or never published, are pruned by partition."""
    rows = spark.read.parquet(f"{folder}/{name}")
    rows = rows.withColumn("project_id", F.col("project_id").cast("long")).withColumn("version", F.col("version").cast("string"))
    return rows.join(manifest(spark, folder), ["project_id", "version"], "left_semi").drop("version")


def replace_project(df: DataFrame, folder: str) -> None:
    """Write rows so that only the project_id partitions they hold are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(folder)


def append_run(df: DataFrame, folder: str) -> None:
    """Add rows of a scan run to a history table."""
    df.write.mode("append").partitionBy("scan_run_id").parquet(folder)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table after the changes, the last of a key by the order column winning over earlier ones and over the table."""
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in key]), order).alias("r")).select(*key, "r.*")
    return current.join(last.select(*key), key, "left_anti").unionByName(last.select(*current.columns))


def insert_new(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows whose key it lacks."""
    return current.unionByName(rows.dropDuplicates(key).join(current.select(*key), key, "left_anti"))


def cache_split(asked: DataFrame, kept: DataFrame, now, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Asked keys (cache_key) that a kept result of the last days answers, and those that none does."""
    fresh = kept.filter(F.col("saved_at") > now - F.make_dt_interval(F.lit(days)))
    return fresh.join(asked, "cache_key", "left_semi"), asked.join(fresh, "cache_key", "left_anti")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def read_records(spark: SparkSession, frame: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON arrays of records in a column ``json``."""
    return frame.select(F.inline(F.from_json("json", f"array<struct<{schema}>>")))
