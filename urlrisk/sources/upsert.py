"""Merging changed records into a partitioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.session import children, drop_shared, shared_path

c = F.col


def newest(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """One record per key: that of the greatest version; of equal versions that with the greatest hash of its fields.

    Keys are dealt first: they hardly repeat within a file, and a sort of each whole file before that grows with the file.
    """
    record = F.struct(*[c(n) for n in rows.columns])
    order = F.struct(version.alias("v"), F.xxhash64(F.to_json(record)).alias("h"))
    return rows.repartition(c(key)).groupBy(key).agg(F.max_by(record, order).alias("_r")).select("_r.*")


def upsert(rows: DataFrame, path: str, key: str, version: Column, partition: str) -> None:
    """Merge ``rows`` into the table at ``path``: the newest record of every key stays.

    A key always belongs to the same partition.  Only partitions that ``rows``
    touch are read and written again; files of all others stay as they are.
    The merged partitions are written aside before they replace the old ones, so a
    repeated merge finds what it needs and changes nothing.  Without rows nothing
    is written, unless there is no table yet.
    """
    spark = rows.sparkSession
    aside = shared_path(spark, "merge")
    new = rows.select(*rows.columns)
    if any("=" in name for name in children(spark, path)):
        old = spark.read.parquet(path).select([F.col(f.name).cast(f.dataType) for f in rows.schema])
        touched = rows.select(partition).distinct()
        new = old.join(touched, partition, "left_semi").unionByName(new)
    newest(new, key, version).write.parquet(aside)
    merged = spark.read.schema(rows.schema).parquet(aside)
    (merged.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
    drop_shared(spark, aside)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as it is; no key repeats.  One that was never written is empty."""
    if any("=" in name for name in children(spark, path)):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
