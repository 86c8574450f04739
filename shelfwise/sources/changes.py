"""Change tables: appends, batch and streaming reads, and what a change log makes of entities.

A change is (version, index, ts, area, entity_type, pk, operation, container_type,
container_name, body). A version is a transaction; index 0 is its lead event.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version long, index int, ts timestamp, area string, entity_type string, pk int, operation string, container_type string, container_name string, body string"


@dataclass(frozen=True)
class Criterion:
    """What a subscriber wants; fields that are left out match everything."""

    area: str | None = None
    entity_type: str | None = None
    pk: int | None = None
    operations: tuple[str, ...] = ()
    container_types: tuple[str, ...] = ()
    container_names: tuple[str, ...] = ()

    def column(self) -> Column:
        out = F.lit(True)
        for name, value in (("area", self.area), ("entity_type", self.entity_type), ("pk", self.pk)):
            if value is not None:
                out &= F.col(name) == value
        for name, values in (("operation", self.operations), ("container_type", self.container_types), ("container_name", self.container_names)):
            if values:
                out &= F.col(name).isin(*values)
        return F.coalesce(out, F.lit(False))


def captured(changes: DataFrame, criteria: Iterable[Criterion] = (), since_version: int | None = None, since_index: int | None = None, content: str = "BODY") -> DataFrame:
    """Changes that meet any of the criteria (all, without one), from (version, index) on; HEADER leaves the body out.

    The same for a batch table and for a stream.
    """
    out = changes
    if since_version is not None:
        at = F.col("version") > since_version
        out = out.where(at | ((F.col("version") == since_version) & (F.col("index") >= (since_index or 0))))
    criteria = list(criteria)
    if criteria:
        any_ = F.lit(False)
        for c in criteria:
            any_ |= c.column()
        out = out.where(any_)
    return out.drop("body") if content == "HEADER" else out


def append(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def from_events(events: DataFrame) -> DataFrame:
    """The driver's events as changes: a version for every minute, signup and purchase upserting, error removing."""
    version = F.unix_timestamp(F.date_trunc("minute", "ts"))
    operation = F.when(F.col("event_type") == "error", "REMOVE").otherwise("UPSERT")
    return events.select(
        version.alias("version"), F.col("event_id").cast("int").alias("index"), "ts", F.lit("DATA").alias("area"), F.lit("user").alias("entity_type"), F.col("user_id").cast("int").alias("pk"), operation.alias("operation"),
        F.lit("ATTRIBUTE").alias("container_type"), F.col("event_type").alias("container_name"), F.col("value").cast("decimal(12,2)").cast("string").alias("body"),
    )


def replayed(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """(entity_type, pk, container_type, container_name, body): the last writer of every container wins; removed ones are gone."""
    if upto is not None:
        changes = changes.where(F.col("version") <= upto)
    last = changes.groupBy("entity_type", "pk", "container_type", "container_name").agg(F.max_by(F.struct("operation", "body"), F.struct("version", "index")).alias("last"))
    return last.where("last.operation <> 'REMOVE'").select("entity_type", "pk", "container_type", "container_name", F.col("last.body").alias("body"))


def transactions(changes: DataFrame) -> DataFrame:
    """A row for each version: its time and how many changes it holds."""
    return changes.groupBy("version").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("changes"), F.count_distinct("pk").alias("entities"))


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = ()) -> None:
    """Write a result or a backup to a folder of any file system that Spark reaches."""
    writer = df.write.mode("error").format(fmt)
    names = list(partition_by)
    (writer.partitionBy(*names) if names else writer).save(path)
