"""Change capture as Structured Streaming over an append-only change table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.sources.changes import SCHEMA, Criterion, captured


def capture(spark: SparkSession, path: str, criteria: Iterable[Criterion] = (), since_version: int | None = None, since_index: int | None = None, content: str = "BODY") -> DataFrame:
    """A stream of changes; offsets are checkpointed, so a slow subscriber misses nothing."""
    return captured(spark.readStream.schema(SCHEMA).parquet(path), criteria, since_version, since_index, content)


def by_transaction(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, flush: bool = True) -> StreamingQuery:
    """Hand over whole versions in (version, index) order; a batch that is retried has the same number and rows.

    A version that a micro-batch ends in may go on in the next one, so the highest
    that was seen waits, in a table beside the checkpoint, until a higher one
    comes. With `flush` it is handed over with the batch, for streams whose batches
    are known to end with a version. Changes of versions that were handed over
    already come with the next batch.
    """

    def waiting(number: int) -> str:
        return f"{checkpoint.rstrip('/')}-waiting/{number}"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if flush:
            handle(batch.orderBy("version", "index"), number)
            return
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(waiting(number - 1))
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(waiting(number - 1))) if there else batch
        last = both.agg(F.max("version")).first()[0]
        both.where(F.col("version") == last).write.mode("overwrite").parquet(waiting(number))
        handle(both.where(F.col("version") < last).orderBy("version", "index"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def system(spark: SparkSession, path: str, since_version: int | None = None, since_index: int | None = None, content: str = "BODY") -> DataFrame:
    """A stream of changes of the engine itself: catalogues that were made, renamed or removed (area ENGINE)."""
    return capture(spark, path, [Criterion(area="ENGINE")], since_version, since_index, content)


def current_state(stream: DataFrame) -> DataFrame:
    """The last change of every container, kept as streaming state (complete output)."""
    last = F.max_by(F.struct("operation", "body"), F.struct("version", "index")).alias("last")
    return stream.groupBy("entity_type", "pk", "container_type", "container_name").agg(last).where("last.operation <> 'REMOVE'").select("entity_type", "pk", "container_type", "container_name", F.col("last.body").alias("body"))


def activity(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Changes per window and operation, with a watermark that bounds the state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "operation").count().select(F.col("window.start").alias("start"), "operation", "count")
