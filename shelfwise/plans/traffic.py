"""Traffic recording: a sampled log of queries with their labels, as an append-only table."""

from __future__ import annotations

import time
import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans.compiler import Query, Response

SCHEMA = "ts timestamp, collection string, query string, labels map<string, string>, total long, extras array<string>, seconds double"


def recorded(query: Query, path: str, percent: int = 100) -> Response:
    """Run a query and log it, if its text falls into the sample: the same queries at any time."""
    began = time.perf_counter()
    out = query.run()
    text = str(query.tree)
    if zlib.crc32(text.encode()) % 100 < percent:
        row = (datetime.now(timezone.utc), query.ctx.collection.name, text, {k: str(v) for k, v in query.labels.items()}, out.total, sorted(out.extras), time.perf_counter() - began)
        out.page.sparkSession.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return out


def read(spark: SparkSession, path: str, since: datetime | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """Recorded queries from a moment on that bear all of the labels."""
    out = spark.read.schema(SCHEMA).parquet(path)
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since))
    for name, value in (labels or {}).items():
        out = out.where(F.col("labels")[name] == value)
    return out
