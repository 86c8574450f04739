"""Histograms of numbers: equal-width grids, smaller ones without needless gaps, and quantile grids.

STANDARD has n buckets of one width from least to greatest value; each holds its
lower threshold, the last one the greatest value too, and empty ones stay.
OPTIMIZED takes the largest grid of at most n equal buckets in which no more than
a fifth of the buckets, or one, is empty. EQUALIZED has thresholds at n-quantiles, which are
interpolated where one value spans several; equal thresholds fall together.

Values are aggregated by distinct value first, so what is sorted for quantiles is
the histogram of values, never the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.constraints import QueryError

BEHAVIOURS = ("STANDARD", "OPTIMIZED", "EQUALIZED", "EQUALIZED_OPTIMIZED")


def _number(column: Column) -> Column:
    return column.cast("decimal(20,4)")


def histogram(values: DataFrame, n: int, behaviour: str = "STANDARD", keys: tuple[str, ...] = ()) -> DataFrame:
    """(pk, value, keys...; keys without nulls) to bucket, threshold, occurrences, relative_frequency, and least, greatest, overall per key.

    An entity counts once in a bucket however many of its values fall there, and
    once in the overall count. No values give no rows.
    """
    if n < 1:
        raise QueryError("a histogram has one bucket at least")
    if behaviour not in BEHAVIOURS:
        raise QueryError(f"unknown histogram behaviour {behaviour}")
    given = keys
    if not keys:  # one key for all, so that one way serves both
        keys, values = ("__all",), values.withColumn("__all", F.lit(0))
    v = values.where(F.col("value").isNotNull()).select(*keys, "pk", _number(F.col("value")).alias("value")).distinct()
    ends = v.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.count_distinct("pk").alias("overall"))
    if behaviour.startswith("EQUALIZED"):
        grid = _quantiles(v, ends, n, keys)
    else:
        ends = ends.withColumn("n", F.when(F.col("least") == F.col("greatest"), 1).otherwise(n)) if behaviour == "STANDARD" else _fewer(v, ends, n, keys)
        # Thresholds are least + i * step.
        grid = ends.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        grid = grid.withColumn("threshold", F.col("least") + ((F.col("greatest") - F.col("least")) * F.col("bucket") / F.col("n")).cast("decimal(20,6)")).drop("n")
    bounds = Window.partitionBy(*keys).orderBy("bucket")
    grid = grid.withColumn("upto", F.lead("threshold").over(bounds))
    # Few thresholds for each key: an array of them travels with the key's row, and a value finds its place in it.
    lines = grid.groupBy(*keys).agg(F.array_sort(F.collect_list("threshold")).alias("lines"))
    placed = v.join(lines, list(keys)).withColumn("bucket", F.size(F.filter("lines", lambda t: t <= F.col("value"))) - 1)
    counts = placed.groupBy(*keys, "bucket").agg(F.count_distinct("pk").alias("occurrences"))
    out = grid.join(counts, [*keys, "bucket"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    width = F.coalesce(F.col("upto"), F.col("greatest")) - F.col("threshold")
    if behaviour.startswith("EQUALIZED"):
        # Density: occurrences by the share of the range, brought to 100 in sum.
        density = F.when(width > 0, F.col("occurrences") * ((F.col("greatest") - F.col("least")) / width).cast("double")).otherwise(F.col("occurrences").cast("double"))
        total = F.sum(density).over(Window.partitionBy(*keys))
        frequency = F.round(100 * density / total, 2)
    else:
        frequency = F.round((100 * F.col("occurrences") / F.col("overall")).cast("double"), 2)
    return out.withColumn("relative_frequency", frequency).select(*given, "bucket", "threshold", "occurrences", "relative_frequency", "least", "greatest", "overall")


def _fewer(v: DataFrame, ends: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """`ends` with the largest number of buckets, n at most, of which a fifth at most, or one, is empty."""
    tries = v.select(*keys, "value").distinct().join(ends, list(keys)).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.least(F.floor((F.col("value") - F.col("least")) * F.col("n") / F.when(F.col("greatest") > F.col("least"), F.col("greatest") - F.col("least")).otherwise(1)), F.col("n") - 1)
    full = tries.groupBy(*keys, "n").agg(F.count_distinct(place).alias("full"))
    fits = full.where((F.col("n") - F.col("full") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))) & ((F.col("n") < 3) | (F.col("full") > 1)))
    best = fits.groupBy(*keys).agg(F.max("n").alias("n"))
    return ends.join(best, list(keys)).withColumn("n", F.when(F.col("least") == F.col("greatest"), 1).otherwise(F.col("n")))


def _quantiles(v: DataFrame, ends: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """Thresholds at the n-quantiles of the values, in a row for each bucket."""
    by_value = v.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(*keys).orderBy("value")
    upto = F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = by_value.withColumn("after", upto).withColumn("before", F.col("after") - F.col("k")).withColumn("next", F.lead("value").over(order)).withColumn("all", F.sum("k").over(Window.partitionBy(*keys)))
    # The i-th threshold lies at place all * i / n; inside one value's places it moves on towards the next value.
    steps = steps.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.col("all") * F.col("i") / F.lit(n)
    steps = steps.where((place >= F.col("before")) & (place < F.col("after")))
    part = (place - F.col("before")) / F.col("k")
    value = F.col("value") + (F.coalesce(F.col("next") - F.col("value"), F.lit(0)) * part).cast("decimal(20,6)")
    cuts = steps.withColumn("threshold", F.round(value, 2)).groupBy(*keys, "threshold").agg(F.min("i").alias("i"))
    least = Window.partitionBy(*keys).orderBy("threshold")
    cuts = cuts.withColumn("bucket", F.row_number().over(least) - 1)
    cuts = cuts.select(*keys, "bucket", F.col("threshold").cast("decimal(20,6)").alias("threshold"))
    return cuts.join(ends, list(keys)).withColumn("threshold", F.when(F.col("bucket") == 0, F.col("least")).otherwise(F.col("threshold")).cast("decimal(20,6)"))


