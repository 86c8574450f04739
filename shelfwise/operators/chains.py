"""Orders given by a linked list: each row names the row before it, -1 being the head."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.scratch import checkpointed

HEAD = -1


def positions(rows: DataFrame) -> DataFrame:
    """(pk, predecessor) to (pk, chain, position): where a row stands in its chain, and the chain's first row.

    By pointer doubling: after k rounds each row knows the row 2^k places before
    it and how far that is, so the rounds grow with the logarithm of the chain.
    A consistent list is one chain from the head; a semi-consistent one has
    several, each starting where the predecessor is missing or the head is named
    again. Rows on a cycle belong to the chain of its smallest key, from there on.
    """
    known = rows.select(F.col("pk").alias("__known"))
    now = rows.select("pk", "predecessor").join(known, F.col("predecessor") == F.col("__known"), "left")
    now = now.select("pk", F.col("__known").alias("up"), F.when(F.col("__known").isNull(), 0).otherwise(1).cast("long").alias("distance"), F.col("pk").alias("first"), F.col("pk").alias("least"))
    n, step = rows.count(), 1
    while step < 2 * max(n, 1):
        above = now.select(F.col("pk").alias("__a"), F.col("up").alias("__up"), F.col("distance").alias("__d"), F.col("first").alias("__f"), F.col("least").alias("__l"))
        joined = now.join(above, F.col("up") == F.col("__a"), "left")
        done = F.col("up").isNull()
        now = joined.select(
            "pk", F.when(~done, F.col("__up")).alias("up"),
            (F.col("distance") + F.when(done, 0).otherwise(F.col("__d"))).alias("distance"),
            F.when(done, F.col("first")).otherwise(F.coalesce(F.col("__f"), F.col("up"))).alias("first"),
            F.least("least", F.coalesce("__l", "least")).alias("least"),
        )
        now = checkpointed(now)
        step *= 2
        if now.where("up is not null").isEmpty():
            break
    cyclic = now.where("up is not null").select("pk", F.col("least").alias("chain"))
    straight = now.where("up is null").select("pk", F.col("first").alias("chain"), F.col("distance").alias("position"))
    if cyclic.isEmpty():
        return straight
    # Cut each cycle before its smallest key, and number what is then a chain.
    cut = rows.join(cyclic, "pk").select("pk", F.when(F.col("pk") == F.col("chain"), F.lit(HEAD)).otherwise(F.col("predecessor")).alias("predecessor"))
    return straight.unionByName(positions(cut))
