"""Sharding by extendible hashing.

Rows are hashed to a string of bits; a directory is indexed by prefixes of it.
All rows start in one bucket, and only a bucket over the byte limit is split,
on the next bit, until each fits. A bucket's name is its prefix, so a shard's
content depends only on the data and the limit.

The first BITS bits of the directory come from one histogram of all rows, taken
with map-side sums; if some prefix is still too large then, one more histogram
of the rows under such prefixes alone gives the next BITS bits, and so on. The
key's hash has KEY_BITS bits. Rows of one key that are over the limit together
go on to be split by a hash of all their columns, and, should rows equal in every
column be over the limit, by their place in the input: such rows are
interchangeable. Only a bucket of one row can stay over the limit.

All on DataFrame functions.

Defined cases: a null key hashes like the empty text; a null payload has 0
bytes; an empty table has no shards; extra columns are carried through and count
for telling rows of one key apart, but for those with the name of a result, which
are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import BROADCAST_ROWS, settle

#: Bits that one histogram resolves: 65,536 sums at most under each prefix that is still too large.
BITS = 16
KEY_BITS = 64
#: Bits of the row's own hash that follow the key's, then of its place in the input.
ROW_BITS = 64


def _bits(hex_text: Column, n: int) -> Column:
    """The first n bits of a hex string, as a string of 0 and 1."""
    digits = [F.substring(hex_text, 8 * i + 1, 8) for i in range((n + 31) // 32)]
    return F.substring(F.concat(*(F.lpad(F.conv(d, 16, 2), 32, "0") for d in digits)), 1, n)


def hash_bits(df: DataFrame, key: Column) -> DataFrame:
    """`df` with `__bits`: the key's hash, then the row's, then the place's."""
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) if not t.startswith(("array", "struct", "binary")) else F.xxhash64(F.col(f"`{c}`")).cast("string") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    row = F.md5(F.concat_ws("\1", *plain)) if plain else F.lit("0" * 32)
    place = F.md5(F.monotonically_increasing_id().cast("string"))
    return df.withColumn("__bits", F.concat(_bits(F.md5(F.coalesce(key.cast("string"), F.lit(""))), KEY_BITS), _bits(row, ROW_BITS), _bits(place, ROW_BITS)))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(__bits, __bytes) to the leaves of the directory: shard, depth, shard_bytes, shard_rows.

    Splitting is by whole levels: the sums of every prefix of a histogram give
    all depths of its part of the directory at once, and a prefix is a leaf when
    it fits and its parent doesn't.
    """
    done, depth, leaves = KEY_BITS + 2 * ROW_BITS, 0, None
    open_ = None  # prefixes of `depth` bits that are over the limit
    while depth < done:
        upto = min(depth + BITS, done)
        here = rows if open_ is None else rows.join(open_, F.substring("__bits", 1, depth) == F.col("__open"), "left_semi")
        cells = here.groupBy(F.substring("__bits", 1, upto).alias("cell")).agg(F.sum("__bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        cells = settle(cells, "shard-cells")
        levels = cells.select(F.explode(F.sequence(F.lit(depth), F.lit(upto))).alias("depth"), "cell", "b", "n")
        sums = levels.groupBy("depth", F.substring("cell", F.lit(1), F.col("depth")).alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        big = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        sums = settle(sums.withColumn("big", big), "shard-levels")
        # Both children of a bucket that splits are in the directory, also one without rows.
        split = sums.where(F.col("big") & (F.col("depth") < upto)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.concat("shard", F.lit("0")), F.concat("shard", F.lit("1")))).alias("shard"))
        found = split.join(sums, ["depth", "shard"], "left").where(~F.coalesce("big", F.lit(False)))
        found = found.select("depth", "shard", F.coalesce("shard_bytes", F.lit(0).cast("long")).alias("shard_bytes"), F.coalesce("shard_rows", F.lit(0).cast("long")).alias("shard_rows"))
        if leaves is None:
            leaves = sums.where((F.col("depth") == 0) & ~F.col("big")).select(found.columns)
        leaves = leaves.unionByName(found)
        open_ = sums.where(F.col("big") & (F.col("depth") == upto)).select(F.col("shard").alias("__open"))
        depth = upto
        if open_.isEmpty():
            return leaves
        if open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            open_ = F.broadcast(open_)
    return leaves.unionByName(sums.where(F.col("big") & (F.col("depth") == depth)).select(leaves.columns))


def assign(df: DataFrame, key: Column, payload_bytes: Column, limit: int) -> DataFrame:
    """`df` with shard (its prefix), shard_depth, shard_bytes and row_bytes.

    A row finds its shard by one equality join for each depth at which leaves
    exist, all in one: the row lists its prefixes at those depths. Columns of
    `df` that have one of the four names are replaced; key and payload may use them.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "shard_depth", "shard_bytes", "row_bytes")]
    rows = hash_bits(df, key).withColumn("__bytes", F.coalesce(payload_bytes.cast("long"), F.lit(0).cast("long")))
    leaves = settle(directory(rows.select("__bits", "__bytes"), limit), "shard-directory")
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # 192 at most
    small = leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    leaves = leaves.select(F.col("shard").alias("__shard"), F.col("depth").alias("__depth"), F.col("shard_bytes").alias("__size"))
    # The leaf over a row is found by its longest prefix at which the directory has an entry: prefixes of leaves are disjoint, so one matches.
    at = F.array(*(F.substring("__bits", 1, d) for d in depths)) if depths else F.array().cast("array<string>")
    if small:
        leaves = F.broadcast(leaves)
    out = rows.withColumn("__try", F.explode(at)).join(leaves, F.col("__try") == F.col("__shard"))
    return out.select(*(f"`{c}`" for c in kept), F.col("__shard").alias("shard"), F.col("__depth").alias("shard_depth"), F.col("__size").alias("shard_bytes"), F.col("__bytes").alias("row_bytes"))


def write(df: DataFrame, key: Column, payload_bytes: Column, limit: int, path: str) -> None:
    """Write the shards, a folder for each, by Spark's own writer."""
    assign(df, key, payload_bytes, limit).write.partitionBy("shard").parquet(path)
