"""Window and join forms that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that may meet in one task when positions are dense within the key.
POSITION_BUCKET = 1 << 18
# Ways a hot key is split over in a salted join.
SALTS = 1024
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: Column,
    name: str,
    bucket_of: str | None = None,
    bucket: int = POSITION_BUCKET,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same key that come earlier.

    A plain window over ``keys`` would sort a hot key in one task. Rows are cut by their leading
    position column into buckets instead; each bucket is summed on its own, the bucket totals
    (one small row each) get a running sum, and both are added. The rows are read and shuffled once, by
    keys and bucket: totals are summed behind the same exchange that the window uses, which Spark finds
    to be equal and runs once. For that both sides have to ask for the same columns, hence ``_same``.
    Positions are numbers and unique within a key.
    """
    at = F.floor(F.col(bucket_of or order_by[0]) / F.lit(bucket)).cast("long")
    # One struct, which is never null: rows with null keys belong together, and the join adds no filter to one side.
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], at.alias("bucket"))
    cut = df.withColumn("_place", place).withColumn("_value", value.cast("long")).repartition("_place")
    inner = Window.partitionBy("_place").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    outer = Window.partitionBy(*[f"_place.k{i}" for i in range(len(keys))]).orderBy("_place.bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_place")
        .agg(F.sum("_value").alias("_total"), F.max(F.xxhash64(*df.columns)).alias("_same"))
        .where("_same IS NOT NULL")
        .withColumn("_offset", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
        .drop("_total", "_same")
    )
    return (
        local.join(offsets, "_place", "left")
        .withColumn(name, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_place", "_value", "_local", "_offset")
    )


def number_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str, **kw) -> DataFrame:
    """Add ``name``: contiguous position of the row within its key, from 0."""
    return running_before(df, keys, order_by, F.lit(1), name, **kw)


def fits_broadcast(df: DataFrame, size: Column, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Measure a lookup side before it is broadcast: one sum, combined on the executors."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return total <= limit


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: str,
    size: Column,
    how: str = "left",
    limit: int = BROADCAST_LIMIT_BYTES,
    salts: int = 32,
) -> DataFrame:
    """Join many rows to a lookup with one row per key.

    Below ``limit`` measured bytes the lookup is broadcast and the left side does not move.
    Beyond it every lookup row is repeated ``salts`` times and the left rows of a key spread over
    the copies by ``salt_by``, so a key with a third of all rows is still ``salts`` tasks. Where no key has
    many left rows, one salt will do. Spark takes the size of a packed file for that of its rows and knows nothing of
    the copies; it would broadcast what was just found too large, so the join is told to be a merge.
    """
    if fits_broadcast(right, size, limit):
        return left.join(F.broadcast(right), list(on), how)
    if salts == 1:
        return left.join(right.hint("merge"), list(on), how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
