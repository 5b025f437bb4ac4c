"""Process repeated content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.scale import BROADCAST_LIMIT_BYTES, SALTS, lookup_join
from veilwork.options import RedactOptions
from veilwork.session import materialized


def fingerprint_column(content: Column, opts: RedactOptions) -> Column:
    """sha256 over the content bytes, then the options as sorted JSON; NULL without a content."""
    return F.sha2(F.concat(content.cast("binary"), F.lit(opts.as_json()).cast("binary")), 256)


def fingerprint(df: DataFrame, opts: RedactOptions, content: str = "text") -> DataFrame:
    return df.withColumn("fp", fingerprint_column(F.col(content), opts))


def process_once(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    opts: RedactOptions,
    content: str = "text",
    id_col: str = "doc_id",
    order: str = "doc_id",
    salts: int = SALTS,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Apply ``fn`` to every distinct content once and give each row its result.

    Adds ``fp`` and ``cache_hit`` (true for all but the first row of a content in ``order``); rows
    keep their own name, and rows without a content stay as they are. ``fn`` gets (fp, content, ...),
    must keep every row and the columns it does not know, and adds the same columns each time.

    A first pass sends only fingerprints, places and salts, and finds the contents that have copies. Their
    fingerprints are a lookup, broadcast where their measured size allows it: a content without copies
    is processed where its row lies and goes nowhere. Of the others the first row is processed,
    and its result is repeated once for each of the ``salts`` that the copies fall into, so no
    task sees more than its share of a content that makes up a third of all rows.
    """
    keyed = fingerprint(df, opts, content)
    salt = F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("_part")
    others = [c for c in df.columns if c not in (content, "fp")]
    rows = keyed.select("fp", content, F.col(order).alias("_at"), salt, F.struct(*others).alias("_row"))
    copies = materialized(
        rows.where("fp IS NOT NULL").select("fp", "_at", "_part").groupBy("fp")
        .agg(F.min("_at").alias("_first"), F.collect_set("_part").alias("_parts"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    firsts = copies.select("fp", "_first", F.lit(True).alias("_copied"))
    marked = lookup_join(rows.withColumn("_id", F.col(f"_row.{id_col}")), firsts, ["fp"], "_id", F.lit(128), limit=limit)
    copied = F.col("_copied").isNotNull()

    alone = fn(marked.where(F.col("fp").isNotNull() & ~copied).select("fp", content, "_row"))
    first_rows = marked.where(copied & F.col("_at").eqNullSafe(F.col("_first")))
    done = fn(first_rows.groupBy("fp").agg(F.any_value(content).alias(content)))
    spread = done.join(copies.select("fp", F.explode("_parts").alias("_part")), "fp")
    hit = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False)).alias("cache_hit")
    rest = marked.where(copied | F.col("fp").isNull()).select("fp", "_part", "_row", hit).join(spread, ["fp", "_part"], "left")

    made = [c for c in done.columns if c != "fp"]
    return alone.withColumn("cache_hit", F.lit(False)).unionByName(rest.drop("_part")).select("_row.*", "fp", *made, "cache_hit")
