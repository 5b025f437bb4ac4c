"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

1. Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share all words by weight and stop at
   ``CAP`` times a source's words; the excess is shared again by weight, in closed form.
2. The mix is cut into equal blocks of words. Sources get blocks by highest quotients target / (2k + 1); a
   source's blocks go to its shards the same way, by shard size, which gives an integer quota for each shard.
3. A shard is a run of documents in seeded order, its words cut into blocks. Whole passes over the shard come
   first; the rest of its quota are the blocks of lowest seeded hash. A document is taken by the words it has
   in the chosen blocks.

Shards hold about ``SHARD_DOCS`` documents each, at most ``MAX_SHARDS`` for a source, so that a source with a
third of all rows is many tasks; windows run over slim rows only.

Defined cases: null and empty texts have 0 words and nothing is taken of them; a null source is a source of its
own; rows with equal or null doc_id are rows of their own; of an empty table nothing is taken; other columns
are passed on by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.tables import WORD, n_words, written

CAP = 3
SHARD_DOCS = 256
MAX_SHARDS = 4096
BLOCK_WORDS = 1024
LEAST_BLOCKS = 1 << 16
SEED = 4


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, target, total) for rows of (source, size)."""
    every = Window.partitionBy()
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weighed = sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("double")).withColumn("total", F.sum("source_size").over(every))
    # Sources reach their cap in the order of cap / weight. What is left before each, for each unit of the weight
    # left, rises while those before stop at their cap and falls from there on, so the largest is what holds.
    ratio = F.lit(cap) * F.col("source_size") / F.col("weight")
    upto = Window.orderBy("ratio", "weight", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("ratio", ratio).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(upto), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))),
    )
    target = F.least(F.lit(cap) * F.col("source_size"), F.max("level").over(every) * F.col("weight"))
    return level.select("source", "source_size", "docs", target.cast("double").alias("target"), "total")


def apportion(parties: DataFrame, groups: list[str], order: list[Column], votes: str, seats: str, name: str) -> DataFrame:
    """Add ``name``: what a party gets of its group's ``seats`` by highest quotients votes / (2k + 1).

    Every party starts with its rounded share. The few seats that this gives too many or too few of, half the
    parties at most, are settled by the quotients next to it; as a party can be due several of these, as many
    quotients of it are compared as its share of them can be. Ties fall by ``order``.
    """
    every = Window.partitionBy(*groups)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(F.lit(0.0))
    begun = (
        parties.withColumn("_all", F.sum(votes).over(every))
        .withColumn("_base", F.floor(share * F.col(seats) + 0.5).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_base").over(every))
        .withColumn("_near", F.ceil(share * (F.abs("_open") + F.count(F.lit(1)).over(every))).cast("int") + 1)
        .withColumn("_party", F.struct(*order))
    )
    step = F.explode(F.sequence(F.lit(0), F.when(F.col("_open") == 0, 0).otherwise(F.col("_near")))).alias("_step")
    seat = F.when(F.col("_open") >= 0, F.col("_base") + F.col("_step")).otherwise(F.col("_base") - F.col("_step") - 1)
    tried = begun.select("*", step).withColumn("_seat", seat)
    quotient = F.when(F.col("_seat") >= 0, F.col(votes) / (2 * F.col("_seat") + 1))
    up = Window.partitionBy(*groups).orderBy(F.col("_turn").asc_nulls_last(), "_party", "_step")
    settled = (
        tried.withColumn("_turn", F.when(F.col("_open") >= 0, -quotient).otherwise(quotient))
        .withColumn("_won", (F.row_number().over(up) <= F.abs("_open")) & F.col("_turn").isNotNull() & (F.col(votes) > 0))
    )
    change = F.sum(F.when(F.col("_won"), F.signum("_open")).otherwise(0.0)).cast("long")
    kept = [c for c in parties.columns if c not in groups]
    return (
        settled.groupBy(*groups, "_party")
        .agg(*[F.first(c).alias(c) for c in kept], (F.first("_base") + change).alias(name))
        .drop("_party")
    )


def plan(docs: DataFrame, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, n_blocks, passes, first, last, chosen) for every document.

    ``row`` tells rows apart by content. A document has words in blocks first..last (null for none) of its
    shard of ``n_blocks``; ``chosen`` are those of them that are taken once more than ``passes`` times.
    """
    slim = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("row"))
    sizes = written(slim, "sizes")
    shards = F.least(F.lit(MAX_SHARDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("int")
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / LEAST_BLOCKS))).cast("long")
    targets = source_targets(sizes, cap).withColumn("n_shards", shards).withColumn("block", block)
    targets = targets.withColumn("blocks", F.round(F.col("total") / F.col("block")).cast("long"))
    by_source = [F.col("source").isNull().alias("n"), F.col("source").alias("s")]
    quotas = written(apportion(targets, [], by_source, "target", "blocks", "source_blocks"), "quotas")

    dealt = (
        sizes.join(quotas, sizes["source"].eqNullSafe(quotas["source"]))
        .select(sizes["*"], "source_size", "target", "n_shards", "block", "source_blocks")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "row"), "n_shards").cast("int"))
    )
    line = Window.partitionBy("source", "shard").orderBy("row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = written(dealt.withColumn("end", F.sum("size").over(line)), "lined")

    held = lined.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("block", "source_blocks")]
    )
    quota = apportion(held, ["source"], [F.col("shard")], "words", "source_blocks", "quota")
    quota = (
        quota.where("words > 0")
        .withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long"))
        .withColumn("quota", F.least("quota", F.lit(cap) * F.col("n_blocks")))
        .select("source", "shard", "words", "n_blocks", F.floor(F.col("quota") / F.col("n_blocks")).alias("passes"), (F.col("quota") % F.col("n_blocks")).alias("more"))
    )
    draw = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "source", "shard", "b"), "b")
    blocks = quota.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"))
    chosen = blocks.withColumn("picked", F.row_number().over(draw) <= F.col("more"))
    # One row for a shard, with a flag for each block: as many as SHARD_DOCS documents have words / block_words.
    drawn = chosen.groupBy("source", "shard").agg(
        F.first("words").alias("words"), F.first("n_blocks").alias("n_blocks"), F.first("passes").alias("passes"),
        F.array_sort(F.collect_list(F.when(F.col("picked"), F.col("b")))).alias("picks"),
    )
    drawn = written(drawn, "drawn").withColumnsRenamed({"source": "_source", "shard": "_shard"})
    at = lambda word: F.floor(word * F.col("n_blocks") / F.col("words"))
    placed = lined.join(drawn, lined["source"].eqNullSafe(drawn["_source"]) & (lined["shard"] == drawn["_shard"]), "left")
    some = F.col("size") > 0
    return placed.withColumns({"first": F.when(some, at(F.col("end") - F.col("size"))), "last": F.when(some, at(F.col("end") - 1))}).withColumn(
        "chosen", F.when(some, F.filter("picks", lambda b: b.between(F.col("first"), F.col("last"))))
    ).drop("_source", "_shard", "picks")


def _bound(block: Column) -> Column:
    """First word of a block in its shard: the smallest that ``first`` and ``last`` count to it."""
    return F.ceil(block * F.col("words") / F.col("n_blocks"))


def spans(planned: DataFrame) -> DataFrame:
    """Add ``spans``: from and to (exclusive) of the document's words in its chosen blocks."""
    begin = F.col("end") - F.col("size")
    span = lambda b: F.struct(
        (F.greatest(begin, _bound(b)) - begin).cast("long").alias("a"), (F.least(F.col("end"), _bound(b + 1)) - begin).cast("long").alias("b")
    )
    return planned.withColumn("spans", F.coalesce(F.transform("chosen", span), F.array().cast("array<struct<a:bigint,b:bigint>>")))


def taken(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each document."""
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["b"] - s["a"])
    words = F.coalesce(F.col("passes") * F.col("size"), F.lit(0)) + extra
    return spans(plan(docs, **options)).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", words.cast("long").alias("taken")
    )


def mix(docs: DataFrame, seed: int = SEED, **options: int) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each full pass, then once with the rest of its share.

    That rest keeps the words of chosen blocks, joined by spaces where the document is not chosen whole.
    """
    own = docs.columns
    keyed = docs.select(F.struct(*own).alias("_doc"), F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("row"))
    shares = spans(plan(docs, seed=seed, **options)).where("size > 0 AND (passes > 0 OR size(spans) > 0)").select("row", "size", "passes", "spans")
    shares = written(shares.dropDuplicates(["row"]), "shares")
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(WORD), F.lit(0))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["b"] - s["a"])
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), " ")
    rest = F.when(covered == F.col("size"), F.col("_doc.text")).otherwise(cut)
    whole = F.array_repeat(F.col("_doc.text"), F.col("passes").cast("int"))
    texts = F.when(covered > 0, F.concat(whole, F.array(rest))).otherwise(whole)
    out = keyed.join(shares, "row").select("_doc", F.explode(texts).alias("_text"))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in own])
