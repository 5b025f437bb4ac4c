"""N-gram Jaccard self-join by MinHash banding.

1. Each text becomes the set of its runs of ``n`` words. ``bands * rows`` minima of hashed runs are taken, rows
   for the threshold being fixed and bands chosen so that a pair at the threshold shares a band with at least
   the target recall. Texts with equal sets are one class from here on; its first row stands for it.
2. Band hashes are shuffled; a class is tied to the smallest class of each of its bands. Components of these
   ties hold every pair that shares a band.
3. Pairs are verified on the full sets within components: in blocks of ``block`` classes against blocks, each
   in a task of its own, which gives the number of links of each class and no rows for pairs.
4. Components of verified links are the groups.

Defined cases: texts of 1 to n - 1 words are one run of all their words; null and empty texts have no runs and
no links; rows with null doc_id take no part and are no result; equal rows count as copies of each other; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.graph import connected_components
from veilwork.llm.tables import written
from veilwork.llm.words import Words, chunks, int64, mix, runs

NGRAM = 5
THRESHOLD = 0.8
BAND_ROWS = 4
RECALL = 0.9999
BLOCK = 512
COLUMNS = 4096


def band_count(threshold: float = THRESHOLD, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """Fewest bands by which a pair at the threshold shares one with the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _gram_sets(texts: list[bytes], n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of all texts one after another, and the bounds of each text; repeats are kept."""
    words = Words(texts)
    hashes = words.hashes(which)
    size = np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(bounds[-1], np.uint64)
    whole = runs(hashes, n, which)
    start = np.flatnonzero(words.left() >= n)
    long = np.repeat(words.counts >= n, size)
    out[long] = whole[start]
    for d in np.flatnonzero((words.counts > 0) & (words.counts < n)):
        own = hashes[words.first[d] : words.first[d + 1]]
        out[bounds[d]] = runs(own, len(own), which)[0] + np.uint64(len(own))
    return out, bounds


def _set_hash(grams: np.ndarray) -> np.uint64:
    """Of a set, whatever its order."""
    return mix(mix(grams).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams)))[0]


def _signatures(n: int, bands: int, rows: int):
    """Task: 64 bits of each text's set, the number of its runs and its band hashes."""
    draw = np.random.default_rng(7)
    factors = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            grams, bounds = _gram_sets(texts, n)
            full = np.flatnonzero(np.diff(bounds))
            sets, sizes = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
            hashed = np.zeros((bands, len(texts)), np.uint64)
            if len(full):
                for d in full:
                    own = np.unique(grams[bounds[d] : bounds[d + 1]])
                    sizes[d] = len(own)
                    sets[d] = _set_hash(own)
                at = bounds[full]
                for band in range(bands):
                    key = np.full(len(full), band, np.uint64)
                    for i in range(band * rows, band * rows + rows):
                        key = mix(key + np.minimum.reduceat((grams * factors[i] + shifts[i]) >> np.uint64(32), at))
                    hashed[band, full] = key
            out = [batch.column("doc_id"), batch.column("version"), int64(sets), pa.array(sizes), *map(int64, hashed)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "version", "v", "n_grams", *(f"b{i}" for i in range(bands))])

    return task


def _members(n: int):
    """Task: the set of each text that takes part, with what says where it is compared.

    Another text under the same doc_id is told by its hash and left out.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            grams, bounds = _gram_sets(texts, n)
            sets = [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:])]
            v = batch.column("v").to_numpy(zero_copy_only=False).view(np.uint64)
            same = np.array([len(own) > 0 and _set_hash(own) == v[d] for d, own in enumerate(sets)], bool)
            sets = [own.view(np.int64) for own, kept in zip(sets, same) if kept]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            out = batch.drop_columns(["text"]).filter(pa.array(same))
            yield out.append_column("grams", listed)

    return task


def _smallest_reached(linked: np.ndarray) -> np.ndarray:
    """For each class the first one that links lead to."""
    out = np.full(len(linked), -1)
    for k in range(len(linked)):
        if out[k] < 0:
            edge = np.array([k])
            while len(edge):
                out[edge] = k
                edge = np.flatnonzero(linked[edge].any(axis=0) & (out < 0))
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of 0/1 matrices over the runs that several share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _verify(threshold: float):
    """Group function: links of each class within its component, and the root of what it is linked to."""

    def links(table: pa.Table) -> pa.Table:
        v, copies, component, i, j, side = (table.column(c).to_numpy() for c in ("v", "copies", "component", "i", "j", "side"))
        where = np.stack([component, i, j], axis=1)
        grams = table.column("grams").combine_chunks()
        values, values_at = grams.flatten().to_numpy(), grams.offsets.to_numpy() - grams.offsets[0].as_py()
        order = np.lexsort(where.T[::-1])
        cuts = np.flatnonzero(np.any(np.diff(where[order], axis=0), axis=1)) + 1
        count, root = np.zeros(len(v), np.int64), v.copy()
        for own in np.split(order, cuts):
            own = own[np.unique(v[own], return_index=True)[1]]  # equal rows of one class count once
            sets = [values[values_at[k] : values_at[k + 1]] for k in own]
            size = np.array([len(s) for s in sets])
            both = _overlaps(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            if where[own[0], 1] != where[own[0], 2]:
                linked &= side[own][:, None] != side[own][None, :]
            count[own] = linked @ copies[own]
            root[own] = v[own[_smallest_reached(linked)]]
        return pa.table({"v": v, "links": count, "root": root})

    return links


def linked(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, rows: int = BAND_ROWS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, version (hash of its text), class_id, copy_id, n_links, n_grams.

    class_id: smallest doc_id that is linked to it, also by way of others; copy_id: smallest with the same set;
    n_links: rows at the threshold or above, copies included.
    """
    bands = band_count(threshold, rows, recall)
    names = [f"b{i}" for i in range(bands)]
    source = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    schema = "doc_id long, version long, v long, n_grams long, " + ", ".join(f"{b} long" for b in names)
    signed = written(source.mapInArrow(_signatures(n, bands, rows), schema), "signatures")

    kinds = written(
        signed.where("n_grams > 0").groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(b).alias(b) for b in names]),
        "classes",
    )
    banded = kinds.select("v", F.explode(F.array(*names)).alias("band"))
    hubs = written(banded.groupBy("band").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    # A class and its hubs, as many as bands at most, are tied to the smallest of them: classes with the same hubs add one tie each.
    near = banded.join(hubs, "band").groupBy("v").agg(F.collect_set("hub").alias("hubs"))
    near = near.select("v", F.array_union("hubs", F.array("v")).alias("all")).select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
    component = connected_components(near.where("a <> b"))

    # Where each class is compared: components up to one block share tasks, larger ones take a task for each pair of blocks.
    sizes = component.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = component.join(sizes, "label").join(kinds.select("v", "doc_id", "copies"), "v")
    placed = written(placed.withColumn("own", F.pmod(F.hash("v"), "blocks")), "placed")
    packs = max(1, placed.count() // block)
    sets = (
        source.join(placed.hint("merge"), "doc_id")  # the same plan at every size
        .select("v", "label", "copies", "blocks", "own", "text")
        .mapInArrow(_members(n), "v long, label long, copies long, blocks int, own int, grams array<bigint>")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("*", other).select(
        "v", "copies", "grams", F.col("label").alias("component"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(packs))).otherwise(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))).alias("pack"),
    )
    verified = written(pairs.groupBy("pack").applyInArrow(_verify(threshold), "v long, links long, root long"), "verified")

    groups = connected_components(verified.select(F.col("v").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("v").agg(F.sum("links").alias("links"))
    grouped = kinds.select("v", "doc_id", "copies").join(groups, "v", "left").withColumn("label", F.coalesce("label", "v"))
    first = grouped.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    told = written(
        grouped.join(first, "label").join(links, "v", "left")
        .select("v", "class_id", F.col("doc_id").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "told",
    )
    out = signed.select("doc_id", "version", "n_grams", F.when(F.col("n_grams") > 0, F.col("v")).alias("v")).join(told, "v", "left")
    return out.select(
        "doc_id", "version", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_grams",
    )


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    return linked(docs, **options).drop("version")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The first document of each group, as it is; rows with null doc_id all stay."""
    first = linked(docs, **options).where("doc_id = class_id").groupBy("doc_id").agg(F.min("version").alias("_version"))
    keyed = docs.where("doc_id IS NOT NULL").withColumn("_version", F.xxhash64("text"))
    kept = keyed.join(first, ["doc_id", "_version"], "left_semi").dropDuplicates(["doc_id", "_version"])
    return kept.select(*docs.columns).union(docs.where("doc_id IS NULL"))
