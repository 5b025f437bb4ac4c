"""Hard negatives by lists that the anchors of a cluster share (in the manner of MAXIMUS).

1. Anchors are clustered by direction around centres learned from a bounded sample of them; every anchor joins its
   nearest centre, and a cluster's width is the largest angle between the centre and a member.
2. Candidates lie in shards by hash of their id. For each cluster and shard the candidates are sorted once by
   |candidate| * cos(max(0, angle to the centre - width)): times |anchor| no member scores above that.
3. Every member walks this list, all members of a cluster abreast, and stops when the bound of all that is left lies
   below the scores it still looks for. Ties are never cut off.
4. A first walk finds each anchor's positives, the best rows of its own label; the shards' bests are merged. A second walk finds,
   for each positive, the best rows of other labels whose scores lie within the band; below the band no walk goes on.

Tiles of anchors by candidate shards are tasks: both sides are packed into blocks of bytes, anchors are repeated for
every shard and candidates for every group of anchors, so a tile has a bounded number of either at any size of the table.
Components are floor(scale * x) and scores whole numbers; bounds are rounded up.

Defined cases: rows with null id, label or vector, an empty vector, or null or non-finite components take no part;
vectors meet only vectors of their length; equal rows (id, label and vector) count once; rows that share an id and differ
are candidates each and, if their id is an anchor's, anchors each, but no row meets its own id; a positive below zero has an empty band;
fewer rows than asked for give all; an empty table gives none; other columns are not read. Scores beyond 64 bits are not meant to be had.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.ball_tree import SCALE, products, usable
from veilwork.llm.tables import written

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # per cent of the positive's score
EVERY = 50
SAMPLE = 16_384  # anchors the centres are learned from
MEMBERS = 64  # anchors a centre, on average
MOST_CENTRES = 1024
ROUNDS = 8
SHARDS = 16  # at least; as many tasks for one group of anchors
SHARD_ROWS = 1 << 18
GROUP_ROWS = 1 << 15
BLOCK = 1024  # rows of a packed block
MOST_HELD = 1 << 16  # rows a packing task holds in unfinished blocks
STEP = 512  # candidates of the first stretch of a walk
_NONE = np.iinfo(np.int64).min + 1
_PACKED = "dim int, place int, ids binary, labels binary, slots binary, width int, vectors binary, wants binary"
_FOUND = "anchor_id long, slot long, wanted int, vec_id long, score long"
_NAMES = ("ids", "labels", "slots", "width", "vectors", "wants")


def relabelled(every: int = 7, classes: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))


def _angles(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles to a centre of length one; zero vectors, which score nothing, have none."""
    norms = np.sqrt((vectors**2).sum(axis=1))
    cosines = np.divide(vectors @ centre, norms, out=np.ones(len(vectors)), where=norms > 0)
    return np.arccos(np.clip(cosines, -1, 1))


def learn_centres(vectors: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: directions of length one."""
    unit = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300)
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:n]]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy()
    return flat[(offsets[:-1] - offsets[0])[rows][:, None] + np.arange(dim)]


def _narrow(vectors: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if len(vectors) == 0 or (vectors.min() >= np.iinfo(kind).min and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind)
    return vectors


def _pack(columns: tuple[str, ...], block: int):
    """Task: rows of one length and place to blocks of bytes. Columns given beside id, label and vector: slot, wants."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        total = 0

        def close(key: tuple[int, int]) -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held.pop(key))]
            ids, labels, vectors, slots, wants = parts
            vectors = _narrow(vectors)
            cells = [key[0], key[1], ids.tobytes(), labels.tobytes(), slots.tobytes(), vectors.itemsize, vectors.tobytes(), wants.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["dim", "place", *_NAMES])

        for batch in batches:
            ids, labels, places = (batch.column(c).to_numpy() for c in ("vec_id", "label", "place"))
            dims = np.diff(batch.column("v").offsets.to_numpy())
            empty = np.zeros(len(ids), np.int64)
            slots = batch.column("slot").to_numpy() if "slot" in columns else empty
            wants = batch.column("wants") if "wants" in columns else None
            for dim, place in {*zip(dims.tolist(), places.tolist())}:
                rows = np.flatnonzero((dims == dim) & (places == place))
                wanted = _matrix(wants, rows, len(wants[0])) if wants is not None else np.zeros((len(rows), 0), np.int64)
                part = (ids[rows], labels[rows], _matrix(batch.column("v"), rows, dim), slots[rows], wanted)
                held.setdefault((dim, place), []).append(part)
                total += len(rows)
                mine = sum(len(x[0]) for x in held[dim, place])
                if mine >= block:
                    total -= mine
                    yield close((dim, place))
            if total > MOST_HELD:
                yield from map(close, [*held])
                total = 0
        yield from map(close, [*held])

    return task


def packed(rows: DataFrame, place: Column, columns: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    given = rows.select("vec_id", "label", "v", place.cast("int").alias("place"), *columns)
    return given.mapInArrow(_pack(columns, block), _PACKED)


class Rows:
    """Unpacked blocks of one length."""

    def __init__(self, blocks: list[dict], dim: int):
        read = lambda name: np.concatenate([np.frombuffer(b[name], np.int64) for b in blocks])
        self.ids, self.labels, self.slots = read("ids"), read("labels"), read("slots")
        self.vectors = np.concatenate([np.frombuffer(b["vectors"], f"<i{b['width']}").reshape(-1, dim) for b in blocks])
        self.wants = read("wants").reshape(len(self.ids), -1)

    def once(self) -> Rows:
        """Without equal rows: the id, label and vector decide."""
        order = np.lexsort((self.labels, self.ids))
        near = np.flatnonzero((self.ids[order][1:] == self.ids[order][:-1]) & (self.labels[order][1:] == self.labels[order][:-1]))
        seen, gone = set(), []
        for i in sorted({*near.tolist(), *(near + 1).tolist()}):
            row = order[i]
            key = (self.ids[row], self.labels[row], self.vectors[row].tobytes())
            gone += [row] if key in seen else []
            seen.add(key)
        keep = np.ones(len(self.ids), bool)
        keep[gone] = False
        for name in ("ids", "labels", "slots", "vectors", "wants"):
            setattr(self, name, getattr(self, name)[keep])
        return self


def best_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each row: scores falling, ids rising; sorted by row and place."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return order[place < k]


class Best:
    """The k best scores and ids of some rows, filled while lists are walked."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (rows ``which`` by ``ids``), ``_NONE`` where an entry does not count."""
        if not scores.size:
            return
        floor = np.maximum(self.kth()[which], np.partition(scores, -min(self.k, scores.shape[1]), axis=1)[:, -min(self.k, scores.shape[1])])
        row, col = np.nonzero((scores >= floor[:, None]) & (scores > _NONE))
        if not len(row):
            return
        own = np.unique(row)
        all_rows = np.concatenate([np.repeat(own, self.k), row])
        all_scores = np.concatenate([self.scores[which[own]].ravel(), scores[row, col]])
        all_ids = np.concatenate([self.ids[which[own]].ravel(), ids[col]])
        best = best_of(all_rows, all_scores, all_ids, self.k)
        self.scores[which[own]], self.ids[which[own]] = all_scores[best].reshape(-1, self.k), all_ids[best].reshape(-1, self.k)


class Lists:
    """Candidates of one shard in the order of a cluster's bound."""

    def __init__(self, rows: Rows, centre: np.ndarray, width: float, norms: np.ndarray):
        bound = norms * np.cos(np.maximum(0, _angles(rows.vectors, centre) - width - 1e-7))
        bound += 1e-9 * norms + 1e-6
        order = np.argsort(-bound, kind="stable")
        self.bound, self.ids, self.labels, self.vectors = bound[order], rows.ids[order], rows.labels[order], rows.vectors[order]

    def stretches(self, within: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Positions to look at next, and the bound of all later ones."""
        begin, step = 0, STEP
        while begin < len(within):
            part = within[begin : begin + step]
            begin, step = begin + step, min(2 * step, 8192)
            yield part, self.bound[within[begin]] if begin < len(within) else -np.inf


def _done(need: np.ndarray, norms: np.ndarray, bound: float) -> np.ndarray:
    """Members none of whose later candidates can reach the score they need."""
    if bound == -np.inf:
        return np.ones(len(need), bool)
    top = norms * bound
    return top + 1e-9 * np.abs(top) + 1 < need


def walk_positives(lists: Lists, members: Rows, k: int) -> Best:
    """Each member's k best candidates of its own label."""
    norms, best = np.sqrt((members.vectors.astype(np.float64) ** 2).sum(axis=1)), Best(len(members.ids), k)
    for label in np.unique(members.labels):
        on, within = np.flatnonzero(members.labels == label), np.flatnonzero(lists.labels == label)
        for part, later in lists.stretches(within):
            scores = products(members.vectors[on], lists.vectors[part])
            scores[members.ids[on][:, None] == lists.ids[part][None, :]] = _NONE
            best.offer(on, scores, lists.ids[part])
            on = on[~_done(best.kth()[on].astype(np.float64), norms[on], later)]
            if not len(on):
                break
    return best


def bands(wants: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest scores of negatives for positives of these scores; empty below zero and for none."""
    scores = [[int(x) for x in row] for row in wants]  # past 64 bits when multiplied
    low = np.array([[-(-x * least // 100) if x >= 0 else 1 for x in row] for row in scores], np.int64).reshape(wants.shape)
    high = np.array([[x * most // 100 if x >= 0 else 0 for x in row] for row in scores], np.int64).reshape(wants.shape)
    return low, high


def walk_negatives(lists: Lists, members: Rows, k: int, least: int, most: int) -> list[Best]:
    """For each of a member's positives the k best candidates of other labels within its band."""
    norms = np.sqrt((members.vectors.astype(np.float64) ** 2).sum(axis=1))
    low, high = bands(members.wants, least, most)
    found = [Best(len(members.ids), k) for _ in range(low.shape[1])]
    on = np.flatnonzero((low <= high).any(axis=1))
    for part, later in lists.stretches(np.arange(len(lists.ids))):
        if not len(on):
            break
        scores = products(members.vectors[on], lists.vectors[part])
        scores[(members.labels[on][:, None] == lists.labels[part][None, :]) | (members.ids[on][:, None] == lists.ids[part][None, :])] = _NONE
        need = np.full(len(on), np.inf)
        for j, best in enumerate(found):
            lo, hi = low[on, j], high[on, j]
            best.offer(on, np.where((scores >= lo[:, None]) & (scores <= hi[:, None]), scores, _NONE), lists.ids[part])
            need = np.minimum(need, np.where(lo <= hi, np.maximum(best.kth()[on], lo).astype(np.float64), np.inf))
        on = on[~_done(need, norms[on], later)]
    return found


def _walk(centres, widths, k: int, band: tuple[int, int] | None):
    """Task: tiles, each first the blocks of its candidates, then those of its anchors by cluster."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, cluster, blocks, rows, lists, norms = None, None, [], None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["shard"], row["group"]) != tile:
                    tile, cluster, blocks, rows = (row["dim"], row["shard"], row["group"]), None, [], None
                if row["cluster"] < 0:
                    blocks.append(row)
                    continue
                if not blocks and rows is None:
                    continue  # no candidate of this length in the shard
                if rows is None:
                    rows, blocks = Rows(blocks, row["dim"]).once(), []
                    norms = np.sqrt((rows.vectors.astype(np.float64) ** 2).sum(axis=1))
                if row["cluster"] != cluster:
                    cluster = row["cluster"]
                    centre = centres.value.get(row["dim"], np.zeros((1, row["dim"])))[cluster]
                    lists = Lists(rows, centre, widths.value[row["dim"], cluster], norms)
                members = Rows([row], row["dim"])
                found = [walk_positives(lists, members, k)] if band is None else walk_negatives(lists, members, k, *band)
                for j, best in enumerate(found):
                    at = np.nonzero(best.scores > _NONE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(members.ids[at[0]]), pa.array(members.slots[at[0]]), pa.array(np.full(len(at[0]), j, np.int32)), pa.array(best.ids[at]), pa.array(best.scores[at])],
                        names=["anchor_id", "slot", "wanted", "vec_id", "score"],
                    )

    return task


class Miner:
    """Candidates in shards, anchors in clusters, and walks over both."""

    def __init__(self, rows: DataFrame, is_anchor: Column, shards: int, shard_rows: int, group_rows: int):
        """``rows``: vec_id, label, v."""
        self.spark, self.rows = rows.sparkSession, rows
        asked = rows.where(is_anchor).distinct().withColumn("slot", F.xxhash64("label", "v"))
        n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
        self.shards, self.groups = max(shards, -(-n_rows // shard_rows)), max(1, -(-n_anchors // group_rows))
        self.centres = self.spark.sparkContext.broadcast(self._learn(asked, n_anchors))
        self.anchors = written(self._clustered(asked), "anchors")
        widths = self.anchors.groupBy(F.size("v").alias("dim"), "cluster").agg(F.max("angle").alias("width")).collect()  # a row a centre
        self.widths = self.spark.sparkContext.broadcast({(r["dim"], r["cluster"]): r["width"] for r in widths})

    def _learn(self, asked: DataFrame, n_anchors: int) -> dict[int, np.ndarray]:
        """Centres of each length of vector, from at most ``SAMPLE`` anchors picked by hash."""
        share = min(1.0, SAMPLE / max(n_anchors, 1))
        sample = asked.where(F.pmod(F.xxhash64("vec_id", "slot"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE).select("v").toArrow()
        column = sample.column("v").combine_chunks()
        column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)
        dims = np.diff(column.offsets.to_numpy())
        out = {}
        for dim in np.unique(dims).tolist():
            vectors = np.unique(_matrix(column, np.flatnonzero(dims == dim), dim).astype(np.float64), axis=0)  # rows come in any order
            n = min(MOST_CENTRES, -(-int(n_anchors * (dims == dim).mean()) // MEMBERS), len(vectors))
            out[dim] = learn_centres(vectors, max(1, n))
        return out

    def _clustered(self, asked: DataFrame) -> DataFrame:
        """Anchors with the nearest centre and the angle to it."""
        centres = self.centres

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.diff(batch.column("v").offsets.to_numpy())
                cluster, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
                for dim in set(dims.tolist()):
                    rows = np.flatnonzero(dims == dim)
                    vectors, own = _matrix(batch.column("v"), rows, dim).astype(np.float64), centres.value.get(dim, np.zeros((1, dim)))
                    cluster[rows] = (vectors @ own.T).argmax(axis=1)
                    for c in np.unique(cluster[rows]):
                        angle[rows[cluster[rows] == c]] = _angles(vectors[cluster[rows] == c], own[c])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

        return asked.select("vec_id", "label", "v", "slot").mapInArrow(task, "vec_id long, label long, v array<bigint>, slot long, cluster int, angle double")

    def walk(self, anchors: DataFrame, columns: tuple[str, ...], k: int, band: tuple[int, int] | None) -> DataFrame:
        """The best of every tile."""
        shard = F.pmod(F.xxhash64("vec_id"), F.lit(self.shards))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        candidates = packed(self.rows, shard).withColumnRenamed("place", "shard").withColumn("cluster", F.lit(-1)).withColumn("group", every(self.groups))
        # Blocks of a cluster's anchors form within one task each: rows meet by group and cluster first.
        grouped = anchors.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(self.groups)).cast("int"))
        place = F.col("cluster") * self.groups + F.col("group")
        near = grouped.repartition("cluster", "group")
        asked = packed(near, place, columns, 256).withColumn("cluster", F.floor(F.col("place") / self.groups).cast("int")).withColumn("group", F.pmod("place", F.lit(self.groups)))
        asked = asked.withColumn("shard", every(self.shards))
        names = ["dim", "shard", "group", "cluster", *_NAMES]
        rows = candidates.select(*names).union(asked.select(*names))
        # The number is given: tiles are small in bytes and long in work, and must not be put together by their bytes.
        tiles = rows.repartition(2 * self.shards * self.groups, "dim", "shard", "group")
        return tiles.sortWithinPartitions("dim", "shard", "group", "cluster").mapInArrow(_walk(self.centres, self.widths, k, band), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot", "wanted").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    column: str = "embedding",
    scale: int = SCALE,
    shards: int = SHARDS,
    shard_rows: int = SHARD_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    known = vectors.where(F.col("label").isNotNull())
    rows = usable(known.select("vec_id", column, "label"), column, scale, keep=("label",)).withColumn("label", F.col("label").cast("long"))
    miner = Miner(rows, is_anchor, shards, shard_rows, group_rows)
    near = written(_ranked(miner.walk(miner.anchors, ("slot",), positives, None), positives), "positives")
    # Scores a member wants, padded by -1, whose band is empty.
    lists = near.groupBy(F.col("anchor_id").alias("vec_id"), "slot").agg(F.collect_list(F.struct("rank", "score")).alias("p"))
    by_rank = F.transform(F.array_sort("p"), lambda x: x["score"])
    wants = F.slice(F.concat(by_rank, F.array_repeat(F.lit(-1).cast("long"), positives)), 1, positives)
    asked = miner.anchors.join(lists.select("vec_id", "slot", wants.alias("wants")), ["vec_id", "slot"])
    far = _ranked(miner.walk(asked, ("slot", "wants"), negatives, (least, most)), negatives)
    pairs = near.select("anchor_id", "slot", (F.col("rank") - 1).alias("wanted"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor_id", "slot", "wanted"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def every_nth(vectors: DataFrame, n: int = EVERY) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by n, after every seventh row's label has been moved on."""
    return mine(vectors.withColumn("label", relabelled()), F.col("vec_id") % n == 0)
