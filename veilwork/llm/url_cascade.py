"""URL filters by a cascade of Bloom filters: exact membership of every key the corpus holds, without a join.

1. A rule is a host and the beginning of a path; it fits its host, all subdomains, and paths that start so. A url's keys
   are its host's endings joined to its path's beginnings, of those lengths that rules have.
2. Level 1 of a cascade encodes the listed keys. Level 2 encodes the corpus's keys that pass level 1 without being listed,
   level 3 the listed keys that pass level 2, and so on until no key passes wrongly. A key is listed if the
   first level it does not pass is an even one, or if it passes all of an odd number of levels.
3. The key universe is every key of every url: one scan finds those that pass level 1, and only they move. Filters
   are built as words of 64 bits, combined in the tasks and merged by bitwise or.
4. One cascade lists the rules' keys within the corpus's keys, a second one the blocking rules within all rules, so
   the longest listed key of a url and its verdict are read from two filters.

Filters are cut by digest into parts of at most ``LIMIT_BYTES``. One part is broadcast, and judging is a single pass over the
urls. With more parts no executor holds them all: distinct keys are sent to the parts, and the few that are listed are
joined to the urls.

Defined cases: a null url, or one without ``://``, has an empty host and path; hosts keep ports and user names as they are;
rules with null host or another verdict than allow or block are left out, a null path is empty, and of equal rules the blocking one holds;
of keys of one length the longer host wins; an empty table gives no rows, an empty list allows all; equal rows are judged each;
columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.scale import lookup_join
from veilwork.llm.tables import written

DIGEST = 16
FIRST_HASHES, LATER_HASHES = 8, 1  # false positives of a level: 1 in 256, then 1 in 2
LIMIT_BYTES = 32 * 1024 * 1024
MOST_LEVELS = 128  # each halves the keys left; only equal digests could need more
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
VERDICTS = ("allow", "block")
_WORDS = "part int, word long, bits long"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to ``/``, ``?`` or ``#``, A-Z in lower case; path up to ``?`` or ``#``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def digest(key: Column) -> Column:
    """First 128 bits of the key's SHA-256."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 2 * DIGEST))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, k, labels, chars, blocks): one row a rule."""
    host, path = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce("path", F.lit(""))
    known = rules.where(F.col("host").isNotNull() & F.col("verdict").isin(*VERDICTS))
    sizes = F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars")
    own = known.select(F.concat(host, path).alias("key"), *sizes, (F.col("verdict") == "block").alias("blocks"))
    return own.groupBy("key").agg(*[F.max(c).alias(c) for c in ("labels", "chars", "blocks")]).withColumn("k", digest(F.col("key")))


def candidate_keys(shapes: list[tuple[int, int]], host: str = "host", path: str = "path") -> Column:
    """A url's keys, one for each number of host labels and path characters that a rule has, the longest first."""
    if not shapes:
        return F.array().cast("array<string>")
    given = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in shapes])
    built = F.transform(given, lambda s: _key(s, host, path))
    return F.transform(F.sort_array(F.array_distinct(built), asc=False), lambda x: x["key"])


def _key(shape: Column, host: str, path: str) -> Column:
    end = F.call_function("substring_index", F.col(host), F.lit("."), -shape["labels"])
    key = F.concat(end, F.call_function("left", F.col(path), shape["chars"]))
    return F.struct(F.length(key).alias("size"), F.length(end).alias("host"), key.alias("key"))


class Level:
    """Shape of one filter: its bits in each part and its hashes."""

    def __init__(self, number: int, keys: int, parts: int):
        self.number, self.hashes, self.parts = number, FIRST_HASHES if number == 1 else LATER_HASHES, parts
        self.bits = 64 * (int(keys / parts * self.hashes / np.log(2)) // 64 + 1)

    def places(self, digests: np.ndarray) -> np.ndarray:
        """Bits of each key: rows (n, 2) of 64-bit halves to (n, hashes)."""
        with np.errstate(over="ignore"):
            salt = np.uint64(self.number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            a, b = _spread(digests[:, 0] ^ salt), _spread(digests[:, 1] + salt) | np.uint64(1)
            steps = np.arange(self.hashes, dtype=np.uint64)
            return (a[:, None] + steps * b[:, None]) % np.uint64(self.bits)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def halves(digests) -> np.ndarray:
    """Digests as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def part_of(digests: np.ndarray, parts: int) -> np.ndarray:
    return (_spread(digests[:, 0] + digests[:, 1]) % np.uint64(parts)).astype(np.int32)


def passes(level: Level, words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    places = level.places(digests)
    return ((words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _touched(level: Level):
    """Task: words of the filter that its keys set, combined in each batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = halves(batch.column("k").to_pylist())
            places, part = level.places(keys), part_of(keys, level.parts)
            at = (part[:, None].astype(np.int64) * (level.bits // 64) + (places >> np.uint64(6)).astype(np.int64)).ravel()
            words, inverse = np.unique(at, return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, inverse, (np.uint64(1) << (places & np.uint64(63))).ravel())
            part, word = np.divmod(words, level.bits // 64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(word), pa.array(bits.view(np.int64))], names=["part", "word", "bits"])

    return task


class Cascade:
    """Levels and a table of their words, (level, part, word, bits)."""

    def __init__(self, spark: SparkSession, parts: int):
        self.spark, self.parts, self.levels, self.tables = spark, parts, [], []
        self._sent = None

    def add(self, keys: DataFrame, count: int) -> None:
        level = Level(len(self.levels) + 1, count, self.parts)
        words = keys.select("k").mapInArrow(_touched(level), _WORDS).groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
        self.levels.append(level)
        self.tables.append(written(words.withColumn("level", F.lit(level.number)), "filter"))
        self._sent = None

    def _words(self, rows, level: Level) -> np.ndarray:
        words = np.zeros(level.bits // 64, np.uint64)
        for at, bits in rows:
            words[at] = np.uint64(bits & (1 << 64) - 1)
        return words

    def broadcast(self):
        """The whole cascade, where it is one part: ``build`` counts keys before it settles on that."""
        if self._sent is None:
            held = [(x, self._words(((r["word"], r["bits"]) for r in t.toLocalIterator()), x)) for x, t in zip(self.levels, self.tables)]
            self._sent = self.spark.sparkContext.broadcast(held)
        return self._sent

    def listed(self, keys: DataFrame) -> DataFrame:
        """Adds ``passed``, the levels a key passes, to rows with a digest ``k``; those it is asked of need be in the universe."""
        if self.parts == 1:
            sent = self.broadcast()

            @F.pandas_udf("int")
            def passed(k: pd.Series) -> pd.Series:
                return pd.Series(levels_passed(sent.value, halves(k)))

            return keys.withColumn("passed", passed("k"))
        return self._by_parts(keys.select("k"))

    def _by_parts(self, keys: DataFrame) -> DataFrame:
        """(k, passed): keys meet the words of their part in one task, the words first."""
        parts = self.parts

        @F.pandas_udf("int")
        def part(k: pd.Series) -> pd.Series:
            return pd.Series(part_of(halves(k), parts))

        null = lambda kind: F.lit(None).cast(kind)
        rows = keys.select(part("k").alias("part"), F.lit(len(self.levels) + 1).alias("level"), null("long").alias("word"), null("long").alias("bits"), "k")
        for table in self.tables:
            rows = rows.unionByName(table.select("part", "level", "word", "bits", null("binary").alias("k")))
        sorted_rows = rows.repartition("part").sortWithinPartitions("part", "level")
        return sorted_rows.mapInArrow(_stream(self.levels), "k binary, passed int")


def levels_passed(held: list[tuple[Level, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """Levels that each key passes before the first it does not."""
    out, alive = np.zeros(len(keys), np.int32), np.arange(len(keys))
    for level, words in held:
        alive = alive[passes(level, words, keys[alive])]
        out[alive] += 1
    return out


def is_listed(passed: Column) -> Column:
    return passed % 2 == 1


def _stream(levels: list[Level]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            parts, numbers = batch.column("part").to_numpy(), batch.column("level").to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(numbers) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
                if begin == end:
                    continue
                if parts[begin] != part:
                    part, held = parts[begin], [(x, np.zeros(x.bits // 64, np.uint64)) for x in levels]
                rows = batch.slice(begin, end - begin)
                if numbers[begin] <= len(levels):
                    bits = rows.column("bits").to_numpy().view(np.uint64)
                    held[numbers[begin] - 1][1][rows.column("word").to_numpy()] = bits
                else:
                    passed = levels_passed(held, halves(rows.column("k").to_pylist()))
                    yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array(passed)], names=["k", "passed"])

    return task


def _parts(listed: int, passing: int, limit: int) -> int:
    """Parts that keep all levels of one part within the limit: every second level holds half the keys of the last but one."""
    bits = (listed * (FIRST_HASHES + 1) + passing * 2) / np.log(2)
    return max(1, int(np.ceil(1.1 * bits / 8 / limit)))


def build(listed: DataFrame, universe: DataFrame, limit: int = LIMIT_BYTES) -> Cascade:
    """Cascade that tells the listed digests from all others of the universe; both have a column ``k``, repeats allowed.

    The universe is read once, for the keys that pass the first level (and again if these are more than the parts can
    hold); after that only wrongly passing keys are held.
    """
    inside = written(listed.select("k").distinct(), "listed")
    count = inside.count()
    parts = _parts(count, 0, limit)
    if count == 0:
        return Cascade(listed.sparkSession, parts)
    while True:
        cascade = Cascade(listed.sparkSession, parts)
        cascade.add(inside, count)
        asked = universe.select("k") if parts == 1 else universe.select("k").distinct()
        outside = cascade.listed(asked).where("passed = 1").select("k").distinct().join(inside, "k", "left_anti")
        sides = [inside, written(outside, "passing")]
        passing = sides[1].count()
        if _parts(count, passing, limit) <= parts:
            break
        parts = _parts(count, passing, limit)
    while passing:
        if len(cascade.levels) == MOST_LEVELS:
            raise ValueError("Two different keys have the same digest")
        cascade.add(sides[1], passing)
        level = len(cascade.levels)
        sides = [sides[1], written(cascade.listed(sides[0]).where(F.col("passed") == level).select("k"), "passing")]
        passing = sides[1].count()
    return cascade


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", limit: int = LIMIT_BYTES) -> DataFrame:
    """The pages with host, path, rule and verdict; urls without a rule are allowed."""
    spark = pages.sparkSession
    given = written(rule_keys(rules), "rules")
    shapes = sorted((r["labels"], r["chars"]) for r in given.select("labels", "chars").distinct().collect())  # host labels by path lengths
    host, path = host_and_path(F.col(url))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*own).alias("page"), host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(shapes))
    universe = rows.select(F.explode("keys").alias("key"))
    rule_cascade = build(given, universe.select(digest(F.col("key")).alias("k")), limit)
    block_cascade = build(given.where("blocks"), given, limit)
    if rule_cascade.parts == block_cascade.parts == 1:
        found = _by_broadcast(rows, rule_cascade, block_cascade)
    else:
        keys = universe.distinct().withColumn("k", digest(F.col("key")))
        hit = keys.join(rule_cascade.listed(keys).where(is_listed(F.col("passed"))).select("k"), "k")
        blocked = block_cascade.listed(hit.select("k")).select("k", is_listed(F.col("passed")).alias("blocks"))
        found = _by_join(rows, hit.join(blocked, "k").select("key", "blocks"))
    return found.select("page.*", "host", "path", "rule", F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))


def _by_broadcast(rows: DataFrame, rule_cascade: Cascade, block_cascade: Cascade) -> DataFrame:
    """Adds rule and blocks in one pass over the rows."""
    listed, blocking = rule_cascade.broadcast(), block_cascade.broadcast()

    @F.pandas_udf("struct<at:int,blocks:boolean>")
    def longest(digests: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(d) for d in digests], np.int64)
        keys = halves(x for d in digests for x in d)
        row = np.repeat(np.arange(len(sizes)), sizes)
        hits = np.flatnonzero(levels_passed(listed.value, keys) % 2 == 1)
        rows_hit, first = np.unique(row[hits], return_index=True)  # keys come longest first
        at, blocks = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), bool)
        at[rows_hit] = hits[first] - (np.cumsum(sizes) - sizes)[rows_hit] + 1
        blocks[rows_hit] = levels_passed(blocking.value, keys[hits[first]]) % 2 == 1
        return pd.DataFrame({"at": at, "blocks": blocks})

    marked = rows.withColumn("found", longest(F.transform("keys", digest)))
    return marked.withColumn("rule", F.when(F.col("found.at") > 0, F.get("keys", F.col("found.at") - 1))).withColumn("blocks", F.col("found.blocks"))


def _by_join(rows: DataFrame, hit: DataFrame) -> DataFrame:
    """Adds rule and blocks where the filters are too large to send: rows meet the listed keys, spread over salts."""
    numbered = written(rows.withColumn("n", F.monotonically_increasing_id()), "urls")
    asked = numbered.select("n", F.posexplode("keys").alias("at", "key"))
    met = lookup_join(asked, hit, ["key"], "n", F.octet_length("key") + 16, how="inner")
    best = met.groupBy("n").agg(F.min_by(F.struct("key", "blocks"), "at").alias("best"))
    return numbered.join(best, "n", "left").withColumn("rule", F.col("best.key")).withColumn("blocks", F.coalesce("best.blocks", F.lit(False)))


def digest_rows(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict by the given rules."""
    return judge(pages.select("page_id", "url"), rule_table(pages.sparkSession)).drop("url")
