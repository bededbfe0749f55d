"""Importance resampling towards a target distribution, by CRC buckets of n-grams.

Every run of ``least`` to ``most`` consecutive words is a feature; its bucket is the CRC-32 of its bytes modulo ``buckets``. The
gain of a bucket is the scaled log ratio of its share among the target's features and among all documents' (each counter plus
one). A document's weight is the sum of its features' gains; with Gumbel noise from a hash of its id, the highest scores are a
draw without replacement in proportion to exp(weight / 1000).

CRCs are made for distinct features only: these are grouped by equal length into two-dimensional uint8 arrays, all CRCs of an
array are updated column by column, and the results scattered back. A feature of over ``WIDEST`` bytes is a group of its own
kind: its CRC is made by zlib, to the same value.

Counts of all documents are summed per task (one row a bucket) before they are shuffled, so no bucket is hot. Ranks are made by a
range partitioning over score and id: each part numbers its own rows, and the parts' sizes, of which there are as many as parts,
give the offsets. So no task sorts all rows.

A null or blank text has no features and weight 0. A row without doc_id has no score and is never drawn, nor does it count among
those drawn from; its features count. Rows that repeat a doc_id are each judged by their own text; rows that tie in score and id
are ranked in any order, which changes no column but the rank among them. Very long texts are judged whole. Other columns are
ignored. An empty table gives an empty result; an empty target makes the gains depend on the documents alone.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

BUCKETS, LEAST, MOST = 10_000, 1, 1
#: Words that a document needs to be drawn; percent of such documents that are drawn; prefix of the hashed id.
WORDS, PERCENT, SEED = 20, 10, "2024"
#: Features that a task remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 60_000, 4_000_000
#: Longest features that go through the matrices; features, and bytes of a text, taken at a time.
WIDEST, STEP, CHUNK = 256, 30_000, 1 << 19
#: Bytes of words: letters (A-Z lower-cased), digits, all beyond ASCII; others are spaces.
_WORD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


def crcs(found: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each, by matrices of equal length."""
    table, out = crc_table(), np.zeros(len(found), np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.frombuffer(b"".join(found), np.uint8)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    for size in np.unique(sizes):
        which = order[np.searchsorted(ordered, size) : np.searchsorted(ordered, size, "right")]
        if size > WIDEST:
            out[which] = [zlib.crc32(found[i]) for i in which]
            continue
        crc = np.full(len(which), 0xFFFFFFFF, np.uint32)
        matrix = flat[starts[which] + np.arange(size)[:, None]]  # a row for each column of bytes
        for column in matrix:
            crc = table[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[which] = ~crc
    return out


def features(text: str | None, least: int, most: int, step: int = CHUNK) -> Iterator[list[bytes]]:
    """The word n-grams of a text, repeats included, from ``step`` bytes at a time."""
    data, at, carried = (text or "").encode("utf-8").translate(_WORD), 0, []
    while at < len(data):
        end = data.find(b" ", at + step)
        end = len(data) if end < 0 else end
        new = data[at:end].split()
        if most == 1:
            yield new
        else:
            words, first = carried + new, len(carried)
            yield [b" ".join(words[k - n + 1 : k + 1]) for n in range(least, most + 1) for k in range(max(first, n - 1), len(words))]
            carried = words[-most + 1 :]
        at = end


def grouped(texts: list[str | None], least: int, most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of texts, features): the features of some texts at a time, with as many numbers as features of each."""
    counts, found = [0] * len(texts), []
    for i, text in enumerate(texts):
        for part in features(text, least, most):
            found += part
            counts[i] += len(part)
            if len(found) >= STEP:
                yield counts, found
                counts, found = [0] * len(texts), []
    yield counts, found


class Buckets:
    """Buckets of features; remembers distinct ones up to a bound."""

    def __init__(self, count: int):
        self.count = count
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict = defaultdict()
        self.place.default_factory = self.place.__len__
        self.known, self.bytes = np.zeros(0, np.int64), 0

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self.place) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.clear()
        before = len(self.place)
        places = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        if len(self.place) > before:
            new = list(islice(reversed(self.place), len(self.place) - before))[::-1]
            self.bytes += sum(map(len, new))
            self.known = np.concatenate([self.known, crcs(new).astype(np.int64) % self.count])
        return self.known[places]


def counted(texts: DataFrame, buckets: int, least: int, most: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total, of = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in slices(batches):
            for _, found in grouped(b.column(0).to_pylist(), least, most):
                total += np.bincount(of.of(found), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "features"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select("text").mapInArrow(run, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features"))
    for r in rows.collect():  # at most a row a bucket
        out[r["bucket"]] = r["features"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the documents."""
    size, s_all, t_all = len(documents), int(documents.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * float(s_all + size) / ((int(s) + 1) * float(t_all + size)))) for s, t in zip(documents, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, least: int, most: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, place (any number that tells rows apart) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        of = Buckets(len(shared.value))
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            size, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for counts, found in grouped(texts, least, most):
                ends = np.cumsum(counts)
                sums = np.concatenate([[0], np.cumsum(shared.value[of.of(found)])])
                size += counts
                weight += sums[ends] - sums[ends - counts]
            words = size if least == most == 1 else np.array([sum(map(len, features(t, 1, 1))) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, size, weight))], ["doc_id", "n_words", "n_features", "weight"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("place", F.monotonically_increasing_id())


def noisy(rows: DataFrame, seed: str) -> DataFrame:
    """rows with score: the weight plus 1000 times Gumbel noise from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank: 1, 2, 3 by score descending, ties to the smaller doc_id; without one task that holds all."""
    parts = rows.repartitionByRange(F.col("score").desc(), F.col("doc_id"), F.col("place")).sortWithinPartitions(F.col("score").desc(), "doc_id", "place")
    at = F.col("order_id")
    numbered = parts.withColumn("order_id", F.monotonically_increasing_id()).select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("nth"))
    numbered = staged(numbered.drop("order_id"), "ranked")
    before, offsets = 0, []
    for r in numbered.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    if not offsets:
        return numbered.select("*", F.col("nth").alias("rank")).drop("part", "nth")
    table = numbered.sparkSession.createDataFrame(offsets, "part long, before long")
    return numbered.join(F.broadcast(table), "part").withColumn("rank", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least: int = LEAST, most: int = MOST, words: int = WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where a row isn't drawn."""
    gain = gains(counted(docs, buckets, least, most), counted(target, buckets, least, most))
    rows = staged(noisy(weighed(docs, gain, least, most), seed), "weighed")
    may = (F.col("n_words") >= words) & F.col("doc_id").isNotNull()
    drawn = rows.where(may).count() * percent // 100
    order = ranked(rows.where(may)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
