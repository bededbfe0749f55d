"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct k-word shingles (the whole word sequence where it is shorter). Two documents link when
the Jaccard similarity of their sets is at least ``percent`` / 100. ``components`` gives one row per row of the input with the
smallest id reachable by links; ``links`` gives links between sets, enough of them to connect all that is linked, and
``all_links`` every one.

How it works, on all rows and exactly (up to collisions of 64-bit hashes of shingles and 128-bit hashes of sets):

1. Rows with equal sets are one node, named by the set's hash. All that follows has one row per node, however often a text or
   an id is repeated.
2. Shingles are ordered from rare to frequent by a counting sketch of fixed size, ties by hash. Linked nodes share l shingles
   among the first n - ceil(t n) + l of that order (prefix filter); l is 1 and EXTRA percent of n. Nodes with identical prefix
   and size form a group, and a prefix shingle stands once per group.
3. Prefix shingles that several groups have are counted exactly; a group with fewer of them than it must share has no partner,
   of the others all but so many of the rarest are left out (prefix filter again). What is left are blocks of groups.
4. In blocks of at most DIRECT members pairs of groups are formed and filtered by size and shared prefix; those that stay are
   expanded into pairs of members, screened by histograms and verified on the sets.
5. In a larger block, one member is the hub, and all others are compared with it alone: who links is linked by that star. What
   is left is told by the shingles in which members differ from the hub, without their sets (see ``families``).

Null and blank texts have an empty set and link with nothing; each is its own component. A null doc_id takes part like others,
but gives a component no name: the component of rows without any id is null. Rows that repeat a doc_id are each judged by
their own text. Very long texts are sets like others. Of equal ids any is the smallest, which changes no result. Other columns
are ignored by ``components`` and carried by ``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import families
from .common import forget, free, heavy, joined, slices, staged

K, PERCENT = 3, 90
#: Lists of row keys up to this long are broadcast (some 50 MB), longer ones are joined by shuffle.
BROADCAST_KEYS = 500_000
#: The sketch has as many counters as documents, within these powers of two.
LEAST_BITS, MOST_BITS, CHUNK = 16, 21, 1024
#: Members of a block whose pairs are all looked at; larger blocks are resolved by hubs.
DIRECT = 32
#: Parts that the members of a hub with many, and the tasks' sketches, are dealt into.
SALTS = 64
#: Percent of a set that prefixes are longer by.
EXTRA = 4
#: Buckets of a set's histogram.
BUCKETS = 128
#: Digests that a task remembers in order to skip repeats.
REPEATS = 200_000
_TOP = np.uint64(64 - 7)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8").lower().split()  # lower-cases A-Z and cuts at space and \t to \r, as bytes do
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for j in range(width):
        out = out * _MIX[0] + hashes[j : len(hashes) - width + 1 + j]
    out ^= out >> np.uint64(32)
    out *= _MIX[1]
    out ^= out >> np.uint64(29)
    out *= _MIX[2]
    return np.unique(out ^ (out >> np.uint64(32)))


def name_of(found: np.ndarray) -> bytes:
    """The node of a set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def digests(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Per row doc_id, text_key, n_shingles, node; and per task chunks of a counting sketch of all shingles (rows with a chunk)."""

    def run(batches):
        sketch, mask = np.zeros(1 << bits, np.uint32), np.uint64((1 << bits) - 1)
        names = ["doc_id", "text_key", "n_shingles", "node", "chunk", "counts"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        for b in slices(batches):
            rows = []
            for doc, key, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                found = shingles(text, k)
                np.add.at(sketch, (found & mask).astype(np.int64), 1)
                rows.append((doc, key, len(found), name_of(found), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows = [(None, None, None, None, c, part.tobytes()) for c, part in enumerate(sketch.reshape(-1, CHUNK)) if part.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", text_key(), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, node binary, chunk int, counts binary")


def frequency_levels(rows: DataFrame, bits: int) -> bytes:
    """A byte per counter: how often its count doubles the mean. 2 ** bits bytes come to the driver.

    Tasks' sketches are added in two steps, so that no task holds a chunk of all of them.
    """

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for blob in part["counts"].to_pylist():
            total += np.frombuffer(blob, np.uint32 if len(blob) == 4 * CHUNK else np.uint64)
        return pa.table({"chunk": [part["chunk"][0].as_py()], "counts": [total.tobytes()]}, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    counts = np.zeros(1 << bits, np.uint64)
    some = rows.where("chunk is not null").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(SALTS)).alias("part"))
    some = some.groupBy("chunk", "part").applyInArrow(add, "chunk int, counts binary")
    for r in some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint64)
    mean = max(1.0, float(counts.mean()))
    return np.floor(np.log2(np.maximum(counts / mean, 1.0))).astype(np.uint8).tobytes()


def heads_of(docs: DataFrame, k: int, percent: int, levels: bytes) -> DataFrame:
    """node, n, gid (names the prefix and size), prefix, histogram of every node.

    The histogram counts the set's hashes by bucket; the sum of differences of two is at most the sets' symmetric difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # at most 2 ** MOST_BITS bytes

    def run(batches):
        level = np.frombuffer(shared.value, np.uint8)
        mask, seen = np.uint64(len(level) - 1), set()
        for b in slices(batches):
            rows = []
            for text in b.column(0).to_pylist():
                found = shingles(text, k)
                node = name_of(found)
                if not len(found) or node in seen:
                    continue
                if len(seen) >= REPEATS:
                    seen.clear()
                seen.add(node)
                first = len(found) - needed(len(found), percent) + 1 + EXTRA * len(found) // 100
                order = np.lexsort((found, level[(found & mask).astype(np.int64)]))[:first]
                head = found[order]
                gid = np.uint64(xxhash.xxh3_64_intdigest(head.tobytes() + len(found).to_bytes(8, "little"))).astype(np.int64)
                counts = np.minimum(np.bincount((found >> _TOP).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)
                rows.append((node, len(found), int(gid), head.view(np.int64), counts.tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["node", "n", "gid", "prefix", "histogram"])

    return docs.select("text").mapInArrow(run, "node binary, n long, gid long, prefix array<long>, histogram binary").dropDuplicates(["node"])


def matching(docs: DataFrame, keys: DataFrame, how: str, *names: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the keys; nulls match nulls. text_key is made from the text."""
    own = {c: free(docs, "key_" + c) for c in names}
    renamed = keys.select(*[F.col(c).alias(own[c]) for c in names])
    same = reduce(Column.__and__, [(F.xxhash64("text") if c == "text_key" else F.col(c)).eqNullSafe(F.col(own[c])) for c in names])
    return docs.join(F.broadcast(renamed) if keys.count() <= BROADCAST_KEYS else renamed, same, how)


def sets_of(nodes: DataFrame, docs: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """node, shingles (sorted hashes as bytes) of nodes, made again from the text of one row of each."""

    def run(batches):
        for b in slices(batches):
            found = [shingles(t, k) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(name_of, found), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "shingles"])

    keys = staged(names.join(nodes, "node", "left_semi").select("doc_id", "text_key"), "keys")
    rows = matching(docs, keys, "left_semi", "doc_id", "text_key")
    return staged(rows.select("text").mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"]), "sets")


def size_bin(n: Column, percent: int) -> Column:
    """Sizes that can link are in the same bin or in neighbouring ones (a margin keeps rounding from parting them)."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent + 1e-9) + 1e-9).cast("long")


def fits(a: str, b: str, percent: int) -> Column:
    """Sizes of two sets that can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def postings(groups: DataFrame, percent: int) -> DataFrame:
    """token, gid, n, members, odd, c of the rarest prefix shingles of groups that may have a partner.

    c: how many members have the shingle; odd: how much of the group's prefix no other has.
    """
    all_ = groups.select("gid", "n", "members", F.size("prefix").alias("first"), F.explode("prefix").alias("token"))
    shared = all_.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("c")).where("groups > 1")
    own = Window.partitionBy("gid")
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # the smallest size that can link
    live = all_.join(shared, "token").withColumn("must", (1 + F.floor(smallest * EXTRA / 100)).cast("long"))
    ranked = live.withColumn("has", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("c", "token")))
    return ranked.where("rank <= has - must + 1").select("token", "gid", "n", "members", "c", (F.col("first") - F.col("has")).alias("odd"))


def level_blocks(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(small, large): key, gid, n, low of the rows of small blocks; hub_gid, gid of those of large ones, by number of members.

    Shingles of many members are parted by size first; ``low`` rows are the smaller neighbours of a block's size bin.
    """
    rows = staged(postings(groups, percent), "postings")
    one = rows.where(F.col("c") <= DIRECT).select(F.col("token").alias("key"), "gid", "n", F.lit(False).alias("low"))
    step = rows.where(F.col("c") > DIRECT).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    many = step.select(F.xxhash64("token", size_bin(F.col("n"), percent) + F.col("step")).alias("key"), "gid", "n", "odd", "members", (F.col("step") == 1).alias("low"))
    whole = groups.where(F.col("members") > DIRECT).select(F.xxhash64("gid", F.lit(-1)).alias("key"), "gid", "n", F.lit(0).alias("odd"), "members", F.lit(False).alias("low"))
    many = staged(many.unionByName(whole), "many")
    hub = F.min(F.when(~F.col("low"), F.struct("odd", "gid")))
    sizes = staged(many.groupBy("key").agg(F.sum("members").alias("size"), F.count(F.lit(1)).alias("rows"), hub.alias("hub")).where("hub is not null and size > 1"), "sizes")
    found = joined(many.drop("members", "odd"), sizes.select("key", "size", "rows", F.col("hub.gid").alias("hub_gid")), "key", "rows")
    small = one.unionByName(found.where(F.col("size") <= DIRECT).select("key", "gid", "n", "low"))
    return small, staged(found.where(F.col("size") > DIRECT).select("hub_gid", "gid").distinct(), "large")


def group_pairs(small: DataFrame, groups: DataFrame, percent: int, most: int = DIRECT) -> DataFrame:
    """ga, gb of the pairs of groups in small blocks that sizes and shared prefix shingles leave; each group of 2 to ``most``
    members with itself."""
    left, right = (small.select("key", F.col("gid").alias("g" + k), F.col("n").alias("n" + k), F.col("low").alias("l" + k)) for k in "ab")
    met = left.join(right, "key").where((F.col("ga") < F.col("gb")) & ~(F.col("la") & F.col("lb")) & fits("na", "nb", percent)).select("ga", "gb").distinct()
    a, b = (groups.select(F.col("gid").alias("g" + k), F.col("n").alias("n" + k), F.col("prefix").alias("p" + k)) for k in "ab")
    least = 1 + F.floor(F.least("na", "nb") * EXTRA / 100)
    kept = met.join(a, "ga").join(b, "gb").where(F.size(F.array_intersect("pa", "pb")) >= least).select("ga", "gb")
    return kept.unionByName(groups.where(F.col("members").between(2, most)).select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))


def member_pairs(pairs: DataFrame, groups: DataFrame, heads: DataFrame) -> DataFrame:
    """a, b: pairs of groups expanded into pairs of their members."""
    alone = groups.where("members = 1").select("gid", "node")
    members = alone.unionByName(heads.join(groups.where("members > 1").select("gid"), "gid").select("gid", "node"))
    a, b = (members.select(F.col("gid").alias("g" + k), F.col("node").alias(k)) for k in "ab")
    return pairs.join(a, "ga").join(b, "gb").where((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def screened(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and histograms leave: all that link, and few others."""
    left, right = (heads.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("histogram").alias("h" + k)) for k in "ab")

    def run(batches):
        for b in slices(batches, 5000):
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (2, 3))
            apart, both = np.abs(x - y).sum(1, dtype=np.int64), b.column(4).to_numpy()
            keep = pa.array(apart * (100 + percent) <= (100 - percent) * both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.distinct().join(left, "a").join(right, "b").where(fits("na", "nb", percent)).select("a", "b", "ha", "hb", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def differences(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """block, node, n, linked, r of met (hub, node): the shingles r that one of both has, and whether the two link.

    Members of the few hubs that have many are dealt out by a salt, and those hubs' sets repeated for each.
    """
    hot = F.broadcast(heavy(met.groupBy("hub").agg(F.count(F.lit(1)).alias("rows")), "rows").select("hub", F.lit(SALTS).alias("salts")))
    dealt = met.join(hot, "hub", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1)).cast("long")))
    own = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("h")).join(met.select("hub").distinct(), "hub", "left_semi").join(hot, "hub", "left")
    right = own.select("hub", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))

    def run(batches):
        for b in slices(batches, 100):
            rows = []
            for hub, node, x, h in zip(*(b.column(c).to_pylist() for c in range(4))):
                x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
                r = np.setxor1d(x, h, assume_unique=True)
                linked = (100 + percent) * len(r) <= (100 - percent) * (len(x) + len(h))
                rows.append((hub, node, len(x), linked, r.view(np.int64)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["block", "node", "n", "linked", "r"])

    both = dealt.join(sets.select("node", F.col("shingles").alias("x")), "node").join(right, ["hub", "salt"])
    return both.select("hub", "node", "x", "h").mapInArrow(run, "block binary, node binary, n long, linked boolean, r array<long>")


def starred(large: DataFrame, groups: DataFrame, heads: DataFrame, docs: DataFrame, names: DataFrame, k: int, percent: int) -> list[DataFrame]:
    """Links (a, b) of large blocks: of members with hubs, and of those that their differences from the hub tell."""
    hubs = groups.select(F.col("gid").alias("hub_gid"), F.col("node").alias("hub"))
    met = staged(large.join(hubs, "hub_gid").join(heads.select("gid", "node"), "gid").where("node != hub").select("hub", "node"), "met")
    if met.isEmpty():
        return []
    sets = sets_of(met.select("node").union(met.select("hub")).distinct(), docs, names, k)
    apart = staged(differences(met, sets, percent), "apart")
    stars = staged(apart.where("linked").select(F.least("block", "node").alias("a"), F.greatest("block", "node").alias("b")), "stars")
    open_ = apart.groupBy("block").agg(F.count_if(~F.col("linked")).alias("loose"), F.count(F.lit(1)).alias("m")).where("loose > 0 and m > 1")
    found = [stars, *families.resolved(joined(apart, staged(open_, "open"), "block", "m").select("block", "node", "n", "linked", "r"), percent)]
    forget(met, sets, apart)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, of every node in edges (a, b). Minimum labels with pointer jumping."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").where("node != other").distinct(), "links")
    degrees = staged(both.groupBy("node").agg(F.min("other").alias("label"), F.count(F.lit(1)).alias("edges")), "degrees")
    labels = staged(degrees.select("node", F.least("label", "node").alias("label")), "labels")
    hot = staged(heavy(degrees, "edges").select("node"), "hot")  # hubs of large stars: their edges go to no single task
    star = both.join(F.broadcast(hot.withColumnRenamed("node", "other")), "other", "left_semi")
    plain = both.join(F.broadcast(hot.withColumnRenamed("node", "other")), "other", "left_anti")
    forget(degrees)
    while True:
        names = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        near = plain.join(names, "other").unionByName(star.join(F.broadcast(names.join(F.broadcast(hot.withColumnRenamed("node", "other")), "other", "left_semi")), "other"))
        near = near.groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.select("node", "label").join(near, "node").select("node", F.least("label", "near").alias("lower"), F.col("label").alias("was"))
        jumped = lower.join(labels.select(F.col("node").alias("lower"), F.col("label").alias("beyond")), "lower", "left")
        jumped = staged(jumped.select("node", F.least("lower", F.coalesce("beyond", "lower")).alias("label"), "was"), "labels")
        forget(labels)
        labels = jumped
        if labels.where("label != was").isEmpty():
            forget(both, hot)
            return labels.select("node", "label")


def named(docs: DataFrame, k: int) -> tuple[DataFrame, bytes]:
    """(doc_id, text_key, n_shingles, node of every row; the frequency levels of shingles)."""
    bits = min(MOST_BITS, max(LEAST_BITS, docs.select("doc_id").count().bit_length()))
    found = staged(digests(docs, k, bits), "digests")
    return found.where("chunk is null").select("doc_id", "text_key", "n_shingles", "node"), frequency_levels(found, bits)


def grouped(docs: DataFrame, rows: DataFrame, levels: bytes, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, doc_id, text_key of one row of each node; heads_of() docs; their groups)."""
    first = rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    names = staged(first.select("node", "x.doc_id", "x.text_key"), "names")
    heads = staged(heads_of(docs, k, percent, levels), "heads")
    groups = heads.groupBy("gid", "n").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("members"), F.first("prefix").alias("prefix"))
    return names, heads, staged(groups, "groups")


def links(docs: DataFrame, rows: DataFrame, levels: bytes, k: int, percent: int) -> DataFrame:
    """a, b: links between nodes of docs (rows and levels as named() gives them); enough to connect all that is linked."""
    names, heads, groups = grouped(docs, rows, levels, k, percent)
    small, large = level_blocks(groups, percent)
    found = starred(large, groups, heads, docs, names, k, percent)
    left = staged(screened(member_pairs(group_pairs(small, groups, percent), groups, heads), heads, percent), "screened")
    sets = sets_of(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, names, k)
    found.append(staged(verified(left, sets, percent), "verified"))
    forget(sets, left, heads, groups, names)
    return reduce(DataFrame.unionByName, found)


def all_links(docs: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(every link (a, b) between nodes, a < b; doc_id, n_shingles, node of every row): no hubs, so the work grows with the number
    of links, which in a group of near copies can be the square of its size. Rows of one node are linked too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, levels = named(docs, k)
    names, heads, groups = grouped(docs, rows, levels, k, percent)
    blocks = postings(groups, percent).select(F.col("token").alias("key"), "gid", "n", F.lit(False).alias("low"))
    pairs = member_pairs(group_pairs(staged(blocks, "blocks"), groups, percent, 1 << 62), groups, heads)
    left = staged(screened(pairs, heads, percent), "screened")
    sets = sets_of(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, names, k)
    return verified(left, sets, percent), rows.select("doc_id", "n_shingles", "node")


def labelled(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node of every row; node, label, rows of nodes that have several rows or links).

    label names the nodes that are connected.
    """
    rows, levels = named(docs, k)
    labels = connected(links(docs, rows, levels, k, percent))
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    several = nodes.join(labels, "node", "left").where("rows > 1 or label is not null")
    return rows, staged(several.select("node", F.coalesce("label", "node").alias("label"), "rows"), "several")


def components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, several = labelled(docs, k, percent)
    least = joined(rows.select("node", "doc_id"), several, "node", "rows").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.countDistinct("node").alias("nodes"))
    known = staged(joined(several, staged(least, "least"), "label", "nodes").select("node", "component_id", "rows"), "known")
    return joined(rows, known, "node", "rows", "left").select("doc_id", "n_shingles", F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs with one row of every group of linked documents: that with the smallest doc_id, a null one last."""
    rows, several = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    held = staged(joined(rows.select("doc_id", "text_key", "node"), several, "node", "rows").groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")), "held")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    firsts = staged(held.groupBy("label").agg(first.alias("x"), F.count(F.lit(1)).alias("members")), "firsts")
    marked = joined(held, firsts, "label", "members").withColumn("stays", F.col("x.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("x.text_key") == F.col("text_key")))
    marked = staged(marked.select("doc_id", "text_key", "rows", "stays"), "marked")
    out = matching(docs, marked.where(~F.col("stays")).select("doc_id", "text_key").distinct(), "left_anti", "doc_id", "text_key")
    twice = marked.where("stays and rows > 1").select("doc_id", "text_key")
    if twice.isEmpty():
        return out
    repeats = matching(out, twice, "left_semi", "doc_id", "text_key").dropDuplicates(["doc_id", "text"])
    return matching(out, twice, "left_anti", "doc_id", "text_key").unionByName(repeats)
