"""Line deduplication by sharded cuckoo filters over exact reference counts; insertions and deletions of documents.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of fewer than ``shortest`` code points count for
nothing. A key that at least ``least`` documents hold is hot: its lines go from every document but that with the largest doc_id
among its holders.

``LineIndex`` keeps, in a folder of the shared store, a log of generations:

* ``references``: a row for each key and document inserted; ``deleted``: ids of documents deleted. A document is there if its last
  insertion is younger than its last deletion.
* ``counts``: the exact table. For each key that a generation touched, how many documents hold it now and the largest of them.
* ``filters``: a cuckoo filter a shard, of the shard's hot keys. A generation writes only the shards in which keys became hot or
  ceased to be: their fingerprints are inserted into, or deleted from, the shard's last filter. A filter that is full is made
  again, twice as large, from the counts.

A document's lines are screened by the filter of their shard, which a task reads where it needs it; what passes is looked up in
the exact counts, so a filter's errors change nothing. Deleting documents brings back every line that only they made hot.

Nothing grows in one task: references are dealt by shard and a salt of the document, counts are summed in two steps (Spark's own
for a distinct count), hot keys are joined by broadcast (they are few by definition), a filter holds about ``SHARD_KEYS`` keys.

A null or empty text is one empty line. A row without doc_id makes no key hot and isn't a holder, but loses its hot lines like
others; it can't be deleted. Rows that repeat a doc_id are one document to the counts, each with its own text and result. Inserting
a document again adds its lines to those it has. Very long texts and lines are taken whole; a document repeating a line counts
once, and loses all its copies. Other columns are ignored; an empty table gives an empty result. Keys are told apart by 128-bit
hashes.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_of, joined, new_folder, open_store, remove, slices, small_batches, staged

LEAST, SHORTEST = 3, 20
#: Shards of an index, keys that a shard's first filter has room for, salts of the documents of a shard.
SHARDS, SHARD_KEYS, SALTS = 64, 1 << 12, 16
#: Documents for which an index made in one go gets a shard.
DOCUMENTS = 1 << 16
#: Slots of a bucket, and moves before a filter counts as full.
SLOTS, MOVES = 4, 500
_SPACE = b" \t\n\x0b\x0c\r"
_MUL = 0x9E3779B97F


def p_moves(prints):
    """What tells a fingerprint's two buckets apart."""
    return (prints * _MUL) >> 9


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints with partial-key hashing, for 64-bit hashes of keys."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy() if table else np.zeros((buckets, SLOTS), np.uint16)
        self.dice = random.Random(buckets)

    @classmethod
    def for_keys(cls, keys: int) -> Cuckoo:
        buckets = 16
        while buckets * SLOTS * 0.8 < keys:
            buckets *= 2
        return cls(buckets)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of each; the second follows from the first and the fingerprint alone."""
        h = hashes.astype(np.uint64)
        prints = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)  # never 0, which is an empty slot
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, first ^ (p_moves(prints.astype(np.int64)) & (self.buckets - 1))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(hashes)
        return ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is full; its content is void then."""
        return all(self._put(int(p), int(a), int(b)) for p, a, b in zip(*self.places(hashes)))

    def _put(self, p: int, a: int, b: int) -> bool:
        if self._placed(a, p) or self._placed(b, p):
            return True
        at = self.dice.choice((a, b))
        for _ in range(MOVES):
            slot = self.dice.randrange(SLOTS)
            held = int(self.table[at, slot])
            self.table[at, slot] = p
            p, at = held, at ^ ((p_moves(held)) & (self.buckets - 1))
            if self._placed(at, p):
                return True
        return False

    def _placed(self, at: int, p: int) -> bool:
        empty = np.flatnonzero(self.table[at] == 0)
        if len(empty):
            self.table[at, empty[0]] = p
        return bool(len(empty))

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for p, a, b in zip(*self.places(hashes)):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == p)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def blob(self) -> bytes:
        return self.table.tobytes()


def key_of(line: bytes, shortest: int) -> bytes | None:
    """The 128-bit key of a line, None if it is too short to count."""
    line = line.strip(_SPACE)
    if len(line) < shortest or len(line) < 4 * shortest and len(line.decode("utf-8")) < shortest:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def low(keys: list[bytes]) -> np.ndarray:
    """The 64 bits of each key that filters use."""
    return np.frombuffer(b"".join(keys), "<u8")[::2] if keys else np.zeros(0, np.uint64)


def lines_of(docs: DataFrame, shortest: int, shards: int) -> DataFrame:
    """shard, key, doc_id, text_key: the distinct keys of every row."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, text_key, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                keys = {key_of(line, shortest) for line in (text or "").encode("utf-8").split(b"\n")} - {None}
                rows += [(key[8] * 256 + key[9], key, doc, text_key) for key in keys]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "key", "doc_id", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "shard int, key binary, doc_id long, text_key long")
    return rows.withColumn("shard", (F.col("shard") % shards).cast("int"))


class LineIndex:
    """An index of lines in a folder of its own; see the module."""

    def __init__(self, spark: SparkSession, least: int = LEAST, shortest: int = SHORTEST, shards: int = SHARDS):
        if not 1 <= shards <= 65536:
            raise ValueError("between 1 and 65536 shards")
        small_batches(spark)
        self.spark, self.least, self.shortest, self.shards = spark, least, shortest, shards
        self.folder, self.generation = new_folder(spark, "lines"), 0
        self.written: dict[str, list[int]] = {}
        self._save(spark.createDataFrame([], "shard int, key binary, doc_id long, text_key long"), "references")
        self._save(spark.createDataFrame([], "doc_id long"), "deleted")
        self._save(spark.createDataFrame([], "shard int, key binary, holders long, largest long, was long"), "counts")
        self._save(spark.createDataFrame([], "shard int, buckets int, filter binary"), "filters")

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table's part of this generation."""
        out = self._aside(df, name)
        self.written.setdefault(name, []).append(self.generation)
        return out

    def _aside(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}/generation={self.generation}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _log(self, name: str) -> DataFrame:
        """All generations of a table so far."""
        paths = [f"{self.folder}/{name}/generation={g}" for g in self.written[name]]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def references(self) -> DataFrame:
        """The references of documents that are there."""
        gone = self._log("deleted").groupBy("doc_id").agg(F.max("generation").alias("gone"))
        rows = self._log("references").join(gone, "doc_id", "left").where("gone is null or generation > gone")
        return rows.select("shard", "key", "doc_id", "text_key")

    def counts(self) -> DataFrame:
        """shard, key, holders, largest: each key's last row."""
        names = ("shard", "holders", "largest")
        last = self._log("counts").groupBy("key").agg(*[F.max_by(c, "generation").alias(c) for c in names])
        return last.select("shard", "key", "holders", "largest")

    def filters(self) -> DataFrame:
        """shard, generation of each shard's last filter."""
        return self._log("filters").groupBy("shard").agg(F.max("generation").alias("generation"))

    def insert(self, docs: DataFrame) -> DataFrame:
        """Adds documents (doc_id, text); gives their references."""
        self.generation += 1
        salted = lines_of(docs, self.shortest, self.shards).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)))
        added = self._save(salted.repartition("shard", "salt").drop("salt").sortWithinPartitions("shard"), "references")
        self._recount(added.select("key") if self.generation > 1 else None)
        return added

    def delete(self, ids: DataFrame) -> None:
        """Takes out the documents with these doc_ids."""
        before = self.references()
        touched = before.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").select("key").distinct()
        self.generation += 1
        touched = self._aside(touched, "touched")
        self._save(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "deleted")
        self._recount(touched)

    def _recount(self, touched: DataFrame | None) -> None:
        """Writes the counts of touched keys (None: all) and the filters of shards whose hot keys changed."""
        held = self.references().where("doc_id is not null")
        if touched is not None:
            held = held.join(touched.distinct(), "key", "left_semi")
        fresh = held.groupBy("shard", "key").agg(F.countDistinct("doc_id").alias("holders"), F.max("doc_id").alias("largest"))
        if touched is None:
            changed = fresh.withColumn("was", F.lit(0).cast("long"))
        else:
            old = self.counts().join(touched.distinct(), "key", "left_semi").select("shard", "key", F.col("holders").alias("was"))
            changed = old.join(fresh, ["shard", "key"], "full").fillna(0, ["holders", "was"])
        counts = self._save(changed, "counts").withColumn("hot", F.col("holders") >= self.least)
        moved = counts.where(F.col("hot") != (F.col("was") >= self.least)).select("shard", "key", "hot")
        self._refilter(moved)

    def _refilter(self, moved: DataFrame) -> None:
        """Inserts keys that became hot into their shards' last filters, takes out others; makes full filters again."""
        last, folder, room = self.filters(), f"{self.folder}/filters", SHARD_KEYS

        def change(part: pa.Table) -> pa.Table:
            shard, g = part["shard"][0].as_py(), part["generation"][0].as_py()
            cuckoo = Cuckoo.for_keys(room) if g is None else read_filter(folder, g, shard)
            hot, keys = part["hot"].to_numpy(), low(part["key"].to_pylist())
            cuckoo.delete(keys[~hot])
            full = not cuckoo.insert(keys[hot])
            return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([cuckoo.buckets], pa.int32()), "filter": pa.array([None if full else cuckoo.blob()], pa.binary())})

        def make(part: pa.Table) -> pa.Table:
            keys = low(part["key"].to_pylist())
            cuckoo = Cuckoo.for_keys(2 * len(keys))
            while not cuckoo.insert(keys):
                cuckoo = Cuckoo(2 * cuckoo.buckets)
            return pa.table({"shard": part["shard"].slice(0, 1), "buckets": pa.array([cuckoo.buckets], pa.int32()), "filter": pa.array([cuckoo.blob()], pa.binary())})

        kind = "shard int, buckets int, filter binary"
        told = moved.join(F.broadcast(last), "shard", "left")  # a row a shard
        changed = self._aside(told.groupBy("shard").applyInArrow(change, kind), "changed")
        full = F.broadcast(changed.where("filter is null").select("shard"))
        hot = self.counts().where(F.col("holders") >= self.least).select("shard", "key")
        again = hot.join(full, "shard", "left_semi").groupBy("shard").applyInArrow(make, kind)
        self._save(changed.where("filter is not null").unionByName(again), "filters")

    def hot_lines(self, references: DataFrame) -> DataFrame:
        """doc_id, text_key, key of references that lose their lines: screened by the filters, then held against the counts."""
        newest = {r["shard"]: r["generation"] for r in self.filters().collect()}  # a row a shard
        folder = f"{self.folder}/filters"

        def screen(batches):
            shard, cuckoo = None, None
            for b in slices(batches, 20_000):
                shards, keep = b.column(0).to_numpy(), np.zeros(b.num_rows, bool)
                keys = low(b.column(1).to_pylist())
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi > lo and shards[lo] != shard:
                        shard = int(shards[lo])
                        cuckoo = read_filter(folder, newest[shard], shard) if shard in newest else None
                    if cuckoo is not None and hi > lo:
                        keep[lo:hi] = cuckoo.has(keys[lo:hi])
                yield b.filter(pa.array(keep))

        rows = references.select("shard", "key", "doc_id", "text_key").mapInArrow(screen, "shard int, key binary, doc_id long, text_key long")
        hot = self.counts().where(F.col("holders") >= self.least).select("key", "holders", "largest")
        found = joined(rows, staged(hot, "hot"), "key", "holders")
        return found.where(~F.col("doc_id").eqNullSafe(F.col("largest"))).select("doc_id", "text_key", "key").distinct()

    def cleaned(self, docs: DataFrame, references: DataFrame | None = None, texts: bool = True) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256, and with texts kept, of every row of docs, by the index as it is.

        references: what insert() gave for docs; else they are made from the texts. Documents that surely lose nothing, by a
        Bloom filter of those that do, are done in the scan; of the others the texts are shuffled to their dropped keys.
        """
        if references is None:
            references = lines_of(docs, self.shortest, self.shards)
        drops = self.hot_lines(references).groupBy("doc_id", "text_key").agg(F.collect_list("key").alias("keys"))
        drops = staged(drops.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), F.xxhash64("doc_id", "text_key").alias("who"), "keys"), "drops")
        may, shortest = bloom_of(drops, "who").shared(self.spark), self.shortest
        told = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"

        def scan(batches):
            for b in slices(batches):
                keep = may.value.has(b.column(2).to_numpy().view(np.uint64))
                rows = []
                for lost, doc, key, text in zip(keep.tolist(), *(b.column(c).to_pylist() for c in (0, 1, 3))):
                    rows.append((*(result(doc, text, (), shortest, texts) if not lost else (doc, None, None, None, None)), key, text if lost else None))
                yield batch(rows, f"{told}, text_key long, text string")

        def judge(batches):
            for b in slices(batches):
                rows = []
                for *done, text, keys in zip(*(b.column(c).to_pylist() for c in range(7))):
                    rows.append(tuple(done) if done[1] is not None else result(done[0], text, frozenset(keys or ()), shortest, texts))
                yield batch(rows, told)

        left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
        left = left.select("doc_id", "text_key", F.xxhash64("doc_id", "text_key").alias("who"), "text").mapInArrow(scan, f"{told}, text_key long, text string")
        rows = left.join(drops, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
        out = rows.select(*[x.split()[0] for x in told.split(", ")], "text", "keys").mapInArrow(judge, told)
        return out if texts else out.drop("kept")

    def drop(self) -> None:
        """Deletes the index."""
        remove(self.spark, self.folder)


def result(doc: int | None, text: str | None, gone: frozenset | tuple, shortest: int, texts: bool) -> tuple:
    """doc_id, n_lines, n_dropped, kept_sha256, kept of a text that loses the lines with these keys."""
    lines = (text or "").encode("utf-8").split(b"\n")
    kept = [x for x in lines if key_of(x, shortest) not in gone] if gone else lines
    data = b"\n".join(kept)
    return doc, len(lines), len(lines) - len(kept), hashlib.sha256(data).hexdigest(), data.decode("utf-8") if texts else None


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(cols, kinds)], list(names))


def read_filter(folder: str, generation: int, shard: int) -> Cuckoo:
    """A shard's filter, read by a task from the shared store."""
    fs, path = open_store(f"{folder}/generation={generation}")
    rows = pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(columns=["buckets", "filter"], filter=pads.field("shard") == shard)
    return Cuckoo(rows["buckets"][0].as_py(), rows["filter"][0].as_py())


def deduplicated(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs: an index of all of them, applied to them."""
    shards = min(65536, max(SHARDS, 1 << (docs.count() // DOCUMENTS).bit_length()))
    index = LineIndex(docs.sparkSession, least, shortest, shards)
    return index.cleaned(docs, index.insert(docs), texts=False)
