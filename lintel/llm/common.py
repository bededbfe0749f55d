"""Shared plumbing: the folder all nodes see, lineage cuts through written tables, Arrow batches in bounded slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Python handles at a time; texts of some 100 kB each still fit in memory.
SLICE_ROWS = 250
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 500


#: A key is hot when it has more than this part of all rows.
HEAVY = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lintel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made in the shared one by this driver and not deleted yet.
_MADE: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lintel-{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Deletes every folder that operators of this driver have staged; how many there were. To be called once their results have
    been written elsewhere: until then results read from these folders."""
    made = sorted(_MADE)
    for path in made:
        remove(spark, path)
    return len(made)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that executors and their workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lintel_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of frames that staged() made, once nothing reads them any more."""
    for df in frames:
        remove(df.sparkSession, df.lintel_path)


def heavy(table: DataFrame, weight: str) -> DataFrame:
    """The rows of a table that hold over 1 / HEAVY of the weight of all: at most HEAVY of them, so they can be broadcast."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    return table.where(F.col(weight) * HEAVY > total)


def joined(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with a table of one row a key that says (weight) how many rows have it. No task gets all
    rows of a hot key: the keys over 1 / HEAVY of all rows are broadcast, the others joined as Spark sees fit."""
    hot = heavy(table, weight)
    if hot.isEmpty():
        return rows.join(table, key, how)
    keys = F.broadcast(hot.select(key))
    rest = rows.join(keys, key, "left_anti").join(table.join(keys, key, "left_anti"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by staged() or new_folder() once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.discard(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared-folder URI, as Python on an executor reaches it, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def give_back() -> None:
    """Returns memory that this worker has freed, earlier tasks' included, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc: nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    give_back()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    give_back()


def free(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    own = {c.lower() for c in df.columns}
    while name in own:
        name += "_"
    return name


def chosen(docs: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of docs, all their columns with them, that a judge of a column's values takes; each task makes its own judge."""

    def run(batches):
        judge = make()
        for b in slices(batches):
            yield b.filter(pa.array(judge(b.column(at).to_pylist()), pa.bool_()))

    at = docs.columns.index(column)
    return docs.mapInArrow(run, docs.schema)


#: Bits of a Bloom filter: least, most (32 MB), for each key; bytes of a chunk of one.
LEAST_FILTER_BITS, MOST_FILTER_BITS, BITS_A_KEY, FILTER_CHUNK = 16, 28, 16, 8192


class Bloom:
    """A Bloom filter of 64-bit hashes, two bits a key; of bounded size, so with very many keys it may take all."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(8 * len(table) - 1)

    @staticmethod
    def bits(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return hashes & mask, (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.bits(hashes, self.mask):
            out &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def shared(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self)


def bloom_of(keys: DataFrame, column: str) -> Bloom:
    """A filter of a column of longs of a staged table. Tasks' bits are united in two steps; 2 ** MOST_FILTER_BITS bits at most
    come to the driver."""
    size = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (BITS_A_KEY * keys.count() - 1).bit_length()))
    kind = "chunk int, part int, bits binary"

    def run(batches):
        table = np.zeros(1 << size >> 3, np.uint8)
        for b in batches:
            for at in Bloom.bits(b.column(0).to_numpy().view(np.uint64), np.uint64((1 << size) - 1)):
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        held = [k for k in range(0, len(table), FILTER_CHUNK) if table[k : k + FILTER_CHUNK].any()]
        blobs = [table[k : k + FILTER_CHUNK].tobytes() for k in held]
        yield pa.RecordBatch.from_arrays([pa.array([k // FILTER_CHUNK for k in held], pa.int32()), pa.array([zlib.crc32(x) % 64 for x in blobs], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "bits"])

    def unite(part: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_CHUNK, np.uint8)
        for blob in part["bits"].to_pylist():
            bits |= np.frombuffer(blob, np.uint8)
        return pa.table({"chunk": part["chunk"].slice(0, 1), "part": part["part"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = keys.select(column).mapInArrow(run, kind).groupBy("chunk", "part").applyInArrow(unite, kind).groupBy("chunk").applyInArrow(unite, kind)
    out = np.zeros(1 << size >> 3, np.uint8)
    for r in rows.collect():
        out[r["chunk"] * FILTER_CHUNK : (r["chunk"] + 1) * FILTER_CHUNK] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
