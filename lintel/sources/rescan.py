"""Incremental scans: only files whose content has changed are read into rows anew.

A scan is a folder of versions. Version v holds

* ``files``: path, modified, length, hash and the version that made its rows, of every file there was;
* ``rows``: what the maker made of the files that are new or changed in v, by partition ``version=v``.

``current()`` joins the rows of all versions with the newest list of files, so a changed or removed file's old rows are left out.
A version counts once its marker file is there, which is written last: a scan that fails or is cut off leaves the version before.
Listings cost no content: a file of unchanged time and length isn't read, others are compared by the SHA-256 of their content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modified timestamp, length long, hash string, made int"


def contents(files: DataFrame) -> DataFrame:
    """files (path and other columns) with content and hash, each file read by the task that has its row; files that went away
    meanwhile are left out."""
    names = files.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # a file at a time: they may be large
                store, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", b.column(names.index("path"))[k].as_py()))
                try:
                    with store.open_input_stream(path, compression=None) as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([data], pa.binary()), pa.array([hashlib.sha256(data).hexdigest()])], [*names, "content", "hash"])

    return files.mapInArrow(run, f"{kinds}, content binary, hash string")


class Rescan:
    """An incremental scan of the files under a root that fit a glob; make turns (path, text) into rows that have a path."""

    def __init__(self, spark: SparkSession, root: str, pattern: str, folder: str, make: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.pattern, self.folder, self.make = spark, root, pattern, folder.rstrip("/"), make

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """The newest complete version, 0 for none."""
        v = 0
        while self._exists(f"{self.folder}/done/{v + 1}/_SUCCESS"):
            v += 1
        return v

    def files(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/files/version={v}") if v else self.spark.createDataFrame([], FILES)

    def _listed(self) -> DataFrame:
        """path, modified, length of the files there are; no content is read."""
        raw = self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", True).load(self.root)
        return raw.select("path", F.col("modificationTime").alias("modified"), "length")

    def update(self) -> DataFrame:
        """Scans; gives path and status (added, changed, removed) of the files whose rows are made anew or left out."""
        v = self.version() + 1
        before = self.files(v - 1)
        old = before.select("path", F.col("modified").alias("m"), F.col("length").alias("l"), F.col("hash").alias("h"), F.col("made").alias("v"))
        # the listing alone tells which files may have changed; only their content is read
        listed = self._listed().join(old, "path", "left")
        same = listed.where("m = modified and l = length").select("path", "modified", "length", F.col("h").alias("hash"), F.col("v").alias("made"))
        maybe = listed.where("m is null or m != modified or l != length").select("path", "modified", "length", "h", "v")
        now = contents(maybe).select("path", "modified", "length", "hash", F.when(F.col("h").eqNullSafe(F.col("hash")), F.col("v")).otherwise(F.lit(v)).alias("made"))
        same.unionByName(now).select([c.split()[0] for c in FILES.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/files/version={v}")
        after = self.spark.read.schema(FILES).parquet(f"{self.folder}/files/version={v}")
        fresh = after.where(F.col("made") == v).select("path", F.col("hash").alias("wanted"))
        texts = contents(fresh).where("hash = wanted").select("path", F.col("content").cast("string").alias("text"))
        self.make(texts).write.mode("overwrite").parquet(f"{self.folder}/rows/version={v}")
        feed = after.select("path", "made").join(before.select("path", F.lit(True).alias("was")), "path", "full_outer")
        status = F.when(F.col("made").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("made") == v, "changed")
        feed.select("path", status.alias("status")).where("status is not null").write.mode("overwrite").parquet(f"{self.folder}/feed/version={v}")
        self.spark.createDataFrame([(v,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/{v}")
        return self.spark.read.schema("path string, status string").parquet(f"{self.folder}/feed/version={v}")

    def current(self) -> DataFrame:
        """The rows of all files as they are, as a full scan would make them."""
        v = self.version()
        if not v:
            raise ValueError("nothing scanned yet")
        paths = [f"{self.folder}/rows/version={k}" for k in range(1, v + 1)]
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*paths)
        live = self.files(v).select("path", F.col("made").alias("version"))
        return rows.join(live, ["path", "version"], "left_semi").drop("version")
