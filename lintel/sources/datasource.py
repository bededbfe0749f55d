"""Python data sources: catalogs of databases that have a DB-API module, and a sink of findings that commits once.

``lintel-catalog`` reads the columns of a database's tables, a range of tables in each partition, with filters on table_name pushed
into its queries. Options: ``module`` (a DB-API module whose database answers SQLite's catalog queries; sqlite3 unless given), ``url``
(what its connect() takes), ``schema_id``, ``partitions``. PostgreSQL and MySQL are read by JDBC, see ``catalogs``.

``lintel-findings`` replaces the findings of documents. Tasks write files that no one refers to; the driver's commit writes one
manifest, after which readers see all of the batch and before which they see none; one batch is written at a time. Retried and speculative tasks leave at most files
that no manifest names. ``findings()`` reads what is committed: of each document the rows of the newest batch that has it; a row
whose code is null says that a document has none.
"""

from __future__ import annotations

import importlib
import io
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..operators.catalog import COLUMNS

FINDINGS = "doc_id string, stmt_idx int, code string, severity string, message string, start_offset int, end_offset int"


@dataclass
class Tables(InputPartition):
    names: tuple[str, ...]


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = options, None

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Takes filters on table_name; gives back the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("table_name",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def _rows(self, sql: str, *values: str) -> list[tuple]:
        connection = importlib.import_module(self.options.get("module", "sqlite3")).connect(self.options["url"])
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            return cursor.fetchall()
        finally:
            connection.close()

    def tables(self) -> list[str]:
        return [r[0] for r in self._rows("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]

    def partitions(self):
        names = [t for t in self.tables() if self.wanted is None or t in self.wanted]
        parts = max(1, min(int(self.options.get("partitions", "4")), len(names)))
        return [Tables(tuple(names[k::parts])) for k in range(parts)]

    def read(self, partition: Tables):
        schema = self.options.get("schema_id", self.options["url"])
        for t in partition.names:
            keys = {r[3].lower(): (r[2], r[4]) for r in self._rows('select * from pragma_foreign_key_list(?)', t)}
            for k, name, kind, required, default, pk in self._rows('select * from pragma_table_info(?)', t):
                fk = keys.get(name.lower())
                yield schema, t, name, k, kind, not (required or pk), bool(pk), fk is not None, fk and fk[0], fk and fk[1], default


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lintel-catalog"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class FindingsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        name, rows, held = uuid.uuid4().hex, 0, io.BytesIO()
        writer = None
        for b in iterator:
            writer = writer or pq.ParquetWriter(held, b.schema)
            writer.write_batch(b)
            rows += b.num_rows
        if writer is None:
            return Written("", 0)
        writer.close()
        fs, base = store(self.path)
        fs.create_dir(f"{base}/data")
        with fs.open_output_stream(f"{base}/data/{name}.parquet", compression=None) as out:
            out.write(held.getvalue())
        return Written(f"{name}.parquet", rows)

    def commit(self, messages) -> None:
        fs, base = store(self.path)
        fs.create_dir(f"{base}/batches")
        files = [m.file for m in messages if m and m.file]
        number = len(batches(self.path)) + 1
        draft = f"{base}/batches/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(json.dumps({"batch": number, "files": files}).encode())
        fs.move(draft, f"{base}/batches/{number:09d}.json")

    def abort(self, messages) -> None:
        fs, base = store(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{base}/data/{m.file}")


class FindingsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lintel-findings"

    def schema(self) -> str:
        return FINDINGS

    def writer(self, schema, overwrite: bool) -> FindingsWriter:
        return FindingsWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    spark.dataSource.register(FindingsSink)


def batches(path: str) -> list[dict]:
    """What is committed, oldest first."""
    fs, base = store(path.rstrip("/"))
    listed = fs.get_file_info(pafs.FileSelector(f"{base}/batches", allow_not_found=True))
    return [json.loads(fs.open_input_stream(f.path, compression=None).read()) for f in sorted(listed, key=lambda f: f.base_name) if f.base_name.endswith(".json") and not f.base_name.startswith(".")]


def findings(spark: SparkSession, path: str) -> DataFrame:
    """The committed findings of every document's newest batch."""
    held = [(b["batch"], f) for b in batches(path) for f in b["files"]]
    if not held:
        return spark.createDataFrame([], FINDINGS)
    named = spark.createDataFrame(held, "batch int, file string")
    rows = spark.read.schema(FINDINGS).parquet(*[f"{path.rstrip('/')}/data/{f}" for _, f in held]).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rows = rows.join(F.broadcast(named), "file").drop("file")  # a row a file
    newest = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["doc_id", "batch"]).where("code is not null").select([c.split()[0] for c in FINDINGS.split(", ")])
