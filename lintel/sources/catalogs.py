"""Live catalogs: PostgreSQL and MySQL by JDBC with one query per catalog view, and Spark's own catalog."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONNECT_SECONDS, QUERY_SECONDS = 5, 30
log = logging.getLogger("lintel")


def redacted(url: str) -> str:
    """A connection string as it may be logged: without its password."""
    return re.sub(r"(?i)(//[^/:@\s]+:)[^@/\s]*@|(\b(?:password|pwd)=)[^&;\s]*", lambda m: f"{m[1]}***@" if m[1] else f"{m[2]}***", url)

POSTGRES = {
    "columns": "select table_name, column_name, ordinal_position as ordinal, data_type, is_nullable, column_default from information_schema.columns where table_schema = '{schema}'",
    "keys": "select tc.constraint_type, tc.table_name, kcu.column_name, ccu.table_name as ref_table, ccu.column_name as ref_column from information_schema.table_constraints tc join information_schema.key_column_usage kcu on tc.constraint_name = kcu.constraint_name and tc.table_schema = kcu.table_schema left join information_schema.constraint_column_usage ccu on tc.constraint_name = ccu.constraint_name and tc.table_schema = ccu.table_schema where tc.table_schema = '{schema}' and tc.constraint_type in ('PRIMARY KEY', 'FOREIGN KEY')",
    "rows": "select relname as table_name, cast(reltuples as bigint) as row_count from pg_class where relkind = 'r'",
}
MYSQL = {
    "columns": "select table_name, column_name, ordinal_position as ordinal, column_type as data_type, is_nullable, column_default from information_schema.columns where table_schema = '{schema}'",
    "keys": "select case when constraint_name = 'PRIMARY' then 'PRIMARY KEY' else 'FOREIGN KEY' end as constraint_type, table_name, column_name, referenced_table_name as ref_table, referenced_column_name as ref_column from information_schema.key_column_usage where table_schema = '{schema}' and (constraint_name = 'PRIMARY' or referenced_table_name is not null)",
    "rows": "select table_name, table_rows as row_count from information_schema.tables where table_schema = '{schema}'",
}


def _jdbc(spark: SparkSession, url: str, query: str, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**({"url": url, "query": query, "queryTimeout": str(QUERY_SECONDS), "loginTimeout": str(CONNECT_SECONDS)} | options)).load()


def assembled(columns: DataFrame, keys: DataFrame, schema_id: str) -> DataFrame:
    """The columns frame from catalog rows."""
    kind = lambda k: keys.where(F.col("constraint_type") == k).select("table_name", "column_name", "ref_table", "ref_column").dropDuplicates(["table_name", "column_name"])
    pk = kind("PRIMARY KEY").select("table_name", "column_name", F.lit(True).alias("is_pk"))
    fk = kind("FOREIGN KEY").withColumn("is_fk", F.lit(True))
    both = columns.join(pk, ["table_name", "column_name"], "left").join(fk, ["table_name", "column_name"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select(F.lit(schema_id).alias("schema_id"), "table_name", "column_name", F.col("ordinal").cast("int"), "data_type", (F.upper("is_nullable") == "YES").alias("nullable"), no("is_pk"), no("is_fk"), "ref_table", "ref_column", F.col("column_default").alias("default_value"))


def load(spark: SparkSession, db_type: str, url: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(columns, tables with row_count) of a live database."""
    if db_type not in ("postgresql", "mysql"):
        raise NotImplementedError(f"no catalog source for {db_type}; postgresql and mysql are supported")
    view = POSTGRES if db_type == "postgresql" else MYSQL
    get = lambda k: _jdbc(spark, url, view[k].format(schema=schema.replace("'", "''")), options)
    return assembled(get("columns"), get("keys"), schema), get("rows")


def spark_catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """Columns of the tables in Spark's catalog."""
    rows = [(database, t.name, c.name, k, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for k, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}"))]
    out = spark.createDataFrame(rows, "schema_id string, table_name string, column_name string, ordinal int, data_type string, nullable boolean")
    none = F.lit(None).cast("string")
    return out.select("*", F.lit(False).alias("is_pk"), F.lit(False).alias("is_fk"), none.alias("ref_table"), none.alias("ref_column"), none.alias("default_value"))


def load_or(spark: SparkSession, db_type: str, url: str, schema: str, stored: tuple[DataFrame, DataFrame], **options: str) -> tuple[DataFrame, DataFrame]:
    """(columns, tables) of a live database, or the stored ones where it can't be reached; what is not supported stays an error."""
    try:
        columns, tables = load(spark, db_type, url, schema, **options)
        columns, tables = columns.cache(), tables.cache()  # read here and once, so that a failure of either part is seen
        columns.count(), tables.count()
        return columns, tables
    except NotImplementedError:
        raise
    except Exception as e:  # whatever a driver raises: no driver, no network, no permission
        log.warning("no live catalog from %s, stored one taken: %s", redacted(url), redacted(str(e))[:300])
        return stored
