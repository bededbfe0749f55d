"""Catalog frames: columns, tables; pruning, existing-wins merge, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "schema_id string, table_name string, column_name string, ordinal int, data_type string, nullable boolean, is_pk boolean, is_fk boolean, ref_table string, ref_column string, default_value string"


def schema_keys(df: DataFrame) -> list[str]:
    """What names a table: schema_id where a frame has it, and table_name."""
    return [c for c in ("schema_id", "table_name") if c in df.columns]


def pruned(columns: DataFrame, names: DataFrame) -> DataFrame:
    """Columns of the named tables (table_name in whatever case; of one schema where names have a schema_id) and of the tables of
    their schema that their foreign keys point at."""
    own = [c for c in schema_keys(columns) if c != "table_name"]
    low = columns.withColumn("low", F.lower("table_name"))
    given = [c for c in own if c in names.columns]
    named = names.select(*given, F.lower("table_name").alias("low")).distinct()
    hit = low.join(named, [*given, "low"], "left_semi")
    targets = hit.where("is_fk and ref_table is not null").select(*own, F.lower("ref_table").alias("low"))
    return low.join(hit.select(*own, "low").union(targets).distinct(), [*own, "low"], "left_semi").drop("low")


def pruned_live(live: DataFrame, stored: DataFrame, names: DataFrame) -> DataFrame:
    """Columns of the named tables, as live where a live catalog has the table, else as stored."""
    named = names.select("table_name").distinct()
    both = stored.join(live.select("table_name").distinct(), "table_name", "left_anti").unionByName(live)
    return both.join(named, "table_name", "left_semi").select(stored.columns)


def existing_wins(first: DataFrame, second: DataFrame, keys: list[str], fill: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both; where both have a key the first's row as a whole, with nulls of the ``fill`` columns from the second."""
    rest = [c for c in first.columns if c not in keys]
    mark = lambda df, p: df.select(*keys, F.struct(F.lit(True).alias("here"), *rest).alias(f"__{p}"))
    both = mark(first, "a").join(mark(second, "b"), keys, "full_outer")
    pick = lambda c: F.coalesce(f"__a.{c}", f"__b.{c}") if c in fill else F.when(F.col("__a").isNotNull(), F.col(f"__a.{c}")).otherwise(F.col(f"__b.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def live_wins(live: dict[str, DataFrame], code: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalog of a live database completed by that of its code: frames columns, tables (row_count), indexes (index_name) and
    constraints (name, raw), each by table_name. A constraint of the code goes where the live table has its name or its text."""
    out = {
        "columns": existing_wins(live["columns"], code["columns"], ["table_name", "column_name"]),
        "tables": existing_wins(live["tables"], code["tables"], ["table_name"], fill=("row_count",)),
        "indexes": existing_wins(live["indexes"], code["indexes"], ["table_name", "index_name"]),
    }
    own = live["constraints"].select("table_name", F.col("name").alias("__name"), F.col("raw").alias("__raw"))
    named = code["constraints"].join(own.select("table_name", "__name"), (code["constraints"]["table_name"] == own["table_name"]) & (F.col("name") == F.col("__name")), "left_anti")
    new = named.join(own.select(F.col("table_name").alias("__t"), "__raw"), (F.col("table_name") == F.col("__t")) & (F.col("raw") == F.col("__raw")), "left_anti")
    out["constraints"] = live["constraints"].unionByName(new.select(live["constraints"].columns))
    return {k: df.withColumn("source", F.lit("merged")) for k, df in out.items()}


def summary(columns: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """schema_id, tables, columns; with a history (schema_id, snapshot_ts) also last_updated, its latest time."""
    counts = columns.groupBy("schema_id").agg(F.countDistinct("table_name").alias("tables"), F.count(F.lit(1)).alias("columns"))
    if history is None:
        return counts
    return counts.join(history.groupBy("schema_id").agg(F.max("snapshot_ts").alias("last_updated")), "schema_id", "left")


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count of DataFrames."""
    return union_all([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in tables.items()])


def inventory(spark: SparkSession, tables: dict[str, DataFrame], schema_id: str) -> DataFrame:
    """Columns frame of the schemas of DataFrames, with one name for each kind of type."""
    rows = [(schema_id, t, f.name, k, f.dataType.simpleString().split("(")[0].replace("timestamp_ntz", "timestamp"), f.nullable) for t, df in tables.items() for k, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "schema_id string, table_name string, column_name string, ordinal int, data_type string, nullable boolean")


def context_text(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """schema_id (where columns have it), table_name, text: a line that describes each table and its columns."""
    key = schema_keys(columns)
    sized = [c for c in key if c in tables.columns]
    one = F.concat(F.col("column_name"), F.lit(" "), F.col("data_type"), F.when(~F.col("nullable"), " NOT NULL").otherwise(""), F.when(F.col("is_pk"), " PK").otherwise(""), F.when(F.col("is_fk"), F.concat(F.lit(" FK->"), F.coalesce("ref_table", F.lit("?")), F.lit("."), F.coalesce("ref_column", F.lit("?")))).otherwise(""))
    body = columns.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", one.alias("d")))), lambda s: s["d"]), ", ").alias("body"))
    rows = F.when(F.col("row_count").isNotNull(), F.concat(F.lit(" ("), F.format_number("row_count", 0), F.lit(" rows)"))).otherwise("")
    return body.join(tables.select(*sized, "row_count"), sized, "left").select(*key, F.concat(F.col("table_name"), rows, F.lit(": ["), F.col("body"), F.lit("]")).alias("text"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
