"""Schema history: change counts, bounded history, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP = 50


def keep_latest(history: DataFrame, key: list[str], order: list, keep: int = KEEP) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return history.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def change_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """changes: 1 for each table added or removed, and the difference in the number of columns of each other table."""
    n = lambda df, c: df.groupBy("table_name").agg(F.count(F.lit(1)).alias(c))
    both = n(before, "b").join(n(after, "a"), "table_name", "full_outer")
    return both.agg(F.coalesce(F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(F.abs(F.col("a") - F.col("b")))), F.lit(0)).alias("changes"))


def versus_previous(snapshots: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """snapshots with previous and change of a value, by key in order."""
    w = Window.partitionBy(*key).orderBy(order)
    return snapshots.withColumn("previous", F.lag(value).over(w)).withColumn("change", F.col(value) - F.coalesce("previous", F.lit(0)))


def table_sizes(columns: Column) -> Column:
    """Map of table_name to its number of columns, from an array of (table_name, column_name)."""
    names = F.array_sort(F.array_distinct(F.transform(columns, lambda c: c["table_name"])))
    return F.map_from_arrays(names, F.transform(names, lambda t: F.size(F.filter(columns, lambda c: c["table_name"] == t))))


def changes(updates: DataFrame, keep: int = KEEP) -> DataFrame:
    """schema_id, snapshot_ts, change_count, tables, held of every update (schema_id, snapshot_ts, columns: the whole schema after
    it): the batch form of streaming.state.tracked."""
    w = Window.partitionBy("schema_id").orderBy("snapshot_ts")
    sized = updates.withColumn("now", table_sizes(F.col("columns"))).withColumn("was", F.coalesce(F.lag("now").over(w), F.create_map().cast("map<string,int>")))
    both = F.array_union(F.map_keys("now"), F.map_keys("was"))
    one = lambda t: F.when(F.map_contains_key("now", t) & F.map_contains_key("was", t), F.abs(F.try_element_at("now", t) - F.try_element_at("was", t))).otherwise(1)
    n = F.aggregate(F.transform(both, one), F.lit(0), lambda a, x: a + x)
    return sized.select("schema_id", "snapshot_ts", n.cast("long").alias("change_count"), F.size("now").cast("long").alias("tables"), F.least(F.row_number().over(w), F.lit(keep)).cast("long").alias("held"))


def updated(history: DataFrame, before: DataFrame, after: DataFrame, schema_id: str, at, keep: int = KEEP) -> DataFrame:
    """history (schema_id, snapshot_ts, change_count, columns) with the schema as it was before an update, and how many changes the
    update made; the latest ``keep`` snapshots stay."""
    names = ["table_name", "column_name", "ordinal", "data_type", "nullable"]
    held = before.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("columns"))
    snapshot = held.join(change_count(before, after), F.lit(True)).select(F.lit(schema_id).alias("schema_id"), F.lit(at).cast("timestamp").alias("snapshot_ts"), F.col("changes").cast("long").alias("change_count"), "columns")
    return keep_latest(history.unionByName(snapshot), ["schema_id"], [F.desc("snapshot_ts")], keep)


def report(history: DataFrame, many: int = 5) -> DataFrame:
    """schema_id, snapshot_ts, tables, change_count, badge of snapshots, the newest first of each schema."""
    n = F.size(F.array_distinct(F.transform("columns", lambda c: c["table_name"])))
    badge = F.when(F.col("change_count") > many, "high").when(F.col("change_count") > 0, "medium").otherwise("low")
    return history.select("schema_id", "snapshot_ts", n.alias("tables"), "change_count", badge.alias("badge")).orderBy("schema_id", F.desc("snapshot_ts"))
