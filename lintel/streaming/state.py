"""Schema history as keyed state of a stream: the last snapshots of each schema, and how many changes each update makes.

Each key holds a list of its last ``keep`` snapshots (time, changes, tables) and the number of columns of each table as it is now.
State that isn't touched for ``expire`` is dropped. Needs Spark's RocksDB state store.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.timeline import KEEP

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "schema_id string, snapshot_ts timestamp, change_count long, tables long, held long"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with lists and expiry wants this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def changes_between(before: dict[str, int], after: dict[str, int]) -> int:
    """1 for each table added or removed, and the difference in the number of columns of each other table."""
    return sum(abs(before[t] - after[t]) if t in before and t in after else 1 for t in before.keys() | after.keys())


class History(StatefulProcessor):
    """Takes schema_id, snapshot_ts, columns (array of table_name, column_name), the whole schema after an update."""

    def __init__(self, keep: int = KEEP, expire_ms: int | None = None):
        self.keep, self.expire_ms = keep, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "tables string", self.expire_ms)
        self.past = handle.getListState("past", "at timestamp, changes long, tables long", self.expire_ms)

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802  Spark's name
        before = json.loads(self.now.get()[0]) if self.now.exists() else {}
        past = list(self.past.get()) if self.past.exists() else []
        # a micro-batch's rows of one schema; its size is bounded by the source's trigger
        found = pd.concat(list(rows)).sort_values("snapshot_ts", kind="stable")
        out = []
        for at, columns in zip(found["snapshot_ts"], found["columns"]):
            after: dict[str, int] = {}
            for c in columns:
                after[c["table_name"]] = after.get(c["table_name"], 0) + 1
            n = changes_between(before, after)
            past = [*past, (at.to_pydatetime(), n, len(after))][-self.keep :]
            out.append((key[0], at, n, len(after), len(past)))
            before = after
        self.now.update((json.dumps(before),))
        self.past.put(past)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def tracked(updates: DataFrame, keep: int = KEEP, expire_ms: int | None = None) -> DataFrame:
    """schema_id, snapshot_ts, change_count, tables, held of each update of a stream (schema_id, snapshot_ts, columns): what it
    changed against the schema as the state has it, and how many snapshots are held with it. Each schema's updates arrive in
    order from one micro-batch to the next; within one they are sorted."""
    use_rocksdb(updates.sparkSession)
    return updates.groupBy("schema_id").transformWithStateInPandas(History(keep, expire_ms), CHANGES, "append", "processingTime" if expire_ms else "none")
