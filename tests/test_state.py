"""Keyed state of streams against the batch window, across a restart; incremental re-scans."""

import collections

import pytest
from pyspark.sql import functions as F

from lintel.operators import timeline
from lintel.plans import driver_queries
from lintel.streaming import state

SF = "/root/testdata/sf0.001"


def test_changes_between():
    assert state.changes_between({}, {"a": 2}) == 1 and state.changes_between({"a": 2, "b": 1}, {"a": 5, "c": 1}) == 5 and state.changes_between({"a": 1}, {"a": 1}) == 0


@pytest.mark.parametrize("keep", [50, 3])
def test_history_goes_on_after_a_restart(spark, tmp_path, keep):
    """Three micro-batches by time, the query stopped and started again between them: the same rows as one batch window."""
    rows = driver_queries.updates(spark, SF).where("cast(schema_id as int) < 12")
    cuts = rows.selectExpr("percentile_approx(snapshot_ts, array(0.33, 0.66))").first()[0]
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    at = F.col("snapshot_ts")
    for k, part in enumerate((rows.where(at < cuts[0]), rows.where((at >= cuts[0]) & (at < cuts[1])), rows.where(at >= cuts[1]))):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = state.tracked(spark.readStream.schema(rows.schema).parquet(src), keep)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        assert spark.read.parquet(out).count() <= rows.count() and k < 3
    got = collections.Counter(map(tuple, spark.read.parquet(out).collect()))
    assert got == collections.Counter(map(tuple, timeline.changes(rows, keep).collect())) and len(got) > 100


def test_rescan_makes_only_changed_files_anew(spark, tmp_path):
    """After one file changes, one is touched, one goes and one comes: rows made, the feed, and the catalog of a full scan."""
    import os

    from lintel.plans import ddl
    from lintel.sources import rescan

    root, made = tmp_path / "src", []
    (root / "sub").mkdir(parents=True)
    put = lambda name, text: (root / name).write_text(text)
    for k in range(6):
        put(f"sub/t{k}.sql", f"CREATE TABLE t{k} (id INT, note TEXT);")
    put("other.txt", "CREATE TABLE no (x INT)")

    def make(texts):
        made.append(texts.count())
        return ddl.catalog_of(texts.select(F.col("path").alias("schema_id"), F.lit("1").alias("order_key"), "text")).withColumnRenamed("schema_id", "path")

    scan = rescan.Rescan(spark, str(root), "*.sql", str(tmp_path / "scan"), make)
    with pytest.raises(ValueError):
        scan.current()
    status = lambda feed: {os.path.basename(r["path"]): r["status"] for r in feed.collect()}
    assert status(scan.update()) == {f"t{k}.sql": "added" for k in range(6)}
    assert scan.current().count() == 12 and status(scan.update()) == {}
    put("sub/t1.sql", "CREATE TABLE t1 (id INT, note TEXT, more INT);")
    os.utime(root / "sub/t2.sql", (1, 1))
    (root / "sub/t3.sql").unlink()
    put("new.sql", "CREATE TABLE fresh (id INT);")
    assert status(scan.update()) == {"t1.sql": "changed", "t3.sql": "removed", "new.sql": "added"}
    assert made == [6, 0, 2]
    whole = rescan.Rescan(spark, str(root), "*.sql", str(tmp_path / "whole"), make)
    whole.update()
    rows = lambda s: sorted(tuple(r) for r in s.current().select("path", "table_name", "column_name", "ordinal", "data_type").collect())
    assert rows(scan) == rows(whole) and len(rows(scan)) == 12
    # a scan that fails leaves the version before
    put("sub/t4.sql", "CREATE TABLE t4 (other INT);")
    broken = rescan.Rescan(spark, str(root), "*.sql", str(tmp_path / "scan"), lambda texts: texts.select(F.raise_error(F.lit("broken")).alias("path")))
    with pytest.raises(Exception, match="broken"):
        broken.update()
    assert scan.version() == 3 and rows(scan) == rows(whole)
    assert status(scan.update()) == {"t4.sql": "changed"} and scan.version() == 4
