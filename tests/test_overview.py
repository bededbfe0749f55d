"""The overview of findings: each text judged once, counted as often as events have it."""

import datetime

import duckdb
from pyspark.sql import functions as F

from lintel.operators import rules
from lintel.plans import reports, rich_queries
from lintel.plans.driver_queries import ORACLES

DAY = datetime.datetime(2024, 1, 1, 12)


def test_each_text_is_judged_once(spark, monkeypatch):
    judged, diagnostics = [], rules.diagnostics
    monkeypatch.setattr(rules, "diagnostics", lambda statements, *more: (judged.append(statements), diagnostics(statements, *more))[1])
    d = "/root/testdata/sf0.001"
    rich_queries.findings_overview(spark, d)
    texts = rich_queries.rich(spark, d).select("sql").distinct().count()
    assert judged[0].select("doc_id").distinct().count() == texts < 200
    assert judged[0].count() <= 2 * texts


def test_repeated_and_missing_ids_count_as_in_sql(spark, tmp_path):
    rows = [(k % 8, DAY + datetime.timedelta(days=k % 3), k % 5, ["view", "click", None][k % 3]) for k in range(60)]
    rows += [(None, DAY, 1, "view"), (7, None, 2, "view"), (15, DAY, 0, None), (23, DAY, 3, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = rich_queries.findings_overview(spark, str(tmp_path))
    names = found.columns
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    meant = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['findings_overview']})").fetchall()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, spark.createDataFrame(meant, found.schema).collect()))


def test_findings_without_times_count_once(spark):
    found = spark.createDataFrame([("x", "DBS-PERF-1", "info")] * 3 + [("y", "DBS-PERF-1", None), (None, "DBS-BREAK-1", "error")], "source string, code string, severity string")
    out = reports.overview(found, ["source"], [[], ["source"]], ["PERF", "BREAK"])
    assert sorted((r["level"], r["source"] or "", r["n"], r["errors"], r["infos"], r["perf"], r["break"]) for r in out.collect()) == [
        ("all", "", 5, 1, 3, 4, 1), ("source", "", 1, 1, 0, 0, 1), ("source", "x", 3, 0, 3, 3, 0), ("source", "y", 1, 0, 0, 1, 0)
    ]
    weighed = reports.overview(found.withColumn("times", F.lit(2)), ["source"], [[]], ["PERF"], "times").first()
    assert (weighed["n"], weighed["infos"], weighed["perf"]) == (10, 6, 8)
