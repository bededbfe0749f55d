"""Data sources and files: catalogs with pushed filters, a sink that commits once, scans and sinks of files."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from lintel.sources import catalogs, datasource, files


@pytest.fixture(scope="session")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "some.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table users (id integer primary key, mail text not null, age int default 3); create table orders (id integer primary key, user_id int references users(id), total decimal(10,2));" + "".join(f"create table t{k} (a int, b text);" for k in range(9)))
    datasource.register(spark)
    return path


def test_catalog_source_reads_and_prunes(spark, base):
    whole = spark.read.format("lintel-catalog").option("url", base).option("schema_id", "s").load()
    rows = {(r["table_name"], r["column_name"]): r for r in whole.collect()}
    assert len(rows) == 6 + 18 and whole.rdd.getNumPartitions() == 4
    r = rows["orders", "user_id"]
    assert (r["schema_id"], r["ordinal"], r["is_fk"], r["ref_table"], r["ref_column"], r["nullable"]) == ("s", 1, True, "users", "id", True)
    assert rows["users", "id"]["is_pk"] and not rows["users", "mail"]["nullable"] and rows["users", "age"]["default_value"] == "3"
    some = whole.where("table_name in ('users', 't3') and ordinal > 0")
    assert {(r["table_name"], r["column_name"]) for r in some.collect()} == {("users", "mail"), ("users", "age"), ("t3", "b")}
    assert whole.where("table_name = 'none'").count() == 0


def test_catalog_filters_reach_the_reader(base):
    reader = datasource.CatalogReader({"url": base})
    rest = list(reader.pushFilters([datasource.EqualTo(("table_name",), "t1"), datasource.EqualTo(("ordinal",), 0), datasource.In(("table_name",), ["t1", "t2"])]))
    assert len(rest) == 1 and reader.partitions() == [datasource.Tables(("t1",))]


def test_live_catalog_falls_back_as_a_whole(spark, monkeypatch):
    """A part that fails only when it is read takes the stored catalog's place."""
    stored = (spark.range(1), spark.range(2))
    bad = spark.range(3).select(F.raise_error(F.lit("no rows")).alias("x"))
    for parts in ((spark.range(3), bad), (bad, spark.range(3))):
        monkeypatch.setattr(catalogs, "load", lambda *a, parts=parts, **k: parts)
        assert catalogs.load_or(spark, "mysql", "jdbc:x", "s", stored) == stored
    monkeypatch.setattr(catalogs, "load", lambda *a, **k: (spark.range(3), spark.range(4)))
    assert [df.count() for df in catalogs.load_or(spark, "mysql", "jdbc:x", "s", stored)] == [3, 4]


def put(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, datasource.FINDINGS).repartition(3).write.format("lintel-findings").option("path", path).mode(mode).save()


def test_findings_are_replaced_by_document_and_at_once(spark, base, tmp_path):
    path, row = str(tmp_path / "found"), lambda d, code, at=0: (d, 0, code, "error", "m", at, at + 1)
    assert datasource.findings(spark, path).count() == 0
    put(spark, path, [row("a", "X", k) for k in range(5)] + [row("b", "Y")])
    put(spark, path, [row("a", "Z"), row("c", None)])
    now = lambda: sorted((r["doc_id"], r["code"]) for r in datasource.findings(spark, path).collect())
    assert now() == [("a", "Z"), ("b", "Y")]
    # a task that fails amid the write leaves all as it was
    broken = spark.createDataFrame([row("a", "N", k) for k in range(40)], datasource.FINDINGS).repartition(4).withColumn("message", F.when(F.col("start_offset") == 17, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("message")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("lintel-findings").option("path", path).mode("append").save()
    assert now() == [("a", "Z"), ("b", "Y")] and len(datasource.batches(path)) == 2
    put(spark, path, [row("b", None)])
    assert now() == [("a", "Z")]
    # files that no manifest names, as a lost or doubled task leaves them, are not read
    os.link(next(os.path.join(path, "data", f) for f in os.listdir(f"{path}/data")), f"{path}/data/stray.parquet")
    assert now() == [("a", "Z")]


def test_file_scans(spark, tmp_path):
    put_ = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put_("db/2_b.sql", "SELECT 2"), put_("db/10_a.sql", "SELECT 10"), put_("node_modules/x.sql", "SELECT 0")
    put_("app/models.py", "class A(models.Model):\n pass"), put_("app/plain.py", "x = 1"), put_("app/e.ts", "@Entity()\nclass B {}"), put_("schema.prisma", "model A {}")
    put_("README.md", "# api"), put_("notes.md", "nothing"), put_("openapi.yaml", "a: 1")
    root = str(tmp_path)
    scripts = files.sql_scripts(spark, root).orderBy("order_key").collect()
    assert [os.path.basename(r["path"]) for r in scripts] == ["2_b.sql", "10_a.sql"]
    assert {(os.path.basename(r["path"]), r["kind"]) for r in files.model_files(spark, root).collect()} == {("models.py", "django"), ("e.ts", "typeorm")}
    assert files.model_files(spark, root, most_chars=20).count() <= 1 and files.prisma_schemas(spark, root).count() == 1
    assert {(os.path.basename(r["path"]), r["line_no"], r["line"]) for r in files.code_lines(spark, root, "*.py").collect()} == {("models.py", 1, "class A(models.Model):"), ("models.py", 2, " pass"), ("plain.py", 1, "x = 1")}
    assert {os.path.basename(r["path"]) for r in files.documents(spark, root).collect()} >= {"README.md", "openapi.yaml"}


def test_json_schema_and_sinks(spark, tmp_path):
    path = tmp_path / "schema.json"
    path.write_text(json.dumps({"tables": {"t": {"columns": {"id": {"type": "int", "isPrimaryKey": True, "nullable": False}, "r": {"name": "ref", "type": "int", "isForeignKey": True, "referencesTable": "u", "referencesColumn": "id"}}}}}))
    rows = {r["column_name"]: r for r in files.json_schema(spark, str(path), "s").collect()}
    assert rows["id"]["is_pk"] and not rows["id"]["nullable"] and rows["ref"]["ref_table"] == "u" and rows["ref"]["nullable"] and rows["ref"]["ordinal"] == 1
    df = spark.createDataFrame([("d1", "x"), ("d2", "y")], "doc_id string, code string")
    files.write_json(df, str(tmp_path / "json"))
    assert {r["doc_id"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {"d1", "d2"}
    out = str(tmp_path / "by")
    files.replace_by_document(df, out)
    files.replace_by_document(spark.createDataFrame([("d1", "z")], df.schema), out)
    assert {(r["doc_id"], r["code"]) for r in spark.read.parquet(out).collect()} == {("d1", "z"), ("d2", "y")}
    name = spark.sql("select timestamp'2024-01-02 03:04:05' as t").select(files.export_name(F.lit("my table"), F.col("t"))).first()[0]
    assert name == "impact-my-table-2024-01-02T03-04-05.json"
    files.save_state(df, df, str(tmp_path / "state"))
    assert [x.count() for x in files.load_state(spark, str(tmp_path / "state"))] == [2, 2]


def test_spark_catalog(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("seen_view")
    rows = {(r["column_name"], r["data_type"], r["ordinal"]) for r in catalogs.spark_catalog(spark).where("table_name = 'seen_view'").collect()}
    assert rows == {("id", "int", 0), ("name", "string", 1)}
