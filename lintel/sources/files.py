"""Text sources: SQL scripts, Prisma schemas, model files, code, documents, JSON schemas; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_MODEL_CHARS = 524_288
SKIPPED = r"/(node_modules|out|dist|\.git)/"


def text_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, text of the files under root whose name fits a glob; generated folders aside. No cap on their number."""
    raw = spark.read.text(root, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(SKIPPED))


def numeric_key(path: Column) -> Column:
    """Sort key of paths in which numbers count as numbers."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def sql_scripts(spark: SparkSession, root: str) -> DataFrame:
    return text_files(spark, root, "*.sql").withColumn("order_key", numeric_key(F.col("path")))


def prisma_schemas(spark: SparkSession, root: str) -> DataFrame:
    return text_files(spark, root, "schema.prisma")


def model_files(spark: SparkSession, root: str, most_chars: int | None = MOST_MODEL_CHARS) -> DataFrame:
    """path, text, kind (django or typeorm) of model files, told by their content; larger ones than most_chars aside (None: all)."""
    kind = F.when(F.col("text").rlike(r"models\.Model\b"), "django").when(F.col("text").rlike(r"@Entity\b"), "typeorm")
    both = text_files(spark, root, "*.py").unionByName(text_files(spark, root, "*.ts"))
    sized = both if most_chars is None else both.where(F.length("text") <= most_chars)
    return sized.withColumn("kind", kind).where("kind is not null").dropDuplicates(["path"])


def code_lines(spark: SparkSession, root: str, pattern: str = "*.{ts,js,py,java,rb,go,cs}") -> DataFrame:
    """path, line_no (from 1), line."""
    return text_files(spark, root, pattern).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")


def documents(spark: SparkSession, root: str) -> DataFrame:
    return text_files(spark, root, "*.{md,yaml,yml,json}").where(F.lower("path").rlike("readme|api|schema"))


def json_schema(spark: SparkSession, path: str, schema_id: str) -> DataFrame:
    """Columns of a JSON schema file: {"tables": {name: {"columns": {name: {...}}}}}."""
    column = "struct<name:string,type:string,nullable:boolean,isPrimaryKey:boolean,isForeignKey:boolean,referencesTable:string,referencesColumn:string,defaultValue:string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"tables map<string,struct<columns:map<string,{column}>>>").alias("s"))
    tables = raw.select(F.explode("s.tables").alias("table_name", "t"))
    cols = tables.select("table_name", F.posexplode(F.map_entries("t.columns")).alias("ordinal", "e"))
    v = F.col("e.value")
    no = lambda c: F.coalesce(c, F.lit(False))
    return cols.select(F.lit(schema_id).alias("schema_id"), "table_name", F.coalesce(v["name"], F.col("e.key")).alias("column_name"), "ordinal", v["type"].alias("data_type"), F.coalesce(v["nullable"], F.lit(True)).alias("nullable"), no(v["isPrimaryKey"]).alias("is_pk"), no(v["isForeignKey"]).alias("is_fk"), v["referencesTable"].alias("ref_table"), v["referencesColumn"].alias("ref_column"), v["defaultValue"].alias("default_value"))


def export_name(table: Column, at: Column) -> Column:
    slug = F.regexp_replace(F.coalesce(table, F.lit("unknown")), "[^A-Za-z0-9]", "-")
    return F.concat(F.lit("impact-"), slug, F.lit("-"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".json"))


def write_json(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def replace_by_document(findings: DataFrame, path: str) -> None:
    """Findings, one folder per document, each replaced as a whole."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def save_state(columns: DataFrame, history: DataFrame, path: str) -> None:
    """The current catalog and its history, each as a table in a folder of its own."""
    for name, df in (("current", columns), ("history", history)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(columns, history) as saved."""
    return spark.read.parquet(f"{path}/current"), spark.read.parquet(f"{path}/history")
