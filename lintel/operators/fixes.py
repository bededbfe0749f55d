"""Quick fixes of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lex

GUARD = " WHERE 1 = 0 /* TODO: add real predicate */"


def guarded(sql: Column) -> Column:
    """DELETE and UPDATE without WHERE get a predicate that is never true."""
    bare = sql.rlike(r"(?i)^\s*(?:DELETE\s+FROM|UPDATE)\b") & ~sql.rlike(r"(?i)\bWHERE\b")
    return F.when(bare, F.concat(F.regexp_replace(sql, r"\s*;?\s*$", ""), F.lit(GUARD)))


def soft_delete(sql: Column) -> Column:
    """DROP TABLE becomes a deletion mark."""
    t = F.regexp_extract(sql, r"(?i)^\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?[`\"]?([\w.]+)", 1)
    return F.when(t != "", F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD COLUMN deleted_at TIMESTAMP NULL")))


def nullable(sql: Column) -> Column:
    return F.when(sql.rlike(r"(?i)\sNOT\s+NULL\b"), F.regexp_replace(sql, r"(?i)\s+NOT\s+NULL\b", ""))


def quick_fix(sql: Column) -> Column:
    return F.coalesce(guarded(sql), soft_delete(sql), nullable(sql))


def expanded_star(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, stmt_idx, sql with SELECT * spelled out from the first table's columns."""
    stars = statements.where(F.col("clause_mask").rlike(r"(?i)\bSELECT\s+\*")).withColumn("low", F.element_at(lex.statement_tables(F.col("parse_mask")), 1))
    listed = columns.groupBy(F.lower("table_name").alias("low")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda s: s["column_name"]), ", ").alias("cols"))
    return stars.join(listed, "low").select("doc_id", "stmt_idx", F.expr(r"regexp_replace(sql, '(?i)(\\bSELECT\\s+)\\*', concat('$1', cols))").alias("sql"))
