"""Lint rules over statements: a table of patterns, and checks against a catalog by joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lex
from . import scopes

#: (code, pattern, severity, message, suggestion, only without WHERE and LIMIT). Codes and patterns are fixed values.
PATTERN_RULES = [
    ("DBS-DESTRUCT-001", r"\bDROP\s+(?:TABLE|DATABASE)\b", "error", "drops a table or database with its data", "soft-delete first", False),
    ("DBS-DESTRUCT-001b", r"\bDROP\s+COLUMN\b", "error", "drops a column with its data", "rename the column first", False),
    ("DBS-DESTRUCT-002", r"\bTRUNCATE\b", "error", "removes all rows at once", "delete with a predicate", False),
    ("DBS-DESTRUCT-003", r"\bDELETE\s+FROM\b", "error", "deletes without a predicate", "add a WHERE clause", True),
    ("DBS-DESTRUCT-004", r"\bUPDATE\s+\w[\w$]*\s+SET\b", "error", "updates without a predicate", "add a WHERE clause", True),
    ("DBS-SCHEMA-005", r"\bALTER\s+TABLE\s+\w[\w$]*\s+ADD\s+(?:COLUMN\s+)?\w[\w$]*\s+\w[\w$]*(?:\([^)]*\))?\s+NOT\s+NULL(?!\s+DEFAULT)(?!\s+GENERATED)", "warning", "adds a required column without a default", "give a default or backfill first", False),
    ("DBS-PERF-001", r"\bDROP\s+INDEX\b", "warning", "drops an index", "look at the queries that use it", False),
    ("DBS-PERF-002", r"\bSELECT\s+\*", "info", "selects all columns", "name the columns", False),
    ("DBS-BREAK-001", r"\bALTER\s+TABLE\s+\w[\w$]*\s+RENAME\b", "warning", "renames what queries refer to", "keep a view under the old name", False),
]
MODAL = ["DBS-DESTRUCT-001", "DBS-DESTRUCT-002", "DBS-DESTRUCT-003"]
#: Names that are never taken for tables. Fixed values.
NO_TABLE = (
    "dual excluded new old inserted deleted select from where join left right inner outer full cross on using union all with as set "
    "values into update delete insert create alter drop table index view database primary key foreign references constraint"
).split()

COLUMNS = ["code", "severity", "message", "suggestion", "start_offset", "end_offset", "seq"]


def fires(mask: Column, pattern: str, guarded: bool) -> Column:
    hit = mask.rlike("(?i)" + pattern)
    # a pattern that begins with a whole word, and has no other beginning, needs that word
    word = re.match(r"\\b([A-Z]+)\\[bs]", pattern)
    if word and "|" not in re.sub(r"\(\?[:!][^()]*\)", "", pattern):
        hit = lex.mentions(mask, word[1]) & hit
    return hit & ~lex.has_clause(mask, "WHERE") & ~lex.has_clause(mask, "LIMIT") if guarded else hit


def pattern_findings(statements: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """doc_id, stmt_idx and COLUMNS: a row per match of each rule on the mask, located in the document."""
    one = lambda k, r: F.when(fires(F.col("clause_mask"), r[1], r[5]), F.struct(F.lit(r[0]).alias("code"), F.lit(r[2]).alias("severity"), F.lit(r[3]).alias("message"), F.lit(r[4]).alias("suggestion"), F.lit("(?i)" + r[1]).alias("pattern"), F.lit(k).alias("seq")))
    hits = statements.select("doc_id", "stmt_idx", "clause_mask", "start_offset", F.explode(F.array_compact(F.array(*[one(k, r) for k, r in enumerate(rules)]))).alias("r"))
    # the text between matches tells where each match stands
    found = hits.withColumn("m", F.expr("regexp_extract_all(clause_mask, r.pattern, 0)")).withColumn("gaps", F.expr("split(clause_mask, r.pattern)"))
    rows = found.select("*", F.posexplode("m").alias("k", "text"))
    before = F.expr("aggregate(slice(gaps, 1, k + 1), 0, (a, g) -> a + length(g)) + aggregate(slice(m, 1, k), 0, (a, g) -> a + length(g))")
    return rows.select("doc_id", "stmt_idx", "r.code", "r.severity", "r.message", "r.suggestion", (F.col("start_offset") + before).alias("start_offset"), (F.col("start_offset") + before + F.length("text")).alias("end_offset"), (F.col("r.seq") * 1000 + F.col("k")).alias("seq"))


def first_per_place(findings: DataFrame) -> DataFrame:
    """The first finding of each (document, offset, code), by statement and then by rule."""
    w = Window.partitionBy("doc_id", "start_offset", "code").orderBy("stmt_idx", "seq")
    return findings.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


SCHEMA_RULES = {
    "DBS-SCHEMA-001": ("error", "see whether the name is spelled right and the catalog is current"),
    "DBS-SCHEMA-002": ("error", "see whether the name is spelled right and the catalog is current"),
    "DBS-SCHEMA-003": ("error", "drop the foreign keys first"),
    "DBS-SCHEMA-004": ("error", "alter the column that is there, or take another name"),
    "DBS-SCHEMA-005": (None, "give a default, or add it nullable and backfill"),
}
_TABLE = r"[`\"]?(?:\w+[`\"]?\.[`\"]?)*(\w+)[`\"]?"


def low_tables(tables: DataFrame, *more: str) -> DataFrame:
    """table_name in lower case, one row a table; with the largest of other columns."""
    return tables.groupBy(F.lower("table_name").alias("table_name")).agg(*[F.max(c).alias(c) for c in more] or [F.count(F.lit(1)).alias("n")]).select("table_name", *more)


def used_tables(statements: DataFrame) -> DataFrame:
    """doc_id, stmt_idx and the statement's columns with pos, table_name of every table named that is no CTE."""
    mask = F.col("parse_mask")
    return statements.select("*", F.posexplode(F.array_except(lex.statement_tables(mask), lex.cte_names(mask))).alias("pos", "table_name"))


def offset_of(name: Column) -> Column:
    """Where a name stands first in a statement's parse mask, counted in the document; the statement's start where it doesn't."""
    before = F.regexp_instr(F.lower("parse_mask"), F.concat(F.lit(r"(?<![a-z0-9_])\Q"), name, F.lit(r"\E(?![a-z0-9_])")), F.lit(0))
    return F.col("start_offset") + F.greatest(before - 1, F.lit(0))


def finding(code: str, message: Column, start: Column, end: Column, seq: Column, severity: Column | None = None) -> list[Column]:
    level, hint = SCHEMA_RULES[code]
    return [F.lit(code).alias("code"), (F.lit(level) if severity is None else severity).alias("severity"), message.alias("message"), F.lit(hint).alias("suggestion"), start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), (seq + int(code[-1]) * 100_000).cast("int").alias("seq")]


def unknown_tables(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name and the finding of tables named but not in the catalog; CTEs, CREATE and DROP IF EXISTS aside."""
    mask = F.col("clause_mask")
    makes, drops = lex.mentions(mask, "CREATE"), lex.mentions(mask, "DROP")
    checked = statements.where(~lex.first_keyword(mask).isin("CREATE", "COMMENT") & ~(makes & mask.rlike(r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|INDEX)\b")) & ~(drops & mask.rlike(r"(?i)\bDROP\s+(?:TEMPORARY\s+)?TABLE\s+IF\s+EXISTS\b")))
    used = used_tables(checked).where(~F.col("table_name").isin(NO_TABLE)).join(low_tables(tables), "table_name", "left_anti")
    at = offset_of(F.col("table_name"))
    return used.select("doc_id", "stmt_idx", "table_name", *finding("DBS-SCHEMA-001", F.concat(F.lit('no table "'), "table_name", F.lit('" in the catalog')), at, at + F.length("table_name"), F.col("pos")))


def unknown_columns(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """table_name, column_name and the finding of columns used but not in the statement's first known table.

    Of SELECT its list is looked at (not where it has a bare star), of UPDATE what it sets and its WHERE, of DELETE its WHERE, of
    INSERT its list.
    """
    mask = F.col("parse_mask")
    verb = lex.first_keyword(F.col("clause_mask"))
    verbs = statements.where(verb.isin("SELECT", "INSERT", "UPDATE", "DELETE") & ~(F.contains(mask, F.lit("*")) & mask.rlike(r"(?is)^\s*SELECT\s+(?:DISTINCT\s+)?(?:[^;]*?,\s*)?\*\s*(?:,|\bFROM\b)")))
    known = low_tables(columns)
    named = used_tables(verbs).join(known, "table_name")
    first = named.groupBy("doc_id", "stmt_idx").agg(F.min(F.struct("pos", "table_name", "parse_mask", "start_offset", verb.alias("verb"))).alias("x")).select("doc_id", "stmt_idx", "x.table_name", "x.parse_mask", "x.start_offset", "x.verb")
    what = F.when(F.col("verb") == "SELECT", lex.select_columns(mask)).when(F.col("verb") == "INSERT", lex.insert_columns(mask)).when(F.col("verb") == "DELETE", lex.where_columns(mask)).otherwise(F.array_distinct(F.concat(lex.set_columns(mask), lex.where_columns(mask))))
    used = first.select("*", F.posexplode(what).alias("pos", "column_name")).where(~F.col("column_name").isin(NO_TABLE))
    there = columns.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()
    rows = used.join(there, ["table_name", "column_name"], "left_anti")
    at = offset_of(F.col("column_name"))
    text = F.concat(F.lit('no column "'), "column_name", F.lit('" in table "'), "table_name", F.lit('"'))
    return rows.select("doc_id", "stmt_idx", "table_name", "column_name", *finding("DBS-SCHEMA-002", text, at, at + F.length("column_name"), F.col("pos")))


def altered(statements: DataFrame) -> DataFrame:
    """Statements that alter a table, with its name."""
    name = F.lower(F.regexp_extract("parse_mask", rf"(?i)\bALTER\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?{_TABLE}", 1))
    return statements.where(lex.mentions(F.col("clause_mask"), "ALTER") & (lex.first_keyword(F.col("clause_mask")) == "ALTER")).withColumn("table_name", name).where("table_name != ''")


def fk_dependents(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """table_name, column_name, dependents and the finding of dropped columns that foreign keys point at."""
    drop = rf"(?i)\bALTER\s+TABLE\s+{_TABLE}\s+DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?[`\"]?(\w+)"
    dropped = altered(statements).withColumn("column_name", F.lower(F.regexp_extract("parse_mask", drop, 2))).where("column_name != ''")
    keys = columns.where("ref_table is not null and ref_column is not null").groupBy(F.lower("ref_table").alias("table_name"), F.lower("ref_column").alias("column_name")).agg(F.sort_array(F.collect_set(F.concat_ws(".", "table_name", "column_name"))).alias("d"))
    rows = dropped.join(keys, ["table_name", "column_name"]).withColumn("dependents", F.array_join("d", ", "))
    text = F.concat(F.lit('column "'), "table_name", F.lit("."), "column_name", F.lit('" is what '), F.size("d").cast("string"), F.lit(" foreign keys point at: "), "dependents")
    return rows.select("doc_id", "stmt_idx", "table_name", "column_name", "dependents", *finding("DBS-SCHEMA-003", text, F.col("start_offset"), F.col("end_offset"), F.lit(0)))


def duplicate_columns(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """table_name, column_name and the finding of columns added that are there already."""
    new = F.lower(F.regexp_extract("parse_mask", r"(?i)\bADD\s+(?:COLUMN\s+)?(?!CONSTRAINT\b|PRIMARY\b|FOREIGN\b|UNIQUE\b|INDEX\b|KEY\b|CHECK\b)[`\"]?(\w+)[`\"]?\s+\w", 1))
    added = altered(statements).where(~F.col("clause_mask").rlike(r"(?i)\bADD\s+(?:COLUMN\s+)?IF\s+NOT\s+EXISTS\b")).withColumn("column_name", new).where("column_name != ''")
    known = columns.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()
    rows = added.join(known, ["table_name", "column_name"], "left_semi")
    text = F.concat(F.lit('column "'), "column_name", F.lit('" is in table "'), "table_name", F.lit('" already'))
    return rows.select("doc_id", "stmt_idx", "table_name", "column_name", *finding("DBS-SCHEMA-004", text, F.col("start_offset"), F.col("end_offset"), F.lit(0)))


def not_null_without_default(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name and the finding: info where the table is known to be empty, else warning."""
    mask = F.col("clause_mask")
    added = altered(statements).where(mask.rlike(r"(?i)\bNOT\s+NULL\b") & mask.rlike(r"(?i)\bADD\b") & ~lex.has_clause(mask, "DEFAULT"))
    sizes = low_tables(tables, "row_count")
    rows = added.join(sizes, "table_name", "left")
    text = F.concat(F.lit('adds a required column without a default to "'), "table_name", F.lit('"'), F.coalesce(F.concat(F.lit(" of "), F.col("row_count").cast("string"), F.lit(" rows")), F.lit("")))
    return rows.select("doc_id", "stmt_idx", "table_name", *finding("DBS-SCHEMA-005", text, F.col("start_offset"), F.col("end_offset"), F.lit(0), F.when(F.col("row_count") == 0, "info").otherwise("warning")))


def nested_columns(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """table_name, column_name and the finding of every use of a column that its table hasn't, subqueries and aliases resolved."""
    rows = scopes.unknown_columns(statements, columns).withColumnsRenamed({"start_offset": "from_", "end_offset": "to_"})
    text = F.concat(F.lit('no column "'), "column_name", F.lit('" in table "'), "table_name", F.lit('"'))
    return rows.select("doc_id", "stmt_idx", "table_name", "column_name", *finding("DBS-SCHEMA-002", text, F.col("from_"), F.col("to_"), F.col("from_") % 100_000))


def schema_findings(statements: DataFrame, columns: DataFrame, tables: DataFrame, nested: bool = False) -> DataFrame:
    """doc_id, stmt_idx and COLUMNS of all rules that ask a catalog: its columns, and its tables with row_count. With nested, columns
    are resolved in subqueries and by aliases; else by the statement's first known table."""
    every = columns.select("table_name").unionByName(tables.select("table_name"))
    found = [unknown_tables(statements, every), (nested_columns if nested else unknown_columns)(statements, columns), fk_dependents(statements, columns), duplicate_columns(statements, columns), not_null_without_default(statements, tables)]
    return reduce(DataFrame.unionByName, [f.select("doc_id", "stmt_idx", *COLUMNS) for f in found])


def diagnostics(statements: DataFrame, columns: DataFrame | None = None, tables: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """All findings, those of patterns before those of the catalog in a statement, the first of each (document, offset, code).

    Without a catalog only patterns are looked for. Each rule reads the statements, so persist them where they are costly to make.
    """
    found = pattern_findings(statements)
    if columns is not None:
        found = found.unionByName(schema_findings(statements, columns, tables if tables is not None else columns.select("table_name", F.lit(None).cast("long").alias("row_count")), nested))
    return first_per_place(found)
