"""Differences between two schemas, reconciliation SQL, the unified schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

CONFLICT = ["table_name", "column_name", "conflict_type", "source_a", "source_b", "suggestion", "reconciliation_sql", "emit_pos"]


def create_table_sql(columns: DataFrame) -> DataFrame:
    """table_name, sql that creates it."""
    one = F.concat(F.lit("  "), F.col("column_name"), F.lit(" "), F.col("data_type"), F.when(~F.col("nullable"), " NOT NULL").otherwise(""), F.when(F.col("is_pk"), " PRIMARY KEY").otherwise(""))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", one.alias("d")))), lambda s: s["d"]), ",\n")
    return columns.groupBy("table_name").agg(body.alias("body")).select("table_name", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.col("table_name"), F.lit(" (\n"), F.col("body"), F.lit("\n);")).alias("sql"))


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of shared tables, side by side; in_a and in_b tell where a column is."""
    shared = a.select("table_name").distinct().join(b.select("table_name").distinct(), "table_name")
    side = lambda df, p: df.join(shared, "table_name", "left_semi").select("table_name", "column_name", F.lit(True).alias(f"in_{p}"), F.col("data_type").alias(f"type_{p}"), F.col("nullable").alias(f"nullable_{p}"), F.col("ordinal").alias(f"ord_{p}"))
    return side(a, "a").join(side(b, "b"), ["table_name", "column_name"], "full_outer")


def column_conflicts(a: DataFrame, b: DataFrame, strict_types: bool = False) -> DataFrame:
    """Missing columns, type mismatches and nullability differences of shared tables.

    Types of one group don't conflict, whatever their lengths; with strict_types all that are spelled differently do.
    """
    t, c, ta, tb = F.col("table_name"), F.col("column_name"), F.col("type_a"), F.col("type_b")
    best = names.preferred_type(ta, tb)
    kind = F.coalesce(ta, tb)
    add = F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD COLUMN "), c, F.lit(" "), kind)
    none = F.lit(None).cast("string")
    row = lambda what, sa, sb, hint, sql, pos: F.struct(F.lit(what).alias("conflict_type"), sa.alias("source_a"), sb.alias("source_b"), hint.alias("suggestion"), sql.alias("reconciliation_sql"), pos.alias("emit_pos"))
    same = F.lower(F.regexp_replace(ta, r"\s+", "")) == F.lower(F.regexp_replace(tb, r"\s+", "")) if strict_types else names.merge_compatible(ta, tb)
    missing = F.col("in_a").isNull() | F.col("in_b").isNull()
    null_word = lambda x: F.when(x, "NULLABLE").otherwise("NOT NULL")
    found = F.array_compact(
        F.array(
            F.when(missing, row("missing_column", F.coalesce(ta, none), F.coalesce(tb, none), add, F.concat(add, F.lit(";")), F.when(F.col("in_a"), F.col("ord_a") * 2).otherwise(1000000 + F.col("ord_b")))),
            F.when(~missing & ~same, row("type_mismatch", ta, tb, F.concat(F.lit("use "), best), F.concat(F.lit("ALTER TABLE "), t, F.lit(" ALTER COLUMN "), c, F.lit(" TYPE "), best, F.lit(" USING "), c, F.lit("::"), best, F.lit(";")), F.col("ord_a") * 2)),
            F.when(~missing & (F.col("nullable_a") != F.col("nullable_b")), row("nullable_difference", null_word(F.col("nullable_a")), null_word(F.col("nullable_b")), F.lit("use NULLABLE"), F.concat(F.lit("ALTER TABLE "), t, F.lit(" ALTER COLUMN "), c, F.lit(" DROP NOT NULL;")), F.col("ord_a") * 2 + 1)),
        )
    )
    return joined(a, b).select(t, c, F.explode(found).alias("x")).select("table_name", "column_name", "x.*")


def table_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables that only one schema has."""
    side = lambda df, p: df.select("table_name").distinct().withColumn(f"in_{p}", F.lit(True))
    found = side(a, "a").join(side(b, "b"), "table_name", "full_outer").where("in_a is null or in_b is null")
    sql = create_table_sql(a).unionByName(create_table_sql(b).join(a.select("table_name").distinct(), "table_name", "left_anti"))
    where = lambda p: F.when(F.col(f"in_{p}"), "present").otherwise("absent")
    return found.join(sql, "table_name").select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("missing_table").alias("conflict_type"), where("a").alias("source_a"), where("b").alias("source_b"), F.concat(F.lit("create "), F.col("table_name")).alias("suggestion"), F.col("sql").alias("reconciliation_sql"), F.when(F.col("in_a"), -2).otherwise(-1).alias("emit_pos"))


def conflicts(a: DataFrame, b: DataFrame, strict_types: bool = False) -> DataFrame:
    return table_conflicts(a, b).select(CONFLICT).unionByName(column_conflicts(a, b, strict_types).select(CONFLICT))


def conflict_id() -> Column:
    """table::column::type of a conflict."""
    return F.concat_ws("::", "table_name", F.coalesce("column_name", F.lit("")), "conflict_type")


def enriched(found: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts with the resolution of their id (id, confidence, resolution, reason, files) in the suggestion, where there is one."""
    r = resolutions.select(F.col("id").alias("__id"), "confidence", "resolution", "reason", "files")
    some = F.concat(F.lit(" Affects "), F.size("files"), F.lit(" file(s): "), F.array_join(F.slice("files", 1, 3), ", "), F.when(F.size("files") > 3, "...").otherwise(""))
    text = F.concat(F.lit("["), F.round(F.col("confidence") * 100).cast("int"), F.lit("% confidence, "), F.col("resolution"), F.lit("] "), F.col("reason"), F.when(F.size("files") > 0, some).otherwise(""))
    return found.withColumn("__id", conflict_id()).join(r, "__id", "left").withColumn("suggestion", F.coalesce(text, "suggestion")).select(CONFLICT)


def reconciliation_script(found: DataFrame) -> DataFrame:
    """phase, table_name, script: the SQL of each table's conflicts in order, a comment before each. The scripts run in the order
    of phase (tables of the first schema, of the second, then changes) and table_name; no row holds more than a table's."""
    line = F.concat(F.lit("-- "), F.col("conflict_type"), F.lit(": "), F.concat_ws(".", "table_name", "column_name"), F.lit("\n"), F.col("reconciliation_sql"))
    phase = F.when(F.col("emit_pos") < 0, F.col("emit_pos") + 2).otherwise(2).cast("int")
    order = F.struct("emit_pos", F.coalesce("column_name", F.lit("")).alias("c"), line.alias("line"))
    script = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["line"]), "\n\n")
    return found.groupBy(phase.alias("phase"), "table_name").agg(script.alias("script"))


def unified(a: DataFrame, b: DataFrame) -> DataFrame:
    """table_name, column_name, data_type, nullable, ordinal of both schemas: the preferred type, nullable where either is; a
    table's columns in the order of the first schema, those that only the second has behind them."""
    side = lambda df, p: df.select("table_name", "column_name", F.col("data_type").alias(f"type_{p}"), F.col("nullable").alias(f"null_{p}"), F.col("ordinal").alias(f"ord_{p}"))
    both = side(a, "a").join(side(b, "b"), ["table_name", "column_name"], "full_outer")
    kind = F.when(F.col("type_a").isNull(), F.col("type_b")).when(F.col("type_b").isNull(), F.col("type_a")).otherwise(names.preferred_type(F.col("type_a"), F.col("type_b")))
    own = Window.partitionBy("table_name").orderBy(F.col("ord_a").isNull(), "ord_a", "ord_b", "column_name")
    return both.select("table_name", "column_name", kind.alias("data_type"), (F.coalesce("null_a", F.lit(False)) | F.coalesce("null_b", F.lit(False))).alias("nullable"), (F.row_number().over(own) - 1).alias("ordinal"))


def merged_header(a: DataFrame, b: DataFrame) -> DataFrame:
    """db_type, database_name of the unified schema from the headers (db_type, database_name) of both."""
    one = lambda df, p: df.select(F.col("db_type").alias(f"kind_{p}"), F.col("database_name").alias(f"name_{p}")).limit(1)
    return one(a, "a").join(one(b, "b"), F.lit(True)).select(F.col("kind_a").alias("db_type"), F.concat_ws("_", "name_a", F.lit("merged"), "name_b").alias("database_name"))


def of_kinds(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Conflicts of some kinds, with their ids."""
    return found.where(F.col("conflict_type").isin(kinds)).withColumn("id", conflict_id())


def renamed(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """table_name, column_a, column_b, likeness: columns of shared tables that only one side has, matched as renamed.

    Likeness is 0.5 of the names' similarity, 0.3 where the types merge, and 0.2 less with the distance of their places. In each
    round every column offers itself to its most alike free partner, and mutual offers match; so a table's matching is that of
    taking the most alike pairs first (ties by names). A table's columns meet only those of the same table.
    """
    both = joined(a, b)
    side = lambda p, q: both.where(f"in_{q} is null").select("table_name", F.col("column_name").alias(f"column_{p}"), F.col(f"type_{p}").alias(f"type_{p}"), F.col(f"ord_{p}").alias(f"ord_{p}"))
    pairs = side("a", "b").join(side("b", "a"), "table_name")
    near = 0.2 / (1 + F.abs(F.col("ord_a") - F.col("ord_b")))
    like = 0.5 * names.similarity(names.normal(F.col("column_a")), names.normal(F.col("column_b"))) + F.when(names.merge_compatible(F.col("type_a"), F.col("type_b")), 0.3).otherwise(0.0) + near
    pairs = pairs.select("table_name", "column_a", "column_b", F.round(like, 9).alias("likeness")).where(F.col("likeness") >= least)
    order = F.struct((-F.col("likeness")).alias("l"), "column_a", "column_b")
    listed = pairs.groupBy("table_name").agg(F.sort_array(F.collect_list(order)).alias("offers"))
    # taking from a sorted list each pair whose columns are still free is what the rounds come to
    free = lambda taken, o: ~F.exists(taken, lambda t: (t["column_a"] == o["column_a"]) | (t["column_b"] == o["column_b"]))
    none = F.array().cast("array<struct<l:double,column_a:string,column_b:string>>")
    matched = F.aggregate("offers", none, lambda taken, o: F.when(free(taken, o), F.concat(taken, F.array(o))).otherwise(taken))
    return listed.select("table_name", F.explode(matched).alias("m")).select("table_name", "m.column_a", "m.column_b", (-F.col("m.l")).alias("likeness"))


def keyed_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status of the rows of two frames that differ: only_a, only_b or changed (any other column)."""
    rest = [c for c in a.columns if c not in keys]
    side = lambda df, p: df.select(*keys, F.struct(F.lit(1).alias("here"), *rest).alias(p))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, status.alias("status")).where("status is not null")
