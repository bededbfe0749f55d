"""Migration impact: breaking changes, data risks, rollback, dependencies, documentation drift, score and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lex, names
from ..functions.lineage import cut
from . import textindex

#: (severity, test on text). Patterns, caps and weights are fixed values.
RISKS = [
    ("critical", "delete_without_where", lambda s, op: (op == "DELETE") & ~s.rlike("(?i)WHERE")),
    ("critical", "update_without_where", lambda s, op: (op == "UPDATE") & ~s.rlike("(?i)WHERE")),
    ("high", "drop_column", lambda s, op: s.rlike(r"(?i)ALTER.*DROP\s+COLUMN")),
    ("high", "not_null_without_default", lambda s, op: s.rlike(r"(?i)NOT\s+NULL") & ~s.rlike("(?i)DEFAULT") & ~s.rlike(r"(?i)ADD\s+COLUMN")),
    ("medium", "cascade", lambda s, op: s.rlike(r"(?i)\bCASCADE\b")),
    ("high", "drop_foreign_key", lambda s, op: s.rlike(r"(?i)ALTER\s+TABLE.*DROP\s+FOREIGN\s+KEY")),
    ("high", "drop_primary_key", lambda s, op: s.rlike(r"(?i)ALTER\s+TABLE.*DROP\s+PRIMARY\s+KEY")),
    ("high", "unique_index", lambda s, op: s.rlike(r"(?i)CREATE\s+UNIQUE\s+INDEX")),
    ("medium", "engine_change", lambda s, op: s.rlike(r"(?i)ENGINE\s*=")),
]
BREAKING = [
    ("drop", lambda s, op: op == "DROP"),
    ("drop_column", lambda s, op: (op == "ALTER") & s.rlike(r"(?i)DROP\s+COLUMN")),
    ("rename", lambda s, op: (op == "ALTER") & s.rlike(r"(?i)RENAME\s+(?:COLUMN|TABLE)")),
    ("type_change", lambda s, op: (op == "ALTER") & s.rlike(r"(?i)\bMODIFY\b|\bCHANGE\b")),
    ("not_null_without_default", lambda s, op: (op == "ALTER") & s.rlike(r"(?i)ADD.*NOT\s+NULL") & ~s.rlike("(?i)DEFAULT")),
    ("delete", lambda s, op: op == "DELETE"),
    ("truncate", lambda s, op: op == "TRUNCATE"),
]


def listed(rules) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def breaking(sql: Column) -> Column:
    op = lex.operation(sql)
    return listed([(n, t(sql, op)) for n, t in BREAKING])


def non_breaking(sql: Column) -> Column:
    return listed([("add_column", (lex.operation(sql) == "ALTER") & sql.rlike(r"(?i)ADD\s+COLUMN"))])


def risks(sql: Column) -> Column:
    """Array of (severity, risk)."""
    return found_risks(sql, lex.operation(sql))


def found_risks(sql: Column, op: Column) -> Column:
    return F.array_compact(F.array(*[F.when(t(sql, op), F.struct(F.lit(sev).alias("severity"), F.lit(n).alias("risk"))) for sev, n, t in RISKS]))


def count_risks(sql: Column, severity: str) -> Column:
    return F.size(F.filter(risks(sql), lambda r: r["severity"] == severity))


def size_factor(rows: Column) -> Column:
    return F.when(rows > 1_000_000, 1.5).when(rows > 100_000, 1.25).when(rows > 10_000, 1.1).otherwise(1.0)


def risk_score(n_breaking: Column, n_cascade: Column, n_deps: Column, n_critical: Column, n_high: Column, n_docs: Column, factor: Column) -> Column:
    """Capped, weighted sum times the factor, rounded into 1 to 10."""
    part = lambda n, w, cap: F.least(n.cast("double") * w, F.lit(float(cap)))
    total = part(n_breaking, 2.0, 4) + part(n_cascade, 0.5, 1) + part(n_deps, 1.0, 2) + part(n_critical, 2.0, 2) + part(n_high, 1.0, 1) + part(n_docs, 0.25, 1)
    return F.least(F.greatest(F.floor(total * factor + 0.5).cast("int"), F.lit(1)), F.lit(10))


def risk_level(score: Column) -> Column:
    return F.when(score >= 8, "critical").when(score >= 6, "high").when(score >= 4, "medium").otherwise("low")


def dependency_severity(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike("delete|drop|truncate|remove"), "critical").when(low.rlike("update|alter|modify|insert"), "high").when(low.rlike("select|find|fetch|get|query"), "medium").otherwise("low")


def suggestions(breaks: Column, found: Column, deps: Column, score: Column) -> Column:
    return listed(
        [
            ("nullable_first", F.array_contains(breaks, "not_null_without_default")),
            ("soft_delete_first", F.arrays_overlap(breaks, F.array(F.lit("drop"), F.lit("drop_column")))),
            ("add_predicate", F.exists(found, lambda r: r["risk"].endswith("without_where"))),
            ("update_files", deps > 5),
            ("require_approval", score >= 7),
        ]
    )


def cascades(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """stmt_id, n_cascade: foreign keys of the tables that a statement names."""
    used = statements.select("stmt_id", F.explode(lex.parsed_tables(F.col("sql"))).alias("table_name"))
    return used.join(columns.where("is_fk and ref_table is not null").select("table_name", "column_name"), "table_name").groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n_cascade"))


def analyze(statements: DataFrame, columns: DataFrame, tables: DataFrame, dependencies: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """A row per statement (stmt_id, sql): lists, counts, factor, score, level, suggestions.

    dependencies: (term, severity) rows; drift: (term) rows, counted for the tables that a statement names.
    """
    used = statements.select("stmt_id", F.explode(lex.parsed_tables(F.col("sql"))).alias("table_name"))
    keys = columns.where("is_fk and ref_table is not null").groupBy("table_name").agg(F.count(F.lit(1)).alias("keys"))
    facts = tables.groupBy("table_name").agg(F.max("row_count").alias("row_count")).join(keys, "table_name", "full_outer")
    counts = {"n_cascade": F.sum("keys"), "max_rows": F.max("row_count"), "n_deps": None, "n_docs": None}
    for frame, name, total in ((dependencies, "n_deps", F.count_if(F.col("severity") == "critical")), (drift, "n_docs", F.count(F.lit(1)))):
        if frame is not None:
            own = frame.withColumnRenamed("term", "table_name").groupBy("table_name").agg(total.alias(name))
            facts = facts.join(own, "table_name", "full_outer")
            counts[name] = F.sum(name)
    # what is known of a table is one row; a statement's tables meet it once
    met = used.join(facts, "table_name").groupBy("stmt_id").agg(*[c.alias(n) for n, c in counts.items() if c is not None])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if counts[c] is not None else F.lit(0)
    out = statements.join(met, "stmt_id", "left").select(*statements.columns, *[zero(n).alias(n) for n in counts])
    out = out.withColumn("op", lex.operation(F.col("sql")))
    op, sql = F.col("op"), F.col("sql")
    out = out.withColumns({"breaking": listed([(n, t(sql, op)) for n, t in BREAKING]), "non_breaking": listed([("add_column", (op == "ALTER") & sql.rlike(r"(?i)ADD\s+COLUMN"))]), "risks": found_risks(sql, op), "factor": size_factor(F.col("max_rows"))})
    of = lambda severity: F.size(F.filter("risks", lambda r: r["severity"] == severity))
    out = out.withColumn("score", risk_score(F.size("breaking"), F.col("n_cascade"), F.col("n_deps"), of("critical"), of("high"), F.col("n_docs"), F.col("factor")))
    return out.withColumn("level", risk_level(F.col("score"))).withColumn("suggestions", suggestions(F.col("breaking"), F.col("risks"), F.col("n_deps"), F.col("score"))).drop("op")


def rollback(sql: Column, known_type: Column | None = None, create_sql: Column | None = None) -> Column:
    """(sql, safety) that undoes a statement. known_type: a dropped column's type; create_sql: how the catalog made a table."""
    name = r"[`\"]?([\w.]+)[`\"]?"
    table = F.regexp_extract(sql, rf"(?i)ALTER\s+TABLE\s+{name}", 1)
    get = lambda p, k=1: F.nullif(F.regexp_extract(sql, "(?i)" + p, k), F.lit(""))
    dropped, added = get(rf"DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?{name}"), get(rf"ADD\s+COLUMN\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}")
    old, new = get(rf"RENAME\s+COLUMN\s+{name}\s+TO\s+{name}"), get(rf"RENAME\s+COLUMN\s+{name}\s+TO\s+{name}", 2)
    moved = get(rf"RENAME\s+(?:TABLE\s+)?{name}\s+TO\s+{name}")
    index = get(rf"CREATE\s+(?:UNIQUE\s+)?INDEX\s+{name}")
    row = lambda s, safety: F.struct(s.alias("sql"), (safety if isinstance(safety, Column) else F.lit(safety)).alias("safety"))
    alter = F.concat(F.lit("ALTER TABLE "), table)
    kind = known_type if known_type is not None else F.lit(None).cast("string")
    made = create_sql if create_sql is not None else F.lit(None).cast("string")
    op = lex.operation(sql)
    return (
        F.when((op == "DROP"), row(F.coalesce(made, F.lit("-- take a backup first")), F.when(made.isNotNull(), "manual_review").otherwise("destructive")))
        .when(dropped.isNotNull(), row(F.concat(alter, F.lit(" ADD COLUMN "), dropped, F.lit(" "), F.coalesce(kind, F.lit("TEXT")), F.lit(";")), F.when(kind.isNotNull(), "safe").otherwise("manual_review")))
        .when(added.isNotNull(), row(F.concat(alter, F.lit(" DROP COLUMN "), added, F.lit(";")), "safe"))
        .when(old.isNotNull(), row(F.concat(alter, F.lit(" RENAME COLUMN "), new, F.lit(" TO "), old, F.lit(";")), "safe"))
        .when(moved.isNotNull() & (op != "ALTER"), row(F.concat(F.lit("RENAME TABLE "), get(rf"RENAME\s+(?:TABLE\s+)?{name}\s+TO\s+{name}", 2), F.lit(" TO "), moved, F.lit(";")), "safe"))
        .when(index.isNotNull(), row(F.concat(F.lit("DROP INDEX "), index, F.lit(";")), "safe"))
        .when(op.isin("DELETE", "TRUNCATE"), row(F.lit("-- take a backup first"), "destructive"))
    )


def dependency_scan(lines: DataFrame, terms: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """term, path, line_no, usage, severity: the first line of each file that has a term (rows: term) as a word or words; terms
    without any ASCII letter, digit or underscore are looked for anywhere in a line. index: one built from the lines before."""
    if index is None:
        hits = textindex.scan(lines, terms)
    else:
        hits = textindex.find(index, terms)
    first = hits.groupBy("term", "path").agg(F.min(F.struct("line_no", "line")).alias("x"))
    return first.select("term", "path", "x.line_no", F.substring(F.trim("x.line"), 1, 120).alias("usage"), dependency_severity(F.col("x.line")).alias("severity"))


def dependencies_of(tables: DataFrame, lines: DataFrame, most: int | None = 50) -> DataFrame:
    """table_name, path, line_no, usage, severity of tables' names and class names in code; at most so many, by path and line."""
    terms = tables.select("table_name", F.explode(F.array_distinct(F.array("table_name", names.model_name(F.col("table_name"))))).alias("term")).distinct()
    found = dependency_scan(lines, terms.select("term")).join(terms, "term").select("table_name", "path", "line_no", "usage", "severity").distinct()
    return found if most is None else found.orderBy("path", "line_no", "table_name").limit(most)


def batches(candidates: DataFrame, order: list[str], size: int = 20) -> DataFrame:
    """candidates with batch, from 0: so many a batch, in order. Each part of a range partitioning numbers its own rows, and the parts'
    sizes, of which there are as many as parts, give the offsets; no task sorts all rows."""
    dealt = cut(candidates.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    before, offsets = 0, []
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    known = dealt.sparkSession.createDataFrame(offsets, "__part long, __before long")
    both = dealt.withColumn("__part", part).join(F.broadcast(known), "__part")
    place = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return both.select(*candidates.columns, F.floor(place / size).cast("int").alias("batch"))


def terms_of(tables: DataFrame) -> DataFrame:
    """term: table names and the class names derived from them."""
    return tables.select(F.explode(F.array("table_name", names.model_name(F.col("table_name")))).alias("term")).distinct()


def doc_drift(docs: DataFrame, terms: list[str]) -> DataFrame:
    """path, term of documents (path, text) that lack a term; ``terms`` are those of one statement."""
    lacking = F.filter(F.array(*map(F.lit, terms)), lambda t: ~F.contains(F.lower("text"), F.lower(t)))
    return docs.select("path", F.explode(lacking).alias("term"))


#: Dimensions of confidence, in their order.
DIMENSIONS = ["schema_impact", "app_dependencies", "data_risks", "doc_drift"]


def lowest_confidence(frame: DataFrame) -> DataFrame:
    """stmt_id, dimension, score, reason of the lowest score of each statement (rows stmt_id, dimension, score, reason), the first
    of equal ones in the order of DIMENSIONS; other dimensions aside."""
    at = F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("dimension"))
    one = frame.where(at > 0).groupBy("stmt_id").agg(F.min(F.struct("score", at.alias("at"), "dimension", "reason")).alias("x"))
    return one.select("stmt_id", "x.dimension", "x.score", "x.reason")


def confidence_line(label: Column, score: Column, reason: Column) -> Column:
    """A bar of ten cells, the percentage and the reason's first 55 letters."""
    pct = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5).cast("int")))
    cells = F.floor(pct / 10 + 0.5).cast("int")
    return F.concat(F.rpad(label, 18, " "), F.repeat(F.lit("#"), cells), F.repeat(F.lit("."), 10 - cells), F.lit("  "), F.lpad(pct.cast("string"), 3, " "), F.lit("%  "), F.substring(reason, 1, 55))


def hover_text(score: Column, level: Column, found: Column, hints: Column, undo: Column | None = None, confidence: Column | None = None) -> Column:
    """A short report: a bar of ten cells, up to three risks and two suggestions, and of an array of (sql, safety) up to two ways
    back, their first lines; confidence: lines put below."""
    bar = F.concat(F.repeat(F.lit("#"), score), F.repeat(F.lit("."), F.lit(10) - score))
    listed_ = lambda xs, n, f: F.nullif(F.array_join(F.transform(F.slice(xs, 1, n), f), "\n"), F.lit(""))
    parts = [F.concat(F.lit("risk "), score, F.lit("/10 ["), bar, F.lit("] "), level), listed_(found, 3, lambda r: F.concat(F.lit("- "), r["severity"], F.lit(": "), r["risk"])), listed_(hints, 2, lambda s: F.concat(F.lit("* "), s))]
    if undo is not None:
        parts.append(listed_(undo, 2, lambda r: F.concat(F.lit("back ("), r["safety"], F.lit("): "), F.substring(F.element_at(F.split(r["sql"], "\n"), 1), 1, 90))))
    return F.concat_ws("\n", *parts, *([confidence] if confidence is not None else []))
