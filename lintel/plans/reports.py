"""Reports as frames of rows, and their HTML: impact, merge, duplicates, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lex

#: Dependencies and files that a report lists, conflicts from which on it warns. Fixed values.
MOST_DEPENDENCIES, MOST_FILES, MANY_CONFLICTS = 20, 5, 5


def impact(done: DataFrame, dependencies: DataFrame) -> DataFrame:
    """stmt_id, section, pos, text: score, breaking changes, risks, suggestions and the first dependencies of analyzed statements
    (impact.analyze), dependencies being (stmt_id, path, line_no, severity)."""
    texts = lambda name, xs: done.select("stmt_id", F.lit(name).alias("section"), F.posexplode(xs).alias("pos", "text"))
    score = done.select("stmt_id", F.lit("score").alias("section"), F.lit(0).alias("pos"), F.concat(F.col("score").cast("string"), F.lit("/10 "), "level").alias("text"))
    named = dependencies.select("stmt_id", F.struct("path", "line_no", F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(" "), "severity").alias("text")).alias("x"))
    listed = named.groupBy("stmt_id").agg(F.slice(F.sort_array(F.collect_set("x")), 1, MOST_DEPENDENCIES).alias("xs"))
    deps = listed.select("stmt_id", F.lit("dependencies").alias("section"), F.posexplode(F.transform("xs", lambda x: x["text"])).alias("pos", "text"))
    risks = texts("risks", F.transform("risks", lambda r: F.concat(r["severity"], F.lit(": "), r["risk"])))
    return score.unionByName(texts("breaking", F.col("breaking"))).unionByName(risks).unionByName(texts("suggestions", F.col("suggestions"))).unionByName(deps)


def merge(conflicts: DataFrame) -> DataFrame:
    """conflict_type, n, badge of the conflicts of a merge; the badge is of all together."""
    n = conflicts.groupBy("conflict_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row for each type
    return n.select("conflict_type", "n", F.when(total > MANY_CONFLICTS, "high").otherwise("medium").alias("badge"))


def overview(findings: DataFrame, keys: list[str], sets: list[list[str]], kinds: list[str], times: str | None = None) -> DataFrame:
    """keys, level, n, errors, warnings, infos and a column for each kind (a part of the code), of findings with code and severity:
    totals of every set of keys, in one pass. level names the set's keys, or says all. A finding counts once, or as often as its
    column ``times`` says. Equal findings are counted together before the sets multiply them."""
    each = findings.groupBy(*dict.fromkeys([*keys, "code", "severity"])).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("__n"))
    count = lambda hit: F.sum(F.when(hit, F.col("__n")).otherwise(0))
    severities = [count(F.col("severity") == x).alias(f"{x}s") for x in ("error", "warning", "info")]
    of_kinds = [count(F.col("code").contains(f"-{k}")).alias(k.lower()) for k in kinds]
    # the grouping column itself is null in totals, so what is counted reads a copy
    rows = each.withColumns({f"__{k}": F.col(k) for k in keys})
    grouped = rows.groupingSets([[F.col(f"__{k}") for k in s] for s in sets], *[F.col(f"__{k}") for k in keys])
    mark = F.concat(*[F.grouping(f"__{k}").cast("string") for k in keys])
    level = F.lit(None).cast("string")
    for s in sets:
        level = F.when(F.col("mark") == "".join("0" if k in s else "1" for k in keys), " and ".join(s) or "all").otherwise(level)
    out = grouped.agg(mark.alias("mark"), F.sum("__n").alias("n"), *severities, *of_kinds)
    return out.select(*[F.col(f"__{k}").alias(k) for k in keys], level.alias("level"), "n", "errors", "warnings", "infos", *[k.lower() for k in kinds])


def duplicates(groups: DataFrame) -> DataFrame:
    """schema_id, meaning, level (group, schema, all), groups, columns, most_tables, badge of groups of columns with one meaning
    (dupes.synonym_groups), with totals."""
    each = groups.groupBy("schema_id", "meaning").agg(F.count(F.lit(1)).alias("columns"), F.countDistinct("table_name").alias("tables"))
    cols = [F.col("schema_id"), F.col("meaning")]
    out = each.groupingSets([[], cols[:1], cols], *cols).agg((F.grouping("schema_id") + F.grouping("meaning")).alias("mark"), F.count(F.lit(1)).alias("groups"), F.sum("columns").alias("columns"), F.max("tables").alias("most_tables"))
    level = F.when(F.col("mark") == 2, "all").when(F.col("mark") == 1, "schema").otherwise("group")
    return out.select("schema_id", "meaning", level.alias("level"), "groups", "columns", "most_tables", F.when(F.col("most_tables") > 1, "high").otherwise("medium").alias("badge"))


def cell(value: Column) -> Column:
    return F.concat(F.lit("<td>"), lex.html_escape(F.coalesce(value.cast("string"), F.lit(""))), F.lit("</td>"))


def html_rows(report: DataFrame, columns: list[str]) -> DataFrame:
    """html: a table row of each row of a report, escaped."""
    return report.select(F.concat(F.lit("<tr>"), *[cell(F.col(c)) for c in columns], F.lit("</tr>")).alias("html"))
