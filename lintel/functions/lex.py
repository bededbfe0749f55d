"""SQL text to columns and relations, as native expressions only: masks, statements, tables, columns, embedded SQL."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of SQL text: comments, strings, quoted names, dollar-quoted bodies, runs of plain characters, single characters.
TOKEN = (
    r"--[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[EeNn]?'(?:''|\\[\s\S]?|[^'\\])*+(?:'|\z)|\"(?:\"\"|[^\"])*+(?:\"|\z)"
    r"|`(?:``|[^`])*+(?:`|\z)|(\$(?:[A-Za-z_]\w*)?\$)[\s\S]*?(?:\1|\z)|(?:[^-/EeNn'\"`$]++|[EeNn](?!')|-(?!-)|/(?!\*))++|[\s\S]"
)
#: Statement verbs; words that are never tables; words that are never columns. Fixed values.
OPERATIONS = ["SELECT", "INSERT", "UPDATE", "DELETE", "ALTER", "DROP", "CREATE", "TRUNCATE"]
DESTRUCTIVE = ["DELETE", "DROP", "TRUNCATE", "ALTER"]
NOT_TABLES = (
    "select from where and or not in is null join left right inner outer full cross on group by order having limit offset "
    "union all insert into values update set delete truncate create alter drop table index view database primary key foreign "
    "references constraint unique default auto_increment serial cascade"
).split()
NOT_COLUMNS = (
    "select from where and or not in is null true false join left right inner outer full cross on using group by order having "
    "limit offset union all except intersect insert into values update set delete truncate create alter drop table index view "
    "database schema primary key foreign references constraint unique check default auto_increment serial cascade with as case "
    "when then else end between like ilike exists any some distinct top over partition row_number rank dense_rank count sum avg "
    "min max coalesce nullif cast convert"
).split()

_NAME = r"([`\"]?[\w$]+[`\"]?(?:\s*\.\s*[`\"]?[\w$]+[`\"]?)?)"


def _blank(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\r\n]", " ")


def _masks(text: Column) -> Column:
    """(clause, parse) masks in one pass over the tokens; text without quotes or comments is its own mask."""
    hidden = r"^(?:--|/\*|[EeNn]?'|\$(?:[A-Za-z_]\w*)?\$)"
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    masked = F.transform(tokens, lambda t: F.when(t.rlike(hidden), F.struct(_blank(t).alias("c"), _blank(t).alias("p"))).when(t.rlike(r'^["`]'), F.struct(_blank(t).alias("c"), t.alias("p"))).otherwise(F.struct(t.alias("c"), t.alias("p"))))
    both = F.transform(F.array(masked), lambda m: F.struct(F.array_join(m["c"], "").alias("clause"), F.array_join(m["p"], "").alias("parse")))  # an array of one, so that tokens are cut once
    return F.when(text.rlike(r"['\"`$]|--|/\*"), both[0]).otherwise(F.struct(text.alias("clause"), text.alias("parse")))


def clause_mask(text: Column) -> Column:
    """Text of equal length whose comments, strings and quoted names are blank."""
    return _masks(text)["clause"]


def parse_mask(text: Column) -> Column:
    """Text of equal length whose comments and strings are blank."""
    return _masks(text)["parse"]


def statement_ends(mask: Column) -> Column:
    """Positions (from 0) of the semicolons at parenthesis depth 0; depth never falls below 0.

    Only parentheses and semicolons are folded over; the gaps between them tell where they stand.
    """
    marks, gaps = F.regexp_extract_all(mask, F.lit("[();]"), F.lit(0)), F.split(mask, "[();]", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(s, m):
        c, at = m["c"], s["at"] + F.length(m["gap"])
        ends = F.when((c == ";") & (s["depth"] == 0), F.concat(s["ends"], F.array(at))).otherwise(s["ends"])
        depth = F.when(c == "(", s["depth"] + 1).when(c == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (at + 1).alias("at"), ends.alias("ends"))

    pairs = F.transform(marks, lambda c, i: F.struct(c.alias("c"), F.element_at(gaps, i + 1).alias("gap")))
    return F.when(F.contains(mask, F.lit(";")), F.aggregate(pairs, start, step, lambda s: s["ends"])).otherwise(F.array().cast("array<int>"))


def split_statements(docs: DataFrame, text: str = "sql", key: str = "doc_id") -> DataFrame:
    """key, stmt_idx, sql, clause_mask, parse_mask, start_offset, end_offset of every statement that isn't blank.

    Statements are numbered within their document's array, so nothing is shuffled.
    """
    masked = docs.select(key, F.col(text).alias("t"), _masks(F.col(text)).alias("m"))
    cut = masked.select(key, "t", "m", F.concat(statement_ends(F.col("m.clause")), F.array(F.length("t"))).alias("ends"))
    span = lambda stop, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at("ends", i) + 1).alias("from"), stop.alias("stop"))
    raw = lambda s: F.substr(F.col("t"), s["from"] + 1, s["stop"] - s["from"])
    spans = F.filter(F.transform("ends", span), lambda s: raw(s).rlike(r"\S"))
    rows = cut.select(key, "t", "m", F.posexplode(spans).alias("stmt_idx", "s")).withColumn("raw", raw(F.col("s")))
    lead, inner = F.length(F.regexp_extract("raw", r"^(\s*)", 1)), F.length(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    rows = rows.withColumn("lead", lead).withColumn("size", inner)
    piece = lambda c: F.substr(F.col(c), F.col("s.from") + F.col("lead") + 1, F.col("size"))
    return rows.select(key, "stmt_idx", piece("t").alias("sql"), piece("m.clause").alias("clause_mask"), piece("m.parse").alias("parse_mask"), (F.col("s.from") + F.col("lead")).alias("start_offset"), F.col("s.stop").alias("end_offset"))


def statement_at(docs: DataFrame, offset: str, text: str = "sql", key: str = "doc_id") -> DataFrame:
    """key, sql: the piece between semicolons that holds an offset (from 0), trimmed; null where it is blank.

    Every semicolon parts, those in strings too; an offset on a semicolon belongs to what stands before it.
    """
    before = F.substr(F.col(text), F.lit(1), F.col(offset))
    number = F.length(before) - F.length(F.replace(before, F.lit(";"), F.lit(""))) + 1
    found = F.regexp_replace(F.element_at(F.split(F.col(text), ";", -1), number), r"^\s+|\s+$", "")
    inside = (F.col(offset) >= 0) & (F.col(offset) <= F.length(text))
    whole = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    return docs.select(key, F.nullif(F.when(inside, found).otherwise(whole), F.lit("")).alias("sql"))


def first_keyword(sql: Column) -> Column:
    return F.upper(F.regexp_extract(sql, r"^\s*(\w+)", 1))


def mentions(text: Column, *words: str) -> Column:
    """Whether any of the words (in upper case) is in a text in whatever case, as a part of a word too: far cheaper than a pattern, so
    asked before one that needs it."""
    return reduce(or_, [F.contains(F.upper(text), F.lit(w)) for w in words])


def has_clause(mask: Column, word: str) -> Column:
    return mentions(mask, word) & mask.rlike(rf"(?i)\b{word}\b")


def operation(sql: Column) -> Column:
    first = F.upper(F.regexp_extract(F.trim(F.regexp_replace(sql, r"\s+", " ")), r"^(\S*)", 1))
    return F.when(first.isin(OPERATIONS), first).otherwise("UNKNOWN")


def is_destructive(sql: Column) -> Column:
    return operation(sql).isin(DESTRUCTIVE)


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def bare(name: Column) -> Column:
    """Last part of a dotted name without quotes."""
    return F.regexp_replace(F.element_at(F.split(name, r"\."), -1), r"[`\"\[\]\s]", "")


def parsed_tables(sql: Column) -> Column:
    """Tables by FROM, JOIN, INTO, UPDATE, TABLE, in this order, then by position; first occurrences."""
    flat = F.trim(F.regexp_replace(sql, r"\s+", " "))
    words = ["FROM", "JOIN", "INTO", "UPDATE", r"TABLE\s+(?:IF\s+EXISTS\s+)?"]
    found = F.concat(*[_found(flat, rf"(?i)\b{w}{'' if w.endswith('?') else chr(92) + 's+'}([`\"]?[\w.]+[`\"]?)") for w in words])
    return F.array_distinct(F.filter(F.transform(found, bare), lambda t: ~F.lower(t).isin(NOT_TABLES)))


def parsed_columns(sql: Column) -> Column:
    """Columns that ADD, DROP or MODIFY name."""
    return F.array_distinct(F.transform(_found(sql, r"(?i)\b(?:ADD|DROP|MODIFY)\s+(?:COLUMN\s+)?([`\"]?\w+[`\"]?)"), bare))


def cte_names(mask: Column) -> Column:
    return F.when(first_keyword(mask) == "WITH", F.transform(_found(mask, r"(?i)([A-Za-z_]\w*)(?:\s*\([^()]*\)\s*|\s+)AS\s*(?:(?:NOT\s+)?MATERIALIZED\s*)?\("), F.lower)).otherwise(F.array().cast("array<string>"))


def statement_tables(mask: Column) -> Column:
    """Lower-cased tables of a statement: FROM/JOIN, INSERT INTO, UPDATE, DELETE FROM, ALTER/DROP/TRUNCATE TABLE."""
    named = lambda words, pattern: F.when(mentions(mask, *words), _found(mask, pattern)).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        named(["FROM", "JOIN"], rf"(?i)\b(?:FROM|JOIN)\s+{_NAME}"),
        named(["INSERT"], rf"(?i)\bINSERT\s+(?:IGNORE\s+|LOW_PRIORITY\s+)?INTO\s+{_NAME}"),
        named(["UPDATE"], rf"(?i)^\s*UPDATE\s+(?:LOW_PRIORITY\s+|DELAYED\s+|QUICK\s+)?{_NAME}"),
        named(["TABLE"], rf"(?i)\b(?:ALTER|DROP|TRUNCATE)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?{_NAME}"),
    )
    return F.array_distinct(F.transform(found, lambda t: F.lower(bare(t))))


def _columns(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda c: F.lower(bare(c))), lambda c: ~c.isin(NOT_COLUMNS) & c.rlike(r"^[a-z_][\w$]*$")))


def where_columns(mask: Column) -> Column:
    """Names left of a comparison after the first WHERE."""
    after = F.regexp_extract(mask, r"(?is)\bWHERE\b(.*)$", 1)
    return _columns(_found(after, r"(?i)\b((?:\w+\.)?[A-Za-z_]\w*)\s*(?:=|<>|!=|<=?|>=?|\bLIKE\b|\bILIKE\b|\bIN\b|\bIS\b|\bBETWEEN\b|\bNOT\b)"))


def select_columns(mask: Column) -> Column:
    """Plain names of a leading SELECT list; qualifiers stripped, functions and stars skipped."""
    listed = F.regexp_extract(mask, r"(?is)^\s*SELECT\s+(?:DISTINCT\s+)?(.*?)\bFROM\b", 1)
    plain = F.regexp_replace(listed, r"\w+\s*\([^()]*\)", "")
    return _columns(F.transform(F.split(plain, ","), lambda c: F.regexp_extract(F.trim(c), r"^((?:\w+\.)?[A-Za-z_]\w*)(?:\s|$)", 1)))


def set_columns(mask: Column) -> Column:
    after = F.regexp_extract(mask, r"(?is)\bSET\b(.*?)(?:\bWHERE\b|$)", 1)
    return _columns(_found(after, r"((?:\w+\.)?[A-Za-z_]\w*)\s*="))


def insert_columns(mask: Column) -> Column:
    return _columns(F.split(F.regexp_extract(mask, rf"(?i)\bINSERT\s+INTO\s+{_NAME}\s*\(([^)]*)\)", 2), r"\s*,\s*"))


def embedded_sql(line: Column) -> Column:
    """The first string on a line that begins with a verb: backticks, then double, then single quotes; ${...} becomes ?."""
    verbs = r"(?:SELECT|INSERT|UPDATE|DELETE|ALTER|DROP|CREATE|TRUNCATE)"
    tries = [F.nullif(F.regexp_extract(line, rf"(?is){q}({space}{verbs}[^{q}]+){q}", 1), F.lit("")) for q, space in (("`", r"\s*"), ('"', ""), ("'", ""))]
    return F.trim(F.regexp_replace(F.coalesce(*tries), r"\$\{[^}]*\}", "?"))


def embedded_near(lines: DataFrame, reach: int = 5) -> DataFrame:
    """path, line_no, sql: the SQL in a string of each line, or else of the lines up to ``reach`` around it; null where none is."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-reach, reach)
    block = lines.withColumn("block", F.array_join(F.collect_list("line").over(w), "\n"))
    return block.select("path", "line_no", F.coalesce(embedded_sql(F.col("line")), embedded_sql(F.col("block"))).alias("sql"))


def json_block(text: Column, array: bool = False) -> Column:
    """JSON in a reply: the fenced block, else from the first brace (or bracket) to the last; null where there is none.

    A reply wrapped as {"last_message": ...} is unwrapped first.
    """
    inner = F.coalesce(F.get_json_object(F.when(text.rlike(r'^\s*\{\s*"'), F.when(F.try_parse_json(text).isNotNull(), text)), "$.last_message"), text)
    fenced = F.nullif(F.regexp_extract(inner, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(inner, r"(?s)(\[.*\])" if array else r"(?s)(\{.*\})", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(fenced, plain), r"^\s+|\s+$", "")


def severity(word: Column) -> Column:
    """low, medium, high or critical, in whatever case; anything else is low."""
    low = F.lower(F.trim(word))
    return F.when(low.isin("low", "medium", "high", "critical"), low).otherwise("low")


def token_estimate(text: Column) -> Column:
    """Tokens of a text, at four characters each."""
    return F.ceil(F.length(text) / 4)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
