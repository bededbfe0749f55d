"""Names in nested queries: tokens read in order with a stack of scopes, and columns resolved to the innermost FROM.

Every subquery is a scope, the statement itself the outermost one. A scope's sources are the tables, derived tables and CTEs of its
FROM, JOIN, UPDATE and INTO, with their aliases. A qualified column belongs to the source of that name or alias in the innermost
scope that has one; a bare one to any source of its scope or of those around it. It is unknown if that source is a table of the
catalog without it, or, when bare, if all sources are tables of the catalog and none has it. Derived tables and CTEs (those with a
list of columns too) tell nothing about their columns, so nothing is said about columns that may be theirs.

A statement's tokens are read in their order where the statement stands, in batches of rows; they become no rows. Only the columns it
uses leave it, each with the tables that it may belong to, to meet the catalog by a semi and an anti join.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lex

#: Words that part a query, and words that are no columns. Fixed values.
FROM_LIKE = ("FROM", "JOIN", "UPDATE", "INTO")
CLAUSES = (*FROM_LIKE, "SELECT", "ON", "USING", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "SET", "VALUES", "UNION", "INTERSECT", "EXCEPT", "RETURNING", "WINDOW")
OTHER = ("AS", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "BETWEEN", "EXISTS", "CASE", "WHEN", "THEN", "ELSE", "END", "DISTINCT", "ALL", "ANY", "ASC", "DESC", "BY", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "LATERAL", "WITH", "RECURSIVE", "DELETE", "INSERT", "TRUE", "FALSE", "INTERVAL", "CURRENT_DATE", "CURRENT_TIMESTAMP", "OVER", "PARTITION", "ONLY", "IGNORE", "NULLS", "FIRST", "LAST", "ESCAPE", "COLLATE", "CAST")
#: Words of a FROM that are no part of a source.
BESIDE = (*FROM_LIKE, "LATERAL", "ONLY", "LEFT", "RIGHT", "INNER", "FULL", "OUTER", "CROSS", "NATURAL")
_TOKEN = re.compile(r"""(?:"[^"]*")|`[^`]*`|\[[^\]]*\]|[A-Za-z_]\w*|\d[\w.]*|\S""", re.A)
_NAME = re.compile(r"""[A-Za-z_"`\[]""")
_BEFORE = re.compile(r"""["`\[A-Z_0-9]|\)\Z""")
_SOURCE = re.compile(r"(?:\S+ \. )*(\S+)", re.A)
_ALIAS = re.compile(r"(?:\S+ \. )*\S+(?: (?i:AS))? ([A-Za-z_\"`\[]\S*)", re.A)
_DERIVED = re.compile(r"\)(?: (?i:AS))? (\S+)", re.A)
_PARTS, _NO_COLUMNS = frozenset(CLAUSES), frozenset(CLAUSES + OTHER)
KEY = ["doc_id", "stmt_idx"]
#: Statements of one text are read once while they are among the last so many of a task.
CACHED = 2_000


def plain(token: str) -> str:
    token = token[1:] if token[:1] in ('"', "`", "[") else token
    return (token[:-1] if token[-1:] in ('"', "`", "]") else token).lower()


@dataclass
class Scope:
    """A subquery by the place of its parenthesis (-1: the statement): its depth, the last word of CLAUSES, first as it stands and then
    as it counts (after a comma behind an ON, FROM again), and the source being read. around: the scopes that a name in it may come
    from, itself last; not those outside a derived table or CTE."""

    place: int
    around: tuple[int, ...]
    base: int
    first: str | None = None
    clause: str | None = None
    text: list[str] = field(default_factory=list)


def source(text: str, ctes: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(name, alias) of what a FROM reads; name is None for derived tables and CTEs."""
    name = plain(_SOURCE.match(text)[1]) if _NAME.match(text) else None
    m = _DERIVED.search(text) if text.startswith("(") else _ALIAS.match(text)
    return (None if name in ctes else name), plain(m[1]) if m else name


@lru_cache(CACHED)
def uses(mask: str, ctes: tuple[str, ...]) -> list[tuple[int, str, str, tuple[str, ...]]]:
    """(at, column, own, names) of the columns that a statement uses: own is the source that the column belongs to, or the nearest
    that it may belong to; names are all of those. What may come from a derived table or CTE is left out."""
    found = [(m.start(), m[0]) for m in _TOKEN.finditer(mask)]
    words = [t.upper() for _, t in found]
    depth = low = 0
    for w in words:
        depth += (w == "(") - (w == ")")
        low = min(low, depth)
    depth, here, outer = 0, Scope(-1, (-1,), low), []
    reads: dict[int, list] = defaultdict(list)
    used: list[tuple[tuple[int, ...], int, str, str | None]] = []

    def end(scope: Scope) -> None:
        if scope.text:
            reads[scope.place].append(source(" ".join(scope.text), ctes))
            scope.text = []

    for i, ((at, token), word) in enumerate(zip(found, words)):
        if token == ")" and outer and depth == here.base:
            end(here)
            here = outer.pop()
        depth += (token == "(") - (token == ")")
        if word in _PARTS:
            here.first = here.clause = word
        elif token == "," and here.first in ("ON", "USING") and depth == here.base:
            here.clause = "FROM"
        from_ = here.clause in FROM_LIKE
        if word in FROM_LIKE or (token == "," and from_):
            end(here)
        elif from_ and token != "," and word not in BESIDE:
            here.text.append(token)
        elif here.clause and not from_ and _NAME.match(token) and word not in _NO_COLUMNS and words[i + 1 : i + 2] not in (["("], ["."]):
            last = words[i - 1]
            # a name after another name, a number or a parenthesis is an alias
            after = last == "AS" or (_BEFORE.match(last) and last not in _NO_COLUMNS)
            if last == ".":
                used.append((here.around, at, plain(token), plain(found[i - 2][1])))
            elif not after and here.clause in ("SELECT", "WHERE", "ON", "SET"):
                used.append((here.around, at, plain(token), None))
        if token == "(" and words[i + 1 : i + 2] in (["SELECT"], ["WITH"]):
            outer.append(here)
            here = Scope(i, (i,) if not here.clause or from_ else (*here.around, i), depth)
    for scope in (*outer, here):
        end(scope)
    out = []
    for around, at, column, qualifier in used:
        met = [name for k in reversed(around) for name, alias in reads[k] if qualifier is None or qualifier in (name, alias)]
        met = met[:1] if qualifier is not None else met
        if met and None not in met:
            out.append((at, column, met[0], tuple(dict.fromkeys(met))))
    return out


def references(statements: DataFrame) -> DataFrame:
    """doc_id, stmt_idx, start_offset, at, column_name, own, k, name: the uses of columns, a row for each of their k names."""
    rows = statements.select(*KEY, "start_offset", "parse_mask", lex.cte_names(F.col("parse_mask")).alias("ctes"))
    more = {"at": T.IntegerType(), "column_name": T.StringType(), "own": T.StringType(), "k": T.IntegerType(), "name": T.StringType()}
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def batch(batches):
        for b in batches:
            masks, ctes = b.column(3).to_pylist(), b.column(4).to_pylist()
            listed = [(r, at, c, own, len(names), n) for r, (m, k) in enumerate(zip(masks, ctes)) for at, c, own, names in uses(m, tuple(k)) for n in names]
            r, *cols = zip(*listed) if listed else [()] * 6
            held = [b.column(k).take(pa.array(r, pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*KEY, "start_offset", *more])

    return rows.mapInArrow(batch, T.StructType([*rows.select(*KEY, "start_offset").schema, *(T.StructField(n, t) for n, t in more.items())]))


def unknown_columns(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, stmt_idx, table_name, column_name, start_offset, end_offset of every use of a column that its table hasn't.

    A use is unknown if all its tables are in the catalog and none has it; what the joins leave of its tables is counted.
    """
    checked = statements.where(lex.first_keyword(F.col("clause_mask")).isin("SELECT", "WITH", "UPDATE", "DELETE", "INSERT"))
    there = columns.select(F.lower("table_name").alias("name"), F.lower("column_name").alias("column_name")).distinct()
    lost = references(checked).join(there.select("name").distinct(), "name", "left_semi").join(there, ["name", "column_name"], "left_anti")
    found = lost.groupBy(*KEY, "start_offset", "at", "column_name", "own", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k")
    start = (F.col("start_offset") + F.col("at")).cast("int")
    return found.select(*KEY, F.col("own").alias("table_name"), "column_name", start.alias("start_offset"), (start + F.length("column_name")).cast("int").alias("end_offset"))
