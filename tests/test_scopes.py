"""Columns of nested queries, resolved by hand."""

import pytest

from lintel.functions import lex
from lintel.operators import scopes

TABLES = {"users": ["id", "name", "org_id"], "orders": ["id", "user_id", "total"], "orgs": ["id", "title"]}

CASES = [
    ("SELECT u.id, u.nope FROM users u", [("users", "nope")]),
    ("SELECT id FROM users WHERE EXISTS (SELECT 1 FROM orders o WHERE o.user_id = users.id AND o.bad = users.worse)", [("orders", "bad"), ("users", "worse")]),
    ("SELECT name FROM users WHERE id IN (SELECT user_id FROM orders WHERE total > 3 AND org_id = 2)", []),  # org_id is the outer one's
    ("SELECT name FROM users WHERE id IN (SELECT user_id FROM orders WHERE title = 2)", [("orders", "title")]),
    ("SELECT x.sum, x.any FROM (SELECT total AS sum, missing FROM orders) x", [("orders", "missing")]),
    ("WITH r(a, b) AS (SELECT id, total FROM orders) SELECT a, b, r.c FROM r JOIN users u ON u.id = r.a WHERE u.b = 1", [("users", "b")]),
    ("WITH r AS (SELECT oops FROM orders) SELECT q FROM r", [("orders", "oops")]),
    ("SELECT a.id, b.title, c.x FROM users AS a JOIN orgs b ON a.org_id = b.id, other c WHERE a.title = 1", [("users", "title")]),
    ("SELECT name n, count(id) cnt FROM users GROUP BY n ORDER BY cnt", []),
    ("UPDATE users SET nme = 'x', name = (SELECT title FROM orgs g WHERE g.id = org_id AND g.foo = 1) WHERE id = 3", [("users", "nme"), ("orgs", "foo")]),
    ("DELETE FROM orders WHERE user_id IN (SELECT id FROM users WHERE total > 1) AND missing = 2", [("orders", "missing")]),
    ("SELECT (SELECT max(o.total) FROM orders o WHERE o.user_id = u.idd) FROM users u WHERE (u.name = 'a' OR (u.id = 2 AND u.z = 1))", [("users", "idd"), ("users", "z")]),
    ("SELECT t.id FROM public.users t WHERE t.\"Name\" = 1 AND t.age IS NULL", [("users", "age")]),
    ("SELECT * FROM unknown_table WHERE whatever = 1", []),
    ("SELECT id FROM users u JOIN (SELECT user_id, count(*) c FROM orders GROUP BY user_id) k ON k.user_id = u.id WHERE k.c > 2 AND u.c = 1", [("users", "c")]),
    ("SELECT 1", []),
    ("SELECT ((id FROM users", []),
]


@pytest.fixture(scope="session")
def found(spark):
    docs = spark.createDataFrame([(k, sql) for k, (sql, _) in enumerate(CASES)], "doc_id long, sql string")
    cat = spark.createDataFrame([(t, c) for t, cs in TABLES.items() for c in cs], "table_name string, column_name string")
    return scopes.unknown_columns(lex.split_statements(docs), cat).collect()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_columns_belong_to_the_innermost_source(found, k):
    mine = sorted((r["table_name"], r["column_name"]) for r in found if r["doc_id"] == k)
    assert mine == sorted(CASES[k][1])
    for r in found:
        sql = CASES[r["doc_id"]][0]
        assert sql[r["start_offset"] : r["end_offset"]].lower() == r["column_name"]


def test_tokens_become_no_rows(spark):
    """A statement is read where it stands: no windows, and no shuffle but of what the joins leave and of the catalog."""
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('SELECT u.id, u.c', id, ' FROM users u WHERE EXISTS (SELECT 1 FROM orders o WHERE o.id = u.id AND bad = 1)') AS sql")
    cat = spark.createDataFrame([(t, c) for t, cs in TABLES.items() for c in cs], "table_name string, column_name string")
    found = scopes.unknown_columns(lex.split_statements(docs), cat)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan
    got = {(r["doc_id"], r["table_name"], r["column_name"]) for r in found.collect()}
    assert got == {(k, "users", f"c{k}") for k in range(40)} | {(k, "orders", "bad") for k in range(40)}


def test_unbalanced_and_long_statements(spark):
    """Parentheses that close nothing or stay open; a list of many values and a select list of many names."""
    many = ", ".join(f"c{k}" for k in range(3000))
    docs = spark.createDataFrame([(0, "SELECT a) FROM users u) JOIN orders o ON u.id = o.id, orgs g WHERE g.b = 1"), (1, "SELECT id FROM users WHERE id IN (SELECT user_id FROM orders WHERE x = (SELECT 1"), (2, f"SELECT {many} FROM users"), (3, f"DELETE FROM users WHERE y IN ({', '.join(map(str, range(20000)))})")], "doc_id long, sql string")
    cat = spark.createDataFrame([(t, c) for t, cs in TABLES.items() for c in cs], "table_name string, column_name string")
    got = sorted((r["doc_id"], r["table_name"], r["column_name"]) for r in scopes.unknown_columns(lex.split_statements(docs), cat).collect())
    assert (0, "orgs", "b") in got
    assert (1, "orders", "x") in got and (3, "users", "y") in got and sum(k == 2 for k, _, _ in got) == 3000
