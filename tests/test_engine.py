"""Lexer, names, rules, diff, duplicates, impact, replay and model parsers against plain Python and stated results."""

import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lintel.functions import lex, names
from lintel.operators import catalog, diff, dupes, fixes, impact, rules, timeline
from lintel.plans import ddl, driver_queries, orm, reports
from lintel.sources import catalogs, files
from lintel.streaming import stream

SF = "/root/testdata/sf0.001"


def blank(s):
    return "".join(c if c in "\r\n" else " " for c in s)


def plain_mask(t, names_too):
    """Masks by a loop over characters."""
    out, i, n = [], 0, len(t)

    def quoted(q, backslash):
        j = i + 1
        while j < n:
            if backslash and t[j] == "\\":
                j += 2
            elif t[j] == q:
                if t[j + 1 : j + 2] == q:
                    j += 2
                else:
                    return min(j + 1, n)
            else:
                j += 1
        return n

    while i < n:
        if t.startswith("--", i):
            j = t.find("\n", i)
            j, hide = (n if j < 0 else j), True
        elif t.startswith("/*", i):
            j = t.find("*/", i + 2)
            j, hide = (n if j < 0 else j + 2), True
        elif t[i] == "'" or (t[i] in "EeNn" and t[i + 1 : i + 2] == "'"):
            at = i
            i += t[i] != "'"
            j, hide = quoted("'", True), True
            i = at
        elif t[i] in '"`':
            j, hide = quoted(t[i], False), names_too
        else:
            import re

            m = re.compile(r"\$(?:[A-Za-z_]\w*)?\$").match(t, i)
            if m:
                j = t.find(m[0], m.end())
                j, hide = (n if j < 0 else j + len(m[0])), True
            else:
                j, hide = i + 1, False
        out.append(blank(t[i:j]) if hide else t[i:j])
        i = j
    return "".join(out)


def test_masks_and_statements_match_a_loop(spark):
    rng = random.Random(3)
    bits = ["'", '"', "`", "--", "/*", "*/", "$$", "$a$", ";", "(", ")", "\n", "E'", "x", " ", "\\", "SELECT", "-", "/", "$"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, sql string")
    got = {r[0]: r for r in df.select("doc_id", lex.clause_mask(F.col("sql")), lex.parse_mask(F.col("sql"))).collect()}
    for k, t in enumerate(texts):
        assert got[k][1] == plain_mask(t, True), t
        assert got[k][2] == plain_mask(t, False), t
    want = {}
    for k, t in enumerate(texts):
        mask, depth, start, parts = plain_mask(t, True), 0, 0, []
        for i, c in enumerate(mask + ";"):
            if i == len(mask) or (c == ";" and depth == 0):
                if t[start:i].strip():
                    parts.append(t[start:i].strip())
                start = i + 1
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        want[k] = parts
    found = {}
    for r in lex.split_statements(df).orderBy("doc_id", "stmt_idx").collect():
        found.setdefault(r["doc_id"], []).append(r["sql"])
    assert {k: v for k, v in want.items() if v} == found


def test_names(spark):
    row = spark.range(1).select(
        names.normal(F.lit("__Foo--Bar!")), names.model_name(F.lit("categories")), names.model_name(F.lit("statuses")), names.model_name(F.lit("class")),
        names.type_compatibility(F.lit("varchar"), F.lit("text")), names.type_compatibility(F.lit("integer"), F.lit("float")), names.type_compatibility(F.lit("integer"), F.lit("json")), names.type_compatibility(F.lit("uuid"), F.lit("text")),
        names.similarity(F.lit("phone"), F.lit("mobile")) < 0.75, names.similarity(F.lit(""), F.lit("")),
    ).first()
    assert tuple(row) == ("foo_bar", "Category", "Status", "Class", "compatible", "castable", "incompatible", "castable", True, 1.0)


def test_size_factor_and_score(spark):
    sizes = spark.createDataFrame([(5_000_000,), (200_000,), (15_000,), (50,)], "n long").select(impact.size_factor(F.col("n"))).collect()
    assert [r[0] for r in sizes] == [1.5, 1.25, 1.1, 1.0]
    stmts = spark.createDataFrame([(1, "DROP TABLE users"), (2, "ALTER TABLE users DROP COLUMN phone"), (3, "DELETE FROM orders"), (4, "SELECT 1")], "stmt_id long, sql string")
    cols = spark.createDataFrame([("users", "role_id", True, "roles"), ("orders", "user_id", True, "users")], "table_name string, column_name string, is_fk boolean, ref_table string")
    tabs = spark.createDataFrame([("users", 50_000), ("orders", 2_000_000)], "table_name string, row_count long")
    got = {r["stmt_id"]: (r["score"], r["level"]) for r in impact.analyze(stmts, cols, tabs).collect()}
    assert got == {1: (3, "low"), 2: (4, "medium"), 3: (7, "high"), 4: (1, "low")}


def test_replay_reads_nested_and_qualified():
    """Parentheses in comments and defaults, blanks in literals, schemas, lists of tables."""
    rows = lambda sql: [r[1:6] + r[10:] for r in ddl.replay([sql]).rows("s")]
    assert rows("CREATE TABLE t (a INT) ENGINE=InnoDB COMMENT='x (y)'") == [("t", "a", 0, "INT", True, None)]
    got = rows("CREATE TABLE t (a INT DEFAULT (1+(2*3)) NOT NULL, b TEXT DEFAULT 'x  y',\n c TIMESTAMP  DEFAULT now(3), d int default -1)")
    assert [(r[1], r[3], r[5]) for r in got] == [("a", "INT", "(1+(2*3))"), ("b", "TEXT", "'x  y'"), ("c", "TIMESTAMP", "now(3)"), ("d", "INT", "-1")]
    assert [r[:2] for r in rows("CREATE TABLE s1.t (a INT); CREATE TABLE s2.t (b INT)")] == [("s1.t", "a"), ("s2.t", "b")]
    assert [r[:2] for r in rows("CREATE TABLE s1.t (a INT); CREATE TABLE s2.t (b INT); ALTER TABLE s2.t ADD COLUMN z TEXT; DROP TABLE s1.t")] == [("t", "b"), ("t", "z")]
    assert [r[0] for r in rows("CREATE TABLE a (x INT); CREATE TABLE b (x INT); CREATE TABLE c (x INT); DROP TABLE IF EXISTS a, b CASCADE")] == ["c"]


def test_replay_over_files():
    cat = ddl.replay(
        [
            "CREATE TABLE users (id SERIAL PRIMARY KEY, email VARCHAR(255) NOT NULL, created_at TIMESTAMP DEFAULT NOW()); -- c;\n CREATE TABLE t (a INT, b DECIMAL(10,2), UNIQUE (a), CONSTRAINT f FOREIGN KEY (b) REFERENCES users (id));",
            "ALTER TABLE users ADD COLUMN first_name TEXT, ADD COLUMN phone TEXT; CREATE UNIQUE INDEX ux ON users (email);",
            "ALTER TABLE users DROP COLUMN phone; ALTER TABLE users RENAME COLUMN email TO mail; ALTER TABLE t RENAME TO s; ALTER TABLE users ALTER COLUMN first_name TYPE VARCHAR(9) USING x; ALTER TABLE nothing ADD COLUMN z INT; ALTER TABLE s MODIFY COLUMN a BIGINT NOT NULL; DROP TABLE IF EXISTS gone",
        ]
    )
    users, s = cat.find("users"), cat.find("s")
    assert [c.name for c in users.columns.values()] == ["id", "created_at", "first_name", "mail"]
    assert users.columns["created_at"].type == "TIMESTAMP" and users.columns["created_at"].default == "NOW()"
    assert users.columns["id"].pk and not users.columns["id"].nullable and users.columns["first_name"].type == "VARCHAR(9)"
    assert users.indexes["ux"] == (["mail"], True)
    assert s.columns["b"].fk and s.columns["b"].ref_table == "users" and s.columns["a"].type == "BIGINT" and not s.columns["a"].nullable
    assert ddl.statements("a; 'b;' $$c;$$ (d;e); /* ; */ f") == ["a", "'b;' $$c;$$ (d;e)", "f"]


def test_catalog_of_scripts(spark):
    scripts = spark.createDataFrame([("x", "002", "ALTER TABLE t ADD COLUMN b INT"), ("x", "001", "CREATE TABLE t (a INT)")], "schema_id string, order_key string, text string")
    assert [(r["table_name"], r["column_name"], r["ordinal"]) for r in ddl.catalog_of(scripts).orderBy("ordinal").collect()] == [("t", "a", 0), ("t", "b", 1)]


def test_models(spark):
    prisma = 'enum Role { A }\nmodel User {\n id Int @id @default(autoincrement())\n mail String? @map("email") @unique\n role Role\n posts Post[]\n @@map("users")\n}\nmodel Post {\n id Int @id\n authorId Int\n author User @relation(fields: [authorId], references: [id])\n tags String[]\n}\n'
    got = {(r[0], r[1]): r[2:] for r in orm.prisma(prisma)}
    assert got["users", "id"] == ("integer", False, True, False, None, None, "autoincrement()")
    assert got["users", "email"][:2] == ("text", True) and got["users", "role"][0] == "enum(Role)"
    assert got["Post", "authorId"][3:6] == (True, "users", "id") and got["Post", "tags"][0] == "text[]" and ("Post", "author") not in got
    django = "class Category(models.Model):\n    name = models.CharField(max_length=40, null=True)\n    price = models.DecimalField(max_digits=8,\n        decimal_places=2)\n    parent = models.ForeignKey('self', on_delete=models.CASCADE)\n    owner = models.ForeignKey(User, null=True)\n    tags = models.ManyToManyField(Tag)\n"
    got = {r[1]: r for r in orm.django(django, {"User": "auth_user"})}
    assert got["name"][:4] == ("categories", "name", "varchar(40)", True) and got["price"][2] == "decimal(8,2)"
    assert got["parent_id"][6] == "categories" and got["owner_id"][6] == "auth_user" and "tags" not in got
    ts = "@Entity('people')\nexport class Person {\n @PrimaryGeneratedColumn('uuid') id: string;\n @Column({ length: 20 }) name?: string;\n @ManyToOne(() => Team, t => t.people) team: Team;\n @OneToMany(() => Pet, p => p.owner) pets: Pet[];\n @CreateDateColumn() made: Date;\n}\n"
    got = {r[1]: r for r in orm.typeorm(ts)}
    assert got["id"][2:5] == ("uuid", False, True) and got["name"][2:4] == ("character varying(20)", True)
    assert got["teamId"][6] == "teams" and "pets" not in got and got["made"][2] == "timestamp"
    rows = orm.models(spark.createDataFrame([(prisma, "prisma"), (ts, "typeorm")], "text string, kind string")).collect()
    assert {r["table_name"] for r in rows} == {"users", "Post", "people"}


def test_fuzzy_pairs_match_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab_c") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    got = {(r["a"], r["b"]) for r in dupes.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if 1 - edit(a, b) / max(len(a), len(b)) >= 0.75}


def plain_fuzzy_groups(cols):
    """Groups by a loop over all pairs, in order."""
    def sim(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return 1 - row[-1] / max(len(a), len(b))

    groups, seen = [], set()
    for i, (t, c) in enumerate(cols):
        for u, e in cols[i + 1 :]:
            key, s = tuple(sorted((t, c, u, e))), sim(c.lower(), e.lower())
            if key in seen or not 0.75 <= s < 1:
                continue
            seen.add(key)
            own = next((g for g in groups if (t, c) in g), None)
            if own is None:
                groups.append([(t, c), (u, e)])
            else:
                own.append((u, e))
    return groups


def test_fuzzy_groups_match_a_loop(spark):
    rng = random.Random(11)
    cols = sorted({(rng.choice("pqr"), rng.choice(["phone", "phones", "Phone1", "phone2", "mail", "mails", "email", "user_name", "username", "users_name", "total", "totals", "id", "ix"])) for _ in range(40)})
    place = {}
    rows = [("s", t, c, place.setdefault(t, []).append(c) or len(place[t]) - 1, "TEXT") for t, c in cols]
    df = spark.createDataFrame(rows, "schema_id string, table_name string, column_name string, ordinal int, data_type string")
    got = {}
    for r in dupes.fuzzy_groups(df).orderBy("group_no", "member_no").collect():
        got.setdefault(r["group_no"], []).append((r["table_name"], r["column_name"]))
    want = plain_fuzzy_groups(cols)
    assert [got[k] for k in sorted(got)] == want and len(want) > 2
    first = dupes.fuzzy_groups(df).where("group_no = 0 and member_no = 1").first()
    assert first["suggestion"].startswith('give "') and first["reason"].endswith("%)")
    ordered = [(r["n"], r["meaning"]) for r in dupes.duplicate_groups(df).collect()]
    assert [n for n, _ in ordered] == sorted((n for n, _ in ordered), reverse=True) and {"phone", "email"} <= {m for _, m in ordered}
    with pytest.raises(ValueError):
        dupes.fuzzy_pairs(df, "column_name", least=0.5)


def test_table_pairs_match_all_pairs(spark):
    rng = random.Random(4)
    tables = {f"t{i:02d}_{rng.choice(['order', 'orders', 'user'])}": {"id", *rng.sample([f"c{k}" for k in range(9)], rng.randint(1, 7))} for i in range(30)}
    # another schema whose tables have the same names and other columns changes nothing
    rows = [("s", t, c) for t, cs in tables.items() for c in cs] + [("other", t, f"x{i}_{k}") for i, t in enumerate(tables) for k in range(3)]
    df = spark.createDataFrame(rows, "schema_id string, table_name string, column_name string")
    sim = {(r["x"], r["y"]): r["s"] for r in spark.createDataFrame([(a, b) for a in tables for b in tables if a < b], "x string, y string").select("x", "y", names.similarity(F.col("x"), F.col("y")).alias("s")).collect()}
    want = {}
    for (a, b), s in sim.items():
        j = len(tables[a] & tables[b]) / len(tables[a] | tables[b])
        if 0.7 * j + 0.3 * s >= 0.6:
            want[a, b] = round(0.7 * j + 0.3 * s, 9)
    got = dupes.table_pairs(df).collect()
    assert {(r["a"], r["b"]): round(r["combined"], 9) for r in got} == want and want and {r["schema_id"] for r in got} == {"s"}
    assert [r["combined"] for r in got] == sorted((r["combined"] for r in got), reverse=True)


def test_schemas_are_kept_apart(spark):
    cols = "schema_id string, table_name string, column_name string, ordinal int, data_type string, nullable boolean, is_pk boolean, is_fk boolean, ref_table string, ref_column string"
    row = lambda s, t, c, fk=None: (s, t, c, 0, "TEXT", True, False, fk is not None, fk, None)
    df = spark.createDataFrame([row("s1", "u", "email"), row("s1", "u", "email_address"), row("s2", "u", "mail"), row("s2", "v", "mail", "u"), row("s1", "v", "x")], cols)
    ups = {r["schema_id"]: r["up_sql"] for r in dupes.consolidation_sql(dupes.synonym_groups(df)).collect()}
    assert 'COALESCE("email", "email_address")' in ups["s1"] and "COALESCE" not in ups["s2"] and ups["s2"].count("RENAME") == 2
    named = spark.createDataFrame([("V",)], "table_name string")
    assert {(r["schema_id"], r["table_name"]) for r in catalog.pruned(df, named).collect()} == {("s1", "v"), ("s2", "v"), ("s2", "u")}
    one = spark.createDataFrame([("s1", "V")], "schema_id string, table_name string")
    assert {(r["schema_id"], r["table_name"]) for r in catalog.pruned(df, one).collect()} == {("s1", "v")}
    sizes = spark.createDataFrame([("s2", "u", 1200)], "schema_id string, table_name string, row_count long")
    texts = {(r["schema_id"], r["table_name"]): r["text"] for r in catalog.context_text(df, sizes).collect()}
    assert texts["s2", "u"] == "u (1,200 rows): [mail TEXT]" and texts["s1", "u"].startswith("u: [email TEXT")


def test_renames_match_a_loop(spark):
    """Against taking the most alike pair of all that are left, again and again."""
    rng, kinds = random.Random(3), ["INT", "BIGINT", "TEXT", "JSON"]
    word = lambda: "_".join(rng.choice(["user", "users", "mail", "total", "sum", "id", "at"]) for _ in range(rng.randint(1, 2)))
    sides = [{t: {f"{word()}{rng.randint(0, 3)}": (rng.choice(kinds), k) for k in range(6)} for t in "pqr"} for _ in "ab"]
    a, b = (spark.createDataFrame([(t, c, kind, True, pos) for t, cols in side.items() for c, (kind, pos) in cols.items()], "table_name string, column_name string, data_type string, nullable boolean, ordinal int") for side in sides)
    sim = {(r["x"], r["y"]): r["s"] for r in spark.createDataFrame([(x, y) for t in "pqr" for x in sides[0][t] for y in sides[1][t]], "x string, y string").select("x", "y", names.similarity(F.col("x"), F.col("y")).alias("s")).distinct().collect()}
    want = set()
    for t in "pqr":
        left, right = ({c: v for c, v in sides[k][t].items() if c not in sides[1 - k][t]} for k in (0, 1))
        like = lambda x, y: round(0.5 * sim[x, y] + (0.3 if left[x][0] == right[y][0] or {left[x][0], right[y][0]} == {"INT", "BIGINT"} else 0) + 0.2 / (1 + abs(left[x][1] - right[y][1])), 9)  # noqa: B023, E731
        while offers := sorted((-like(x, y), x, y) for x in left for y in right if like(x, y) >= 0.5):
            score, x, y = offers[0]
            want.add((t, x, y, -score))
            del left[x], right[y]
    got = {(r["table_name"], r["column_a"], r["column_b"], r["likeness"]) for r in diff.renamed(a, b).collect()}
    assert got == want and len(want) > 4


def test_expanded_star(spark):
    cols = spark.createDataFrame([("users", "fname", 0), ("users", "lname", 1), ("products", "name", 0)], "table_name string, column_name string, ordinal int")
    star = spark.createDataFrame([("d", 0, "SELECT * FROM users", "SELECT * FROM users", "SELECT * FROM users")], "doc_id string, stmt_idx int, sql string, clause_mask string, parse_mask string")
    assert fixes.expanded_star(star, cols).first()["sql"] == "SELECT fname, lname FROM users"


def test_terms_of_several_words(spark):
    lines = spark.createDataFrame([("a", 1, "see order-items and dbo.users;"), ("a", 2, "UNITED KINGDOM, users"), ("b", 1, "reorder-items dbo.users_x xUnited Kingdom таблица"), ("b", 3, "delete from Order-Items")], "path string, line_no int, line string")
    terms = spark.createDataFrame([(t,) for t in ("order-items", "dbo.users", "United Kingdom", "users", "таблица", "")], "term string")
    got = {(r["term"], r["path"]): (r["line_no"], r["severity"]) for r in impact.dependency_scan(lines, terms).collect()}
    assert got == {("order-items", "a"): (1, "low"), ("order-items", "b"): (3, "critical"), ("dbo.users", "a"): (1, "low"), ("users", "a"): (1, "low"), ("United Kingdom", "a"): (2, "low"), ("таблица", "b"): (1, "low")}
    tables = spark.createDataFrame([("users",), ("order-items",)], "table_name string")
    deps = impact.dependencies_of(tables, lines).collect()
    assert [(r["path"], r["line_no"], r["table_name"]) for r in deps] == [("a", 1, "order-items"), ("a", 1, "users"), ("b", 3, "order-items")]
    assert impact.dependencies_of(tables, lines, most=1).count() == 1


def test_rows_win_whole(spark):
    row = lambda *r: spark.createDataFrame([r], "t string, c string, k string, d string")
    assert tuple(catalog.existing_wins(row("t", "c", "INT", None), row("t", "c", "TEXT", "x"), ["t", "c"]).first()) == ("t", "c", "INT", None)
    tables = lambda *r: spark.createDataFrame(r, "table_name string, row_count long")
    cols = lambda *r: spark.createDataFrame(r, "table_name string, column_name string, data_type string")
    idx = lambda *r: spark.createDataFrame(r, "table_name string, index_name string, columns array<string>")
    rules_ = lambda *r: spark.createDataFrame(r, "table_name string, name string, raw string")
    live = {"columns": cols(("a", "x", "INT")), "tables": tables(("a", None), ("b", 7)), "indexes": idx(("a", "i", ["x"])), "constraints": rules_(("a", "c1", "CHECK 1"), ("a", None, "CHECK 2"))}
    code = {"columns": cols(("a", "x", "TEXT"), ("a", "y", "TEXT")), "tables": tables(("a", 5), ("b", 9), ("c", None)), "indexes": idx(("a", "i", ["y"]), ("a", "j", ["y"])), "constraints": rules_(("a", "c1", "CHECK 9"), ("a", "c3", "CHECK 2"), ("a", None, "CHECK 4"), ("b", "c1", "CHECK 1"))}
    got = catalog.live_wins(live, code)
    rows = lambda k: sorted(tuple(map(str, r))[:-1] for r in got[k].collect())
    assert rows("columns") == [("a", "x", "INT"), ("a", "y", "TEXT")] and rows("tables") == [("a", "5"), ("b", "7"), ("c", "None")]
    assert rows("indexes") == [("a", "i", "['x']"), ("a", "j", "['y']")]
    assert rows("constraints") == [("a", "None", "CHECK 2"), ("a", "None", "CHECK 4"), ("a", "c1", "CHECK 1"), ("b", "c1", "CHECK 1")]
    both = catalog.pruned_live(cols(("a", "x", "INT")), cols(("a", "z", "TEXT"), ("b", "w", "TEXT"), ("c", "v", "TEXT")), spark.createDataFrame([("a",), ("b",)], "table_name string"))
    assert sorted(tuple(r) for r in both.collect()) == [("a", "x", "INT"), ("b", "w", "TEXT")]


def test_state_history_and_reports(spark, tmp_path):
    schema = "table_name string, column_name string, ordinal int, data_type string, nullable boolean"
    old, new = spark.createDataFrame([("t", "a", 0, "INT", True)], schema), spark.createDataFrame([("t", "a", 0, "INT", True), ("t", "b", 1, "INT", True), ("u", "a", 0, "INT", True)], schema)
    history = spark.createDataFrame([("s", k, 1) for k in range(60)], "schema_id string, k int, change_count long").select("schema_id", F.timestamp_seconds("k").alias("snapshot_ts"), "change_count", F.lit(None).cast("array<struct<table_name:string,column_name:string,ordinal:int,data_type:string,nullable:boolean>>").alias("columns"))
    kept = timeline.updated(history, old, new, "s", "2024-01-01 00:00:00")
    rows = timeline.report(kept).collect()
    assert len(rows) == 50 and (rows[0]["change_count"], rows[0]["tables"], rows[0]["badge"]) == (2, 1, "medium")
    files.save_state(new.withColumn("schema_id", F.lit("s")), kept, str(tmp_path / "state"))
    columns, again = files.load_state(spark, str(tmp_path / "state"))
    r = catalog.summary(columns, again).first()
    assert (r["tables"], r["columns"], str(r["last_updated"])) == (2, 3, "2024-01-01 00:00:00")
    done = impact.analyze(spark.createDataFrame([(1, "DELETE FROM t")], "stmt_id long, sql string"), spark.createDataFrame([], "table_name string, column_name string, is_fk boolean, ref_table string"), spark.createDataFrame([("t", 2_000_000)], "table_name string, row_count long"))
    deps = spark.createDataFrame([(1, f"f{k:02d}", k, "low") for k in range(30)], "stmt_id long, path string, line_no long, severity string")
    found = reports.impact(done, deps).collect()
    assert sum(x["section"] == "dependencies" for x in found) == 20 and {x["text"] for x in found if x["section"] == "risks"} == {"critical: delete_without_where"}
    line = done.select(impact.hover_text(F.col("score"), F.col("level"), F.col("risks"), F.col("suggestions"), F.array(impact.rollback(F.col("sql"))), impact.confidence_line(F.lit("Overall"), F.lit(84.6), F.lit("r" * 80)))).first()[0].split("\n")
    assert line[0].startswith("risk 6/10 [######....] high") and line[-2] == "back (destructive): -- take a backup first" and line[-1] == "Overall".ljust(18) + "#########.   85%  " + "r" * 55


def test_live_catalogs(spark, monkeypatch, caplog):
    """Catalog views as a driver gives them, of both kinds; and stored ones where there is no database."""
    frames = {
        "columns": spark.createDataFrame([("t", "id", 1, "int", "NO", None), ("t", "u", 2, "int", "YES", "7")], "table_name string, column_name string, ordinal int, data_type string, is_nullable string, column_default string"),
        "keys": spark.createDataFrame([("PRIMARY KEY", "t", "id", None, None), ("FOREIGN KEY", "t", "u", "users", "id"), ("FOREIGN KEY", "t", "u", "users", "id")], "constraint_type string, table_name string, column_name string, ref_table string, ref_column string"),
        "rows": spark.createDataFrame([("t", 5)], "table_name string, row_count long"),
    }
    asked = []

    def jdbc(_, url, query, options):
        asked.append(query)
        return next(f for k, f in frames.items() if query in (catalogs.POSTGRES[k].format(schema="x''y"), catalogs.MYSQL[k].format(schema="x''y")))

    with monkeypatch.context() as m:
        m.setattr(catalogs, "_jdbc", jdbc)
        for kind in ("postgresql", "mysql"):
            columns, tables = catalogs.load(spark, kind, "jdbc:x", "x'y")
            got = sorted(tuple(r) for r in columns.select("column_name", "nullable", "is_pk", "is_fk", "ref_table", "default_value").collect())
            assert got == [("id", False, True, False, None, None), ("u", True, False, True, "users", "7")] and tables.first()["row_count"] == 5
    assert len(asked) == 6 and all("x''y" in q for q in asked if "{schema}" in q or "schema" in q)
    stored = (frames["columns"], frames["rows"])
    with caplog.at_level("WARNING", logger="lintel"):
        assert catalogs.load_or(spark, "postgresql", "jdbc:postgresql://u:secret@nowhere/db?password=secret", "s", stored) is stored
    assert "***" in caplog.text and "secret" not in caplog.text
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("lintel_view")
    assert {(r["column_name"], r["data_type"]) for r in catalogs.spark_catalog(spark).where("table_name = 'lintel_view'").collect()} == {("k", "int"), ("v", "string")}


def test_json_blocks(spark):
    texts = ['```json\n{"a": 1}\n```', 'x {"a": {}} y', "[1, {}] tail", '{"last_message": "so [1, 2] it"}', "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [tuple(r) for r in df.select(lex.json_block(F.col("t")), lex.json_block(F.col("t"), array=True)).collect()] == [('{"a": 1}', '{"a": 1}'), ('{"a": {}}', None), ("{}", "[1, {}]"), (None, "[1, 2]"), (None, None)]


CAT_B = "('b','users','id',0,'BIGINT',false,true,false,NULL,NULL),('b','users','mobile',1,'TEXT',true,false,false,NULL,NULL),('b','users','email',2,'TEXT',false,false,false,NULL,NULL),('b','orders','id',0,'INTEGER',false,true,false,NULL,NULL),('b','orders','user_id',1,'TEXT',false,false,true,'users','id'),('b','orders','total',2,'DOUBLE',true,false,false,NULL,NULL),('b','inventory','id',0,'INTEGER',false,true,false,NULL,NULL)"


def test_diff_script_and_enrichment(spark):
    a, b = (driver_queries.rows(spark, x) for x in (driver_queries.A, driver_queries.vals(CAT_B, driver_queries.CAT_COLS)))
    found = diff.conflicts(a, b)
    parts = diff.reconciliation_script(found).orderBy("phase", "table_name").collect()
    script = "\n\n".join(r["script"] for r in parts)
    assert script.count("-- ") == found.count() and "CREATE TABLE IF NOT EXISTS inventory" in script
    r = spark.createDataFrame([("users::mobile::missing_column", 0.9, "rename", "same data", ["a", "b", "c", "d"])], "id string, confidence double, resolution string, reason string, files array<string>")
    text = diff.enriched(found, r).where("column_name = 'mobile'").first()["suggestion"]
    assert text == "[90% confidence, rename] same data Affects 4 file(s): a, b, c..."


def test_change_count_and_sources(spark, tmp_path):
    t = lambda *rows: spark.createDataFrame(rows, "table_name string, column_name string")
    assert timeline.change_count(t(("a", "x"), ("b", "x")), t(("a", "x"), ("a", "y"), ("c", "x"))).first()["changes"] == 3
    for n in ("2_b.sql", "10_c.sql", "1_a.sql"):
        (tmp_path / n).write_text("SELECT 1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.sql").write_text("no")
    got = [os.path.basename(r["path"]) for r in files.sql_scripts(spark, str(tmp_path)).orderBy("order_key").collect()]
    assert got == ["1_a.sql", "2_b.sql", "10_c.sql"]
    (tmp_path / "s.json").write_text('{"tables": {"t": {"columns": {"a": {"name": "a", "type": "int", "isPrimaryKey": true}}}}}')
    r = files.json_schema(spark, str(tmp_path / "s.json"), "j").first()
    assert (r["table_name"], r["column_name"], r["is_pk"], r["nullable"]) == ("t", "a", True, True)
    with pytest.raises(NotImplementedError):
        catalogs.load(spark, "oracle", "", "")


def test_streams_agree_with_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("doc_id"), F.col("ts"), F.when(F.col("event_type") == "error", "DELETE FROM t").otherwise("SELECT a FROM t").alias("sql"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.linted(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("linted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM linted").first()[0] == stream.linted(events).count() > 0
    findings = spark.createDataFrame([("d", "DBS-DESTRUCT-001", 3, 1)] * 2 + [("d", "DBS-PERF-002", 3, 1)], "doc_id string, code string, start_offset int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    findings.write.parquet(str(tmp_path / "f"))
    once = stream.alerts(spark.readStream.schema(findings.schema).parquet(str(tmp_path / "f")), "ts")
    q = once.writeStream.format("memory").queryName("alerts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM alerts").count() == 1


def same(frame):
    """Rows as sorted text: numbers of whatever kind alike, dates without a time."""

    def text(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v).removesuffix(" 00:00:00")

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(driver_queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql("set threads to 4")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = driver_queries.QUERIES[name](spark, SF).toPandas(), con.sql(driver_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and same(got) == same(want) and (len(got) or name == "table_similarity")


def test_rules_guard():
    assert {r[0] for r in rules.PATTERN_RULES} >= set(rules.MODAL)
