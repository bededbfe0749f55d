"""Masks by few tokens, and patterns asked only where their word is there."""

import random
import re

from pyspark.sql import functions as F

from lintel.functions import lex
from lintel.functions.lineage import spread
from lintel.operators import rules

#: Tokens as they were cut before: plain text parted at every letter that might begin a string.
PARTED = re.compile(r"--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|[EeNn]?'(?:''|\\[\s\S]?|[^'\\])*+(?:'|\Z)|\"(?:\"\"|[^\"])*+(?:\"|\Z)|`(?:``|[^`])*+(?:`|\Z)|(\$(?:[A-Za-z_]\w*)?\$)[\s\S]*?(?:\1|\Z)|[^-/EeNn'\"`$]+|[\s\S]", re.A)


def masks(text):
    blank = lambda t: re.sub(r"[^\r\n]", " ", t)
    found = [m[0] for m in PARTED.finditer(text)]
    hidden = [bool(re.match(r"--|/\*|[EeNn]?'|\$(?:[A-Za-z_]\w*)?\$", t, re.A)) for t in found]
    return "".join(blank(t) if h or t[0] in '"`' else t for t, h in zip(found, hidden)), "".join(blank(t) if h else t for t, h in zip(found, hidden))


def test_masks_of_odd_texts(spark):
    rng = random.Random(3)
    bits = ["E'", "'", "name", "N", "e", "-", "--", "/", "/*", "*/", "\n", '"', "`", "$", "$$", "$a$", "\\", ";", "SELECT ", " x ", "é", "''", "n'"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(1500)] + ["ne - / " * 40000 + "'x'"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", lex.clause_mask(F.col("t")).alias("c"), lex.parse_mask(F.col("t")).alias("p")).collect()
    assert {r["k"]: (r["c"], r["p"]) for r in rows} == {k: masks(t) for k, t in enumerate(texts)}


def test_plain_text_is_one_token(spark):
    sql = "DELETE FROM events e WHERE e.name - 1 > 2 / n"
    assert spark.range(1).select(F.regexp_extract_all(F.lit(sql), F.lit(lex.TOKEN), F.lit(0)).alias("x")).first()["x"] == [sql]


def test_rules_fire_in_any_case(spark):
    texts = ["drop Table x", "Truncate y", "delete from z", "update z set a = 1", "update z set a = 1 Where b", "select *", "dropped", "Alter table a rename b", "a | b"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    more = [("own", r"\bALTER\b|\bDROPPED\b"), ("own", r"\b(?:ALTER|DROPPED)\b"), ("own", r"\bDROPS?\b"), ("own", r"\bDROP\s*")]
    for _, pattern in [(r[0], r[1]) for r in rules.PATTERN_RULES] + more:
        got = {r["t"] for r in docs.where(rules.fires(F.col("t"), pattern, False)).collect()}
        assert got == {t for t in texts if re.search(pattern, t, re.I | re.A)}


def test_statements_of_a_small_file_are_judged_by_several_tasks(spark):
    """findings_overview and full_diagnostics deal their statements to all cores, and adaptive plans keep them so."""
    from lintel.plans import rich_queries

    found = rich_queries.full_diagnostics(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    docs = spread(spark.range(200).coalesce(1), "id")
    assert docs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
