"""The inverted index against brute force over lines, in any script."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lintel.operators import impact, textindex


@pytest.fixture(scope="session")
def lines(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    bits = ["日本語", "の", "users", "User_1", "größe", "ß", "c++", "a\\Eb", "€5", ", ", " ", "--", "naïve", "x", "über", "本"]
    odd = [("odd", k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(300)] + [("odd", 301, None), ("odd", 302, ""), ("odd", 303, "   ")]
    return docs.unionByName(spark.createDataFrame(odd, "path string, line_no int, line string"))


TERMS = ["users", "USER_1", "größe", "ß", "日本", "本の", "c++", "the", "the the", "über x", "naïve", "€5", "--", ", ", "a\\Eb", "absent", "not there", "語", "", " ", None, "ion", "á", "日 本"]


def stands(term, line):
    low, at = term.lower(), line.lower()
    if not term.strip():
        return False
    if not re.search("[a-z0-9_]", low):
        return low in at
    return re.search(r"(?<![a-z0-9_])" + re.escape(low) + r"(?![a-z0-9_])", at) is not None


@pytest.mark.parametrize("bound", [textindex.BROADCAST_TERMS, 0])
def test_find_matches_brute_force(spark, lines, monkeypatch, tmp_path, bound):
    """By broadcast and by shuffle; one written index answers several lookups."""
    monkeypatch.setattr(textindex, "BROADCAST_TERMS", bound)
    textindex.build(lines).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    every = [tuple(r) for r in lines.collect()]
    for some in (TERMS, ["the", "von"]):
        terms = spark.createDataFrame([(t,) for t in some], "term string")
        found = textindex.find(index, terms)
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
        want = {(t, p, n) for t in some if t for p, n, line in every if line is not None and stands(t, line)}
        assert {(r["term"], r["path"], r["line_no"]) for r in found.collect()} == want and len(want) > 20


@pytest.mark.parametrize("bound", [textindex.BROADCAST_TERMS, 0])
def test_phrases_match_brute_force(spark, lines, monkeypatch, bound):
    monkeypatch.setattr(textindex, "BROADCAST_TERMS", bound)
    index = textindex.build(lines, keep=False, other=False)
    rng, want = random.Random(1), set()
    rows = [(p, n, re.findall("[a-z0-9_]+", line.lower())) for p, n, line in lines.collect() if line is not None]
    some = {" ".join(w[i : i + k]) for _, _, w in rng.sample(rows, 60) if w for k in (1, 2, 4) for i in [rng.randrange(len(w))]} | {"no such words", "the the"}
    for t in some:
        k = t.split(" ")
        want |= {(t, p, n, i) for p, n, w in rows for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k}
    got = [tuple(r) for r in textindex.phrases(index, spark.createDataFrame([(t,) for t in some], "term string")).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_scan_takes_the_first_line(spark, lines):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = {(r["term"], r["path"]): r["line_no"] for r in impact.dependency_scan(lines, terms).collect()}
    again = {(r["term"], r["path"]): r["line_no"] for r in impact.dependency_scan(lines, terms, textindex.build(lines)).collect()}
    want = {}
    for p, n, line in lines.collect():
        for t in TERMS:
            if t and line is not None and stands(t, line):
                want[t, p] = min(n, want.get((t, p), n))
    assert got == again == want
    assert impact.dependency_scan(lines.limit(0), terms).count() == 0 and impact.dependency_scan(lines, terms.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [textindex.BROADCAST_TERMS, 0])
def test_places_without_an_index(spark, lines, monkeypatch, bound):
    """The same places as by an index, with terms that share words, repeat one, or have a word that no line has; no sort-merge join."""
    monkeypatch.setattr(textindex, "BROADCAST_TERMS", bound)
    rng = random.Random(4)
    rows = [re.findall("[a-z0-9_]+", line.lower()) for _, _, line in lines.collect() if line is not None]
    some = {" ".join(w[i : i + k]) for w in rng.sample(rows, 60) if w for k in (1, 2, 5) for i in [rng.randrange(len(w))]} | {"the absentword", "the the", "", "é"}
    terms = spark.createDataFrame([(t,) for t in some] + [(None,)], "term string")
    found = textindex.places(lines, terms)
    want = textindex.phrases(textindex.build(lines, keep=False, other=False), terms)
    got = [tuple(r) for r in found.collect()]
    assert len(got) > 100 and sorted(got) == sorted(tuple(r) for r in want.collect())
    if bound:
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize(("bound", "few"), [(textindex.BROADCAST_TERMS, textindex.FEW), (textindex.BROADCAST_TERMS, 2), (0, textindex.FEW)])
def test_scan_reads_lines_once(spark, lines, monkeypatch, bound, few):
    """A scan without an index finds what brute force finds, whichever way it takes; the usual one reads the lines in one branch."""
    monkeypatch.setattr(textindex, "BROADCAST_TERMS", bound)
    monkeypatch.setattr(textindex, "FEW", few)
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    found = textindex.scan(lines, terms)
    want = {(t, p, n) for t in TERMS if t for p, n, line in lines.collect() if line is not None and stands(t, line)}
    assert {(r["term"], r["path"], r["line_no"]) for r in found.collect()} == want and len(want) > 20
    if bound and few > 2:
        tree = impact.dependency_scan(lines, terms)._jdf.queryExecution().executedPlan().toString()
        assert tree.count("parquet") <= 2 and "NestedLoop" not in tree
