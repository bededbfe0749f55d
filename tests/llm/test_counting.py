"""Importance resampling, collocations, line deduplication and families of near copies against brute force, and their edges."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import collocations, families, linededup, resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, blank texts, repeated ids and rows, lines that repeat, a very long text and a very long word."""
    line = "This line stands in several documents."
    rows = [(1, f"{line}\nown line of the first one\n{line}", "en"), (2, f"  {line.upper()}\t\nshort\n", "en"), (3, line, None), (4, f"{line}\r\nmore of it, that is only here", "de"), (4, f"another text, and\n{line}", "de")]
    rows += [(5, None, "en"), (6, "", None), (7, " \n \n", ""), (None, f"no id\n{line}", "en"), (None, f"no id\n{line}", "en"), (None, None, None)]
    rows += [(8, "the cat sat on the mat, the cat sat. " * 4000, "en"), (9, "x" * 300_000 + " the cat sat", "en"), (10, "äöü ÄÖÜ ß é\x00x a\tb  c\nthe  cat\tsat", "fr"), (11, "the cat\nsat the cat sat on", "en")]
    return spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in rows], DOCS)


# 11


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(words, least, most):
    return [" ".join(words[i : i + n]).encode() for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def test_crc_matrices(monkeypatch):
    rng = random.Random(1)
    found = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 9, 300]))) for _ in range(3000)]
    assert resampling.crcs(found).tolist() == [zlib.crc32(x) for x in found]
    monkeypatch.setattr(resampling, "REMEMBERED", 100)
    of = resampling.Buckets(97)
    for k in range(0, 3000, 250):
        assert of.of(found[k : k + 250] + found[:10]).tolist() == [zlib.crc32(x) % 97 for x in found[k : k + 250] + found[:10]]


@pytest.mark.parametrize("least,most", [(1, 1), (1, 3), (2, 2)])
def test_features_in_steps(least, most):
    text = "The cat, the CAT; sat 12 on é \x7f x" * 5
    for step in (1, 7, 1 << 20):
        got = [f for part in resampling.features(text, least, most, step) for f in part]
        assert collections.Counter(got) == collections.Counter(grams(words_of(text), least, most))


@pytest.mark.parametrize("least,most,buckets", [(1, 1, 10_000), (1, 2, 64)])
def test_resampling_matches_brute_force(spark, hard, least, most, buckets):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(hard).withColumn("rank", F.lit(1))
    target = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None), (7, "")], "item_id long, text string"))
    rows = [(r["doc_id"], words_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
    count = lambda lists: np.bincount([zlib.crc32(f) % buckets for w in lists for f in grams(w, least, most)], minlength=buckets)
    s, t = count(w for _, w in rows), count(words_of(r["text"]) for r in target.collect())
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    want = []
    for doc, w in rows:
        found = grams(w, least, most)
        weight, score = sum(gain[zlib.crc32(f) % buckets] for f in found), None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append([doc, len(found), weight, score, None, len(w)])
    may = sorted((r for r in want if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: len(may) * 10 // 100]):
        r[4] = k + 1
    got = resampling.resample(docs, target, buckets, least, most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and len(may) > 100
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(tuple(r[:5]) for r in want)
    again = resampling.resample(docs.repartition(7), target, buckets, least, most)
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(tuple(r[:5]) for r in want)


def test_ranks_go_over_parts(spark):
    """Ties in score and id, and one value that a third of all rows have."""
    rows = [(k if k % 3 else 5, k % 7 if k % 3 else 3) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long").withColumn("place", F.monotonically_increasing_id()).repartition(9)
    got = [(r["score"], r["doc_id"]) for r in sorted(resampling.ranked(df).collect(), key=lambda r: r["rank"])]
    assert got == sorted(((s, d) for d, s in rows), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in resampling.ranked(df).collect()) == list(range(1, 3001))


def test_resampling_edges(spark, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(hard.limit(0), none).count() == 0
    got = resampling.resample(hard, none).collect()
    assert len(got) == hard.count() and all(r["weight"] == 0 for r in got if r["n_features"] == 0) and sum(r["rank"] is not None for r in got) == 0


# 12


def brute_collocations(rows, shortest, longest, least, percent, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    common = {k: a for k, a in f.items() if a >= least and len(k[1]) >= shortest}
    around = collections.Counter()
    for (lang, p), a in common.items():
        for m in range(shortest, len(p)):
            for i in range(len(p) - m + 1):
                around[lang, p[i : i + m]] = max(around[lang, p[i : i + m]], a)
    for (lang, p), a in common.items():
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if 100 * around[lang, p] < percent * a or not around[lang, p]:
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    found = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        found += [(r[0], k + 1, *r[1:]) for k, r in enumerate(mine[:top])]
    return collections.Counter(found)


@pytest.mark.parametrize("shortest,longest,least,percent,top,bits", [(2, 3, 10, 50, 2000, 64), (2, 3, 3, 50, 40, 11), (3, 5, 2, 80, 300, 64), (2, 2, 2, 50, 2000, 16)])
def test_collocations_match_brute_force(spark, hard, monkeypatch, shortest, longest, least, percent, top, bits):
    """Also with fingerprints of a few bits, which collide; and with texts cut into small segments and blocks."""
    if bits < 64:
        monkeypatch.setattr(collocations, "CHUNK", 50)
        monkeypatch.setattr(collocations, "BLOCK", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0").unionByName(hard).withColumn("key", F.lit("x"))
    got = collocations.collocations(docs, shortest, longest, least, percent, top, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations([(r["lang"], r["text"]) for r in docs.collect()], shortest, longest, least, percent, top)
    assert collections.Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_segments_keep_every_run():
    """Each run of words stands in one segment and counts once, whatever the segments' length."""
    rng = random.Random(3)
    for _ in range(200):
        buf = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "longword" * rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))).encode()
        want = collections.Counter()
        for piece in buf.split(b"\n"):
            w = piece.split()
            want.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        got = collections.Counter()
        for part in collocations.Grams([buf.decode()], ["en"], 3, rng.randint(1, 20)):
            w = [bytes(part.flat[a : a + n]) for a, n in zip(part.starts, part.sizes)]
            for n in (1, 2, 3):
                if len(w) >= n:
                    got.update(tuple(w[i : i + n]) for i in np.flatnonzero(part.whole(n)))
        assert got == want


def test_collocation_edges(spark, hard):
    assert collocations.collocations(hard.limit(0)).count() == 0
    assert collocations.collocations(hard.where("text is null or trim(text) = ''"), least=1).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(hard, 1, 2)
    # 10^6 a^2 passes 64 bits
    big = spark.createDataFrame([("en\na b", "en", "a b", 2, 4 * 10**9), ("en\na", "en", "a", 1, 5 * 10**9), ("en\nb", "en", "b", 1, 4 * 10**9 + 1)], "key string, lang string, phrase string, n int, f long")
    assert collocations.scored(big, 2, 2).first()["score"] == 10**6 * (4 * 10**9) ** 2 // (5 * 10**9 * (4 * 10**9 + 1))


# 13


def brute_lines(rows, least=3, shortest=20):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest and doc is not None:
                held[key(line)].add(doc)
    hot = {k: max(d) for k, d in held.items() if len(d) >= least}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    held = linededup.Cuckoo.for_keys(len(keys))
    assert held.insert(keys) and held.has(keys).all() and held.has(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.001
    held.delete(keys[::2])
    assert held.has(keys[1::2]).all() and held.has(keys[::2]).mean() < 0.001
    again = linededup.Cuckoo(held.buckets, held.blob())
    assert again.has(keys[1::2]).all() and again.insert(keys[::2]) and again.has(keys).all()
    assert not linededup.Cuckoo(16).insert(keys)


def test_lines_match_brute_force(spark, hard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(hard).withColumn("keys", F.lit(1))
    got = linededup.deduplicated(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = brute_lines(pairs_of(docs))
    assert collections.Counter(map(tuple, got.collect())) == want and sum(k[2] > 0 for k in want) > 10
    assert linededup.deduplicated(docs.limit(0)).count() == 0


def test_index_is_reversible(spark, hard, monkeypatch):
    """Insertions in parts give the result of all at once; deletions that of what is left, down to nothing, and back."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)  # filters get full and are made again
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1").unionByName(hard)]
    index = linededup.LineIndex(spark, least=2, shards=5)
    for k, part in enumerate(parts):
        index.insert(part)
        here = parts[0] if k == 0 else parts[0].unionByName(parts[1])
        got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in index.cleaned(here).collect())
        assert got == brute_lines(pairs_of(here), least=2)
    index.delete(docs.where("doc_id % 2 = 0").select("doc_id"))
    left = parts[0].unionByName(parts[1]).join(docs.where("doc_id % 2 = 0").select("doc_id"), "doc_id", "left_anti").select("doc_id", "text")
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in index.cleaned(left).collect())
    assert got == brute_lines(pairs_of(left), least=2)
    counts = {bytes(r["key"]): (r["holders"], r["largest"]) for r in index.counts().where("holders > 0").collect()}
    held = collections.defaultdict(set)
    for doc, text in pairs_of(left):
        for line in (text or "").encode().split(b"\n"):
            key = linededup.key_of(line, linededup.SHORTEST)
            if key and doc is not None:
                held[key].add(doc)
    assert counts == {k: (len(v), max(v)) for k, v in held.items()}
    index.delete(left.select("doc_id"))
    assert index.counts().where("holders > 0").count() == 0
    index.insert(parts[0])
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in index.cleaned(parts[0]).collect())
    assert got == brute_lines(pairs_of(parts[0]), least=2)
    kept = {r["doc_id"]: r for r in index.cleaned(parts[0]).collect()}
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in kept.values())
    index.drop()


def test_staged_folders_go(spark, hard, tmp_path):
    """clean_up() leaves nothing of a run in the shared folder, once its result is written."""
    import os

    from lintel.llm import common

    common.clean_up(spark)
    linededup.deduplicated(hard).write.parquet(str(tmp_path / "out"))
    made = [p.removeprefix("file://") for p in common._MADE]
    assert len(made) >= 3 and all(map(os.path.exists, made)) and common.clean_up(spark) == len(made) and not any(map(os.path.exists, made))
    assert spark.read.parquet(str(tmp_path / "out")).count() == hard.count()


# 9: families


def brute_roots(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if (100 + percent) * len(sets[i] ^ sets[j]) <= (100 - percent) * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def made_family(seed):
    rng = random.Random(seed)
    base = set(range(rng.choice([20, 50, 120])))
    centers = [base] + [(base - set(rng.sample(sorted(base), len(base) // 6))) | {rng.randrange(1000, 1100) for _ in range(len(base) // 8)} for _ in range(3)]
    sets = []
    for _ in range(rng.choice([40, 90, 160])):
        s = set(rng.choice(centers))
        s -= set(rng.sample(sorted(s), min(rng.choice([0, 1, 2, 3, 5, 8, 10]), len(s) - 3)))
        sets.append(s | {rng.randrange(2000, 2000 + rng.choice([5, 20, 300])) for _ in range(rng.choice([0, 1, 2, 4, 8]))})
    return sets, rng.choice([80, 90, 70]), rng.choice([*sets, set()])


@pytest.mark.parametrize("direct", [2, 7, 32])
def test_families_match_brute_force(monkeypatch, direct):
    monkeypatch.setattr(families, "DIRECT", direct)
    for seed in range(25):
        sets, percent, common = made_family(seed)
        f = families.within(np.array([len(s) for s in sets]), np.zeros(len(sets), bool), [np.array(sorted(s ^ common), np.int64) for s in sets], percent)
        assert [f.find(i) for i in range(len(sets))] == brute_roots(sets, percent)


def test_families_as_joins_match_brute_force(spark, monkeypatch):
    """Blocks too large for a task, several at once."""
    monkeypatch.setattr(families, "DIRECT", 4)
    made = [made_family(s) for s in (1, 2, 5)]
    rows = [(bytes([b]), bytes([b]) + i.to_bytes(2, "big"), len(s), False, sorted(s ^ common)) for b, (sets, _, common) in enumerate(made) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "block binary, node binary, n long, linked boolean, r array<long>")
    for percent in (80, 90):
        found = [(bytes(r["a"]), bytes(r["b"])) for part in families.resolved(df, percent, local=300) for r in part.collect()]
        for b, (sets, _, _) in enumerate(made):
            root = list(range(len(sets)))

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for x, y in found:
                if x[0] == b:
                    i, j = find(int.from_bytes(x[1:], "big")), find(int.from_bytes(y[1:], "big"))
                    root[max(i, j)] = min(i, j)
            assert [find(i) for i in range(len(sets))] == brute_roots(sets, percent)


def test_unlinked_near_copies_stay_level():
    """A page of 400 words, of which each copy has 8 replaced by one and the same word: pairs compared for each member."""
    per_member = {}
    for m in (1000, 3000, 9000):
        rng, sets = random.Random(1), []
        base = [rng.randrange(1 << 40) for _ in range(400)]
        for _ in range(m):
            w = list(base)
            for p in rng.sample(range(400), 8):
                w[p] = 7
            sets.append({hash((w[i], w[i + 1], w[i + 2])) for i in range(398)})
        f = families.within(np.array([len(s) for s in sets]), np.zeros(m, bool), [np.array(sorted(s ^ sets[0]), np.int64) for s in sets], 90)
        per_member[m] = f.tests / m
    assert max(per_member.values()) < 4 * per_member[1000] < 400
