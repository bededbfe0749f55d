"""License labels, spans and scores against a plain matcher that tries every place and every choice of regions."""

import random
import re

from pyspark.sql import functions as F

from lintel.llm import licenses

SF = "/root/testdata/sf0.001"


def tree(template):
    """A template as nested lists: words, ("var", least, most), ("opt", list)."""
    stack = [[]]
    for token in re.findall(r"<<.*?>>|[^\s<>]+", template):
        if token == "<<opt>>":
            stack.append([])
        elif token == "<</opt>>":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif m := re.fullmatch(r"<<var:(\d+)-(\d+)>>", token):
            stack[-1].append(("var", int(m[1]), int(m[2])))
        else:
            stack[-1].append(token)
    (out,) = stack
    return out


def ends(parts, words, places):
    """Every place where the parts can end that begin at one of the places."""
    for p in parts:
        if not places:
            break
        if isinstance(p, str):
            places = {k + 1 for k in places if k < len(words) and words[k] == p}
        elif p[0] == "var":
            places = {k + n for k in places for n in range(p[1], p[2] + 1) if k + n <= len(words)}
        else:
            places = places | ends(p[1], words, places)
    return places


def made(parts, rng):
    """Words that a template accepts."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "var":
            out += [rng.choice(["acme", "the", "2024", "größe"]) for _ in range(rng.randint(p[1], p[2]))]
        elif rng.random() < 0.5:
            out += made(p[1], rng)
    return out


def test_labels_match_a_plain_matcher(spark):
    rng = random.Random(6)
    templates = [(label, tree(t)) for label, t in licenses.TEMPLATES] + [(label, tree(p)) for p, label in licenses.BASE.items()]
    texts = []
    for _, parts in templates * 2:
        words = made(parts, rng)
        if rng.random() < 0.4:  # one mandatory or other word changed, lost or doubled
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([["other"], [], [words[k]] * 2])
        texts.append(" ".join(["before", *words, "after"] + words[: rng.randint(0, 5)]).replace(" ", rng.choice([" ", ", ", "\n"])).title())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    docs = docs.unionByName(spark.createDataFrame([(20_000, " ".join(texts) * 3)], "doc_id long, text string"))
    got = {(r["doc_id"], r["labels"], r["spans"], round(r["score"], 12)) for r in licenses.scan(docs.withColumn("labels", F.lit(1))).collect()}
    want, labelled = set(), 0
    for doc, text in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found, inside = [], set()
        for at in range(len(words)):
            for label, parts in templates:
                if (not isinstance(parts[0], str) or parts[0] == words[at]) and (stop := ends(parts, words, {at})):
                    found.append((at, max(stop), label))
                    inside |= set(range(at, max(stop)))
        labelled += bool(found)
        spans = ",".join(f"{label}:{a}-{b}" for a, b, label in sorted(found))
        want.add((doc, ",".join(sorted({x[2] for x in found})), spans, round(len(inside) / len(words), 12) if words else 0.0))
    assert got == want and labelled > len(templates)
