"""URL filters: host word segmentation and multinomial naive Bayes, under block and allow rules.

Concatenated names are split into words by unigram Viterbi. Word counts come from the text of all pages; each distinct name is
joined to the counts of all its substrings. Naive Bayes scores the words of a url's host and path, learned from all urls that
a rule decides, by its verdict, or from rated urls where such are given; rules decide what they fit, naive Bayes the rest.
Every token has its weight, in a written table that urls' tokens are joined to.

A null url, or one without ``://``, has empty host and path and no words; like any url without words it gets the verdict of
the prior, of the ratings alone. With no ratings all is allowed. A null page_id is carried; repeated rows are judged alike and
each counts; other columns are ignored; long pages and urls are taken whole; with no pages the result is empty.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, slices, staged

#: (verdict, host and path prefix). A rule holds for the host and its subdomains.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: What a word of a name is: letters, at most so many. What is added to token counts.
LONGEST_WORD, ALPHA = 40, 0.5
#: Words that a task counts before it hands them on.
MEMO_WORDS = 200_000

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    known = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(known, "://") > 0, F.substr(known, F.instr(known, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substr(rest, F.length(host) + F.lit(1))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(after, r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi over lower-case letters; unknown stretches cost by length."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 2

    def split(self, name: str) -> list[str]:
        """The cheapest split of a name; ties go to the longer last word."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                cost = self.cost.get(name[start:end])
                if cost is None:
                    cost = self.unknown + 3 * (end - start)
                options.append((best[start] + cost, start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        out.reverse()
        return out


def names_of(host: str, path: str) -> list[tuple[str, str]]:
    """(mark, name) of the stretches of letters of a host's labels, its last one aside, and of its path, in order."""
    labels = host.split(".")
    return [("h:", n) for label in (labels[:-1] or labels) for n in re.findall(r"[^\W\d_]+", label)] + [("p:", n) for n in re.findall(r"[^\W\d_]+", path.lower())]


def visible(html: bytes) -> Iterator[bytes]:
    """What stands outside of tags, scripts and styles of a lower-cased page, in one pass: what isn't closed runs to the end."""
    at = 0
    while (start := html.find(b"<", at)) >= 0:
        yield html[at:start]
        stop = html.find(b">", start)
        for kind in (b"script", b"style"):
            if html.startswith(kind, start + 1) and not html[start + 1 + len(kind) : start + 2 + len(kind)].isalnum():
                close = html.find(b"</" + kind, start)
                stop = html.find(b">", close) if close >= 0 else -1
        if stop < 0:
            return
        at = stop + 1
    yield html[at:]


def page_words(pages: DataFrame) -> DataFrame:
    """word, n over the visible text of all pages. Each task counts its own rows before the shuffle."""

    def count(batches):
        seen: Counter = Counter()
        kept = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "ignore") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for b in slices(batches):
            for html in b.column(0).to_pylist():
                words = b" ".join(visible((html or "").lower().encode("utf-8", "ignore"))).translate(_LETTERS).split()
                seen.update(w for w in words if len(w) <= 4 * LONGEST_WORD)
            if len(seen) > MEMO_WORDS:
                yield kept()
                seen.clear()
        yield kept()

    return pages.select("html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(pages: DataFrame) -> tuple[DataFrame, int]:
    """(word, n) of all words of two letters to LONGEST_WORD, and what all count for together."""
    words = staged(page_words(pages).where(F.length("word").between(2, LONGEST_WORD)), "words")
    return words, words.agg(F.sum("n")).first()[0] or 0


def splits(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """name_id, words: the cheapest split of every distinct name, from the counts of all its substrings."""

    def pieces(batches):
        for b in slices(batches):
            for name_id, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at in range(0, len(name), 1000):
                    found = sorted({name[i:j] for i in range(at, min(at + 1000, len(name))) for j in range(i + 2, min(len(name), i + LONGEST_WORD) + 1)})
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([name_id] * len(found), pa.binary()), pa.array(found, pa.string())], ["name_id", "word"])

    def cut(batches):
        for b in slices(batches):
            out = [Segmenter({k["word"]: k["n"] for k in known or ()}, total).split(name) for name, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name_id", "words"])

    known = names.mapInArrow(pieces, "name_id binary, word string").join(words, "word").groupBy("name_id").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return names.join(known, "name_id", "left").select("name_id", "name", "known").mapInArrow(cut, "name_id binary, words array<string>")


def tokenised(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """row, tokens: the marked words of every url that has names, in order."""

    def named(batches):
        for b in slices(batches):
            rows = [(r, k, mark, hashlib.blake2b(n.encode("utf-8", "replace"), digest_size=16).digest(), n) for r, h, p in zip(*(b.column(c).to_pylist() for c in range(3))) for k, (mark, n) in enumerate(names_of(h, p))]
            cols = [*zip(*rows)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string()))], ["row", "at", "mark", "name_id", "name"])

    found = staged(urls.where("host != ''").select("row", "host", "path").mapInArrow(named, "row long, at int, mark string, name_id binary, name string"), "names")
    names = found.groupBy("name_id").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("n"))
    names = staged(names, "distinct-names")
    cut = staged(splits(names.select("name_id", "name"), *lexicon(pages)).join(names.select("name_id", "n"), "name_id"), "splits")
    parts = joined(found.drop("name"), cut, "name_id", "n").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "mark", "words"))).alias("parts"))
    return parts.select("row", F.flatten(F.transform("parts", lambda p: F.transform(p["words"], lambda w: F.concat(p["mark"], w)))).alias("tokens"))


def weights(tokens: DataFrame, rated: DataFrame) -> tuple[DataFrame, float]:
    """(token, weight, n) of all tokens of rated urls, weight the log-odds of block against allow, and the prior's log-odds.

    rated: row, bad. Multinomial: each time that a url has a token counts, with ALPHA more for every known token.
    """
    bad = rated.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()
    urls = {r["bad"]: r["n"] for r in bad}
    if not urls:
        return tokens.select(F.lit("").alias("token"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("n")).limit(0), -math.inf
    every = tokens.join(rated, "row", "left").select(F.explode("tokens").alias("token"), "bad")
    counts = staged(every.groupBy("token").agg(F.count_if(F.col("bad")).alias("block"), F.count_if(~F.col("bad")).alias("allow"), F.count(F.lit(1)).alias("n")).where("block + allow > 0"), "counts")
    all_ = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    share = lambda c: F.log((F.col(c) + ALPHA) / ((all_[c] or 0) + ALPHA * ((all_["n"] or 0) + 1)))
    return staged(counts.select("token", (share("block") - share("allow")).alias("weight"), "n"), "weights"), math.log((urls.get(True, 0) + ALPHA) / (urls.get(False, 0) + ALPHA))


def judge(pages: DataFrame, rules=RULES, rated: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, words (the host's, segmented), block_score of every row.

    rated: (url, blocked) to learn from; without it, the urls that the rules decide.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), F.lit(None).cast("boolean").alias("bad"))
    if rated is not None:
        urls = urls.unionByName(rated.where("blocked is not null").select(F.lit(None).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("blocked").alias("bad")))
    urls = staged(urls.select("*", rule.alias("rule"), verdict.alias("ruled"), F.monotonically_increasing_id().alias("row")), "urls")
    tokens = staged(tokenised(urls, pages), "tokens")
    labelled = urls.where("bad is not null") if rated is not None else urls.where("ruled is not null").withColumn("bad", F.col("ruled") == "block")
    weight, prior = weights(tokens, labelled.select("row", "bad"))
    odds = joined(tokens.select("row", F.explode("tokens").alias("token")), weight, "token", "n").groupBy("row").agg(F.sort_array(F.collect_list("weight")).alias("weights"))
    odds = odds.select("row", F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("odds"))
    total = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.coalesce("odds", F.lit(0.0)) + F.lit(prior)))
    host_words = F.transform(F.filter("tokens", lambda t: t.startswith("h:")), lambda t: F.substring(t, 3, 1 << 30))
    out = urls.where("bad is null").join(tokens, "row", "left").join(odds, "row", "left").withColumn("block_score", 1 / (1 + F.exp(-total)))
    words = F.coalesce(F.array_join(host_words, " "), F.lit("")).alias("words")
    final = F.coalesce("ruled", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict")
    return out.select("page_id", "host", "path", "rule", final, words, "block_score")
