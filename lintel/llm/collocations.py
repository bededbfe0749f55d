"""Phrase collocations by Rabin-Karp fingerprints of word n-grams.

Texts (A-Z lower-cased) are split into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at spaces and tabs; all is counted per
lang. f(phrase) is the number of its occurrences within pieces, n that of all words. A phrase of ``shortest`` to ``longest`` words
with f >= least is a candidate. Cut after its first k words into parts with counts l and r it scores floor(10^6 f^2 / (l r)); the
lowest-scoring cut counts, of equal ones the first. A candidate inside a longer one that has at least ``percent`` of its count is
dropped. Of each lang the best ``top`` are reported.

How it works, on all rows and exactly:

1. Words are hashed by length (Horner's rule over a matrix of bytes), and every n-gram from prefix polynomials over the words'
   hashes, modulo 2^64. The fingerprint also holds n and the lang. Tasks sort and count blocks of fingerprints, a shuffle adds
   the counts. One- and two-word phrases are counted in a first scan of the texts, each longer length in one of its own, where
   only those n-grams are shuffled whose two parts of n - 1 words may be frequent, by a Bloom filter of frequent fingerprints.
   Its size is bounded (``common.MOST_FILTER_BITS``): beyond that it prunes less, and results stay the same.
2. Another scan gathers, for fingerprints in the filter alone, the exact count, the least and the greatest of a second,
   independent hash, and a pointer (hash of text and lang, byte offset) to an occurrence: the one in the text with the smallest
   hash, so that few texts are pointed at.
3. Texts that are pointed at are joined to their pointers. The phrase is cut out of the text and its fingerprint made anew, which
   must agree. Fingerprints of which the second hash differs stand for several phrases; their occurrences are counted again by
   the phrases themselves. Only frequent phrases are ever made into strings.
4. Parts and longer phrases are joined by Spark, those that many candidates have by broadcast; counts multiply as decimals of 38
   digits. The best of each lang are found among the best of parts of it.

A lang of null counts as ``und``. Null and blank texts have no words. doc_ids play no part: rows count as often as they are there,
whatever ids they repeat. Very long texts are taken whole, in segments of ``CHUNK`` bytes that overlap by a phrase. Phrases that
tie in score and count stand in the order of their UTF-8 bytes. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, bloom_of, joined, slices, staged

SHORTEST, LONGEST, LEAST, PERCENT, TOP = 2, 3, 10, 50, 2000
#: Bytes of text hashed at a time; fingerprints that a task sorts at a time; rows that it gives out at a time.
CHUNK, BLOCK, GIVEN = 1 << 19, 3 << 19, 100_000
#: Longest words in the matrices; longer ones are hashed one by one.
WIDEST = 64
#: Words of the longest phrases that pointers have room for.
MOST_WORDS = 255
#: Parts of a lang whose best phrases are found first.
PARTS = 64
#: Of bytes: A-Z lower-cased, ends of pieces to \n, tabs to spaces.
_CLEAN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


class Hash:
    """A family of polynomial hashes modulo 2^64: values of bytes and an odd base, both from a seed."""

    def __init__(self, seed: int, bits: int = 64):
        self.seed, self.mask = seed, _U((1 << bits) - 1)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * _U(2 * seed + 1))
        self.base = mixed(np.array([seed + 1000], np.uint64))[0] | _U(1)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def words(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(1, WIDEST + 2))
        for size in range(1, WIDEST + 1):
            which = order[bounds[size - 1] : bounds[size]]
            if len(which):
                h = np.full(len(which), size, np.uint64)
                for column in flat[starts[which] + np.arange(size)[:, None]]:  # a row for each column of bytes
                    h = h * self.base + self.values[column]
                out[which] = h
        for i in order[bounds[WIDEST] :]:
            out[i] = xxhash.xxh3_64_intdigest(flat[starts[i] : starts[i] + sizes[i]].tobytes(), self.seed)
        return mixed(out)

    def sums(self, words: np.ndarray) -> np.ndarray:
        """Prefix polynomials: sums of words times powers of the base."""
        m = len(words)
        if len(self.powers) < m + 1:
            back = pow(int(self.base), -1, 1 << 64)
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * m, _U(b))])) for b in (int(self.base), back))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.powers[:m])])

    def grams(self, words: np.ndarray, n: int, langs: np.ndarray) -> np.ndarray:
        """Fingerprints of all runs of n words; langs: a number of the lang for each word."""
        sums, last = self.sums(words), len(words) - n + 1
        return self.named((sums[n:] - sums[:last]) * self.inverse[:last], n, langs[:last])

    def grams_at(self, words: np.ndarray, first: np.ndarray, n: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of n words that begin at the given ones."""
        sums = self.sums(words)
        return self.named((sums[first + n] - sums[first]) * self.inverse[first], n, langs)

    def named(self, runs: np.ndarray, n: int | np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Polynomials of runs with their length and lang."""
        return mixed(runs + langs * _U(2 * self.seed + 1) + np.asarray(n).astype(np.uint64) * _U(0xA0761D6478BD642F)) & self.mask


def clean(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(_CLEAN)


def lang_number(lang: str | None) -> int:
    return xxhash.xxh3_64_intdigest(b"und" if lang is None else lang.encode("utf-8"))


def segments(buf: bytes, longest: int, chunk: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, carried): cuts between words. Where a piece is cut, the next segment starts with its last words again,
    ``carried`` of them."""
    start = cut = 0
    while cut < len(buf):
        carried = len(buf[start:cut].split())
        end = len(buf)
        if end - cut > chunk:
            end = buf.rfind(b"\n", cut, cut + chunk) + 1
            if end <= cut:
                end = buf.rfind(b" ", cut, cut + chunk) + 1
            if end <= cut:
                end = min([x + 1 for x in (buf.find(b" ", cut + chunk), buf.find(b"\n", cut + chunk)) if x >= 0], default=len(buf))
        yield start, end, carried
        start = cut = end
        if longest > 1 and buf[end - 1 : end] == b" ":  # amid a piece
            back = end
            for _ in range(longest - 1):
                while back > 0 and buf[back - 1 : back] == b" ":
                    back -= 1
                back = max(buf.rfind(b" ", 0, back), buf.rfind(b"\n", 0, back)) + 1
                if buf[back - 1 : back] != b" ":
                    break
            start = back


class Grams:
    """The words of some texts, and fingerprints of their n-grams, a segment at a time."""

    def __init__(self, texts: list[str | None], langs: list[str | None], longest: int, chunk: int | None = None):
        found = [clean(t) for t in texts]
        self.buf = b"\n".join(found)
        self.begin = np.cumsum([0, *[len(x) + 1 for x in found[:-1]]])
        self.langs = np.array([lang_number(x) for x in langs], np.uint64)
        self.longest, self.chunk = longest, chunk or CHUNK

    def __iter__(self):
        every = np.frombuffer(self.buf, np.uint8)
        for start, end, carried in segments(self.buf, self.longest, self.chunk):
            flat = every[start:end]
            gap = (flat == 32) | (flat == 10)
            edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
            self.starts, sizes = edges[::2], edges[1::2] - edges[::2]
            if not len(self.starts):
                continue
            self.flat, self.sizes, self.carried = flat, sizes, carried
            self.piece = np.cumsum(flat == 10, dtype=np.int32)[self.starts]
            self.at = self.starts + start
            self.doc = np.searchsorted(self.begin, self.at, "right") - 1
            self.lang = self.langs[self.doc]
            yield self

    def words(self, hash_: Hash) -> np.ndarray:
        return hash_.words(self.flat, self.starts, self.sizes)

    def whole(self, n: int) -> np.ndarray:
        """Which runs of n words lie within a piece and weren't in the segment before."""
        m = len(self.starts)
        ends = np.arange(n - 1, m)
        return (self.piece[: m - n + 1] == self.piece[n - 1 :]) & (ends >= self.carried)


def summed(prints: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    found, counts = np.unique(np.concatenate(prints), return_counts=True)
    for k in range(0, len(found), GIVEN):
        yield pa.RecordBatch.from_arrays([pa.array(found[k : k + GIVEN].view(np.int64)), pa.array(counts[k : k + GIVEN].astype(np.int64))], ["print", "f"])


def frequent(texts: DataFrame, levels: list[int], filters: dict[int, Bloom], least: int, hash_: tuple[int, int]) -> Bloom:
    """A filter of the fingerprints of n-grams of these lengths that are frequent."""
    known = {n: f.shared(texts.sparkSession) for n, f in filters.items()}

    def run(batches):
        of, held, size = Hash(*hash_), [], 0
        for b in slices(batches):
            for part in Grams(b.column(0).to_pylist(), b.column(1).to_pylist(), max(levels)):
                words = part.words(of)
                for n in levels:
                    if len(words) < n:
                        continue
                    may = part.whole(n)
                    if n - 1 in known:
                        last = known[n - 1].value.has(of.grams(words, n - 1, part.lang))
                        may &= last[:-1] & last[1:]
                    held.append(of.grams(words, n, part.lang)[may])
                    size += len(held[-1])
                if size > BLOCK:
                    yield from summed(held)
                    held, size = [], 0
        if held:
            yield from summed(held)

    rows = texts.mapInArrow(run, "print long, f long").groupBy("print").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return bloom_of(staged(rows.select("print"), "prints"), "print")


POINTED = "print long, f long, check int, text_key long, place long"


def pointed(texts: DataFrame, filters: dict[int, Bloom], least: int, hash_: tuple[int, int]) -> DataFrame:
    """print, n, f, low, high, text_key, at of frequent fingerprints: exact count, range of the second hash, an occurrence. The
    phrase of no words (n = 0) stands once for every word."""
    known = {n: f.shared(texts.sparkSession) for n, f in filters.items()}
    names = [x.split()[0] for x in POINTED.split(", ")]

    def merged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        prints, check, key, place = (np.concatenate([h[k] for h in held]) for k in range(4))
        held.clear()
        order = np.argsort(prints, kind="stable")
        prints, check = prints[order], check[order]
        first = np.flatnonzero(np.concatenate([[True], (prints[1:] != prints[:-1]) | (check[1:] != check[:-1])]))
        sums = np.diff(np.append(first, len(prints)))
        at = order[first]
        cols = (prints[first].view(np.int64), sums, check[first], key[at], place[at])
        for k in range(0, len(first), GIVEN):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + GIVEN]) for c in cols], names)

    def run(batches):
        of, second, held, size, whole = Hash(*hash_), Hash(hash_[0] + 1), [], 0, {}
        for b in slices(batches):
            keys = b.column(2).to_numpy()
            for part in Grams(b.column(0).to_pylist(), b.column(1).to_pylist(), max(known)):
                words, checks = part.words(of), part.words(second)
                docs, counts = np.unique(part.doc[part.carried :], return_counts=True)
                none, langs = np.zeros(len(docs), np.uint64), part.langs[docs]
                for print_, check, key, f in zip(of.named(none, 0, langs).view(np.int64), halved(second.named(none, 0, langs)), keys[docs], counts):
                    whole.setdefault((int(print_), int(check)), [0, int(key)])[0] += int(f)
                for n, known_n in known.items():
                    if len(words) < n:
                        continue
                    prints = of.grams(words, n, part.lang)
                    at = np.flatnonzero(part.whole(n) & known_n.value.has(prints))
                    doc = part.doc[at]
                    held.append((prints[at], halved(second.grams(checks, n, part.lang)[at]), keys[doc], (part.at[at] - part.begin[doc]) * (MOST_WORDS + 1) + n))
                    size += len(at)
                if size > BLOCK:
                    yield from merged(held)
                    size = 0
        if size:
            yield from merged(held)
        rows = [(p, f, c, key, 0) for (p, c), (f, key) in whole.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 2 else pa.int64()) for k, x in enumerate(cols)], names)

    sums = (F.sum("f").alias("f"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("text_key").alias("text_key"), F.min_by("place", "text_key").alias("place"))
    rows = texts.mapInArrow(run, POINTED).groupBy("print").agg(*sums).where(F.col("f") >= least)
    n = F.pmod("place", F.lit(MOST_WORDS + 1))
    return staged(rows.withColumn("n", n.cast("int")).withColumn("at", F.expr(f"place div {MOST_WORDS + 1}")).drop("place"), "pointed")


def halved(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(32)).astype(np.uint32).view(np.int32)


def cut_out(text: bytes, at: int, n: int) -> bytes:
    """The n words of a piece of a cleaned text from a byte on, joined by one space; nothing if there aren't as many."""
    found = re.compile(rb"[^ \n]+" + rb" +[^ \n]+" * (n - 1)).match(text, at) if n else None
    return b" ".join(found[0].split()) if found else b""


def materialised(texts: DataFrame, pointers: DataFrame, hash_: tuple[int, int]) -> DataFrame:
    """lang, phrase, n, f of pointers, cut out of the texts; each fingerprint is made again from its phrase and must agree."""
    keys = staged(pointers.select("text_key").distinct(), "text-keys")
    may = bloom_of(keys, "text_key").shared(texts.sparkSession)

    def pick(batches):
        seen = set()
        for b in slices(batches):
            keep = may.value.has(b.column(2).to_numpy().view(np.uint64))
            for i in np.flatnonzero(keep):
                key = b.column(2)[i].as_py()
                keep[i] = key not in seen
                seen.add(key)
            if len(seen) > BLOCK:
                seen.clear()
            yield b.filter(pa.array(keep))

    def run(batches):
        of = Hash(*hash_)
        for b in slices(batches, 20):
            rows = []
            for text, lang, at in zip(*(b.column(c).to_pylist() for c in range(3))):
                text = clean(text)
                found = [(cut_out(text, p["at"], p["n"]), p) for p in at]
                words = [w for phrase, _ in found for w in phrase.split()]
                sizes = np.array([len(w) for w in words], np.int64)
                n = np.array([len(phrase.split()) for phrase, _ in found], np.int64)
                number = np.full(len(found), lang_number(lang), np.uint64)
                made = of.grams_at(of.words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes), np.cumsum(n) - n, n, number)
                same = made.view(np.int64) == np.array([p["print"] for _, p in found], np.int64)
                rows += [(p["print"], "und" if lang is None else lang, phrase.decode("utf-8"), p["n"], p["f"]) for (phrase, p), s in zip(found, same) if s]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["print", "lang", "phrase", "n", "f"])

    chosen = texts.mapInArrow(pick, "text string, lang string, text_key long")
    lists = pointers.groupBy("text_key").agg(F.collect_list(F.struct("print", "at", "n", "f")).alias("pointers"))  # no more than a text's words
    made = chosen.join(lists, "text_key").select("text", "lang", "pointers").mapInArrow(run, "print long, lang string, phrase string, n int, f long")
    return made.dropDuplicates(["print"]).drop("print")


def recounted(texts: DataFrame, prints: DataFrame, longest: int, least: int, hash_: tuple[int, int]) -> DataFrame:
    """lang, phrase, n, f of the frequent phrases among those with these fingerprints, counted by the phrases themselves."""
    may = bloom_of(prints, "print").shared(texts.sparkSession)

    def run(batches):
        of = Hash(*hash_)
        for b in slices(batches):
            langs, found = b.column(1).to_pylist(), {}
            for part in Grams(b.column(0).to_pylist(), langs, longest):
                words = part.words(of)
                docs, counts = np.unique(part.doc[part.carried :], return_counts=True)
                made = of.named(np.zeros(len(docs), np.uint64), 0, part.langs[docs])
                for i in np.flatnonzero(may.value.has(made)):
                    lang = langs[docs[i]]
                    key = (int(made[i].view(np.int64)), "und" if lang is None else lang, "", 0)
                    found[key] = found.get(key, 0) + int(counts[i])
                for n in range(1, min(longest, len(words)) + 1):
                    made = of.grams(words, n, part.lang)
                    for i in np.flatnonzero(part.whole(n) & may.value.has(made)):
                        lang = langs[part.doc[i]]
                        key = (int(made[i].view(np.int64)), "und" if lang is None else lang, cut_out(part.buf, int(part.at[i]), n).decode("utf-8"), n)
                        found[key] = found.get(key, 0) + 1
            cols = [*zip(*found), list(found.values())] if found else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["print", "lang", "phrase", "n", "f"])

    rows = texts.mapInArrow(run, "print long, lang string, phrase string, n int, f long").join(prints, "print", "left_semi")
    return rows.groupBy("lang", "phrase", "n").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrases(docs: DataFrame, longest: int, least: int, bits: int = 64) -> DataFrame:
    """lang, phrase, n (its words), f of all phrases of up to ``longest`` words with f >= least; n = 0: the lang's words."""
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text", "lang").alias("text_key"))
    hash_ = (1, bits)
    filters = {}
    for n in range(2, max(2, longest) + 1):
        levels = [1, 2] if n == 2 else [n]
        found = frequent(texts, levels, filters, least, hash_)
        filters |= dict.fromkeys(levels, found)
    filters = {n: f for n, f in filters.items() if n <= longest}
    pointers = pointed(texts, filters, least, hash_)
    alone = materialised(texts, pointers.where("low = high"), hash_).select("lang", "phrase", "n", "f")
    mixed_up = staged(pointers.where("low != high").select("print"), "collisions")
    if mixed_up.isEmpty():
        return staged(alone, "phrases")
    again = recounted(texts, mixed_up, longest, least, hash_).select("lang", "phrase", "n", "f")
    return staged(alone.unionByName(again), "phrases")


def scored(found: DataFrame, shortest: int, longest: int) -> DataFrame:
    """key, lang, phrase, words, a, l, r, score of candidates, by the lowest-scoring cut."""
    many = found.where(F.col("n") >= shortest).select("key", "lang", "phrase", "n", "f", F.split("phrase", " ").alias("words"))
    k = F.col("k")
    part = lambda side, words: F.struct(F.lit(side).alias("side"), F.concat("lang", F.lit("\n"), F.array_join(words, " ")).alias("part"))
    cut = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    rows = cut.select("key", "k", F.inline(F.array(part("l", F.slice("words", F.lit(1), k)), part("r", F.slice("words", k + 1, F.col("n") - k)))))
    parts = found.where(F.col("n") < longest).select(F.col("key").alias("part"), F.col("f").alias("of_part"))
    uses = staged(rows.groupBy("part").agg(F.count(F.lit(1)).alias("uses")).join(parts, "part"), "uses")
    counts = joined(rows, uses, "part", "uses")
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("of_part"))).alias(f"{side}{k}")
    counts = counts.groupBy("key").agg(*[at(k, side) for k in range(1, longest) for side in "lr"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = many.drop("n").withColumnRenamed("f", "a").join(counts, "key")
    for k in range(1, longest):
        both = both.withColumn(f"d{k}", wide(f"l{k}") * wide(f"r{k}"))
    both = both.withColumn("top", (F.lit(1_000_000).cast("decimal(7,0)") * (F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)"))).cast("decimal(38,0)"))
    options = F.array(*[F.when(F.col(f"d{k}").isNotNull(), F.struct(F.expr(f"top div d{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)])
    best = F.array_min(F.filter(options, lambda x: x.isNotNull()))
    return both.withColumn("best", best).select("key", "lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def outshone(candidates: DataFrame, shortest: int, longest: int) -> DataFrame:
    """part, most: the greatest count of a longer candidate around each phrase that has one."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(shortest), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    rows = candidates.where(size > shortest).select("lang", "a", F.explode(F.array_distinct(inner)).alias("inside"))
    return rows.groupBy(F.concat("lang", F.lit("\n"), "inside").alias("part")).agg(F.max("a").alias("most"))


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """rows with rank, of each lang the first ``top`` by score, count, phrase."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases."""
    if not 2 <= shortest <= longest <= MOST_WORDS:
        raise ValueError(f"phrases of two to {MOST_WORDS} words")
    found = phrases(docs, longest, least, bits).withColumn("key", F.concat("lang", F.lit("\n"), "phrase"))
    candidates = staged(scored(found, shortest, longest), "candidates")
    around = outshone(candidates, shortest, longest)
    kept = candidates.join(around.withColumnRenamed("part", "key"), "key", "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    words = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return best_of(kept, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
