"""An inverted index of lines: token, file, line, position; terms are looked up as phrases.

Tokens are the runs of ASCII letters, digits and underscores of a lower-cased line, numbered from 0; and, so that terms without such
a run are found too, the pairs of neighbouring characters of what stands between runs (one character where it stands alone). A
term of several words stands in a line where its words have consecutive positions; what stands between them is then compared in
the line itself. A term is looked up by that token of its own which the fewest lines have, so a word that all lines have costs
nothing unless a term has no other. The index is a table: build it once, write it partitioned, look up as many terms as wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Runs of letters, digits and underscores; other characters.
WORD, OTHER = r"[a-z0-9_]+", r"[^a-z0-9_]+"
#: Lookups up to this number are broadcast to the index (some 10 MB); more are joined by shuffle. There, a token with over one in
#: so many of the looked-up rows is hot, and dealt into so many parts.
BROADCAST_TERMS, HOT, PARTS = 100_000, 500, 16
#: Terms without a word up to this number are held against every line.
FEW = 100


def pieces(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of what isn't a word, one character where it stands alone."""
    gaps = F.filter(F.regexp_extract_all(text, F.lit(f"({OTHER})"), F.lit(1)), lambda g: F.length(F.trim(g)) > 0)
    pairs = F.transform(gaps, lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.length(g) - 1, F.lit(1))), lambda i: F.substr(g, i, F.lit(2))))
    singles = F.flatten(F.transform(gaps, lambda g: F.split(g, "")))
    return F.filter(F.array_distinct(F.concat(F.flatten(pairs), singles)), lambda x: (F.length(F.trim(x)) > 0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def build(lines: DataFrame, keep: bool = True, other: bool = True, positions: bool = True) -> DataFrame:
    """token, path, line_no, position (of a word; null for other tokens) of lines (path, line_no, line); with keep also the line,
    without other words alone, for terms that all have one; without positions a word once a line. Lines of null have no tokens."""
    held = ["path", "line_no", *(["line"] if keep else [])]
    low = lines.where("line is not null").select(*held, F.lower("line").alias("low"))
    if positions:
        named = low.select(*held, F.posexplode(words(F.col("low"))).alias("position", "token"))
    else:
        named = low.select(*held, F.lit(None).cast("int").alias("position"), F.explode(F.array_distinct(words(F.col("low")))).alias("token"))
    if not other:
        return named.select("token", *held, "position")
    rest = low.select(*held, F.lit(None).cast("int").alias("position"), F.explode(pieces(F.col("low"))).alias("token"))
    return named.unionByName(rest).select("token", *held, "position")


def tokens_of(terms: DataFrame) -> DataFrame:
    """term, token, at of terms: every token by which a term may be looked up, with its place if it is a word. Terms without a word
    have pairs of characters instead; terms of white space have none."""
    low = F.lower("term")
    own = terms.where("term is not null and term != ''").select("term").distinct()
    named = own.select("term", F.posexplode(words(low)).alias("at", "token"))
    rest = own.where(F.size(words(low)) == 0).select("term", F.lit(None).cast("int").alias("at"), F.explode(pieces(low)).alias("token"))
    return named.unionByName(rest)


def bounded(line: Column, term: Column) -> Column:
    """Whether a term stands in a line between ASCII word boundaries, in whatever case."""
    return F.contains(F.lower(line), F.lower(term)) & F.rlike(F.lower(line), F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.lower(term), F.lit(r"\E(?![a-z0-9_])")))


def scan(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """What find() finds, straight from lines (path, line_no, line): for a lookup that needs no index afterwards.

    Each line is read once: its words meet the terms, which are looked up by their longest word, and terms without a word are held
    against it. More terms than BROADCAST_TERMS, or than FEW without a word, go by an index.
    """
    own = terms.where("term is not null").select("term", F.lower("term").alias("low"), words(F.lower("term")).alias("w")).where(F.length(F.trim("term")) > 0).distinct()
    named = cut(own.select("term", "w", F.explode("w").alias("token")).groupBy("term").agg(F.max(F.struct(F.length("token").alias("n"), "token"))["token"].alias("token"), ((F.max(F.size("w")) == 1) & (F.max("token") == F.lower("term"))).alias("single")))
    wordless = [r["term"] for r in own.where("size(w) = 0").limit(FEW + 1).select("term").collect()]
    if len(wordless) > FEW or named.count() > BROADCAST_TERMS:
        return find(build(lines, other=bool(wordless), positions=False), terms, once=True)
    low = lines.where("line is not null").select("path", "line_no", "line", F.lower("line").alias("low"))
    # a word is a struct with its term unknown; a term without a word needs no lookup
    asked = F.transform(F.array_distinct(words(F.col("low"))), lambda t: F.struct(t.alias("token"), F.lit(None).cast("string").alias("term")))
    if wordless:
        there = F.filter(F.array(*map(F.lit, wordless)), lambda t: F.contains(F.col("low"), F.lower(t)))
        asked = F.concat(asked, F.transform(there, lambda t: F.struct(F.lit("").alias("token"), t.alias("term"))))
    each = low.select("path", "line_no", "line", F.explode(asked).alias("x")).select("path", "line_no", "line", "x.token", F.col("x.term").alias("free"))
    known = named.unionByName(lines.sparkSession.createDataFrame([(None, "", True)], named.schema))
    met = each.join(F.broadcast(known), "token").where(F.col("single") | bounded(F.col("line"), F.col("term")))
    return met.select(F.coalesce("free", "term").alias("term"), "path", "line_no", "line")


def find(index: DataFrame, terms: DataFrame, once: bool = False) -> DataFrame:
    """term, path, line_no, line of every line of the index (built with lines) that has a term (rows: term).

    Terms with a word stand between word boundaries, others anywhere. The frequencies of the terms' tokens are counted first; with
    once, for an index that is made for this lookup alone, terms are looked up by their longest token instead, where they are few
    enough to be broadcast.
    """
    wanted = tokens_of(terms)
    few = wanted.count() <= BROADCAST_TERMS
    hint = F.broadcast if few else (lambda df: df)
    if once and few:
        counts = wanted.select("token").distinct().withColumn("n", -F.length("token"))
    else:
        counts = index.join(hint(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x"))
    all_words = words(F.lower("term"))
    single = F.coalesce((F.size(all_words) == 1) & (F.element_at(all_words, 1) == F.lower("term")), F.lit(False))
    asked = cut(rarest.where("x.n != 0").select("term", "x.token", "x.n", single.alias("single"), (F.size(all_words) > 0).alias("named")))
    rows = index.select("token", "path", "line_no", "line")
    if few:
        met = rows.join(F.broadcast(asked), "token")
    else:
        met = dealt(rows, asked)
    has = F.when(~F.col("named"), F.contains(F.lower("line"), F.lower("term"))).otherwise(F.col("single") | bounded(F.col("line"), F.col("term")))
    return met.where(has).select("term", "path", "line_no", "line").distinct()


def places(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """What phrases() finds, straight from lines (path, line_no, line): for a lookup that needs no index afterwards.

    The lines are read twice, once to count the terms' words and once to look terms up by their rarest word; the words around a place
    are then compared in the line itself, so that nothing of the lines is written or shuffled but the counts. Terms with more words in
    all than BROADCAST_TERMS go by an index.
    """
    low = terms.where("term is not null").select("term").distinct().select("term", words(F.lower("term")).alias("w")).where(F.size("w") > 0)
    each = cut(low.select("term", "w", F.posexplode("w").alias("at", "token")))
    if each.count() > BROADCAST_TERMS:
        return phrases(cut(build(lines, keep=False, other=False)), terms)
    worded = lines.where("line is not null").select("path", "line_no", words(F.lower("line")).alias("words"))
    used = F.broadcast(each.select("token").distinct())
    counts = worded.select(F.explode("words").alias("token")).join(used, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "token").groupBy("term", "w").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "at", "token")).alias("x"))
    asked = cut(rarest.where("met = size(w)").select("term", "w", "x.at", "x.token"))  # a term with a word that no line has is nowhere
    placed = worded.select("path", "line_no", "words", F.posexplode("words").alias("position", "token"))
    met = placed.join(F.broadcast(asked), "token").where("position >= at").withColumn("start", F.col("position") - F.col("at"))
    return met.where(F.slice("words", F.col("start") + 1, F.size("w")) == F.col("w")).select("term", "path", "line_no", "start")


def dealt(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows joined with lookups by shuffle; rows and lookups of hot tokens are dealt by a salt."""
    uses = asked.select("token", "n").distinct()
    total = uses.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(uses.where(F.col("n") * HOT > total).select("token"))  # fewer than HOT
    parts = lambda k: F.pmod(F.xxhash64("path", "line_no"), F.lit(k)).cast("int")
    salted = rows.join(hot, "token", "left_semi").withColumn("salt", parts(PARTS))
    copies = asked.join(hot, "token", "left_semi").withColumn("salt", F.explode(F.array(*map(F.lit, range(PARTS)))))
    rest = rows.join(hot, "token", "left_anti").join(asked.join(hot, "token", "left_anti"), "token")
    return salted.join(copies, ["token", "salt"]).drop("salt").unionByName(rest)


def phrases(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, path, line_no, start of every place where a term's words have consecutive positions, whatever stands between them;
    by positions alone, without the lines (an index built without them does).

    Places are proposed by the rarest word of each term; its other words are then looked for at their places, so a frequent word
    is only looked up where a place is proposed.
    """
    low = terms.where("term is not null").select("term").distinct().select("term", words(F.lower("term")).alias("w")).where(F.size("w") > 0)
    each = low.select("term", "w", F.posexplode("w").alias("at", "token"))
    placed = index.where("position is not null").select("token", "path", "line_no", "position")
    few = each.count() <= BROADCAST_TERMS
    hint = F.broadcast if few else (lambda df: df)
    if few:  # no other words matter
        placed = placed.join(F.broadcast(each.select("token").distinct()), "token", "left_semi")
    counts = placed.join(hint(each.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "token", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "token", "w")).alias("x"))
    asked = cut(rarest.where("x.n > 0").select("term", "x.token", "x.n", "x.at", "x.w"))
    met = placed.join(F.broadcast(asked), "token") if few else dealt(placed, asked)
    proposed = met.where("position >= at").select("term", "w", "path", "line_no", (F.col("position") - F.col("at")).alias("start"))
    wanted = proposed.select("term", F.size("w").alias("k"), "path", "line_no", "start", F.posexplode("w").alias("at", "token")).withColumn("position", F.col("start") + F.col("at"))
    found = wanted.join(placed, ["token", "path", "line_no", "position"]).groupBy("term", "k", "path", "line_no", "start").agg(F.count(F.lit(1)).alias("n"))
    return found.where("n = k").select("term", "path", "line_no", "start")
