"""Mixing sources to target weights with DataFrame operations only.

Tokens (words) are summed per source, each source gets a target share of a budget, the repetition rate of a source is target
over size, and a document is taken floor(rate) times plus once more with probability frac(rate), decided by a hash of its id,
text and source, and of its number among rows that have all three in common. So each row is drawn on its own, repeated ids and
null ones too, and reruns agree: which of several equal rows is taken once more is open, how many of them isn't.

Null text has size 0; a null source is a source of its own, ordered last. Sources of size 0 get target 0 and rate 0. Other
columns, whatever their names, are carried by ``mix`` untouched. Very long texts count all their words. An empty table gives
an empty result. The plan has a row per source and is made in one task, so there should be thousands of sources, not billions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, staged

#: Weights dealt to sources in code-point order, repeating; the share of all words to take; the highest rate of a source.
WEIGHTS, SHARE, MOST_REPEATS, SEED = (3, 1, 2), 1.5, 2, 17
#: Plans with more sources than this are joined by shuffle, smaller ones broadcast.
BROADCAST_SOURCES = 10_000
#: Lists of keys that several rows have are broadcast up to this length (some 20 MB), longer ones joined by shuffle.
BROADCAST_KEYS = 500_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS) -> DataFrame:
    """source, source_size, target of each source.

    Targets are min(most * size, level * weight) for the one level at which they sum to share * all sizes. Sources reach
    their limit in the order of most * size / weight, so one running sum tells which do. There is a row per source here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    filled = Window.orderBy("reach", "k")
    whole = Window.partitionBy()
    fill = (
        sizes.withColumn("k", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("reach", limit / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * float(share))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("capped_size", F.sum(limit).over(filled))
        .withColumn("capped_weight", F.sum("weight").over(filled))
        .withColumn("capped", F.col("capped_size") + F.col("reach") * (F.col("all_weight") - F.col("capped_weight")) <= F.col("budget"))
    )
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), limit)).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return fill.select("source", "source_size", F.when(F.col("capped"), limit).otherwise(F.least(limit, rest * F.col("weight") / open_weight)).alias("target"))


def draw(key: str, number: Column, seed: int = SEED) -> Column:
    """Uniform in [0, 1) from a row's key and its number among the rows of that key."""
    return F.pmod(F.xxhash64(key, number, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def row_key() -> Column:
    """Equal for rows of one id, text and source; others that share one by chance are numbered like them."""
    return F.xxhash64("doc_id", "text", "source")


def numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """rows with their number, from 0, among those of one key. Each task numbers its own and adds what the tasks before it have,
    so a key that a third of all rows share isn't brought to one task."""
    task, at, count, before = (free(rows, c) for c in ("task", "at", "count", "before"))
    rows = staged(rows.withColumn(task, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "repeats")
    counts = rows.groupBy(key, task).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(key).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, task, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(key, task).orderBy(at)) - 1
    return rows.withColumn(number, own).join(counts, [key, task]).withColumn(number, F.col(number) + F.col(before)).drop(task, at, before)


def drawn(rows: DataFrame, key: str, seed: int) -> tuple[DataFrame, str]:
    """rows with a column, whose name is given too, that is uniform in [0, 1)."""
    number, chance = free(rows, "number"), free(rows, "chance")
    again = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "again")
    n = again.count()
    if not n:
        return rows.withColumn(chance, draw(key, F.lit(0).cast("long"), seed)), chance
    again = F.broadcast(again) if n <= BROADCAST_KEYS else again
    alone = rows.join(again, key, "left_anti").withColumn(number, F.lit(0).cast("long"))
    both = alone.unionByName(numbered(rows.join(again, key, "left_semi"), key, number).withColumn(number, F.col(number).cast("long")))
    return both.withColumn(chance, draw(key, F.col(number), seed)).drop(number), chance


def planned(sized: DataFrame, weights, share, most) -> DataFrame:
    """source, source_size, target; broadcast unless there are many sources."""
    plan = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix")
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def times(rate: Column, chance: Column) -> Column:
    return F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")


def repetition() -> Column:
    """How often a source of a plan is taken."""
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def copies(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS, seed=SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of docs."""
    sized = staged(docs.select("doc_id", "source", words().alias("size"), row_key().alias("key")), "sizes")
    plan = planned(sized, weights, share, most).withColumnRenamed("source", "plan_source")
    rows, chance = drawn(sized, "key", seed)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", times(repetition(), F.col(chance)).alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS, seed=SEED) -> DataFrame:
    """docs with every row as many times as the mix takes it; columns as in docs."""
    plan = planned(docs.select("source", words().alias("size")), weights, share, most)
    key, own, rate, copy = (free(docs, c) for c in ("key", "plan_source", "rate", "copy"))
    plan = plan.select(F.col("source").alias(own), repetition().alias(rate))
    rows, chance = drawn(docs.withColumn(key, row_key()), key, seed)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col(own)))
    n = times(F.col(rate), F.col(chance)).cast("int")
    return joined.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of this row, repeats counted)."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
