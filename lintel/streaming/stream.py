"""Event-driven behaviour as Structured Streaming. Frames may be batch or streaming; watermarks bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lex
from ..operators import rules


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, finish, n: one row per burst of events that are less than a gap apart, given out once it is over."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def alerts(findings: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """The alarming findings, each (document, code, offset) once: in a stream within the watermark, else its first by time."""
    alarming, key = findings.where(F.col("code").isin(rules.MODAL)), ["doc_id", "code", "start_offset"]
    if findings.isStreaming:
        return alarming.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    rest = [c for c in findings.columns if c not in (*key, ts)]
    return alarming.groupBy(key).agg(F.min(F.struct(ts, *rest)).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in (ts, *rest)]).select(findings.columns)


def cache_hits(requests: DataFrame, key: str, text: str, ts: str, seconds: int = 10) -> DataFrame:
    """requests with hit: the request before had the same text within so many seconds (a cache of one slot)."""
    w = Window.partitionBy(key).orderBy(ts)
    near = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) < seconds * 1_000_000
    return requests.withColumn("hit", F.coalesce((F.lag(text).over(w) == F.col(text)) & near, F.lit(False)))


def watched_scripts(spark: SparkSession, root: str) -> DataFrame:
    """A stream of path, text over SQL files as they appear."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.sql").option("recursiveFileLookup", True).load(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def append_history(snapshots: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch of snapshots to the history table, once per batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return snapshots.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def linted(docs: DataFrame) -> DataFrame:
    """doc_id and code of rules that fire on whole documents of one statement; stateless, for streams."""
    mask = lex.clause_mask(F.col("sql"))
    hit = F.array_compact(F.array(*[F.when(rules.fires(mask, r[1], r[5]), F.lit(r[0])) for r in rules.PATTERN_RULES]))
    return docs.select(*[c for c in docs.columns if c != "sql"], "sql", F.explode(hit).alias("code"))
