"""Keeping an index fresh: a stream of changed files, merged batch by batch, and quiet-gap debouncing."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvine.functions.languages import UNSUPPORTED, language_of

DEBOUNCE = (5, 30)


def checked_debounce(seconds: int = 15) -> int:
    if not DEBOUNCE[0] <= seconds <= DEBOUNCE[1]:
        raise ValueError(f"a debounce of {seconds} s is not within {DEBOUNCE[0]} to {DEBOUNCE[1]} s")
    return seconds


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new and rewritten files below a folder: (path, modified, content); hidden and unsupported ones left out."""
    read = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    return read.select(path.alias("path"), F.col("modificationTime").alias("modified"), "content").filter(
        ~F.col("path").rlike(r"/\.[^/]*$") & ~language_of(F.col("path")).isin(*UNSUPPORTED) & F.expr("is_valid_utf8(CAST(content AS string))")
    ).withColumn("content", F.col("content").cast("string"))


def latest(batch: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    return batch.groupBy("path").agg(F.max_by(F.struct("modified", "content"), "modified").alias("r")).select("path", "r.*")


def watch(changes: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str, debounce: int = 15, once: bool = False) -> StreamingQuery:
    """Call ``refresh`` with each batch of changed files, a file once; batches are ``debounce`` seconds apart."""
    seconds = checked_debounce(debounce)

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(latest(batch))

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def deleted(known: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that a listing no longer has; file streams do not report them."""
    return known.select("path").join(present.select("path"), "path", "left_anti")


class Listing:
    """Periodic listings of a watched tree: what was created, modified and removed since the last one.

    ``listed`` are tables (path, modified); file streams tell nothing of removed files.
    """

    def __init__(self, known: DataFrame):
        self.known = known

    def changes(self, present: DataFrame) -> DataFrame:
        """(path, event) against the last listing, which ``present`` replaces."""
        was, now = self.known.select("path", F.col("modified").alias("__was")), present.select("path", F.col("modified").alias("__now"))
        event = F.when(F.col("__was").isNull(), "created").when(F.col("__now").isNull(), "removed").when(F.col("__was") < F.col("__now"), "modified")
        self.known = present
        return was.join(now, "path", "full_outer").select("path", event.alias("event")).filter("event IS NOT NULL")


class Background:
    """One job at a time in a thread of its own, with a status that can be asked for at any time."""

    def __init__(self):
        self._lock, self._thread = threading.Lock(), None
        self.status = {"state": "idle"}

    def start(self, files: DataFrame, work: Callable[[DataFrame], None], batches: int = 8) -> bool:
        """Run ``work`` on ``batches`` parts of the files, cut by path; False if a job is running."""
        with self._lock:
            if self._thread and self._thread.is_alive():
                return False
            self.status = {"state": "running", "done": 0, "batches": batches, "started": time.time()}
            self._thread = threading.Thread(target=self._run, args=(files, work, batches), daemon=True)
            self._thread.start()
            return True

    def _run(self, files: DataFrame, work: Callable[[DataFrame], None], batches: int) -> None:
        try:
            for i in range(batches):
                work(files.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == i))
                self.status = self.status | {"done": i + 1}
            self.status = self.status | {"state": "done", "ended": time.time()}
        except Exception as error:
            self.status = self.status | {"state": "failed", "error": str(error), "ended": time.time()}

    def wait(self, seconds: float | None = None) -> dict:
        if self._thread:
            self._thread.join(seconds)
        return self.status


def quiet_gaps(events: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, events): runs of a key's events with no gap between neighbours; for streams and tables of (key, ts)."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def quiet_gaps_by_window(events: DataFrame, seconds: int = 15) -> DataFrame:
    """The same runs of a table by window functions."""
    by = W.partitionBy("key").orderBy("ts")
    begins = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) >= seconds * 1_000_000).cast("int"), F.lit(1))
    runs = events.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by))
    return runs.groupBy("key", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("events")).drop("run")
