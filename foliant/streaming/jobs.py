"""Structured Streaming forms of document processing.

Sources are folders read as file streams; state is bounded by watermarks; sinks that replace rows
write per-batch folders through foreachBatch, named by the query's id, which lives in its checkpoint,
and the batch's. So a replayed batch overwrites itself and nothing else: another query on the same
sink, or one whose checkpoint was lost, has another id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foliant.operators.extensions import observed
from foliant.sources.staging import holds_files

MAIL_DELAY = "1 day"
RUN_DELAY = "10 minutes"


def stream_documents(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder, each once; the checkpoint remembers which."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_dedup(docs: DataFrame, key: str, ts: str, delay: str = MAIL_DELAY) -> DataFrame:
    """First arrival of each key within the watermark."""
    return docs.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def batch_folder(batch: DataFrame, sink: str, batch_id: int) -> tuple[str, str]:
    """The id of the query whose batch this is, and the batch's folder in the sink."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("not within a streaming query")
    return query, f"{sink.rstrip('/')}/stream={query}/batch={batch_id}"


#: Buckets of an archive by hash: a batch reads those that its own hashes fall into.
BUCKETS = 256


def stream_new_only(docs: DataFrame, sink: str, checkpoint: str, hash_col: str, trigger: dict, buckets: int = BUCKETS, order: list[str] | None = None) -> StreamingQuery:
    """Archive-wide dedup: each batch drops what the archive at sink already holds, then appends the rest.

    The archive is laid out by a bucket of the hash, and a batch reads only the buckets it touches. Of rows
    with one hash the first in ``order`` stays (all other columns if not given), so a replayed batch
    writes the same rows. Rows without a hash are copies of each other within a batch and of nothing else.
    """
    bucket = F.pmod(F.xxhash64(hash_col), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        by = order or [c for c in batch.columns if c != hash_col]
        first = F.min_by(F.struct(*[c for c in batch.columns if c != hash_col], F.lit(0).alias("_one")), F.struct(*by, F.lit(0).alias("_one")))
        fresh = batch.groupBy(hash_col).agg(first.alias("_first")).select(hash_col, *[F.col("_first")[c].alias(c) for c in batch.columns if c != hash_col], bucket.alias("bucket"))
        stream, folder = batch_folder(batch, sink, batch_id)
        if holds_files(spark, f"{sink.rstrip('/')}/stream=*/batch=*/bucket=*/*.parquet"):
            touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most so many buckets
            fresh = fresh.join(archived(spark, sink, batch.schema).where(F.col("bucket").isin(touched)).where((F.col("stream") != stream) | (F.col("batch") != batch_id)).select("bucket", hash_col), ["bucket", hash_col], "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def archived(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """What stream_new_only has written to sink, with stream, batch and bucket as partition columns."""
    whole = StructType([*schema]).add("stream", "string").add("batch", "long").add("bucket", "integer")
    return spark.read.schema(whole).parquet(sink)


def stream_apply(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stateless operator (classification, extraction) on the stream."""
    return operator(docs)


def stream_upsert(updates: DataFrame, sink: str, checkpoint: str, keys: list[str], version: str, trigger: dict) -> StreamingQuery:
    """Keeps the newest record of each key: versions of batches are written side by side, read by ``current``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from foliant.sources.writers import upsert

        upsert(batch, batch.limit(0), keys, version).write.mode("overwrite").parquet(batch_folder(batch, sink, batch_id)[1])

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current(spark: SparkSession, sink: str, keys: list[str], version: str, folders: list[str] | None = None) -> DataFrame:
    """The newest record of each key among all batches of stream_upsert, or those in the folders; of equal versions the latest batch's."""
    rows = spark.read.option("basePath", sink).parquet(*(folders or [sink]))
    values = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(version, "batch", "stream")).alias("v"))
    return newest.select(*keys, *[f"v.{c}" for c in values if c not in ("batch", "stream")])


def compact(spark: SparkSession, sink: str, keys: list[str], version: str) -> int:
    """Merge the batches of stream_upsert at sink into one folder; returns how many were merged.

    The merged folder is written beside them under a hidden name and renamed in one step; only then the
    merged ones are deleted. As the newest version of a key wins wherever it stands, ``current`` gives the
    same rows before, meanwhile and after; batches that are written meanwhile are left alone.
    """
    jvm, root = spark._jvm.org.apache.hadoop.fs, sink.rstrip("/")
    fs = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.globStatus(jvm.Path(f"{root}/stream=*/batch=*")) if fs.exists(jvm.Path(x.getPath(), "_SUCCESS"))]
    if len(old) < 2:
        return 0
    last = max(int(p.getName().split("=")[1]) for p in old)
    rows = current(spark, sink, keys, version, [p.toString() for p in old])
    name = uuid.uuid4().hex
    rows.write.parquet(f"{root}/_{name}")
    fs.mkdirs(jvm.Path(f"{root}/stream=merged-{name}"))
    if not fs.rename(jvm.Path(f"{root}/_{name}"), jvm.Path(f"{root}/stream=merged-{name}/batch={last}")):
        raise RuntimeError(f"{root}/_{name} can't be renamed")
    for p in old:
        fs.delete(p, True)
    return len(old)


def stream_timeline(rows: DataFrame, ts: str, width: str = "1 hour", delay: str = RUN_DELAY) -> DataFrame:
    """(slot, n): counts of each hour, final once the watermark passes it."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("slot"), "n")


def stream_active_workers(beats: DataFrame, worker: str, ts: str, width: str = "60 seconds", delay: str = RUN_DELAY) -> DataFrame:
    """(slot, worker, last_beat): workers heard of in each minute."""
    return beats.withWatermark(ts, delay).groupBy(F.window(ts, width), worker).agg(F.max(ts).alias("last_beat")).select(F.col("window.start").alias("slot"), worker, "last_beat")


def stream_sender_context(docs: DataFrame, ts: str | None = None, period: str = "30 days", delay: str = MAIL_DELAY) -> DataFrame:
    """(sender, document_type, n) in update mode, for the next batch to join.

    With ts, a time column, counts are those of periods, with the period's start as ``since``: a period's
    state goes once the watermark is ``delay`` past its end, and documents later than that don't count.
    A sender's count in all is the sum over periods, which ``current`` reads by sender, type and since.
    """
    known = docs.where("sender is not null")
    if ts is None:
        return known.groupBy("sender", "document_type").agg(F.count("*").alias("n"))
    counts = known.withWatermark(ts, delay).groupBy(F.window(ts, period), "sender", "document_type").agg(F.count("*").alias("n"))
    return counts.select("sender", "document_type", F.col("window.start").alias("since"), "n")


def stream_with_statistics(docs: DataFrame, sink: str, checkpoint: str, metrics: dict[str, Column], callback: Callable[[int, dict], None], trigger: dict) -> StreamingQuery:
    """Appends docs to sink; callback(batch_id, values) gets each batch's metrics once its rows are written.

    Metrics are computed while the rows pass. A replayed batch overwrites its folder and calls again with
    the same batch_id, so a callback that keeps values by batch counts each once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, seen = observed(batch, f"batch-{batch_id}-{uuid.uuid4().hex}", **metrics)
        rows.write.mode("overwrite").parquet(batch_folder(batch, sink, batch_id)[1])
        callback(batch_id, seen.get)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


STALE = "item string, worker string, claimed_at long"


class StaleClaims(StatefulProcessor):
    """Releases a claim whose item hears nothing for ten minutes of event time.

    An item's rows of a batch are taken in order of time (at one time, by worker and status), so a claim
    that went stale between two of them is released as well, however rows fall into batches. The state
    is an item's last claim and goes when it is done or released.
    """

    def __init__(self, minutes: int = 10):
        self.millis = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "worker string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = held = self.claim.get()
        seen, out = [], []
        for b in rows:
            at = b["ts"].to_numpy("datetime64[us]")
            seen += [x for x, lost in zip(zip(at.astype("int64").tolist(), b["worker"].tolist(), b["status"].tolist(), strict=True), np.isnat(at).tolist(), strict=True) if not lost]
        for micros, worker, status in sorted(seen, key=lambda x: (x[0], x[1] is None, x[1] or "", x[2] is None, x[2] or "")):
            at = micros // 1000
            if held and at < held[1]:
                continue  # out of order: what is known of the item is newer
            if held and at - held[1] >= self.millis:
                out.append((key[0], *held))
            held = None if status == "done" else (worker, at)
        # An item has a timer if it has a claim: that claim's. Each call to the state is a message to the JVM.
        before, after = (x and x[1] for x in (known, held))
        if known is not None and before != after:
            self.handle.deleteTimer(before + self.millis)
        if held is not None:
            self.claim.update(held)
            if before != after:
                self.handle.registerTimer(after + self.millis)
        elif known is not None:
            self.claim.clear()
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(key[0], *self.claim.get())] if self.claim.exists() else []
        self.claim.clear()
        yield self.frame(held)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["item", "worker", "claimed_at"]).astype({"claimed_at": "int64"})

    def close(self) -> None:
        pass


def stream_stale_claims(claims: DataFrame, minutes: int = 10, delay: str = "1 minute") -> DataFrame:
    """(item, worker, claimed_at in ms) of claims (item, worker, ts, status) gone stale.

    Rows without a time are ignored. The session's state store must be RocksDB, as for every
    transformWithState query.
    """
    watched = claims.withWatermark("ts", delay)
    return watched.groupBy("item").transformWithStateInPandas(StaleClaims(minutes), STALE, "Append", "EventTime")


class RetryCounter(StatefulProcessor):
    """Counts failures of each key and gives it up at the limit; only keys that have failed are kept, for days of event time."""

    def __init__(self, most: int = 3, days: int | None = None):
        self.most, self.millis = most, days and days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.failures.get() if self.failures.exists() else (0, 0)
        for b in rows:
            n += int((b["status"] == "failed").sum())
            if self.millis and b["ts"].notna().any():
                last = max(last, int(b["ts"].max().timestamp() * 1000))
        if n:
            self.failures.update((n, last))
            if self.millis:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last + self.millis)
        yield pd.DataFrame({"file_hash": [key[0]], "retry_count": [n], "retry": [0 < n < self.most]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failures.clear()
        yield pd.DataFrame({"file_hash": [], "retry_count": [], "retry": []}).astype({"file_hash": str, "retry_count": "int32", "retry": bool})

    def close(self) -> None:
        pass


def stream_retry_state(progress: DataFrame, most: int = 3, days: int | None = None, delay: str = RUN_DELAY) -> DataFrame:
    """(file_hash, retry_count, retry) after each batch of progress (file_hash, status).

    With days, progress has a time column ts too, and a file that nothing was heard of for so long
    after its last row is forgotten: its next failure is its first.
    """
    rows = progress if days is None else progress.withWatermark("ts", delay)
    return rows.groupBy("file_hash").transformWithStateInPandas(RetryCounter(most, days), "file_hash string, retry_count int, retry boolean", "Update", "None" if days is None else "EventTime")
