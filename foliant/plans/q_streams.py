"""Queries of streams (T*): a table is read as a file stream, drained with availableNow, and its sink read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import classify
from foliant.sources.staging import shared_folder as scratch
from foliant.streaming import jobs
from .base import ARCHIVE, archive_of, table
from .q_classify import STOP
from .registry import SQL, query

NOW = {"availableNow": True}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files; a glob, since a stream's plain path must be a folder."""
    return jobs.stream_documents(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


def drained(df: DataFrame) -> DataFrame:
    """What the stream appends, read back from Parquet."""
    folder = scratch(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(**NOW).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def updated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key that the stream, in update mode, gives."""
    folder = scratch(df.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(jobs.batch_folder(batch, f"{folder}/out", batch_id)[1])

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(**NOW).start().awaitTermination()
    return jobs.current(df.sparkSession, f"{folder}/out", keys, "batch")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store, which streams with states of their own need, while they start and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def beats(s, d):
    return source(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_stream_documents", "SELECT doc_id, n_chars FROM documents")
def _(s, d):
    return drained(source(s, d, "documents").select("doc_id", "n_chars"))


@query("t2_stream_dedup", "SELECT DISTINCT user_id FROM events")
def _(s, d):
    return drained(jobs.stream_dedup(beats(s, d), "user_id", "ts", "400 days").select("user_id"))


@query("t3_stream_classify", SQL["c33_detect_language"])
def _(s, d):
    language = classify.detect_language(F.col("text"), STOP, [("de", "ßäü"), ("es", "ñ")]).alias("language")
    return drained(jobs.stream_apply(source(s, d, "documents"), lambda x: x.select("doc_id", language)))


@query("t4_stream_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def _(s, d):
    folder = scratch(s)
    jobs.stream_upsert(source(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), f"{folder}/out", f"{folder}/state", ["o_custkey"], "o_orderkey", NOW).awaitTermination()
    return jobs.current(s, f"{folder}/out", ["o_custkey"], "o_orderkey")


@query("t5_stream_timeline", "SELECT date_trunc('hour', ts) AS slot, count(*) AS n FROM events GROUP BY slot HAVING slot + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(s, d):
    return drained(jobs.stream_timeline(beats(s, d), "ts")).withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query("t7_stream_active_workers", "SELECT date_trunc('minute', ts) AS slot, user_id, max(ts) AS last_beat FROM events GROUP BY slot, user_id HAVING slot + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def _(s, d):
    out = drained(jobs.stream_active_workers(beats(s, d), "user_id", "ts"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("slot", "last_beat")})


#: Items of the queue are users' events; the query's watermark is a minute behind the last event.
CLAIMS = """WITH c AS (SELECT user_id::VARCHAR AS item, event_type AS worker, epoch_ns(ts) // 1000000 AS t, ts, CASE WHEN event_id % 5 = 0 THEN 'done' ELSE 'claimed' END AS status FROM events),
n AS (SELECT *, lead(t) OVER (PARTITION BY item ORDER BY ts, worker, status) AS later FROM c)"""


@query("t6_stream_stale_claims", CLAIMS + " SELECT item, worker, t AS claimed_at FROM n WHERE status = 'claimed' AND (later - t >= 600000 OR later IS NULL AND t + 600000 <= (SELECT max(t) FROM c) - 60000)")
def _(s, d):
    claims = beats(s, d).selectExpr("cast(user_id as string) AS item", "event_type AS worker", "ts", "if(event_id % 5 = 0, 'done', 'claimed') AS status")
    with rocks(s):
        return drained(jobs.stream_stale_claims(claims))


@query("t8_stream_retry_state", "SELECT user_id::VARCHAR AS file_hash, count(*) FILTER (event_type = 'error')::INT AS retry_count, count(*) FILTER (event_type = 'error') BETWEEN 1 AND 2 AS retry FROM events GROUP BY user_id")
def _(s, d):
    progress = beats(s, d).selectExpr("cast(user_id as string) AS file_hash", "if(event_type = 'error', 'failed', 'completed') AS status", "ts")
    with rocks(s):
        return updated(jobs.stream_retry_state(progress, days=30), ["file_hash"])


@query("t9_stream_sender_context", f"WITH {ARCHIVE} SELECT sender, document_type, count(*) AS n FROM archive WHERE sender IS NOT NULL GROUP BY sender, document_type")
def _(s, d):
    docs = archive_of(source(s, d, "orders")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    periods = updated(jobs.stream_sender_context(docs, "created_at"), ["sender", "document_type", "since"])
    return periods.groupBy("sender", "document_type").agg(F.sum("n").alias("n"))


@query("x3_statistics", "SELECT count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 1000) AS long, max(n_chars)::BIGINT AS most FROM documents")
def _(s, d):
    folder, seen = scratch(s), {}
    metrics = {"documents": F.count("*"), "chars": F.sum("n_chars"), "long": F.count_if(F.col("n_chars") > 1000), "most": F.max("n_chars")}
    jobs.stream_with_statistics(source(s, d, "documents").select("doc_id", "n_chars"), f"{folder}/out", f"{folder}/state", metrics, seen.__setitem__, NOW).awaitTermination()
    batches = s.createDataFrame([tuple(v[m] for m in metrics) for v in seen.values()], "documents long, chars long, long long, most long")  # one row a batch
    return batches.agg(*[(F.max if m == "most" else F.sum)(m).alias(m) for m in metrics])
