"""Streams with availableNow give what the batch gives."""

import pandas as pd
from pyspark.sql import functions as F

from foliant.streaming import jobs

NOW = {"availableNow": True}


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(**NOW).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, rows, path, parts=2):
    rows.repartition(parts).write.mode("overwrite").parquet(str(path))
    return jobs.stream_documents(spark, str(path), rows.schema, files_per_batch=10)


def test_timeline(spark, sf, tmp_path):
    rows = events(spark, sf)
    got = run(jobs.stream_timeline(source(spark, rows, tmp_path / "in"), "ts"), tmp_path, "timeline")
    want = {(r["slot"], r["n"]) for r in rows.groupBy(F.date_trunc("hour", "ts").alias("slot")).agg(F.count("*").alias("n")).collect()}
    found = {(r["slot"], r["n"]) for r in got.collect()}
    assert found <= want and len(found) >= len(want) - 2


def test_dedup_and_upsert(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, version int, value string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    stream = source(spark, rows, tmp_path / "in")
    assert run(jobs.stream_dedup(stream, "key", "ts"), tmp_path, "dedup").count() == 2
    q = jobs.stream_upsert(source(spark, rows, tmp_path / "in2"), str(tmp_path / "out"), str(tmp_path / "c"), ["key"], "version", NOW)
    q.awaitTermination()
    assert {(r["key"], r["value"]) for r in jobs.current(spark, str(tmp_path / "out"), ["key"], "version").collect()} == {("a", "y"), ("b", "z")}


def test_new_only_of_several_queries(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for k, hashes in enumerate((["h1", "h1", "h2"], ["h1", "h2"], ["h2", "h3", "h3"])):  # each with a checkpoint of its own
        rows = spark.createDataFrame([(h, k) for h in hashes], "hash string, id int")
        jobs.stream_new_only(source(spark, rows, tmp_path / f"in{k}", 1), sink, str(tmp_path / f"c{k}"), "hash", NOW).awaitTermination()
    assert sorted((r["hash"], r["id"]) for r in spark.read.parquet(sink).collect()) == [("h1", 0), ("h2", 0), ("h3", 2)]


def test_upserts_of_two_queries(spark, tmp_path):
    for k, rows in enumerate(([("a", 1, "x"), ("b", 5, "y")], [("a", 2, "z"), ("b", 4, "w"), ("c", 1, "v")])):
        df = spark.createDataFrame(rows, "key string, version int, value string")
        jobs.stream_upsert(source(spark, df, tmp_path / f"in{k}", 1), str(tmp_path / "out"), str(tmp_path / f"c{k}"), ["key"], "version", NOW).awaitTermination()
    got = jobs.current(spark, str(tmp_path / "out"), ["key"], "version")
    assert got.columns == ["key", "version", "value"] and sorted(map(tuple, got.collect())) == [("a", 2, "z"), ("b", 5, "y"), ("c", 1, "v")]


def test_new_only_reads_the_buckets_it_touches(spark, tmp_path):
    sink = str(tmp_path / "sink")
    rows = spark.createDataFrame([(f"h{k}", k) for k in range(50)], "hash string, id int")
    jobs.stream_new_only(source(spark, rows, tmp_path / "in", 1), sink, str(tmp_path / "c"), "hash", NOW, 8).awaitTermination()
    found = jobs.archived(spark, sink, rows.schema)
    assert found.count() == 50 and {r[0] for r in found.select("bucket").distinct().collect()} == set(range(8))
    assert "PartitionFilters: [isnotnull(bucket" in found.where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    late = spark.createDataFrame([("h1", 0), ("new", 9), ("new", 7)], rows.schema)
    jobs.stream_new_only(source(spark, late, tmp_path / "in2", 1), sink, str(tmp_path / "c2"), "hash", NOW, 8).awaitTermination()
    assert sorted((r["hash"], r["id"]) for r in found.sparkSession.read.parquet(sink).where("hash in ('h1', 'new')").collect()) == [("h1", 1), ("new", 7)]


def test_compaction_changes_nothing(spark, tmp_path):
    sink = str(tmp_path / "out")
    for k in range(3):
        df = spark.createDataFrame([("a", k, f"x{k}"), (f"b{k}", 1, "y")], "key string, version int, value string")
        jobs.stream_upsert(source(spark, df, tmp_path / f"in{k}", 1), sink, str(tmp_path / f"c{k}"), ["key"], "version", NOW).awaitTermination()
    rows = lambda: sorted(map(tuple, jobs.current(spark, sink, ["key"], "version").collect()))
    before = rows()
    assert jobs.compact(spark, sink, ["key"], "version") == 3
    assert rows() == before and jobs.compact(spark, sink, ["key"], "version") == 0
    df = spark.createDataFrame([("a", 9, "late")], "key string, version int, value string")
    jobs.stream_upsert(source(spark, df, tmp_path / "in9", 1), sink, str(tmp_path / "c9"), ["key"], "version", NOW).awaitTermination()
    assert ("a", 9, "late") in rows() and len(rows()) == len(before)


def test_sender_context(spark, tmp_path):
    rows = spark.createDataFrame([("a", "invoice"), ("a", "invoice"), (None, "order")], "sender string, document_type string")
    got = run(jobs.stream_sender_context(source(spark, rows, tmp_path / "in", 1)), tmp_path, "context", "update").collect()
    assert [(r["sender"], r["n"]) for r in got] == [("a", 2)]


def test_retry_state(spark, tmp_path):
    rows = spark.createDataFrame([("f", "failed"), ("f", "failed"), ("g", "failed"), ("g", "failed"), ("g", "failed"), ("h", "done")], "file_hash string, status string")
    got = {r["file_hash"]: (r["retry_count"], r["retry"]) for r in run(jobs.stream_retry_state(source(spark, rows, tmp_path / "in", 1)), tmp_path, "retries", "update").collect()}
    assert got == {"f": (2, True), "g": (3, False), "h": (0, False)}


def test_stale_claims(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = spark.createDataFrame([("i", "w1", at(0), "claimed"), ("j", "w2", at(1), "claimed"), ("j", "w2", at(2), "done"), ("k", "w3", at(40), "claimed")], "item string, worker string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(jobs.stream_stale_claims(source(spark, rows, tmp_path / "in", 1)), tmp_path, "stale").collect()
    assert [(r["item"], r["worker"]) for r in got] == [("i", "w1")]


def test_sender_context_expires(spark, tmp_path):
    rows = [[("a", "invoice", f"2024-{m:02d}-05")] * 2 for m in (1, 3, 6)]
    schema = "sender string, document_type string, day string"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("day").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_documents(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        q = jobs.stream_sender_context(stream, "ts").writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(jobs.batch_folder(b, str(tmp_path / "out"), i)[1])).option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start()
        q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only the last period's count is held
    counts = jobs.current(spark, str(tmp_path / "out"), ["sender", "document_type", "since"], "batch")
    assert counts.agg(F.sum("n")).first()[0] == 6


def test_retry_state_expires(spark, tmp_path):
    got = []
    for k, day in enumerate(("2024-01-01", "2024-01-02", "2024-06-01", "2024-06-02")):
        spark.createDataFrame([("f" if k != 2 else "other", "failed", day)], "file_hash string, status string, day string").withColumn("ts", F.col("day").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_documents(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        q = jobs.stream_retry_state(stream, days=30).writeStream.outputMode("update").foreachBatch(lambda b, i: got.extend((r["file_hash"], r["retry_count"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(**NOW).start()
        q.awaitTermination()
    assert got == [("f", 1), ("f", 2), ("other", 1), ("f", 1)]


def test_stale_claims_between_rows_of_a_batch(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("i", "w1", at(0), "claimed"), ("i", "w2", at(20), "claimed"), ("i", "w2", at(25), "done"), ("k", "w3", at(25), "claimed"), ("k", "w3", None, "done")]
    df = spark.createDataFrame(rows, "item string, worker string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(jobs.stream_stale_claims(source(spark, df, tmp_path / "in", 1)), tmp_path, "stale_within").collect()
    assert [(r["item"], r["worker"]) for r in got] == [("i", "w1")]


def test_stale_claims_ask_the_state_little(spark):
    calls = []

    class Store:
        value, timers = None, {60_000 + 600_000}
        get = lambda self: calls.append("get") or self.value
        exists = lambda self: calls.append("exists") or self.value is not None
        update = lambda self, v: calls.append("update") or setattr(self, "value", v)
        clear = lambda self: calls.append("clear") or setattr(self, "value", None)
        getValueState = lambda self, *_: self
        listTimers = lambda self: calls.append("list") or iter(self.timers)
        registerTimer = lambda self, at: calls.append("register") or setattr(self, "timers", {*self.timers, at})
        deleteTimer = lambda self, at: calls.append("delete") or setattr(self, "timers", self.timers - {at})

    def heard(store, rows):
        calls.clear()
        claims = jobs.StaleClaims()
        claims.init(store)
        b = pd.DataFrame(rows, columns=["ts", "worker", "status"])
        b["ts"] = pd.to_datetime(b["ts"])
        return [tuple(r) for out in claims.handleInputRows(("i",), iter([b]), None) for r in out.itertuples(index=False)]

    new = Store()
    new.timers = set()
    assert heard(new, [("1970-01-01 00:01:00.000900", "b", "claimed"), ("1970-01-01 00:01:00.000100", "c", "done"), (None, "d", "done")]) == []
    assert new.value == ("b", 60_000) and new.timers == {660_000}  # the later by microseconds is the last
    assert len(calls) == 3 and "list" not in calls
    assert heard(new, [("1970-01-01 00:21:00", "e", "claimed")]) == [("i", "b", 60_000)]
    assert new.value == ("e", 1_260_000) and new.timers == {1_860_000}
    assert heard(new, [("1970-01-01 00:22:00", "e", "done")]) == [] and new.value is None and not new.timers


def test_statistics_of_each_batch(spark, tmp_path):
    rows, seen = spark.range(10), {}
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_documents(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
    jobs.stream_with_statistics(stream, str(tmp_path / "out"), str(tmp_path / "c"), {"n": F.count("*"), "most": F.max("id")}, seen.__setitem__, NOW).awaitTermination()
    assert len(seen) > 1 and sum(v["n"] for v in seen.values()) == 10 and max(v["most"] for v in seen.values()) == 9
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
