"""Reports: grouped and conditional aggregates over document, run and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.sources.staging import once


def stats_by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy("document_type").agg(F.count("*").alias("n"), F.round(F.avg("ai_confidence"), 2).alias("confidence")).orderBy(F.desc("n"), "document_type")


def overall_confidence(docs: DataFrame) -> DataFrame:
    """Averages of both confidences, null as 0."""
    return docs.agg(F.avg(F.coalesce("ai_confidence", F.lit(0.0))).alias("ai"), F.avg(F.coalesce("ocr_confidence", F.lit(0.0))).alias("ocr"))


def stats_by_json_attr(docs: DataFrame, path: str) -> DataFrame:
    return docs.select(F.get_json_object("metadata", path).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def timeline(rows: DataFrame, ts: str, unit: str = "hour", n: int = 24) -> DataFrame:
    """Counts for each hour (or other unit), the newest n."""
    return rows.groupBy(F.date_trunc(unit, ts).alias("slot")).agg(F.count("*").alias("n")).orderBy(F.desc("slot")).limit(n)


def group_by_sender(docs: DataFrame) -> DataFrame:
    """Per sender (null: Unknown) the documents, those without type, and the distinct types in order."""
    g = docs.groupBy(F.coalesce("sender", F.lit("Unknown")).alias("sender"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("document_type").isNull()).alias("unclassified"), F.array_join(F.array_sort(F.collect_set("document_type")), ",").alias("types"))


def database_stats(docs: DataFrame, training: DataFrame) -> DataFrame:
    one = docs.agg(F.count("*").alias("documents"), F.count_if("synced").alias("synced"), F.countDistinct("document_type").alias("types"))
    return one.crossJoin(training.agg(F.count("*").alias("training")))  # one row each


def documents_by_type(docs: DataFrame) -> DataFrame:
    """(document_type, n, synced) with untyped documents as a type of their own."""
    return docs.groupBy("document_type").agg(F.count("*").alias("n"), F.count_if("synced").alias("synced"))


def histogram(docs: DataFrame, value: Column, edges: list[float], labels: list[str]) -> DataFrame:
    """(bin, n): bins close at each edge; labels has one entry more than edges; null in no bin."""
    bin_ = F.lit(labels[-1])
    for edge, label in zip(reversed(edges), reversed(labels[:-1]), strict=True):
        bin_ = F.when(value <= edge, label).otherwise(bin_)
    return docs.where(value.isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def failure_taxonomy(results: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """(failure, n): non-exclusive classes of failure."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in classes.items()]))
    return results.select(F.explode(found).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def _at_rank(rows: DataFrame, rank: int, bins: int, few: int) -> float:
    """The value x of rows (x) at this rank from 0, by passes that count in bins and keep the bin of the rank."""
    while True:
        finite = F.when(F.abs("x") < float("inf"), F.col("x"))
        n, least, most, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min(finite), F.max(finite)).first()
        if least == most:
            return least
        if n <= few:
            return sorted(r["x"] for r in rows.collect())[rank]  # at most few
        bin_ = F.when(F.col("x") <= low, 0).when(F.col("x") >= high, bins - 1).otherwise(F.floor((F.col("x") - low) / (high - low) * bins).cast("int"))
        bin_ = F.least(F.greatest(bin_, F.lit(0)), F.lit(bins - 1))
        for b, m in sorted(tuple(r) for r in rows.groupBy(bin_.alias("b")).count().collect()):  # at most bins rows
            if rank < m:
                break
            rank -= m
        rows = rows.where(bin_ == b)


def exact_median(results: DataFrame, value: str, bins: int = 4096, few: int = 10_000) -> float | None:
    """The middle value, or the mean of the two middle ones; nulls and NaN are left out, null if there is none.

    Each pass counts values in bins and narrows to the middle one, so no task holds all values; passes are
    as many as it takes to get the middle bin to ``few`` rows, whose values the driver sorts.
    """
    rows = results.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = rows.count()
    if not n:
        return None
    low = _at_rank(rows, (n - 1) // 2, bins, few)
    return low if n % 2 else (low + _at_rank(rows, n // 2, bins, few)) / 2


def time_stats(results: DataFrame, seconds: str, slow: float = 100) -> DataFrame:
    """One row: mean, exact median, least, most and the number of slow items. The median's passes run when this is called."""
    median = exact_median(results, seconds)
    return results.agg(F.avg(seconds).alias("mean"), F.lit(median).cast("double").alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.count_if(F.col(seconds) > slow).alias("slow"))


def slow_items(results: DataFrame, seconds: str, slow: float = 100) -> DataFrame:
    """The items that took longer, slowest first."""
    return results.where(F.col(seconds) > slow).orderBy(F.desc(seconds))


def funnel(results: DataFrame, stages: list[str]) -> DataFrame:
    """Counts of each boolean stage by type with a total row (type null), and rates to the stage before."""
    aggs = [F.count("*").alias("classified"), *[F.count_if(s).alias(s) for s in stages]]
    out = results.rollup("document_type").agg(F.grouping("document_type").alias("is_total"), *aggs)
    before = ["classified", *stages[:-1]]
    return out.select("document_type", (F.col("is_total") == 1).alias("is_total"), "classified", *stages, *[F.round(F.try_divide(F.col(s), F.col(b)), 4).alias(f"{s}_rate") for s, b in zip(stages, before, strict=True)])


def quick_wins(metrics: DataFrame, rules: list[tuple[str, str, float, int]]) -> DataFrame:
    """(advice, metric, value, priority) of rules (metric, advice, least, priority) that metrics (metric, value) exceed."""
    table = metrics.sparkSession.createDataFrame(rules, "metric string, advice string, least double, priority int")
    return metrics.join(F.broadcast(table), "metric").where("value > least").select("advice", "metric", "value", "priority").orderBy("priority", "metric")


def consensus_stats(results: DataFrame, by: str) -> DataFrame:
    return results.groupBy(by).agg(F.count("*").alias("n"), F.count_if("consensus").alias("agreed"), F.round(F.try_divide(F.count_if("consensus"), F.count("*")), 4).alias("rate"), F.round(F.avg("ms"), 4).alias("ms"))


def by_extension(files: DataFrame, name: Column) -> DataFrame:
    from .filters import extension

    return files.groupBy(extension(name).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext")


def top_folders(files: DataFrame, folder: Column, k: int = 20) -> DataFrame:
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(k)


def cascade_stats(attempts: DataFrame) -> DataFrame:
    """One row over attempts_used: how many took 1, 2, 3 or 4 attempts, the average, first-try share, speed-up 4n / sum."""
    used = F.col("attempts_used")
    return attempts.agg(*[F.count_if(used == k).alias(f"took_{k}") for k in (1, 2, 3, 4)], F.avg(used).alias("mean"), F.try_divide(F.count_if(used == 1), F.count("*")).alias("first_try"), F.try_divide(4 * F.count("*"), F.sum(used)).alias("speed_up"))


def run_rollup(runs: DataFrame) -> DataFrame:
    """(instance, processed, failed, started, running, by_type): counters of runs summed, type maps merged."""
    own = runs.groupBy("instance").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.min("start_time").alias("started"), F.max(F.col("end_time").isNull()).alias("running"))
    types = runs.select("instance", F.explode("by_type").alias("type", "n")).groupBy("instance", "type").agg(F.sum("n").alias("n"))
    merged = types.groupBy("instance").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    return own.join(merged, "instance", "left")


def progress_rates(total: Column, done: Column, failed: Column) -> list[Column]:
    one = F.lit(1)
    return [F.round(100 * done / F.greatest(one, total), 2).alias("percent_done"), F.round(100 * (done - failed) / F.greatest(one, done), 2).alias("percent_ok")]


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("stage", "error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage", "error_type")


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), "run_id").limit(n)


def session_stats(progress: DataFrame, sessions: DataFrame) -> DataFrame:
    p = progress.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.try_divide(F.count_if(F.col("status") == "completed"), F.count("*")), 4).alias("success_rate"))
    return p.crossJoin(sessions.agg(F.count("*").alias("sessions"), F.count_if(F.col("end_time").isNull()).alias("crashed")))  # one row each


def last_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    """The n sessions (run_id, start_time, end_time, processed, failed) started last, with their status."""
    status = F.when(F.col("end_time").isNull(), "running").otherwise("completed")
    return recent_runs(sessions.select("run_id", "start_time", "end_time", "processed", "failed", status.alias("status")), n)


def compare_extractions(local: DataFrame, model: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Per model the shares of documents whose item count and total (within 0.01) agree with the local ones.

    With codes, columns of fiscal codes, also code_accuracy: the share of documents all of whose codes agree;
    codes that both lack agree.
    """
    codes = codes or []
    both = local.join(model.select("doc_id", "model", *[F.col(c).alias(f"m_{c}") for c in ("item_count", "total", *codes)]), "doc_id")
    share = lambda same, name: F.round(F.avg(same.cast("int")), 4).alias(name)
    agree = [share(F.col("item_count") == F.col("m_item_count"), "count_accuracy"), share(F.abs(F.col("total") - F.col("m_total")) <= 0.01, "total_accuracy")]
    if codes:
        same = F.lit(True)
        for c in codes:
            same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
        agree.append(share(same, "code_accuracy"))
    return both.groupBy("model").agg(F.count("*").alias("n"), *agree)


def classifier_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(expected, predicted, n, confidence): confusion counts."""
    return predicted.join(truth, "doc_id").groupBy("expected", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def accuracy_by_label(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(expected, n, incorrect, accuracy, confidence) of each expected label, and of all with is_total."""
    both = predicted.join(truth, "doc_id").withColumn("ok", F.col("expected").eqNullSafe(F.col("predicted")).cast("int"))
    out = both.rollup("expected").agg(F.grouping("expected").alias("g"), F.count("*").alias("n"), F.sum(1 - F.col("ok")).alias("incorrect"), F.round(F.avg("ok"), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return out.withColumn("is_total", F.col("g") == 1).drop("g")


def classifier_throughput(runs: DataFrame) -> DataFrame:
    """(method, processed, errors, elapsed, mean, least, most, rate): runs of each method, shortest in all first."""
    g = runs.groupBy("method").agg(F.sum("processed").alias("processed"), F.sum("errors").alias("errors"), F.sum("elapsed").alias("elapsed"), F.round(F.avg("elapsed"), 4).alias("mean"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"))
    return g.withColumn("rate", F.round(F.try_divide("processed", "elapsed"), 4)).orderBy("elapsed")


def override_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("first").agg(F.count("*").alias("n"), F.count_if(F.col("first") != F.col("second")).alias("changed"), F.count_if(F.col("second").isNull()).alias("skipped"))


def learned_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("document_type").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 4).alias("strength"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def corpus_index(docs: DataFrame, columns: list[str], tags: str | None = None) -> DataFrame:
    """(facet, value, n) counts of each column and of exploded tags, from one scan."""
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    if tags:
        facets = F.concat(facets, F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    return docs.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def queue_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def active_workers(beats: DataFrame, as_of: str, seconds: int = 60) -> DataFrame:
    last = beats.groupBy("worker").agg(F.max("ts").alias("last_beat"))
    return last.where(F.col("last_beat") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"))


def folder_stats(marked: DataFrame) -> DataFrame:
    g = marked.groupBy("location").agg(F.count("*").alias("total"), F.count_if(~F.col("is_duplicate")).alias("copied"), F.count_if("is_duplicate").alias("duplicates"))
    return g.withColumn("duplicate_percent", F.round(100 * F.try_divide("duplicates", "total"), 2))


def merged_types(results: DataFrame) -> DataFrame:
    return results.groupBy("document_type").agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"))


def field_completeness(docs: DataFrame, required: list[str]) -> DataFrame:
    """(field, filled, rate) of the required fields, from one pass."""
    one = docs.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in required])
    return one.unpivot(["n"], required, "field", "filled").select("field", "filled", F.round(F.try_divide("filled", "n"), 4).alias("rate"))


def completeness_buckets(docs: DataFrame, required: list[str]) -> DataFrame:
    """(bucket, n): documents by the share of required fields that they have: none, under half, half or more, all."""
    share = sum((F.col(c).isNotNull().cast("int") for c in required), F.lit(0)) / len(required)
    bucket = F.when(share == 0, "none").when(share < 0.5, "under half").when(share < 1, "half or more").otherwise("all")
    return docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def least_complete(docs: DataFrame, required: list[str], k: int = 20) -> DataFrame:
    score = sum((F.col(c).isNotNull().cast("int") for c in required), F.lit(0))
    return docs.select("doc_id", score.alias("filled"), F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])), ",").alias("missing")).orderBy("filled", "doc_id").limit(k)


def normalized_type_counts(docs: DataFrame, synonyms: dict[str, str], default: str = "other") -> DataFrame:
    name = F.element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), F.lower("document_type"))
    return docs.groupBy(F.coalesce(name, F.lit(default)).alias("type")).agg(F.count("*").alias("n"))


def compare_runs(base: DataFrame, variant: DataFrame, seconds: str) -> DataFrame:
    a, b = base.agg(F.sum(seconds).alias("base")), variant.agg(F.sum(seconds).alias("variant"))
    both = a.crossJoin(b)  # one row each
    return both.select("base", "variant", F.round(F.try_divide("base", "variant"), 4).alias("speed_up"), F.round(100 * F.try_divide(F.col("base") - F.col("variant"), F.col("base")), 4).alias("saved_percent"))


def retry_counts(attempts: DataFrame, key: str, order: list) -> DataFrame:
    """attempts with the number of failures of their key so far."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return attempts.withColumn("retry_count", F.sum(F.col("failed").cast("int")).over(own))


def balanced_ranges(counts: DataFrame, key: str, workers: int, blocks: int = 256) -> DataFrame:
    """(worker, first, last, n) of contiguous ranges of key, the remainder to the last worker.

    counts is key (a number or date) and n rows of it, already aggregated; ranges fall on key
    boundaries of the running count. Keys are put in blocks by approximate quantiles; the running
    count is that over the blocks before, so that no task sees all keys. The quantiles of many keys
    depend on the order in which tasks end, so they are computed once and staged.
    """
    cuts = once(counts.agg(F.percentile_approx(key, [k / blocks for k in range(1, blocks)], 10_000).alias("cuts"), F.sum("n").alias("total")))
    at = counts.crossJoin(F.broadcast(cuts)).withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col(key)))).drop("cuts")  # cuts is one row
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("block").agg(F.sum("n").alias("of_block"))
    starts = sums.select("block", F.coalesce(F.sum("of_block").over(earlier(Window.orderBy("block"))), F.lit(0)).alias("start"))  # at most ``blocks`` rows
    run = at.join(F.broadcast(starts), "block").withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(earlier(Window.partitionBy("block").orderBy(key))), F.lit(0)))
    size = F.greatest(F.floor(F.col("total") / workers), F.lit(1))
    placed = run.withColumn("worker", F.least(F.floor(F.col("before") / size), F.lit(workers - 1)).cast("int"))
    return placed.groupBy("worker").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.sum("n").alias("n"))
