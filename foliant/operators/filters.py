"""Projections, filters and predicates over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def list_documents(docs: DataFrame, document_type: str | None = None, sender_like: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of documents, newest first, id breaking ties; filters come before paging."""
    if document_type:
        docs = docs.where(F.col("document_type") == document_type)
    if sender_like:
        docs = docs.where(F.col("sender").contains(sender_like))
    return docs.orderBy(F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def select_documents(docs: DataFrame, document_type: str | None = None, min_conf: float | None = None, max_conf: float | None = None, date_from=None, date_to=None) -> DataFrame:
    """Conjunction of the given bounds, all inclusive; a null confidence counts as 0."""
    conf = F.coalesce("ai_confidence", F.lit(0.0))
    tests = [
        F.col("document_type") == document_type if document_type else None,
        conf >= min_conf if min_conf is not None else None,
        conf <= max_conf if max_conf is not None else None,
        F.col("created_at") >= F.lit(date_from).cast("timestamp") if date_from else None,
        F.col("created_at") <= F.lit(date_to).cast("timestamp") if date_to else None,
    ]
    for t in tests:
        docs = docs if t is None else docs.where(t)
    return docs


def filter_attachments(files: DataFrame, date_from=None, date_to=None, ext: str | None = None, sender: str | None = None, subject: str | None = None) -> DataFrame:
    """date_to covers its whole day; contains is case-insensitive; ext follows the last dot."""
    if date_from:
        files = files.where(F.col("date") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        files = files.where(F.col("date") < F.date_add(F.lit(date_to).cast("date"), 1))
    if ext:
        files = files.where(extension(F.col("filename")) == ext.lower())
    for column, part in (("sender", sender), ("subject", subject)):
        if part:
            files = files.where(F.lower(column).contains(part.lower()))
    return files


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def in_date_range(df: DataFrame, column: str, date_from: str, keep_unparsable: bool) -> DataFrame:
    """Rows at or after date_from; dates without zone are UTC; others as keep_unparsable says."""
    return df.where(F.coalesce(F.try_to_timestamp(F.col(column)) >= F.lit(date_from).cast("timestamp"), F.lit(keep_unparsable)))


def address_keys(sender: Column) -> Column:
    """The lower-cased address and its domain."""
    low = F.lower(F.trim(sender))
    return F.array(low, F.element_at(F.split(low, "@"), -1))


def tag_listed(df: DataFrame, deny: DataFrame, allow: DataFrame) -> DataFrame:
    """denied and allowed flags: the sender's address or its domain is in the list (column entry).

    Distinct senders are matched, so that the lists join few rows and may be of any size.
    """
    senders = df.where("sender is not null").select("sender").distinct()
    keys = senders.select("sender", F.explode(address_keys(F.col("sender"))).alias("entry")).distinct()
    both = deny.select(F.lower("entry").alias("entry"), F.lit(1).alias("d"), F.lit(0).alias("a")).unionByName(allow.select(F.lower("entry").alias("entry"), F.lit(0).alias("d"), F.lit(1).alias("a")))
    flags = keys.join(both, "entry").groupBy("sender").agg((F.max("d") == 1).alias("denied"), (F.max("a") == 1).alias("allowed"))
    out = df.join(flags, "sender", "left")
    return out.withColumn("denied", F.coalesce("denied", F.lit(False))).withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def exclude_listed(df: DataFrame, deny: DataFrame) -> DataFrame:
    return tag_listed(df, deny, deny.limit(0)).where(~F.col("denied")).drop("denied", "allowed")


def update_lists(classified: DataFrame, deny: DataFrame, allow: DataFrame) -> DataFrame:
    """The lists (entry, list) after new verdicts: ads over 0.8 deny, trusted types over 0.9 allow.

    The latest verdict of a sender counts. A sender already in a list is skipped; joining one list
    leaves the other.
    """
    verdict = F.when((F.col("document_type") == "advert") & (F.col("confidence") > 0.8), "deny").when(F.col("document_type").isin("invoice", "receipt", "statement") & (F.col("confidence") > 0.9), "allow")
    rows = classified.where("sender is not null").select(F.lower("sender").alias("entry"), verdict.alias("list"), "date", "doc_id").where("list is not null")
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("date"), F.desc("doc_id")))).where("_n = 1").select("entry", "list")
    old = deny.select(F.lower("entry").alias("entry"), F.lit("deny").alias("list")).unionByName(allow.select(F.lower("entry").alias("entry"), F.lit("allow").alias("list")))
    fresh = latest.join(old, ["entry", "list"], "left_anti")
    return old.join(fresh.select("entry"), "entry", "left_anti").unionByName(fresh)


#: Senders and subjects of system notifications, and words of marketing; fixed values.
NOTIFIERS = [r"noreply@.*loxone", r"no-reply@", r"noreply@", r"donotreply@", r"notification@", r"alert@", r"system@", r"automat.*@", r"robot@", r"synology", r"diskstation"]
NOTICES = [r"^statistic", r"^alert:", r"^notification:", r"automatick[áé]", r"systémov[áé]", r"loxone", r"miniserver", r"^\[192\.168\."]
MARKETING = ["unsubscribe", "newsletter", "marketing", "promo", "discount", "sale", "offer", "sleva", "akce", "odhlásit", "reklama"]


def is_system_notification(sender: Column, subject: Column, senders: list[str] = NOTIFIERS, subjects: list[str] = NOTICES) -> Column:
    any_of = lambda c, ps: F.coalesce(c.rlike("(?iu)" + "|".join(f"(?:{p})" for p in ps)), F.lit(False))
    return any_of(sender, senders) | any_of(subject, subjects)


def is_marketing(*texts: Column, keywords: list[str] = MARKETING) -> Column:
    joined = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(False)
    for k in keywords:
        out = out | joined.contains(k)
    return out


def is_gibberish(text: Column) -> Column:
    """Empty, or fewer than half of the characters other than blanks are letters or digits."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.coalesce(alnum < 0.5 * solid, F.lit(True)) | F.coalesce(solid == 0, F.lit(True))


def is_good_text(confidence: Column, text: Column, min_confidence: float = 60, min_length: int = 50) -> Column:
    return F.coalesce((confidence >= min_confidence) & (F.length(text) >= min_length), F.lit(False)) & ~is_gibberish(text)


def needs_metadata(docs: DataFrame, types: list[str], min_length: int = 100) -> DataFrame:
    """Documents of the types with a text long enough and no amount in their JSON metadata."""
    return docs.where(F.col("document_type").isin(types) & (F.length("text") > min_length) & F.get_json_object("metadata", "$.amount").isNull())


def work_queue(docs: DataFrame, flag: str, wanted: bool, first: str = "created_at") -> DataFrame:
    """Documents whose flag is (or, null or false, isn't) set: by sender, newest first."""
    return docs.where(F.coalesce(flag, F.lit(False)) == wanted).orderBy("sender", F.desc(first), "doc_id")


def split_by_length(docs: DataFrame, n: int) -> DataFrame:
    """status ok or failed and the reason for texts shorter than n characters."""
    short = F.coalesce(F.length(F.trim("text")) < n, F.lit(True))
    return docs.withColumn("status", F.when(short, "failed").otherwise("ok")).withColumn("reason", F.when(short, F.lit(f"text shorter than {n} characters")))


def supported_ext(files: DataFrame, allowed: list[str]) -> DataFrame:
    return files.where(extension(F.col("filename")).isin([a.lower().lstrip(".") for a in allowed]))


def untagged(docs: DataFrame) -> DataFrame:
    """No tags and no type, newest first."""
    return docs.where((F.coalesce(F.size("tags"), F.lit(0)) <= 0) & F.col("document_type").isNull()).orderBy(F.desc("created_at"), "doc_id")


def deterministic_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def unprocessed(all_items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_items.join(done.select(key).distinct(), key, "left_anti")


def retryable(progress: DataFrame, most: int = 3) -> DataFrame:
    return progress.where((F.col("status") == "failed") & (F.col("retry_count") < most)).orderBy(F.desc("updated_at"), "file_hash")
