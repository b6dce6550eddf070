"""Sources: mail files, file inventories, result and failure JSON, exports, statements, catalogs.

All reading goes through Spark's readers, so that any store Spark can open will do.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "path string, message_id string, sender string, recipient string, subject string, date string, body string, attachments array<struct<filename: string, ext: string, size: long, md5: string>>"
#: Extensions of attachments that are kept, and the least payload in bytes.
KEPT = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".xml", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".isdoc", ".txt")
LEAST_PAYLOAD = 100


#: Header values that the default policy gives back as they stand, by lower-cased name; parsing any takes a fraction of a millisecond.
_ATOM = r"[A-Za-z0-9_+-]+"
_ADDRESS = re.compile(rf"{_ATOM}(?:\.{_ATOM})*@{_ATOM}(?:\.{_ATOM})*|[A-Za-z]+(?: [A-Za-z]+)* <{_ATOM}(?:\.{_ATOM})*@{_ATOM}(?:\.{_ATOM})*>")
_PARAMETERS = rf"(?:; [a-z]+={_ATOM}(?:\.{_ATOM})*)*"
PLAIN = {
    "from": _ADDRESS,
    "to": _ADDRESS,
    "subject": re.compile(r"[!-~]+(?: [!-~]+)*"),
    "content-type": re.compile(rf"[a-z]+/[a-z0-9.+-]+{_PARAMETERS}"),
    "content-disposition": re.compile(rf"(?:attachment|inline){_PARAMETERS}"),
    "content-transfer-encoding": re.compile("7bit|8bit|base64|quoted-printable"),
}


class _Policy(email.policy.EmailPolicy):
    """The default policy, which takes plain headers as they stand."""

    def header_fetch_parse(self, name: str, value: str):
        plain = PLAIN.get(name.lower())
        if plain is not None and not hasattr(value, "name") and plain.fullmatch(value) and "=?" not in value:
            return value
        return super().header_fetch_parse(name, value)


POLICY = _Policy()


def _parse(path: str, raw: bytes, kept: tuple[str, ...], least: int) -> tuple:
    m = email.message_from_bytes(raw, policy=POLICY)
    body, files = "", []
    for part in m.walk():
        if part.is_multipart():
            continue
        data = part.get_payload(decode=True) or b""
        name = part.get_filename()
        if name:
            ext = os.path.splitext(name)[1].lower()
            if ext in kept and len(data) >= least:
                files.append({"filename": name, "ext": ext, "size": len(data), "md5": hashlib.md5(data, usedforsecurity=False).hexdigest()})
        elif not body and part.get_content_type() == "text/plain":
            body = data.decode(part.get_content_charset() or "utf-8", "replace")
    head = lambda k: str(m.get(k) or "") or None
    return path, head("Message-ID"), (head("From") or "")[:100] or None, head("To"), (head("Subject") or "")[:200] or None, head("Date"), body, files


def parse_messages(files: DataFrame, kept: tuple[str, ...] = KEPT, least: int = LEAST_PAYLOAD) -> DataFrame:
    """files (path, content binary) -> one row a message with its attachments' names, sizes and hashes.

    Sender and subject are cut at 100 and 200 characters. What can't be parsed gives a row of nulls.
    Messages are parsed in the partitions that files has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MESSAGE.split(", ")[:7]] + ["attachments"]
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    out.append(_parse(path, bytes(raw or b""), kept, least))
                except (ValueError, LookupError, KeyError):
                    out.append((path, None, None, None, None, None, None, []))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def read_messages(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    return parse_messages(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files, split by Spark at the lines that begin with 'From '."""
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^(?:From )?[^\n]*\n", "").cast("binary").alias("content"))
    return parse_messages(lines.where(F.length("content") > 0))


def explode_attachments(messages: DataFrame) -> DataFrame:
    """One row an attachment with the sender, subject and date of its message."""
    return messages.select("path", "sender", "subject", "date", F.explode("attachments").alias("a")).select("path", "sender", "subject", "date", "a.*")


def file_inventory(spark: SparkSession, path: str, exts: list[str], location: str, min_size: int = 1024) -> DataFrame:
    """(path, location, size, modified, hash) of files with the extensions; hidden ones skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in exts])
    shown = ~F.regexp_extract("path", "([^/]+)$", 1).startswith(".")
    return files.where((F.col("length") >= min_size) & wanted & shown).select("path", F.lit(location).alias("location"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("hash"))


RESULT = "instance string, results array<struct<doc_id: long, document_type: string, success: boolean, confidence: double, fields: map<string,string>>>"


def read_results(spark: SparkSession, glob: str, whole_files: bool = True) -> DataFrame:
    """Result files of all instances, their results exploded; the instance from the file's name if it isn't stated.

    A file is one object, or, without whole_files, one object a line.
    """
    files = spark.read.schema(RESULT).json(glob, multiLine=whole_files)
    named = F.coalesce("instance", F.regexp_extract(F.col("_metadata.file_path"), r"instance_?(\w+)", 1))
    return files.select(named.alias("instance"), F.explode("results").alias("r")).select("instance", "r.*")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("email_id string, reason string, ts timestamp, metadata map<string,string>").json(path)


def read_whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) for statement files and order exports."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


#: Bytes of 128 and above in windows-1250, as characters of ISO 8859-1 and what they stand for.
_HIGH = [(bytes([k]).decode("latin-1"), bytes([k]).decode("cp1250", "replace")) for k in range(128, 256)]
LATIN, CP1250 = ("".join(x) for x in zip(*_HIGH, strict=True))


def decode_texts(files: DataFrame) -> DataFrame:
    """(path, content, encoding) of files (path, content binary): UTF-16 by its mark, else UTF-8 if valid, else windows-1250.

    Marks of byte order don't stay in the text; a null content stays null, with a null encoding.
    """
    raw = F.col("content")
    text = raw.cast("string")
    starts = lambda mark: F.hex(F.substring(raw, 1, len(mark))) == mark.hex().upper()
    found = files.select("path", "content", F.when(raw.isNull(), None).when(starts(b"\xff\xfe") | starts(b"\xfe\xff"), "utf-16").when(F.is_valid_utf8(text), "utf-8").otherwise("windows-1250").alias("encoding"))
    utf8 = F.when(starts(b"\xef\xbb\xbf"), F.substring(raw, 4, 2**31 - 1)).otherwise(raw).cast("string")
    latin = F.translate(F.decode(raw, "ISO-8859-1"), LATIN, CP1250)
    content = F.when(F.col("encoding") == "utf-16", F.decode(raw, "UTF-16")).when(F.col("encoding") == "utf-8", utf8).when(F.col("encoding").isNotNull(), latin)
    return found.select("path", content.alias("content"), "encoding")


def read_statements(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, encoding) of statement files in a folder and those below it, whatever their encoding; empty files give no row."""
    return decode_texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))


CATALOG = ("documents", "tags", "correspondents", "types", "custom_fields", "field_instances", "storage_paths", "document_tags")


def catalog_tables(spark: SparkSession, path: str, names: tuple[str, ...] = CATALOG) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
