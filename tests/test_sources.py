"""Files written by the tests and read back."""

import json

from pyspark.sql import functions as F

from foliant.sources import readers as R
from foliant.sources import writers as W

MAIL = b"From: A <a@x.cz>\r\nSubject: Hi\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nbody\r\n--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\n" + b"x" * 150 + b"\r\n--b--\r\n"


def test_messages(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MAIL)
    (tmp_path / "b.eml").write_bytes(b"\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in R.read_messages(spark, str(tmp_path)).collect()}
    assert got["a.eml"]["subject"] == "Hi" and got["a.eml"]["attachments"][0]["size"] == 150
    assert got["b.eml"]["subject"] is None and got["b.eml"]["attachments"] == []
    assert R.explode_attachments(R.read_messages(spark, str(tmp_path))).count() == 1


def test_mbox(spark, tmp_path):
    (tmp_path / "box").write_bytes(b"From a Mon\n" + MAIL.replace(b"\r\n", b"\n") + b"\nFrom b Tue\nSubject: Two\n\nhello\n")
    assert sorted(r["subject"] for r in R.read_mbox(spark, str(tmp_path / "box")).collect()) == ["Hi", "Two"]


def test_inventory_and_results(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.PDF").write_bytes(b"x" * 2000)
    (tmp_path / "f/b.pdf").write_bytes(b"x" * 10)
    (tmp_path / "f/c.txt").write_bytes(b"x" * 2000)
    got = R.file_inventory(spark, str(tmp_path / "f"), [".pdf"], "local").collect()
    assert len(got) == 1 and got[0]["size"] == 2000 and got[0]["location"] == "local"
    (tmp_path / "instance_7.json").write_text(json.dumps({"results": [{"doc_id": 1, "document_type": "invoice", "success": True}]}))
    assert [(r["instance"], r["doc_id"]) for r in R.read_results(spark, str(tmp_path / "instance_*.json")).collect()] == [("7", 1)]
    (tmp_path / "failed.jsonl").write_text('{"email_id":"e","reason":"short"}\n')
    assert R.read_failures(spark, str(tmp_path / "failed.jsonl")).first()["reason"] == "short"


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "invoice", '{"a":"1"}', "2024-01-01"), (2, "order", None, "2024-02-01")], "doc_id long, document_type string, metadata string, created_at string")
    W.write_json(docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("metadata.a = '1'").count() == 1
    W.write_csv(docs, str(tmp_path / "c"), ["doc_id", "document_type"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["doc_id", "document_type"]
    W.write_by_type(docs, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where(F.col("document_type") == "order").count() == 1


def test_upsert_keeps_newest(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, v string, version int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id long, v string, version int")
    assert sorted((r["id"], r["v"]) for r in W.upsert(base, new, ["id"], "version").collect()) == [(1, "c"), (2, "b"), (3, "e")]


def test_statements_in_any_encoding(spark, tmp_path):
    text = "Příkaz – žluťoučký kůň €"
    for name, raw in {"a": text.encode(), "b": text.encode("utf-16"), "c": text.encode("cp1250"), "d": b"\xef\xbb\xbf" + text.encode(), "e": b""}.items():
        (tmp_path / f"{name}.sta").write_bytes(raw)
    got = {r["path"][-5]: (r["content"], r["encoding"]) for r in R.read_statements(spark, str(tmp_path), "*.sta").collect()}
    assert got == {"a": (text, "utf-8"), "b": (text, "utf-16"), "c": (text, "windows-1250"), "d": (text, "utf-8")}  # Spark's reader passes over e, which is empty
    odd = R.decode_texts(spark.createDataFrame([("x", None), ("y", bytearray())], "path string, content binary"))
    assert {r["path"]: (r["content"], r["encoding"]) for r in odd.collect()} == {"x": (None, None), "y": ("", "utf-8")}


ODD = [
    b"From: Jan   <a@x.cz>\r\nSubject: two  blanks\r\n\r\nbody",
    b'From: "Novak, Jan" <a@x.cz>, b@x.cz\r\nTo: <c@x.cz>\r\nSubject: =?utf-8?q?P=C5=99=C3=ADkaz?= x\r\nDate: Mon, 1 Jan 2024 10:00:00 +0100\r\nMessage-ID: <1@x.cz>\r\n\r\nbody',
    b"From: a@x.cz\nSubject: folded\n over lines\nContent-Type: text/plain; charset=iso-8859-2\n\n\xf8\xe1d",
    b"Subject: \r\nFrom: =?utf-8?b?xaA=?= <s@x.cz>\r\n\r\n",
    b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: application/pdf; name=\"=?utf-8?q?=C5=99.pdf?=\"\r\nContent-Transfer-Encoding: BASE64\r\n\r\n" + b"eHh4" * 50 + b"\r\n--b\r\nContent-Disposition: attachment; filename*=utf-8''%C5%99.pdf\r\n\r\n" + b"y" * 120 + b"\r\n--b\r\nContent-Disposition: inline; filename=a.b-c.txt\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n" + b"=41" * 130 + b"\r\n--b--",
    b"Subject: \xc5\x99\xc3\xa1d\r\nFrom: a..b@x.cz\r\nContent-Type: text\r\n\r\nbody",
]


def test_plain_headers_as_by_the_default_policy(monkeypatch):
    """Plain headers aren't parsed by the default policy, and give what it would give."""
    from email import policy

    for raw in [MAIL, *ODD]:
        quick = R._parse("p", raw, R.KEPT, 100)
        with monkeypatch.context() as m:
            m.setattr(R, "POLICY", policy.default)
            assert R._parse("p", raw, R.KEPT, 100) == quick
    seen = []
    monkeypatch.setattr(policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: seen.append(name) or value)
    R._parse("p", MAIL, R.KEPT, 100)
    assert not seen


def test_messages_of_orders_in_many_tasks(spark):
    from foliant.plans.q_sources import mails

    assert mails(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_statement_readers_open_their_own_files_only(spark):
    from foliant.operators import statements as B

    files = spark.createDataFrame([("a", "074\n075" + "0" * 16 + "0800" + "0" * 25 + "000000012345" + "2" + "0" * 24 + "240131"), ("b", "Datum;Částka\n01.02.2024;-5,00"), ("c", "note")], "path string, content string")
    tx = B.read_transactions(files)
    assert {(r["path"], r["format"], str(r["amount"])) for r in tx.collect()} == {("a", "ABO", "123.45"), ("b", "CSV", "-5.00")}
    plan = tx._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(format") == 5


def test_mixed_statements_read_lines_once(spark, sf):
    from foliant.plans.q_orders import mixed

    plan = mixed(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and plan.count("Relation [l_orderkey") == 1


def test_last_lines_need_no_search(spark, sf):
    from foliant import plans
    from foliant.functions.values import last_line

    texts = ["a" * 2_000_000 + "\nend", "one line", "a\nb\n", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", last_line(F.col("text")).alias("line"))
    assert [r["line"] for r in rows.orderBy("n").collect()] == ["end", "one line", "", "", None]
    plan = plans.QUERIES["s7_read_statements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan
