"""Literal fixtures for operators whose cases the corpus doesn't hold."""

import itertools
import os
import random
from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import names as N
from foliant.functions import values as V
from foliant.operators import classify as C
from foliant.operators import dedup as D
from foliant.operators import extensions as X
from foliant.operators import extract as E
from foliant.operators import learn
from foliant.operators import matching as M
from foliant.operators import rules as R
from foliant.operators import statements as B


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("1 234,56", "1234.56"), ("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("1 234,56", "1234.56"), ("-5,00", "-5.00"), ("12.5x", None), ("", None)])
def test_amounts(spark, raw, want):
    assert one(spark, V.normalize_amount(F.lit(raw))) == (Decimal(want) if want else None)


@pytest.mark.parametrize("raw, want", [("5.3.2024", date(2024, 3, 5)), ("2024-03-05", date(2024, 3, 5)), ("1.1.49", date(2049, 1, 1)), ("1.1.50", date(1950, 1, 1)), ("5. března 2024", date(2024, 3, 5)), ("31.02.2024", None), ("none", None)])
def test_dates(spark, raw, want):
    assert one(spark, V.normalize_date(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("Adobe Systems <mail@adobe.com>", "adobe systems"), ("★ Alza.cz", "alza"), ("ČEZ, a.s.", "čez"), ("LinkedIn News", "linkedin"), ("Report 12", "report"), (None, "")])
def test_names(spark, raw, want):
    assert one(spark, N.normalize_name(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("Firma spol. s r.o.", "firma"), ("Acme Pty Ltd", "acme"), ("Firma sp. z o.o.", "firma"), ("Shop.com Newsletter", "shop"), ("Deals Team GmbH", "deals"), ("Věstník č. 12 jaro", "věstník"), ("a_b-c (x)", "a_b-c x")])
def test_names_lose_all_endings(spark, raw, want):
    assert one(spark, N.normalize_name(F.lit(raw))) == want


def test_numbers_hold_a_digit(spark):
    docs = spark.createDataFrame([(1, "order", "OBJEDNÁVKA\nObjednávka č. PO-5"), (2, "order", "obj. 77/A"), (3, "invoice", "Daňový doklad: 2024001\nPO: X-9"), (4, "delivery_note", "DL: 55, objednávka zboží")], "doc_id long, document_type string, text string")
    got = {r["doc_id"]: r for r in E.extract_identifiers(docs).collect()}
    assert got[1]["order_number"] == "PO-5" and got[2]["order_number"] == "77/A"
    assert got[3]["invoice_number"] == "2024001" and got[3]["order_number"] == "X-9" and got[4]["delivery_note_number"] == "55" and got[4]["order_number"] is None


def test_context_boosts_and_thresholds(spark):
    docs = spark.createDataFrame([(1, "s", "Vaše faktura", "invoice", 0.55), (2, "s", "Re: x", "invoice", 0.55), (3, None, "SLEVA 50 %", "advert", 0.97)], "doc_id long, sender string, subject string, document_type string, ai_confidence double")
    none = spark.createDataFrame([], "sender string, subject string, document_type string, n long, threshold double")
    got = {r["doc_id"]: (round(r["boosted"], 6), r["below"]) for r in C.apply_context(docs, none.select("sender", "document_type", "n"), none.select("subject", "document_type", "n"), none.select("document_type", "threshold")).collect()}
    assert got == {1: (0.6, True), 2: (0.55, True), 3: (1.0, False)}


def test_many_rules_take_several_expressions(spark, monkeypatch):
    from foliant.operators import rules as R

    table = R.rules_table(spark, [("keyword", f"l{k % 7}", k, f"word{k:02d}", 1.0) for k in range(40)])
    docs = spark.createDataFrame([(1, "word01 word08 word15 word02"), (2, "word03 word10"), (3, "none"), (4, None)], "doc_id long, text string")
    want = {m: sorted(map(tuple, C.classify_keywords(docs, table, m).collect())) for m in ("ratio", "tiered")}
    assert want["tiered"] == [(1, "l1", 0.85), (2, "l3", 0.7), (3, "other", 0.2), (4, "other", 0.2)]
    monkeypatch.setattr(R, "MOST_FOLDED", 9)
    assert {m: sorted(map(tuple, C.classify_keywords(docs, table, m).collect())) for m in want} == want


def test_quoted_cells(spark):
    from foliant.operators import orders as O

    text = 'Order Number,Order Date,Title,ASIN,Quantity,Item Price\nA-1,5.3.2024,"Cable, black ""2 m""",B01,2,"1,234.50"\n'
    got = O.locale_values(O.read_orders(spark.createDataFrame([("f", text)], "path string, content string"))).collect()[0]
    assert (got["title"], got["asin"], got["quantity"], got["price"]) == ('Cable, black "2 m"', "B01", 2, Decimal("1234.50"))
    text = 'Datum;Částka;Popis\n5.3.2024;-3,50;"a; b"\n'
    got = B.csv_transactions(spark.createDataFrame([("f", text)], "path string, content string")).collect()[0]
    assert (got["description"], got["amount"]) == ("a; b", Decimal("-3.50"))


def test_camt_balances(spark):
    bal = lambda code, amt, kind: f"<Bal><Tp><CdOrPrtry><Cd>{code}</Cd></CdOrPrtry></Tp><Amt Ccy='CZK'>{amt}</Amt><CdtDbtInd>{kind}</CdtDbtInd><Dt><Dt>2024-01-05T00:00:00</Dt></Dt></Bal>"
    xml = "<Document xmlns=\"urn:camt.053\"><BkToCstmrStmt><Stmt><Id>S1</Id><Acct><Id><IBAN>CZ6508000000192000145399</IBAN></Id><Ccy>CZK</Ccy></Acct>" + bal("OPBD", "10.00", "CRDT") + bal("CLBD", "4.50", "DBIT") + "</Stmt></BkToCstmrStmt></Document>"
    got = B.camt_balances(spark.createDataFrame([("f", xml)], "path string, content string")).collect()[0]
    assert (got["bank_code"], got["account"], got["opening"], got["closing"], got["opening_date"]) == ("0800", "0000192000145399", Decimal("10.00"), Decimal("-4.50"), date(2024, 1, 5))
    totals = spark.createDataFrame([("f", Decimal("1.00")), ("g", Decimal("2.00"))], "path string, net_change decimal(18,2)")
    known = spark.createDataFrame([("f", Decimal("10.00"), None), ("g", Decimal("1.00"), Decimal("9.00"))], "path string, opening decimal(18,2), closing decimal(18,2)")
    assert {r["path"]: r["closing"] for r in B.with_balances(totals, known).collect()} == {"f": Decimal("11.00"), "g": Decimal("9.00")}


def test_statements_are_payments(spark):
    rows = [(1, "invoice", None, "F1", None), (2, "bank_statement", None, "F1", None), (3, "receipt", None, "F1", None)]
    meta = spark.createDataFrame(rows, "doc_id long, document_type string, order_number string, invoice_number string, variable_symbol string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert (1, "payment", 2) in {tuple(r) for r in M.pick_matches(meta).collect()}


def test_unpaid_before_paid(spark):
    assert one(spark, C.payment_status(F.lit("Faktura NEZAPLACENO"))) == "unpaid"
    assert one(spark, C.payment_status(F.lit("zaplaceno"))) == "paid"


def test_two_of_three_models_agree(spark):
    rows = [(1, "a", 2, False), (1, "b", 2, False), (1, "c", 3, False), (2, "a", 1, False), (2, "b", 2, False), (3, "a", 1, True), (3, "b", 4, False)]
    got = {r["doc_id"]: (r["item_count"], r["agreeing"], r["accepted"]) for r in C.count_consensus(spark.createDataFrame(rows, "doc_id long, model string, item_count int, failed boolean")).collect()}
    assert got[1] == (2, 2, True)
    assert got[2][2] is False
    assert got[3] == (4, 1, True)


def test_near_duplicates_by_head(spark):
    base = "The quick brown fox jumps over the lazy dog and runs away through the long green field. " * 8
    rows = [(1, base), (2, base.replace("quick", "quack", 1)), (3, base[::-1]), (4, ""), (5, None)]
    got = [(r["doc_id"], r["duplicate_of"]) for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(2, 1)]


def test_near_duplicates_find_what_all_pairs_give(spark, sf):
    from oracle import connect

    sql = """WITH h AS (SELECT doc_id, substr(text, 1, 1000) AS head FROM documents WHERE length(text) > 0),
      p AS (SELECT a.doc_id AS u, b.doc_id AS v, greatest(length(a.head), length(b.head)) AS n, a.head AS x, b.head AS y FROM h a JOIN h b ON a.doc_id < b.doc_id AND abs(length(a.head) - length(b.head)) <= 50)
      SELECT v, min(u) FROM p WHERE levenshtein(x, y) <= floor(n * 0.05 + 1e-9) GROUP BY v"""
    want = sorted(connect(sf).execute(sql).fetchall())
    found = D.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    assert want and sorted((r["doc_id"], r["duplicate_of"]) for r in found.collect()) == want


@pytest.mark.parametrize("hot", [2, 64])
def test_near_duplicates_need_not_share_the_first_of_a_key(spark, hot):
    rng = random.Random(4)
    lead, body, other, more = ("".join(rng.choices("abcdefghijklmnopqrst ", k=500)) for _ in range(4))
    head = lead + body
    rows = list(enumerate([lead + other, more + body, head, head[:700] + "!" + head[701:], head[:620] + "?" + head[620:], head, lead + more[::-1]]))
    got = {r["doc_id"]: (r["duplicate_of"], r["similarity"]) for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert got == {3: (2, 0.999), 4: (2, 0.998), 5: (2, 1.0)}


@pytest.mark.parametrize("hot", [2, 64])
def test_near_duplicates_of_all_lengths_are_those_of_all_pairs(spark, hot):
    rng = random.Random(7)
    heads = []
    for n in (20, 21, 40, 95, 97, 100, 105, 119, 400, 990, 1000):
        base = "".join(rng.choices("abcde ", k=n))
        for edits in (0, 1, n // 25, n // 20, n // 20 + 1):
            for kind in ("xi", "di", "xd"):
                own = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(own))
                    own[at : at + 1] = {"x": "?", "d": "", "i": "!" + own[at]}[rng.choice(kind)]
                heads.append("".join(own)[:1000])
    rng.shuffle(heads)
    docs = spark.createDataFrame(list(enumerate(heads)), "doc_id long, text string")
    pairs = docs.selectExpr("doc_id AS u", "text AS x").join(docs.selectExpr("doc_id AS v", "text AS y"), F.expr("u < v and levenshtein(x, y) <= floor(greatest(length(x), length(y)) * (1 - 0.95D))"))
    want = sorted(tuple(r) for r in pairs.groupBy("v").agg(F.min("u")).collect())
    assert len(want) > 50 and sorted((r["doc_id"], r["duplicate_of"]) for r in D.near_duplicates(docs, hot=hot).collect()) == want


def staged_bytes(monkeypatch):
    """Sizes of what the operators of D write to the shared folder, as they go."""
    from foliant.sources.staging import once

    sizes = []

    def counted(df, *folders):
        out = once(df, *folders)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(D, "once", counted)
    return sizes


def test_cascade_writes_hashes_and_heads_not_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrst ", k=50_000)) for _ in range(60)]
    texts += [texts[3], texts[4][:40_000], texts[5][:400] + "!" + texts[5][400:], "", "", None]
    docs = spark.createDataFrame([(k, t, None if k == 64 else f"h{t}"[:99]) for k, t in enumerate(texts)], "doc_id long, text string, file_hash string")
    sizes = staged_bytes(monkeypatch)
    found = {r["doc_id"]: (r["reason"], r["matched"]) for r in D.dedup_cascade(docs).collect()}
    assert found == {60: ("file_hash", 3), 61: ("file_hash", 4), 62: ("file_hash", 5)}
    found = {r["doc_id"]: (r["reason"], r["matched"]) for r in D.dedup_cascade(docs.withColumn("file_hash", F.md5("text"))).collect()}
    assert found == {60: ("file_hash", 3), 61: ("text_hash", 4), 62: ("similarity", 5), 64: ("file_hash", 63)}
    assert sum(sizes) < 60 * 50_000 / 4


def test_keys_of_one_head_are_not_written(spark, monkeypatch):
    rng = random.Random(6)
    heads = ["".join(rng.choices("abcdefghijklmnopqrst ", k=1000)) for _ in range(1000)]
    heads.append(heads[17][:500] + "?" + heads[17][501:])
    docs = spark.createDataFrame(list(enumerate(heads)), "doc_id long, text string")
    sizes = staged_bytes(monkeypatch)
    assert [(r["doc_id"], r["duplicate_of"]) for r in D.near_duplicates(docs).collect()] == [(1000, 17)]
    assert sum(sizes) < 2_000_000  # heads once, 0.9 MB, sketches and few keys
    keys = D._shared_keys(docs.selectExpr("doc_id AS first_id", "text AS head"), 0.95, 1000)
    assert {r["first_id"] for r in keys.collect()} == {17, 1000}


@pytest.mark.parametrize("most", [1, 512])
def test_keys_that_meet_are_those_of_all_pairs(monkeypatch, most):
    monkeypatch.setattr(D, "ENUMERATED", most)
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 7)
    rng = random.Random(9)
    edits = np.array([D.most_edits(n, 0.95) for n in range(1001)], np.int32)
    rows = [(f"d{i:03}", rng.choice([300, 310, 400]), [(k, rng.randrange(250), rng.random() < 0.4) for k in sorted(rng.sample(range(12), 4))]) for i in rng.sample(range(60), 60)]
    flat = [x for r in rows for x in r[2]]
    at = np.array([x[1] for x in flat], np.int32)
    head, key, _, _, asked, h, _ = D._met(pa.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int32), np.array([4] * 60, np.int32), np.array([x[0] for x in flat], np.int32), at, at, np.array([x[2] for x in flat]), edits)
    got = {(rows[i][0], k): rows[j][0] for i, k, a, j in zip(head, key, asked, h, strict=True) if a}
    left = {(rows[i][0], int(k)) for i, k in zip(head, key, strict=True)}
    want = {}
    for v, n, keys in rows:
        for k, place, looked_up in keys:
            for u, m, others in rows:
                e = max(edits[n], edits[m])
                if looked_up and u < v and abs(n - m) <= e and any(x == k and abs(p - place) <= e for x, p, _ in others):
                    want.setdefault((v, k), []).append(u)
    assert want and all((v, k) in got and got[v, k] <= min(us) and {(u, k) for u in us} <= left for (v, k), us in want.items())
    if most > 1:
        assert got == {x: min(us) for x, us in want.items()}


def test_chosen_windows_cost_least():
    rng = np.random.default_rng(0)
    for _ in range(50):
        span, wanted, spare = int(rng.integers(1, 5)), rng.integers(1, 4, 4), rng.integers(0, 5, 4)
        starts = wanted * span + spare - span + 1
        cost = np.full((4, starts.max()), np.inf, np.float32)
        for b in range(4):
            cost[b, : starts[b]] = rng.integers(1, 6, starts[b])
        for b, row in enumerate(D._rarest(cost, span, wanted, spare)):
            got = row[row >= 0]
            ways = [x for x in itertools.combinations(range(starts[b]), int(wanted[b])) if all(y - z >= span for z, y in zip(x, x[1:], strict=False))]
            assert tuple(got) in ways and cost[b, got].sum() == min(cost[b, list(x)].sum() for x in ways)


def test_sketches_differ_by_two_grams_an_edit():
    rng = random.Random(10)
    for _ in range(100):
        a = "".join(rng.choices("ab ", k=rng.randrange(60)))
        b, edits = list(a), rng.randrange(6)
        for _ in range(edits):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "c", "d"])
        x, y = D._sketches([a, "".join(b)])
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 2 * D.SKETCH_GRAM * edits


@pytest.mark.parametrize("most", [0, 1, 2, 5, 300])
def test_edit_distances_are_exact_up_to_the_most(spark, most):
    rng = random.Random(most)
    heads = ["".join(rng.choices("abč", k=rng.randrange(30))) for _ in range(30)]
    lengths = np.array([len(h) for h in heads])
    codes = np.full((30, lengths.max() + most + 1), 9, np.uint8)
    for k, h in enumerate(heads):
        codes[k, : len(h)] = ["abč".index(c) for c in h]
    u, v = (x.ravel() for x in np.mgrid[0:30, 0:30])
    pairs = spark.createDataFrame([(heads[i], heads[j]) for i, j in zip(u, v, strict=True)], "x string, y string")
    want = [min(r["d"], most + 1) for r in pairs.select(F.levenshtein("x", "y").alias("d")).collect()]
    assert D.edit_distances(codes, lengths, u, v, most).tolist() == want


def test_heads_of_many_pairs_are_not_written_with_each(spark, monkeypatch):
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefghijklmnopqrst ", k=1000))
    heads = [base]
    for _ in range(150):  # not similar to each other nor to base, but with most grams in common
        own = list(base)
        for at in rng.sample(range(1000), 55):
            own[at] = rng.choice("XYZ")
        heads.append("".join(own))
    docs = spark.createDataFrame(list(enumerate(heads)), "first_id long, head string")
    pairs = [(a, b) for b in range(1, 151) for a in range(b)]
    met = D._edits(spark.createDataFrame(pairs, "u long, v long"), docs, 0.95)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "head_u" not in plan and "levenshtein" not in plan
    got = met.collect()
    assert len(got) == len(pairs) and {r["edits"] for r in got} == {51} and {r["longest"] for r in got} == {1000}
    firsts = docs.unionByName(spark.createDataFrame([(200, heads[9][1:] + "!")], "first_id long, head string"))
    assert [tuple(r) for r in D._closest(spark.createDataFrame([*pairs, (3, 200), (9, 200)], "u long, v long"), firsts, 0.95).collect()] == [(200, 9, 0.998)]


def test_beginnings_in_common_are_not_looked_up(spark):
    rng = random.Random(8)
    lead = "".join(rng.choices("abcdefghijklmnopqrst ", k=120))
    rows = [(k, lead + "".join(rng.choices("abcdefghijklmnopqrst ", k=880))) for k in range(40)]
    firsts = spark.createDataFrame(rows, "first_id long, head string")
    keys = D._keyed_heads(firsts, 0.95, 1000, D._common_keys(firsts, 0.95, 1000)).select("first_id", F.explode("keys").alias("k"))
    often = {r["key"] for r in keys.groupBy("k.key").count().where("count > 10").collect()}
    asked = keys.where("k.looked_up").select("first_id", "k.key").collect()
    assert often and len(asked) == 40 * 51 and not often & {r["key"] for r in asked}


def test_chain_members_are_unique_per_slot(spark):
    rows = [(1, "order", "P1", None, None), (2, "invoice", "P1", "F1", "V1"), (3, "invoice", "P1", "F2", None), (4, "payment", None, "F1", "V1"), (5, "receipt", None, None, None)]
    meta = spark.createDataFrame(rows, "doc_id long, document_type string, order_number string, invoice_number string, variable_symbol string").withColumns({"created_at": F.lit("2024-01-01").cast("timestamp"), "amount": F.lit(1.0), "vendor": F.lit("x")})
    chains = M.build_chains(meta)
    again = M.build_chains(meta)
    assert sorted(r["chain_id"] for r in chains.collect()) == sorted(r["chain_id"] for r in again.collect())
    order = next(r for r in chains.collect() if r["chain_id"] == "CHAIN-1")
    assert order["invoice_id"] == 2


def test_statement_formats(spark):
    files = spark.createDataFrame([("a", ":20:X\n:25:1/0800\n:60F:C240101CZK1,00\n:61:240105C10,50NTRF\n:86:VS:123456\n:61:240106D2,00NTRF\n:86:fee\n:62F:C240131CZK9,50"), ("b", "not a statement"), ("c", '<Document xmlns="camt.053"><broken'), ("d", "Date,Amount,Description\n2024-01-05,-3.50,\"a, b\"")], "path string, content string")
    got = {(r["path"], r["n"]): r for r in B.read_transactions(files).collect()}
    assert got["a", 1]["amount"] == Decimal("10.50") and got["a", 1]["variable_symbol"] == "123456"
    assert got["a", 2]["amount"] == Decimal("-2.00") and got["a", 2]["type"] == "DEBIT"
    assert got["d", 1]["description"] == "a, b" and got["d", 1]["date"] == date(2024, 1, 5)
    assert {p for p, _ in got} == {"a", "d"}


def test_invoice_lines_match_summary(spark):
    text = "FAKTURA\nPoložky:\n1. Papír 2 ks 100,00 242,00\n----------\n2. Práce 121,00\nCelkem: 363,00 Kč"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    lines = E.invoice_lines(docs)
    rows = sorted(lines.collect(), key=lambda r: r["line_number"])
    assert [(r["description"], r["quantity"], r["net"], r["gross"]) for r in rows] == [("Papír", 2.0, Decimal("200.00"), Decimal("242.00")), ("Práce", 1.0, Decimal("100.00"), Decimal("121.00"))]
    sums = {r["doc_id"]: r for r in E.invoice_summary(docs, lines).collect()}
    assert sums[1]["gross"] == Decimal("363.00") and sums[2]["n_lines"] == 0 and sums[3]["gross"] == 0


def test_text_model_learns(spark):
    rows = [(k, "invoice total payment due" if k % 2 else "holiday beach sun sea", "a" if k % 2 else "b") for k in range(40)]
    labeled = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = learn.predict_text(learn.train_text_model(labeled), labeled).collect()
    assert all((r["label"] == "a") == bool(r["doc_id"] % 2) for r in got)
    assert learn.train_text_model(labeled.limit(5)) is None


def test_text_model_is_that_of_the_library(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer, IDF, StringIndexer

    words = ["Amount", "due,", "beach", "sun_sea", "été", "č2", "a", "x"]
    rows = [(k, " ".join(words[(k * j + j) % 8] for j in range(k % 7)), "abc"[k * k % 3]) for k in range(60)]
    labeled = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = learn.train_text_model(labeled)
    terms = model.stages[:3]
    old = Pipeline(stages=[*terms, CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=5000, minDF=2.0), IDF(inputCol="counts", outputCol="tfidf"), StringIndexer(inputCol="label", outputCol="label_index", handleInvalid="keep"), NaiveBayes(featuresCol="tfidf", labelCol="label_index", smoothing=0.1)]).fit(labeled)
    assert set(model.stages[3].vocabulary) == set(old.stages[3].vocabulary) and model.stages[5].labels == old.stages[5].labels
    got, want = ({r["doc_id"]: r for r in learn.predict_text(m, labeled).collect()} for m in (model, old))
    assert all(got[k]["label"] == want[k]["label"] and abs(got[k]["confidence"] - want[k]["confidence"]) < 1e-9 for k in want) and len(got) == 60
    few = learn.train_text_model(labeled, features=3).stages[3].vocabulary
    assert few == learn.train_text_model(labeled.repartition(7), features=3).stages[3].vocabulary  # ties by term, not by partitions


def test_text_model_counts_no_pair_that_cannot_be_a_feature(spark):
    texts = [f"often seen word{k} rare{k} rare{k} once{k}" for k in range(30)]
    labeled = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, label string")
    counted = learn.term_counts(labeled, frozenset(["often", "seen"]), pairs=True).where("term is not null")
    assert {(r["label"], r["term"], r["n"], r["df"]) for r in counted.collect()} == {("a", "often seen", 15, 15), ("b", "often seen", 15, 15)}
    assert learn.train_text_model(labeled, features=3).stages[3].vocabulary == ["often", "often seen", "seen"]
    assert learn.train_text_model(labeled, features=2).stages[3].vocabulary == ["often", "often seen"]


def test_amounts_of_a_row_are_found_once(spark):
    rows = ["1. Bolt 2 ks 1 234,56 2 469,12", "----------", "   ", "Nut 12,5 x 1,5 3,50 3,50", "no amount 12,3", "7 = 1,50", "9,99"]
    docs = spark.createDataFrame([(1, "Items:\n" + "\n".join(rows) + "\nTotal"), (2, None)], "doc_id long, text string")
    lines = E.invoice_lines(docs)
    got = [(r["line_number"], r["description"], r["quantity"], str(r["gross"])) for r in lines.orderBy("line_number").collect()]
    assert got == [(1, "Bolt", 2.0, "2469.12"), (2, "Nut", 12.5, "3.50"), (3, "=", 1.0, "1.50"), (4, "Item 4", 1.0, "9.99")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    from foliant.functions.values import AMOUNT

    assert plan.count(AMOUNT) == 1


def test_sequence_similarity(spark):
    pairs = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz"), (None, "")], "a string, b string")
    assert [r["similarity"] for r in X.sequence_similarity(pairs, "a", "b").collect()] == [1.0, 0.0, 1.0]


def test_observed_metrics(spark):
    df, seen = X.observed(spark.range(10), "rows", n=F.count("*"), most=F.max("id"))
    df.collect()
    assert seen.get == {"n": 10, "most": 9}


def test_many_keywords_in_one_pass(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(20_000)]
    rows = [(k, None if k == 3 else "".join(rng.choices("abcdefgh ABC", k=300))) for k in range(40)] + [(None, "abab cdcd"), (None, "hh"), (5, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = R.rules_table(spark, [("keyword", f"label{k % 7}", k % 7, w.upper() if k % 2 else w, 1.0) for k, w in enumerate(words)])
    found = C._all_scores(docs, rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, t in rows:
        hits = [0] * 7
        for k, w in enumerate(words):
            hits[k % 7] += w in (t or "").lower()
        want.append((-1 if i is None else i, sorted((h, f"label{j}") for j, h in enumerate(hits) if h)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], sorted((x["hits"], x["label"]) for x in r["scores"])) for r in found.collect()) == sorted(want)
    small = rules.limit(300)
    one, many = (C.matched_keywords(docs, x) for x in (small, small.unionByName(R.rules_table(spark, [("keyword", "z", 99, f"zz{k}", 1.0) for k in range(200)]))))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    counts = C.classify_regex_counts(docs, R.rules_table(spark, [("regex", "x", 0, f"a[b-d]{{1,{k % 3 + 1}}}", 1.0) for k in range(500)]))
    assert {r["label"] for r in counts.collect()} == {"x", "other"}


def test_score_cards_from_rules(spark):
    docs = spark.createDataFrame([(1, "Invoice total 5, paid"), (2, "draft invoice"), (3, None)], "doc_id long, text string")
    cards = {"invoice": {"base": 60, "keywords": ["invoice"], "required": ["total", "date"], "bonus": ["paid"], "negative": ["draft"]}}
    rules = R.rules_table(spark, [("keyword", "invoice", 0, "invoice", 60.0), ("required", "invoice", 1, "total", 1.0), ("required", "invoice", 2, "date", 1.0), ("bonus", "invoice", 3, "paid", 5.0), ("negative", "invoice", 4, "draft", -50.0), ("lang", "en", 5, "en", 1.0)])
    assert C.cards_of(rules) == cards
    got = {r["doc_id"]: (r["label"], r["score"]) for r in C.scorecard(docs, C.cards_of(rules)).collect()}
    assert got == {1: ("invoice", 90), 2: ("unknown", 0), 3: ("unknown", 0)}


def test_exact_median_by_passes(spark):
    from foliant.operators import reports

    rng = random.Random(2)
    for values in ([], [None], [3.0], [1.0, 2.0], [5.0] * 50 + [7.0], [rng.gauss(0, 1e6) for _ in range(999)], [float("-inf"), 1.0, 2.0, float("inf")], [*range(400), 1e300, -1e300]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
        kept = sorted(float(v) for v in values if v is not None)
        want = None if not kept else (kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / 2
        assert reports.exact_median(df, "x", 16, 5) == want


def test_forests_of_any_depth(spark):
    from foliant.operators import forest

    chain = [(k, k - 1) for k in range(1, 5001)]
    links = spark.createDataFrame([*chain, (9001, 9002), (9002, 9001), (9003, 9001), (7000, None), (8001, 8000), (8002, 8000)], "id long, parent long")
    got = {r["id"]: r["root"] for r in forest.roots(links).collect()}
    assert got == {**{k: 0 for k in range(5001)}, 8000: 8000, 8001: 8000, 8002: 8000}
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 4, "loop"), (5, 99, "orphan"), (None, 1, "x")], "id long, parent_id long, name string")
    assert {r["id"]: r["path"] for r in M.type_paths(nodes).collect()} == {1: "a", 2: "a > b", 3: "a > b > c"}


def test_clusters_of_duplicates(spark):
    found = spark.createDataFrame([(2, "file_hash", 1), (3, "similarity", 2), (9, "text_hash", 8)], "doc_id long, reason string, matched long")
    assert sorted((r["doc_id"], r["cluster_id"], r["reason"], r["matched"]) for r in D.duplicate_clusters(found).collect() if r["reason"]) == [(2, 1, "file_hash", 1), (3, 1, "similarity", 2), (9, 8, "text_hash", 8)]
    assert D.duplicate_clusters(found.limit(0)).count() == 0


def test_order_summary_of_items_and_of_stated_sums(spark):
    from decimal import Decimal

    from foliant.operators import orders

    items = "items array<struct<price: decimal(18,2), quantity: int, vat_rate: decimal(5,2)>>"
    line = [(Decimal("119.00"), 2, Decimal("19.00")), (None, 1, None)]
    bare = orders.order_summary(spark.createDataFrame([("a", line), ("b", [])], f"order_number string, {items}"))
    assert {r["order_number"]: tuple(float(v) for v in r[1:]) for r in bare.collect()} == {"a": (200.0, 38.0, 238.0, 0.0, 0.0), "b": (0.0,) * 5}
    stated = spark.createDataFrame([("a", line, Decimal("4.50"), Decimal("-10.00"), None)], f"order_number string, {items}, shipping decimal(18,2), promotion decimal(18,2), order_total decimal(18,2)")
    assert tuple(float(v) for v in orders.order_summary(stated).first()[1:]) == (194.5, 38.0, 232.5, 4.5, -10.0)


def test_order_export_with_sums_by_other_names(spark):
    from foliant.operators import orders

    head = "Bestellnummer;Bestelldatum;ASIN;Titel;Menge;Artikelpreis;USt.-Satz;Versandkosten;Rabatt;Summe inkl. USt;USt;Zwischensumme"
    files = spark.createDataFrame([("f", f"{head}\n1;01.02.2024;B1;x;2;119,00;19%;4,50;-10,00;-;N/A;200,00")], "path string, content string")
    rows = orders.read_orders(files)
    assert rows.first()["language"] == "de"
    r = orders.order_summary(orders.group_orders(orders.locale_values(rows))).first()
    assert tuple(float(v) for v in r[1:]) == (194.5, 38.0, 232.5, 4.5, -10.0)


def test_balanced_ranges_cut_once(spark):
    """Quantiles of many keys depend on the order of tasks, so both uses must see the same ones."""
    from foliant.operators.reports import balanced_ranges

    counts = spark.range(0, 1000, numPartitions=4).selectExpr("id AS k", "id % 7 + 1 AS n")
    got = balanced_ranges(counts, "k", 4)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(r["n"] for r in got.collect()) == sum(k % 7 + 1 for k in range(1000))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_rendered_where_they_are_gathered(spark, sf):
    """Lines are dealt to all tasks before their texts are made, not after."""
    from foliant.plans import q_extract, q_orders

    for df in (q_extract.invoices(spark, sf), q_extract.statements(spark, sf), q_extract.receipts(spark, sf), q_orders.camt(spark, sf), q_orders.exports(spark, sf)):
        assert "RepartitionByExpression" in optimized(df)


def test_lines_are_read_once(spark):
    """Neither an order's line nor a transaction's date is taken apart a second time by a filter."""
    from foliant.operators.extract import statement_lines
    from foliant.operators.orders import read_orders

    files = spark.createDataFrame([("a.csv", 'Order Number;ASIN;Title;Quantity;Item Price\n1;"B;1";N/A;2;3,50\n\n2;x\n3;B3;T;1;')], "path string, content string")
    rows = read_orders(files)
    assert optimized(rows).count("split(") <= 3
    assert [(r["row"], r["order_number"], r["asin"], r["title"], r["price"], r["vat_rate"]) for r in rows.collect()] == [(1, "1", "B;1", None, "3,50", None), (3, "3", "B3", "T", None, None)]
    text = "Datum Popis Částka\n5.3.2024 VS 12 -1 234,56\n31.02.2024 VS 13 1,00\n6.3.2024 no amount\n7.3.2024 a 2,00 b -3,00\nCelkem"
    tx = statement_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    assert optimized(tx).count("Filter") == 0
    assert [(r["n"], str(r["date"]), str(r["amount"]), r["vs"]) for r in tx.collect()] == [(1, "2024-03-05", "-1234.56", "12"), (4, "2024-03-07", "-3.00", None)]
