"""Prefix tries, repairs and token counts against brute force and their libraries."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliant.llm import conversation_repair, prefix_trie, token_counts

TURNS = "conv_id long, turn long, role string, text string, words long, gone string, given long, depth long, copy int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (20, 1, "user", "One two."), (20, 0, "system", "Be brief."), (20, 2, "assistant", "Three"), (20, 3, None, "?"), (20, 4, "user", None),
        (21, None, "user", "null turn first."), (21, 5, "assistant", ""), (21, 5, "assistant", ""), (21, None, None, None), (22, 7, "user", "x" * 5000 + " y." ), (23, 1, "user", "One two."),
        (24, 1, "assistant", "One two."), (24, 1, "assistant", "One two."), (24, 9, "user", " \n\t "), (24, 10, "", "no role."), (24, 11, "tool", "other role!\u0085"), (24, 12, "user", "Größe ﬁ 中文 🙂?"),
        (None, 1, "user", "no conversation"), (None, None, None, None), (2**60 + 1, 0, "user", "big."), (2**60 + 3, 0, "user", "big."), (-7, 0, "system", "below zero."), (26, 2**63 - 1, "user", "late."), (26, -(2**63), "assistant", "early."),
        *((25, k, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(300)),
    ]
    return spark.createDataFrame([(*r, k, "g", k, k, 1) for k, r in enumerate(rows)], TURNS)


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


# Prefix tries


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in by_turn(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c > 0 else -1)
        full[c] = tuple(own.get(donor, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in full.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [50, 10**6])
def test_trie_is_brute_force(spark, odd, shard_rows):
    rows = [tuple(r) for r in odd.select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(1)
    rows += [(100 + c, t, rng.choice("ua"), rng.choice(["a", "b b", "c"])) for c in range(60) for t in range(rng.randint(0, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(df), shard_rows)) == slow_trie(rows)


def test_trie_of_odd_columns_and_empty_table(odd):
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(odd))) == slow_trie([tuple(r) for r in odd.select("conv_id", "turn", "role", "text").collect()])
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(odd.limit(0))).count() == 0


def test_slots_are_perfect_and_verified():
    rng = np.random.default_rng(1)
    hi, lo = prefix_trie.distinct(rng.integers(-5, 5, 4000) * 2**58, rng.integers(-(2**63), 2**63 - 1, 4000))
    table = prefix_trie.SlotTable(hi, lo)
    assert sorted(table.slots(hi, lo).tolist()) == list(range(len(hi)))
    with pytest.raises(ValueError):
        table.slots(np.array([1]), np.array([2]))
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([3, 3]), np.array([4, 4]))


def test_one_digest_for_two_prefixes_is_an_error(spark):
    steps = spark.createDataFrame([(1, 1, 5, 6, 0, 0, 2, 7, True), (2, 1, 5, 6, 0, 0, 2, 8, True)], "conv_id long, depth long, hi long, lo long, up_hi long, up_lo long, words long, proof long, ends boolean")
    with pytest.raises(Exception, match="one digest"):
        prefix_trie.nodes_of(steps).collect()


# Repairs


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """Least (cost, edits, repaired rows) over all sequences of edits, tried one by one."""
    marks = faults(rows)

    def legal(s):
        s = s.removeprefix("s") if s != "s" else "-"
        return s == "ua" * (len(s) // 2) and s != "-"

    # All edits of every row, insertions of up to two turns before each and at the end; the pattern is tested last.
    out = []
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    options = []
    for (_, role, text), f in zip(rows, marks, strict=True):
        own = [(4, "D", ())]
        if f not in ("blank", "duplicate"):
            extra = 3 * (f == "truncated")
            own += [(extra, "K", ((role, text),)), (3 + extra, "R", (("user", text),)), (3 + extra, "R", (("assistant", text),))]
        options.append([(3 * len(g) + c, "I" * len(g) + e, tuple((x, "") for x in g) + kept) for g in gaps for c, e, kept in own if not (kept and kept[0][0] == "")])
    options.append([(3 * len(g), "I" * len(g), tuple((x, "") for x in g)) for g in gaps])
    for way in itertools.product(*options):
        kept = [r for w in way for r in w[2]]
        if legal("".join(r[0][:1] for r in kept)):
            out.append((sum(w[0] for w in way), "".join(w[1] for w in way), "\n".join(f"{a}:{b}" for a, b in kept)))
    return min(out)


def report(rows):
    marks = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))


@pytest.mark.parametrize("spill", [1, 10**7])
def test_repair_is_brute_force(spark, spill):
    rng = random.Random(7)
    rows = [(c, rng.choice([None, 0, 1, 2, 5]), rng.choice(["system", "user", "user", "assistant", "tool", ""]), rng.choice(["a.", "b!", "cut", " ", "d?"]), False) for c in range(60) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")
    found = {r["conv_id"]: r for r in conversation_repair.repaired(df, spill).collect()}
    own = defaultdict(list)
    for c, *rest, _ in rows:
        own[c].append(tuple(rest))
    for c, mine in own.items():
        mine = by_turn(mine)
        cost, audit, said = slow_repair(mine)
        r = found[c]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(said.encode()).hexdigest()), mine
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == report(mine)


@pytest.mark.parametrize("spill", [200, 10**7])
def test_repair_of_odd_rows(odd, spill):
    rows = conversation_repair.damaged(odd)
    found = {r["conv_id"]: r for r in conversation_repair.repaired(rows, spill).collect()}
    own = defaultdict(list)
    for r in rows.collect():
        own[r["conv_id"]]
        if not r["gone"]:
            own[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    assert set(found) == set(own)
    for c, mine in own.items():
        r, mine = found[c], by_turn(mine)
        want = list(report(mine))
        want[0] = min(want[0], 2**63 - 1)
        assert [r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]] == want
        if len(mine) < 5:
            assert (r["cost"], r["audit"]) == slow_repair(mine)[:2]
    assert len(found[25]["audit"]) >= 280
    assert conversation_repair.repaired(conversation_repair.damaged(odd.limit(0))).count() == 0


def test_damage_of_one_row_conversations(spark):
    df = spark.createDataFrame([(c, None, None, "End. of! it?") for c in range(40)], "conv_id long, turn long, role string, text string")
    rows = conversation_repair.damaged(df).collect()
    for c in range(40):
        kind = zlib.crc32(f"{c}: ".encode()) % 20
        mine = [r for r in rows if r["conv_id"] == c]
        assert len(mine) == 1 + (kind == 3) and mine[0]["gone"] == (kind == 0)
        assert mine[0]["role"] == ("user" if kind == 4 else " ")
        assert mine[0]["text"] == {1: "", 2: "End of it"}.get(kind, "End. of! it?")
    assert conversation_repair.repaired(conversation_repair.damaged(df)).count() == 40


# Token counts


def hard_texts():
    rng = random.Random(3)
    mixed = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "Z", ".", "!?", "中", "<|endoftext|>", "́", "ᅡ"]
    texts = [None, "", " \n ", "one two", "x" * 5000, "ab " * 3000, "中文，字。" * 900, "don't it's 12345 " * 400, "é o " * 800, "<|endoftext|>" * 700, "a <|endoftext|>b " * 300, "Σς İ ﬁ " * 500, " " * 4000 + "z", "1234567890" * 400, "🙂é " * 900]
    return texts + ["".join(rng.choice(mixed) for _ in range(8000)), "".join(rng.choice(mixed[:-3]) for _ in range(8000))]


def library_count(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda t: len(own.encode(t, add_special_tokens=False))
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(own.encode(t))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize(("chunk", "overlap", "huge"), [(700, 100, 1 << 21), (1500, 80, 3000)])
def test_token_counts_are_the_library(spark, monkeypatch, name, chunk, overlap, huge):
    monkeypatch.setattr(token_counts, "HUGE", huge)
    rows = [(None if k == 3 else 2**60 + k, t) for k, t in enumerate(hard_texts())]
    rows += rows[:6]
    df = spark.createDataFrame([(*r, "k", 5, 6) for r in rows], "doc_id long, text string, _key string, n_bytes long, _n long")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, ["doc_id"], public_tokenizers.path(name), chunk, overlap).collect())
    count = library_count(name)
    assert got == sorted((i or 0, len((t or "").encode()), count(t or "")) for i, t in rows)


def test_token_counts_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    count = library_count("word_bpe_49k.json")
    for r in token_counts.op12_token_counts(spark, sf).collect():
        n = count(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)
    assert token_counts.token_counts(docs.limit(0), ["doc_id"], token_counts.word_tokenizer()).count() == 0


def test_unproven_definitions_are_encoded_whole():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    assert token_counts.proven(definition)
    assert not token_counts.proven(definition.replace("[^\\\\s\\\\p{L}\\\\p{N}]+", "(?<=a)b|[^\\\\s\\\\p{L}\\\\p{N}]+"))
    assert not token_counts.proven(definition.replace('"NFC"', '"Precompiled"'))


def test_seams_of_one_long_word_need_wider_overlaps(spark):
    text = "word " * 2000 + "y" * 9000 + " word" * 2000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    first = token_counts.encoded(df, ["doc_id"], token_counts.word_tokenizer(), 2000, 100, 2000)
    assert first.count() == 15 and token_counts.spliced(first).where(F.col("n_tokens").isNull()).count() == 1
    found = token_counts.token_counts(df, ["doc_id"], token_counts.word_tokenizer(), 2000, 100).first()
    assert found["n_tokens"] == library_count("word_bpe_49k.json")(text)


# Ids and columns through Python workers


def test_ids_and_columns_come_back_unchanged(spark):
    """64-bit ids beside a null one in the same batch, and columns of every kind."""
    import corpus_pipeline
    from foliant.llm import bpe, license_scan, near_copies, packing, pu_quality, simhash, suffix_dedup

    ids = [2**60 + 1, None, 2**60 + 3, 2**63 - 1, -(2**63)]
    texts = [" ".join(f"word{i}x{k}" for k in range(60)) + " tail. Released under the MIT License." for i in range(len(ids))]
    rows = [(i, t, "en", "s", 2**61 + 1 if k else None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    wide = df.select("*", (F.col("n_chars") + 1).alias("big"), F.lit("1.25").cast("decimal(30,10)").alias("d"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("t"), F.struct(F.col("doc_id").alias("x"), F.lit(None).cast("int").alias("y")).alias("st"), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    path = public_tokenizers.path("word_bpe_49k.json")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    labels = spark.createDataFrame([(i, 1) for i in ids if i], "doc_id long, quality int")
    model = {"prior": 0.6, "weights": None}
    some = {
        "op1": simhash.near_duplicates(df), "op2": pu_quality.score_texts(df, model, ["doc_id"]), "op3": license_scan.own_licences(df.select(F.col("doc_id").alias("file_id"), "text", F.lit(False).alias("is_licence"))).withColumnRenamed("file_id", "doc_id"),
        "op7": packing.pack(df, path), "op10": bpe.digests(df, ["doc_id"], ranks, public_tokenizers.PATTERN), "op12": token_counts.token_counts(df, ["doc_id"], path), "op4": suffix_dedup.passages(df.unionByName(df.withColumn("text", F.concat("text", F.lit(" end"))))),
    }
    for name, found in some.items():
        assert {r["doc_id"] for r in found.select("doc_id").collect()} == set(ids), name
    shown = lambda d: sorted(map(str, (tuple(r) for r in d.drop("text").collect())))
    for stage in (pu_quality.keep_good(wide, labels, 0.0), simhash.keep_one(wide), near_copies.keep_first(wide), suffix_dedup.remove_repeats(wide), corpus_pipeline.quality_rules(spark, wide, "")):
        assert stage.columns == wide.columns and shown(stage.drop("n_chars")) == shown(wide.drop("n_chars"))
    licensed = license_scan.scan(df.select(F.col("doc_id").alias("file_id"), F.lit(None).cast("string").alias("path"), "text"), some["op3"].withColumnRenamed("doc_id", "file_id"), spark.createDataFrame([], "folder string, licence string"))
    assert [r["licence"] for r in licensed.collect()] == ["MIT"] * len(ids)


def test_small_near_copies_are_all_found(spark):
    """Pairs of small sets at exactly 4/5, which wide fingerprints would miss."""
    rng = random.Random(5)
    rows = []
    for k in range(400):
        n = rng.choice([4, 8, 12, 16, 20, 24])
        words = [f"t{k}w{j}" for j in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, *(f"more{k}x{j}" for j in range(n // 4))]))]
    from foliant.llm import near_copies

    kept = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * k for k in range(400)]


def test_blocks_of_long_texts_are_read_once():
    from foliant.llm import license_scan

    text = "some words of a line\n\n" * 200_000
    scanner = license_scan.Scanner({}, {}, license_scan.THRESHOLD)
    assert sum(1 for _ in scanner.blocks(text, False)) == 200_000
    blocks = list(scanner.blocks("a b\n\nc\n", True))
    assert [len(b[0]) for b in blocks] == [len(license_scan.terms("a b")), len(license_scan.terms("c")), len(license_scan.terms("a b c"))]
