"""Token counts of whole texts, of whatever length, exactly as a tokenizer's library gives them.

Texts of at most CHUNK characters are encoded whole. Longer ones are cut into chunks that overlap
by ``overlap`` characters on both sides of each seam; chunks are rows of their own, encoded with
offsets wherever Spark puts them. Two neighbours are spliced at the first place in their overlap that
both encodings begin a word at, with the same token, and that is proven to be stable:

* tokenizers (.json): splitting into words is a scan from left to right that keeps no state but its
  position and looks one character ahead. Where both scans begin a word they go on alike, and tokens
  don't span words. The place lies GUARD characters before the end of the left chunk, so that what
  is cut off there can't change the words before it, and doesn't begin with a mark that could be
  composed with what precedes.
* sentencepiece (.model): the vocabulary has no piece with a word's sign after another character, so
  no piece can span a place between a word's end and the next word's sign.

A seam without such a place (a word of thousands of letters, say) sends its text into another round
with overlaps and chunks WIDEN times as wide; in the end the text is one chunk. A definition for
which neither proof holds (unknown splitters or normalisers, look-behind, dropout) is encoded whole.

Defined results: a null text is empty and has no tokens; null ids and repeated rows are counted like
any others; other columns are ignored; an empty table gives an empty result. Literals of special
tokens inside texts are what the library's default makes of them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, staged
from .packing import WordIds, word_tokenizer

#: Characters of a chunk, and of the overlap on either side of a seam in the first round.
CHUNK = 32768
OVERLAP = 512
#: How much wider overlaps are in the next round.
WIDEN = 8
#: Characters that a splice stays away from the end of the left chunk.
GUARD = 64
#: Texts beyond this are dealt out chunk by chunk before they are encoded.
HUGE = 1 << 21
#: Tokens beyond which the query marks a document.
LIMIT = 2048
#: Rows that are handed on together.
BATCH_ROWS = 2000

#: Splitters that scan from left to right without a state, and normalisers of single characters or runs.
SPLITTERS = {"Split", "ByteLevel", "Whitespace", "WhitespaceSplit", "Digits", "Punctuation", "BertPreTokenizer"}
NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}


def _parts(node: dict | None, name: str) -> list[dict]:
    if not node:
        return []
    return node[name] if node["type"] == "Sequence" else [node]


def proven(definition: str) -> bool:
    """Whether a .json definition splits and normalises so that common beginnings of words are stable."""
    own = json.loads(definition)
    splits = [p for p in _parts(own.get("pre_tokenizer"), "pretokenizers") if p["type"] != "ByteLevel" or p.get("use_regex", True)]
    patterns = [str(p.get("pattern")) for p in splits]
    literals = [t["content"] for t in own.get("added_tokens") or []]
    return (
        len(splits) == 1
        and splits[0]["type"] in SPLITTERS
        and not any("(?<" in p or "\\b" in p or "\\B" in p or "\\G" in p for p in patterns)
        and all(p["type"] in NORMALIZERS for p in _parts(own.get("normalizer"), "normalizers"))
        and not (own.get("model") or {}).get("dropout")
        and max(map(len, literals), default=0) < GUARD
    )


class JsonLibrary:
    """The tokenizers library under a .json definition."""

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        text = definition.decode()
        own = json.loads(text)
        # Whole texts: nothing is cut off or filled up.
        own["truncation"] = own["padding"] = None
        text = json.dumps(own)
        self.tokenizer = Tokenizer.from_str(text)
        self.words = WordIds(text)
        self.width = 2 if self.words.kind == "H" else 4
        self.proven = proven(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text; words that the worker has seen aren't encoded again."""
        return len(self.words.of_text(text)) // self.width

    def tokens(self, text: str) -> tuple[list[int], list[int], list[bool]]:
        """Id and first character of each token, and whether a word certainly begins with it."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        word, starts = found.word_ids, [a for a, _ in found.offsets]
        return found.ids, starts, [k > 0 and word[k] != word[k - 1] and not composes(text[a : a + 1]) for k, a in enumerate(starts)]


class PieceLibrary:
    """The sentencepiece library under a .model file."""

    def __init__(self, definition: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=definition)
        pieces = [self.processor.id_to_piece(k) for k in range(self.processor.get_piece_size())]
        self.proven = not any("▁" in p.lstrip("▁") for p in pieces)

    def count(self, text: str) -> int:
        return len(self.processor.encode(text))

    def tokens(self, text: str) -> tuple[list[int], list[int], list[bool]]:
        """Id and first character of each token, and whether a word certainly begins with it."""
        found = self.processor.encode(text, return_type="proto").pieces
        shown = [p.piece for p in found]
        fresh = [k > 0 and p.startswith("▁") and p != "▁" and not shown[k - 1].endswith("▁") for k, p in enumerate(shown)]
        # The library counts bytes.
        raw = np.frombuffer(text.encode("utf-8", "replace") + b" ", np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return [p.id for p in found], char[[p.begin for p in found]].tolist() if found else [], fresh


def composes(c: str) -> bool:
    """Whether a character can become one with what stands before it."""
    return c != "" and (unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ")


def library(definition: bytes, kind: str) -> Any:
    return JsonLibrary(definition) if kind == "json" else PieceLibrary(definition)


def chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """(number, last, characters) of a text's chunks; seams lie at multiples of chunk."""
    n = max(1, -(-len(text) // chunk))
    for k in range(n):
        yield k, k == n - 1, text[max(0, k * chunk - overlap) : (k + 1) * chunk + overlap]


def seam_tokens(lib: Any, k: int, last: bool, text: str, chunk: int, overlap: int) -> tuple:
    """Tokens of a chunk, and the stable beginnings of words (place and id in one) with their number at its left and right seam."""
    ids, starts, fresh = lib.tokens(text)
    first = max(0, k * chunk - overlap)
    zones: list[list[int]] = []
    for seam, wanted in ((k * chunk, k > 0), ((k + 1) * chunk, not last)):
        at = [i for i, f in enumerate(fresh) if f and -overlap <= first + starts[i] - seam < overlap - GUARD] if wanted else []
        # At one place the last token of several that begin there counts.
        places = {(first + starts[i] - seam + overlap) << 32 | ids[i]: i for i in at}
        zones += [list(places), list(places.values())]
    return len(ids), *zones


#: Where a chunk comes from, and what the seams need.
ROW = "_key string, _k long, _last boolean, n_bytes long"
SEAMS = ["_n", "_left", "_left_at", "_right", "_right_at"]


def cut_rows(batches: Iterator[pa.RecordBatch], keep: list[str], chunk: int, overlap: int, longer: float) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Rows of keep and, in the same order, (key, k, last, n_bytes, text) of the chunks of each text; only texts of more than ``longer`` characters are cut and have a key."""
    for b in batches:
        at: list[int] = []
        out: list[tuple] = []
        size = 0
        for i, t in enumerate(b.column("text")):
            text = t.as_py() or ""
            n = len(text) if text.isascii() else len(text.encode("utf-8", "replace"))
            key = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest() if len(text) > longer else None
            for k, last, part in [(0, True, text)] if key is None else chunks(text, chunk, overlap):
                at.append(i)
                out.append((key, k, last, n, part))
                size += len(part)
                if len(out) >= BATCH_ROWS or size > 64 * CHUNK:
                    yield b.select(keep).take(pa.array(at, pa.int64())), out
                    at, out, size = [], [], 0
        if out:
            yield b.select(keep).take(pa.array(at, pa.int64())), out


def joined(rows: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *names])


def encoded(docs: DataFrame, keep: list[str], tokenizer: str, chunk: int, overlap: int, longer: int) -> DataFrame:
    """keep, n_bytes and the chunks of every row of docs (keep, text), each with its tokens and seams; texts of more than ``longer`` characters have a key."""
    with open(tokenizer, "rb") as f:
        definition = f.read()
    kind = "json" if tokenizer.endswith(".json") else "model"
    name = hashlib.md5(definition, usedforsecurity=False).hexdigest()
    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {ROW}"
    lists = [pa.list_(pa.int64())] * 4

    def lib() -> Any:
        return per_worker("token-library", name, lambda: library(definition, kind))

    def least() -> float:
        return longer if lib().proven else float("inf")

    def of(rows: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        own = lib()
        found = [(own.count(t), [], [], [], []) if k == 0 and last else seam_tokens(own, k, last, t, chunk, overlap) for _, k, last, _, t in parts]
        cells = list(zip(*[p[:4] for p in parts], strict=True))
        arrays = [pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)]
        arrays += [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), *lists), strict=True)]
        return joined(rows, ["_key", "_k", "_last", "n_bytes", *SEAMS], arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in cut_rows(batches, keep, chunk, overlap, least()):
            yield of(rows, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, parts in cut_rows(batches, keep, chunk, overlap, least()):
            columns = zip(*parts, strict=True)
            yield joined(rows, ["_key", "_k", "_last", "n_bytes", "text"], [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)])

    def of_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                yield of(some.select(keep), list(zip(*(some.column(c).to_pylist() for c in ("_key", "_k", "_last", "n_bytes", "text")), strict=True)))

    out = f"{head}, _n long, " + ", ".join(f"{c} array<long>" for c in SEAMS[1:])
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    large = F.coalesce(F.length("text") > HUGE, F.lit(False))
    dealt = rows.where(large).mapInArrow(cut, f"{head}, text string").repartition(F.col("_key"), F.col("_k"))
    return rows.where(~large).mapInArrow(run, out).unionByName(dealt.mapInArrow(of_cut, out))


def spliced(parts: DataFrame) -> DataFrame:
    """(_key, n_tokens) of cut texts from their chunks; null where a seam has no stable place."""
    one = parts.select("_key", "_k", "_last", *SEAMS).dropDuplicates(["_key", "_k"])
    left = one.select("_key", "_k", "_last", "_n", "_right", "_right_at")
    right = one.select("_key", (F.col("_k") - 1).alias("_k"), "_left", "_left_at")
    place = F.get(F.array_intersect("_right", "_left"), 0)
    met = left.join(right, ["_key", "_k"], "left").withColumn("_place", place)
    index = lambda side: F.expr(f"get({side}_at, cast(array_position({side}, _place) - 1 as int))")
    own = F.when(F.col("_last"), F.col("_n")).otherwise(index("_right") - index("_left"))
    sums = met.select("_key", own.alias("_own")).groupBy("_key").agg(F.sum("_own").alias("n"), F.count_if(F.col("_own").isNull()).alias("failed"))
    return sums.select("_key", F.when(F.col("failed") == 0, F.col("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, keep: list[str], tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """keep, n_bytes (UTF-8) and n_tokens of every row of docs, which has text.

    Rounds are run when this is called; their chunks' seams, not their texts, are written to the
    shared folder. Equal long texts are spliced once.
    """
    first = staged(encoded(docs, keep, tokenizer, chunk, overlap, chunk), "chunks")
    found = staged(spliced(first.where("_key is not null")), "counts")
    texts = docs.select("text").where(F.length("text") > chunk).withColumn("_key", F.sha2(F.col("text").cast("binary"), 256))
    done, todo = found.where("n_tokens is not null"), found.where("n_tokens is null").select("_key")
    while not todo.isEmpty():
        overlap *= WIDEN
        wider = max(chunk, 4 * overlap)
        again = texts.join(todo, "_key", "left_semi").select("_key", "text").withColumnRenamed("_key", "_text")
        found = staged(spliced(encoded(again, ["_text"], tokenizer, wider, overlap, chunk)), "counts")
        done, todo = done.unionByName(found.where("n_tokens is not null")), found.where("n_tokens is null").select("_key")
    rows = first.where("_k = 0").select(*keep, "n_bytes", "_key", "_n")
    return rows.join(done, "_key", "left").select(*keep, "n_bytes", F.when(F.col("_key").isNull(), F.col("_n")).otherwise(F.col("n_tokens")).alias("n_tokens"))


def op12_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = token_counts(docs, ["doc_id"], tokenizer or word_tokenizer())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
