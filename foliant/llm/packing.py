"""Mixture-controlled packing: documents of several sources into token sequences of fixed length.

Deficit round-robin over source queues. A round is a window of WINDOW_TOKENS tokens, of which a
queue of target share p is granted p * WINDOW_TOKENS. A queue serves its next document once its
unspent grants cover it; what it can't spend is its deficit, carried to the next window. Served to
the end, document i of a queue leaves in window ceil(c_i / (p * WINDOW_TOKENS)) - 1, where c_i is
the queue's token count up to and including i: grants and deficits are a prefix sum. So every
partition counts its own tokens, sums of earlier partitions give where its queues continue, and
deficits carry over windows and partitions alike without a pass in order.

Within a window documents go in order of virtual finish, c_i / p, so that sources interleave.
Windows follow each other without gaps, cut every ``length`` tokens: only the last sequence of all
is short. A queue that runs dry leaves its share to the others.

Defined results: a null text is empty and contributes its end token alone; a null source is a
queue of its own; null ids and repeated rows are packed like any others; sources without a share
in the mixture follow all others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import STEP, block_offsets, per_worker, staged

LENGTH = 2048
WINDOW_TOKENS = 64 * LENGTH
#: Windows summed together before their prefix sum, so that few rows reach one task.
WINDOWS_PER_BLOCK = 1024
#: Words whose ids a worker remembers, about.
MOST_WORDS = 600_000
END_ID = 1
#: Blanks to Python alone, letters whose lower case depends on the context or falls apart.
ODD = re.compile("[\x1c-\x1f\u03a3\u0130]")
#: A stop or comma after another sign, which belong together.
STOPS = re.compile(r"[.,](?<=(?:[^\w\s]|_)[.,])\s")


#: How the vocabulary for which texts are split here normalises and splits; fixed with it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_words(definition: str) -> bool:
    """Whether a tokenizer's definition normalises and splits as WordIds does by itself."""
    own = json.loads(definition)
    model = own.get("model") or {}
    return own.get("normalizer") == NORMALIZER and own.get("pre_tokenizer") == SPLITTER and own.get("post_processor") is None and model.get("type") == "BPE" and not model.get("dropout")


class Known(dict):
    """Ids by word, found by ``make`` when a word is first asked for.

    Once half of MOST_WORDS are held they become the old half, from which words still in use return.
    """

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS // 2:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        found = self[word] = self.make(word) if found is None else found
        return found


class WordIds:
    """Ids of texts as the tokenizer's plain encode() without added special tokens gives them.

    For the vocabulary whose tokens never span white space (``splits_words``) a text's ids are its
    words' ids in order, so each distinct word is encoded once and remembered. Texts are lower-cased
    whole, as the tokenizer does with each, and stops and commas after a word are set apart, where it
    splits too. A run of letters then goes to the tokenizer's merges directly; other words are split
    into the tokenizer's parts first. Texts for which that could differ (not composed, contextual
    lower case, odd blanks, literals of the tokenizer's added tokens) are encoded whole, and so are
    all texts under any other definition.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_str(definition)
        #: For single words. They are lower-cased already and must not become added tokens by that.
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.literals = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.by_word = splits_words(definition)
        self.merges = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        #: How the tokenizer splits ASCII words; fixed with the vocabulary.
        self.parts = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        #: Characters that stand for bytes in the vocabulary: printable ones for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.of_byte = {b: chr(256 + k) for k, b in enumerate(rest)}
        self.known = Known(self.of_word)

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.plain.encode(text, add_special_tokens=False).ids).tobytes()

    def of_word(self, word: str) -> bytes:
        if word.isalpha():
            return self.of_run(word)
        if word.isascii():
            runs = self.parts(word)
            return self.of_run(word) if len(runs) == 1 else b"".join([self.known[p] for p in runs])
        return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of_run(self, run: str) -> bytes:
        """Ids of one part as the tokenizer splits it."""
        shown = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.of_byte)
        return array(self.kind, [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def of_text(self, t: str) -> bytes:
        if not self.by_word or any(x in t for x in self.literals) or ODD.search(t) or not (t.isascii() or unicodedata.is_normalized("NFC", t)):
            return self.whole(t)
        t = t.lower()
        if not STOPS.search(t):
            t = t.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
        return b"".join(map(self.known.__getitem__, t.split()))


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of docs (doc_id, source, text) as (_part, _row, doc_id, source, ids, n, _queued).

    ids holds the text's ids and END_ID, n their number, _queued the tokens of the same source in
    this partition up to and including this row.
    """

    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    name = hashlib.md5(definition.encode(), usedforsecurity=False).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker("word-ids", name, lambda: WordIds(definition))
        end = array(words.kind, [END_ID]).tobytes()
        width = len(end)
        part, row, queued = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                some = b.slice(at, STEP)
                ids = [words.of_text(t or "") + end for t in some.column("text").to_pylist()]
                n = [len(x) // width for x in ids]
                done = []
                for s, k in zip(some.column("source").to_pylist(), n, strict=True):
                    queued[s] = queued.get(s, 0) + k
                    done.append(queued[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(range(row, row + len(n)), pa.int64()), some.column("doc_id"), some.column("source"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(done, pa.int64())],
                    names=["_part", "_row", "doc_id", "source", "ids", "n", "_queued"],
                )
                row += len(n)

    kinds = dict(docs.dtypes)
    plain = docs.select("doc_id", "source", "text")
    return plain.mapInArrow(run, f"_part int, _row long, doc_id {kinds['doc_id']}, source {kinds['source']}, ids binary, n long, _queued long")


def target_shares(sums: DataFrame, mixture: dict[str, float] | None) -> DataFrame:
    """(source, grant, late): tokens granted to each source in a window; sums has source and n.

    Without a mixture the sources' own shares are the target. With one, sources that it doesn't name
    divide what it leaves to 1 by their own shares, and all shares are scaled to a sum of 1 over the
    sources there are. Sources that are left with nothing are late: they follow all others, by
    their own shares.
    """
    mixture = mixture or {}
    if any(not 0 <= w < float("inf") for w in mixture.values()):
        raise ValueError("a mixture's shares are finite and not negative")
    left = max(0.0, 1.0 - sum(mixture.values()))
    wanted = F.element_at(F.create_map(*[F.lit(x) for s, w in mixture.items() for x in (s, float(w))]), F.col("source")) if mixture else F.lit(None).cast("double")
    rows = sums.select("source", "n", wanted.alias("wanted"))
    free = rows.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("wanted").isNull(), F.col("n"))), F.lit(0)).alias("free"))
    rows = rows.crossJoin(F.broadcast(free)).select("source", (F.col("n") / F.col("total")).alias("own"), F.coalesce("wanted", F.try_divide(F.lit(left) * F.col("n"), "free")).alias("raw"))
    scale = rows.agg(F.sum("raw").alias("of_early"), F.sum(F.when(F.col("raw") <= 0, F.col("own"))).alias("of_late"))
    late = F.col("raw") <= 0
    share = F.when(late, F.try_divide("own", "of_late")).otherwise(F.try_divide("raw", "of_early"))
    return rows.crossJoin(F.broadcast(scale)).select("source", (share * WINDOW_TOKENS).alias("grant"), late.alias("late"))  # totals are one row


def placed(tokens: DataFrame, mixture: dict[str, float] | None, length: int) -> DataFrame:
    """(_part, _row, position): where each row of tokens begins in the stream of all windows."""
    rows = tokens.select("_part", "_row", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "n", "_queued")
    queue = ["source", "no_source"]
    totals = rows.groupBy("_part", *queue).agg(F.sum("n").alias("n"))
    totals = staged(totals, "queues")
    before = block_offsets(totals, "_part", queue, F.col("n"), "_before")
    sums = totals.groupBy(*queue).agg(F.sum("n").alias("n"))
    name = F.when(~F.col("no_source"), F.col("source"))
    grants = target_shares(sums.select(name.alias("source"), "n"), mixture)
    grants = grants.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "grant", "late")
    # Late sources begin with the window after the last of the others.
    ended = sums.join(grants.where("not late"), queue).agg(F.coalesce(F.max(F.ceil(F.col("n") / F.col("grant"))), F.lit(0)).cast("long").alias("_ended"))
    start = before.join(grants, queue).crossJoin(F.broadcast(ended))  # one row
    served = rows.join(start, ["_part", *queue])
    finish = (F.col("_before") + F.col("_queued")) / F.col("grant")
    window = F.greatest(F.ceil(finish).cast("long") - 1, F.lit(0).cast("long")) + F.when(F.col("late"), F.col("_ended")).otherwise(0)
    served = served.select("_part", "_row", "n", *queue, finish.alias("finish"), window.alias("window"))
    own = Window.partitionBy("window").orderBy("finish", *queue, "_part", "_row").rowsBetween(Window.unboundedPreceding, -1)
    served = staged(served.select("_part", "_row", "n", "window", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("inner")), "windows")
    windows = served.groupBy("window").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("window") / WINDOWS_PER_BLOCK))
    blocks = block_offsets(windows, "block", [], F.col("n"), "_block_start")
    inside = Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    starts = windows.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
    starts = starts.select("window", (F.col("_block_start") + F.col("_inside")).alias("_start"))
    return served.join(starts, "window").select("_part", "_row", (F.col("_start") + F.col("inner")).alias("position"))


PIECES = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, mixture: dict[str, float] | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """The pieces of all rows of docs (doc_id, source, text), each with its place in a sequence.

    Columns: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, if
    with_ids, ids (array<int>). Tokenized rows are written to the shared folder, once; only their
    numbers are sorted into windows, and each row of ids moves once, to be cut. mixture is as in
    target_shares.
    """
    tokens = staged(tokenized(docs, tokenizer), "tokens")
    rows = tokens.select("_part", "_row", "doc_id", "source", "ids", "n").join(placed(tokens, mixture, length), ["_part", "_row"])
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, STEP):
                some = b.slice(low, STEP)
                owner, out = [], []
                for k, (raw, n, position) in enumerate(zip(*(some.column(c).to_pylist() for c in ("ids", "n", "position")), strict=True)):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    at = 0
                    while at < n:
                        seq, offset = divmod(position + at, length)
                        size = min(length - offset, n - at)
                        piece = ids[at : at + size]
                        owner.append(k)
                        out.append((at, size, n, seq, offset, zlib.crc32(piece.tobytes()), piece.astype(np.int32) if with_ids else None))
                        at += size
                if out:
                    *numbers, pieces = zip(*out, strict=True)
                    own = some.select(["doc_id", "source"]).take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, pa.int64()) for c in numbers), pa.array(pieces, pa.list_(pa.int32()))], names=PIECES)

    pieces = rows.mapInArrow(cut, f"doc_id {kinds['doc_id']}, source {kinds['source']}, {PIECE}, ids_crc32 long, ids array<int>")
    return pieces if with_ids else pieces.drop("ids")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 2048 tokens, sources in the corpus's own proportions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    pieces = pack(docs, tokenizer or word_tokenizer(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
