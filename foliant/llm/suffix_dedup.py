"""Suffix-array dedup over a sparse suffix array: passages of MIN_WORDS words or more that repeat.

Words are compared with A-Z lower-cased; white space doesn't matter. The unit is a window of
MIN_WORDS words. A window is repeated if its words occur elsewhere in the corpus, in the same or
another text, and its first occurrence (least doc_id, then least position) stays.

1. Sparse suffixes. In each window the ``gram``-word gram of least hash among the first
   MIN_WORDS - PREFIX + 1 is its minimiser; suffixes are kept only where some window has its
   minimiser, about one in sixteen. Equal windows keep the same suffix, because content picks it.
2. Sort and compare. Suffixes are range-partitioned and sorted by their first PREFIX words
   (as a 64-bit hash, so that ``sorted`` means equal prefixes are neighbours) and by occurrence. A
   suffix whose neighbour shares the prefix is a candidate; so are the ends of a partition, whose
   neighbours lie elsewhere. A prefix that a third of all texts share is spread over partitions,
   since occurrence is part of the sort key, and is never paired.
3. Extend. Candidates of one prefix are compared with the one that occurs first, word by word, to
   the left and to the right as far as windows with this minimiser reach. The windows within such a
   match are repeated there. That is one comparison a candidate, whatever the size of the group.
4. The rest. Windows with their minimiser at the candidate that the match does not cover are not in
   the first suffix's text, yet may occur in others of the group: these few are compared with each
   other by two independent 64-bit hashes.

Texts of equal hash are one text in all of this. The first document of such a group stands for it,
the others are repeated as a whole if they have MIN_WORDS words and a second hash agrees too.

Defined results: null and short texts have no passages; rows equal in doc_id and text count as
one document; a null doc_id sorts last; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, STEP, staged, with_values
from .simhash import keyed_rows

MIN_WORDS = 50
PREFIX = 20
GRAM = 8
#: Bytes of windows that are hashed together.
HASHED = 1 << 18
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Roller:
    """Hashes of word ranges of a text by prefix sums modulo 2**64."""

    def __init__(self, seed: int = 20240229) -> None:
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(65, 91):
            self.of_byte[c] = self.of_byte[c + 32]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.base = 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            step = lambda x: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))])
            self.up, self.down = step(self.base), step(pow(self.base, -1, 1 << 64))
        return self.up, self.down

    @staticmethod
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair."""
        up, down = self.powers(len(values) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)])])
        return self.mixed((sums[end] - sums[start]) * down[start])

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's bytes and where its words begin and end there."""
        return self.spans_of((text or "").encode("utf-8", "replace"))

    def spans_of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], ~self.blank[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return raw, edges[::2], edges[1::2]

    def words(self, text: str | None) -> np.ndarray:
        return self.words_of((text or "").encode("utf-8", "replace"))

    def words_of(self, data: bytes) -> np.ndarray:
        """A hash of each word of data."""
        raw, start, end = self.spans_of(data)
        return self.ranges(self.of_byte[raw], start, end) if len(start) else np.zeros(0, np.uint64)

    def grams(self, words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n words from each position, or from each of at."""
        at = np.arange(max(0, len(words) - n + 1)) if at is None else at
        return self.ranges(words, at, at + n)


def anchors(roll: Roller, words: np.ndarray, min_words: int, prefix: int, gram: int) -> np.ndarray:
    """For each window of min_words words: the position of its minimiser."""
    windows = len(words) - min_words + 1
    if windows < 1:
        return np.zeros(0, np.int64)
    reach = min_words - prefix + 1
    g = roll.grams(words, gram)[: windows + reach - 1]
    return np.arange(windows) + np.lib.stride_tricks.sliding_window_view(g, reach).argmin(1)


ROWS = "key long, tkey long, pos int, doc_id long, rkey long, check long"


def sparse_suffixes(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX, gram: int = GRAM) -> DataFrame:
    """The kept suffixes (key, tkey, pos) of docs (doc_id, text), and a row for each document.

    A document's row has a null key, its number of words in pos, its doc_id and its row key. A
    task gives the suffixes of equal texts once.
    """

    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, seen = Roller(), {}
        for b in batches:
            n, parts = [], []
            for text, tkey in zip(b.column("text"), b.column("tkey").to_pylist(), strict=True):
                if tkey not in seen:
                    w = roll.words(text.as_py())
                    seen[tkey] = len(w)
                    at = np.unique(anchors(roll, w, min_words, prefix, gram))
                    if len(at):
                        parts.append((roll.grams(w, prefix, at).view(np.int64), np.full(len(at), tkey, np.int64), at.astype(np.int32)))
                n.append(seen[tkey])
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in kinds[3:])], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), b.column("tkey"), pa.array(n, pa.int32()), *(b.column(c) for c in ("doc_id", "rkey", "check"))], names=names)

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tkey"), F.xxhash64("doc_id", "text").alias("rkey"), F.xxhash64(F.lit(1), "text").alias("check"))
    return keyed.mapInArrow(run, ROWS)


def candidates(suffixes: DataFrame) -> DataFrame:
    """(key, tkey, pos) of suffixes whose sorted neighbour has the same prefix in another place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sure = None, False  # the row before, and whether it is given out already
        for b in batches:
            if last is not None:
                b = pd.concat([last, b])
            b = b.drop_duplicates()
            key = b["key"].to_numpy()
            same = key[1:] == key[:-1]
            hit = np.append(same, False) | np.insert(same, 0, last is None)
            if last is not None and sure:
                hit[0] = False
            yield b[hit][["key", "tkey", "pos"]]
            sure = bool(hit[-1]) or (len(b) == 1 and sure)
            last = b.iloc[-1:]
        if last is not None and not sure:
            yield last[["key", "tkey", "pos"]]

    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = suffixes.repartitionByRange(n, "key", "tkey", "pos").sortWithinPartitions("key", "tkey", "pos")
    return dealt.mapInPandas(run, "key long, tkey long, pos int")


def surroundings(texts: DataFrame, min_words: int, prefix: int, gram: int) -> DataFrame:
    """(key, first, tkey, pos, start, words) of the candidates.

    start is where the first window with its minimiser at the candidate begins, words the words
    from there to the end of the last such window, in lower case. texts: tkey, text, at (the
    candidates' key, pos and whether they come first of their prefix), one row for each distinct text.
    """

    def start() -> Callable[[list], list[pa.Array]]:
        roll = Roller()

        def make(given: list) -> list[pa.Array]:
            found = []
            for x in given:
                raw, start, end = roll.spans(x["text"])
                anchor = anchors(roll, roll.ranges(roll.of_byte[raw], start, end) if len(start) else np.zeros(0, np.uint64), min_words, prefix, gram)
                lower = raw.tobytes().translate(LOWER)
                # Minimisers never move back, so a candidate's windows are neighbours.
                places = np.array([y["pos"] for y in x["at"]])
                firsts, ends = np.searchsorted(anchor, places, "left"), np.searchsorted(anchor, places, "right")
                found.append([{"key": y["key"], "first": y["first"], "pos": y["pos"], "start": one, "words": b" ".join(lower[start[one] : end[two + min_words - 2]].split())} for y, one, two in zip(x["at"], firsts.tolist(), ends.tolist(), strict=True) if one < two])
            return [pa.array(found, pa.list_(pa.struct([("key", pa.int64()), ("first", pa.bool_()), ("pos", pa.int32()), ("start", pa.int32()), ("words", pa.binary())])))]

        return make

    given = texts.select("tkey", F.struct("text", "at").alias("given"))
    found = with_values(given, ["tkey"], start, "around array<struct<key: bigint, first: boolean, pos: int, start: int, words: binary>>", "given")
    return found.select("tkey", F.explode("around").alias("a")).select("a.key", "a.first", "tkey", "a.pos", "a.start", "a.words")


def common(a: bytes, b: bytes) -> int:
    """How many bytes the two begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0  # a[:low] == b[:low], a[:n] != b[:n]
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def common_words(a: bytes, b: bytes) -> int:
    """How many words the two, words with single blanks between them, begin with in common."""
    n = common(a, b)
    whole = (n == len(a) or a[n] == 32) and (n == len(b) or b[n] == 32)
    return a.count(b" ", 0, n) + (whole and n > 0)


def blank_after(words: bytes, n: int) -> int:
    """Where the blank after the first n words is; -1 for none of them."""
    at = -1
    for _ in range(n):
        at = words.index(b" ", at + 1)
    return at


def extended(pairs: DataFrame, min_words: int) -> DataFrame:
    """What a candidate's comparison with the first suffix of its prefix gives.

    pairs: (tkey, pos, start, words, ftkey, fpos, fstart, fwords). Rows (tkey, lo, hi, removed, h,
    g): windows from lo to hi are repeated, removed for the candidate and not for the first; with
    hashes h and g, a single window that is still to be compared with others.
    """
    schema = pa.schema([("tkey", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("removed", pa.bool_()), ("h", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollers = Roller(), Roller(20250311)

        def windows(rest: list[tuple[int, int, bytes, np.ndarray]]) -> pa.RecordBatch:
            """Windows that no match covers, of (tkey, start, words, their places), hashed together."""
            before = np.cumsum([0, *(words.count(b" ") + 1 for _, _, words, _ in rest)])
            at = np.concatenate([own - start + n for (_, start, _, own), n in zip(rest, before[:-1], strict=True)])
            data, places = b" ".join(words for _, _, words, _ in rest), pa.array(np.concatenate([own for *_, own in rest]), pa.int32())
            keys = pa.array(np.repeat(np.array([x[0] for x in rest], np.int64), [len(own) for *_, own in rest]))
            return pa.RecordBatch.from_arrays([keys, places, places, pa.array(np.ones(len(at), bool)), *(pa.array(r.grams(r.words_of(data), min_words, at).view(np.int64)) for r in rollers)], schema=schema)

        for b in batches:
            out, rest, held = set(), [], 0
            for tkey, pos, start, words, ftkey, fpos, fstart, fwords in zip(*(b.column(c).to_pylist() for c in ("tkey", "pos", "start", "words", "ftkey", "fpos", "fstart", "fwords")), strict=True):
                cut, fcut = blank_after(words, pos - start), blank_after(fwords, fpos - fstart)
                right = common_words(words[cut + 1 :], fwords[fcut + 1 :])
                left = common_words(words[: max(cut, 0)][::-1], fwords[: max(fcut, 0)][::-1])
                lo, hi = pos - left, pos + right - min_words  # the first and last window within the match
                if lo <= hi:
                    out.add((tkey, lo, hi, True))
                    out.add((ftkey, lo - pos + fpos, hi - pos + fpos, False))
                else:
                    lo, hi = pos, pos - 1
                last = start + words.count(b" ") + 1 - min_words
                if start < lo or hi < last:
                    rest.append((tkey, start, words, np.array([k for k in range(start, last + 1) if not lo <= k <= hi])))
                    held += len(words)
                    if held > HASHED:
                        yield windows(rest)
                        rest, held = [], 0
            if out:
                columns = [pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())], schema=schema)
            if rest:
                yield windows(rest)

    return pairs.select("tkey", "pos", "start", "words", "ftkey", "fpos", "fstart", "fwords").mapInArrow(run, "tkey long, lo int, hi int, removed boolean, h long, g long")


def merged(found: DataFrame, min_words: int) -> DataFrame:
    """(tkey, start_word, n_words, removed): runs of overlapping windows; found has tkey, lo, hi, removed, each once."""

    row_bits = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                some = b.slice(at, STEP)
                spans = some.column("at")
                row = np.repeat(np.arange(len(spans), dtype=np.int64), spans.value_lengths().to_numpy())
                # Texts follow each other, each in a range of its own, so that one pass serves all.
                lo, hi = ((row << row_bits) + spans.flatten().field(c).to_numpy() for c in ("lo", "hi"))
                order = np.argsort(lo)
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(lo[1:] - reach[:-1] > min_words)
                start, end = lo[np.insert(new + 1, 0, 0)], reach[np.append(new, len(lo) - 1)] + min_words
                texts = some.select(["tkey", "removed"]).take(pa.array(start >> row_bits))
                yield pa.RecordBatch.from_arrays([texts.column("tkey"), pa.array(start & ((1 << row_bits) - 1), pa.int32()), pa.array(end - start, pa.int32()), texts.column("removed")], names=["tkey", "start_word", "n_words", "removed"])

    by_text = found.groupBy("tkey", "removed").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))
    return by_text.select("tkey", "removed", "at").mapInArrow(run, "tkey long, start_word int, n_words int, removed boolean")


def first_marked(found: DataFrame, of_text: DataFrame) -> DataFrame:
    """found (key, tkey, pos) with first: whether the row comes first of its key; keys of one row go.

    of_text has tkey and doc_id. No words are needed for this, so they are shuffled once only, to be compared.
    """
    found = staged(found, "candidates")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "pos")
    first = found.join(of_text.select("tkey", "doc_id"), "tkey").groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("f")).where("n > 1")
    # Both sides lie in files, so that a common prefix can be split.
    first = staged(first.select("key", F.col("f.tkey").alias("ftkey"), F.col("f.pos").alias("fpos")), "first-suffixes")
    return found.join(first, "key").select("key", "tkey", "pos", F.expr("tkey = ftkey and pos = fpos").alias("first"))


def repeated_windows(around: DataFrame, of_text: DataFrame, min_words: int) -> DataFrame:
    """(tkey, lo, hi, removed), distinct, of the candidates around; of_text has tkey and doc_id."""
    # Rows of a prefix meet its first one; both sides lie in files, so that a common prefix can be split.
    first = around.where("first").select("key", *[F.col(c).alias(f"f{c}") for c in ("tkey", "pos", "start", "words")])
    pairs = around.where("not first").join(first, "key")
    texts = of_text.select("tkey", F.col("doc_id").isNull().alias("no_id"), "doc_id")
    found = staged(extended(pairs, min_words), "extended")
    whole = found.where("h is null").select("tkey", "lo", "hi", "removed").distinct()
    rest = found.where("h is not null").join(texts, "tkey").select("h", "g", "no_id", "doc_id", "tkey", F.col("lo").alias("s"))
    rest = staged(rest, "rest")
    place = F.struct("no_id", "doc_id", "tkey", "s")
    ends = staged(rest.groupBy("h", "g").agg(F.min(place).alias("one"), F.max(place).alias("last")).where("one <> last").select("h", "g", "one"), "rest-ends")
    single = rest.join(ends, ["h", "g"]).select("tkey", F.col("s").alias("lo"), F.col("s").alias("hi"), (place != F.col("one")).alias("removed")).distinct()
    return whole.unionByName(single)


def passages(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX, gram: int = GRAM) -> DataFrame:
    """(doc_id, rkey, start_word, n_words, removed) of all repeated passages of docs (doc_id, text).

    removed is false for the windows that occur there first. Both kinds may overlap in a document.
    """
    rows = staged(sparse_suffixes(docs, min_words, prefix, gram), "suffixes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rkey")
    own = rows.where("key is null")
    of_text = own.groupBy("tkey").agg(F.min_by(F.struct("doc_id", "rkey", "check"), order).alias("f"), (F.min(order) != F.max(order)).alias("copied"), F.max("pos").alias("n_words"))
    of_text = staged(of_text.select("tkey", "f.*", "copied", "n_words"), "texts")
    found = first_marked(candidates(rows.where("key is not null").select("key", "tkey", "pos")).distinct(), of_text)
    at = found.groupBy("tkey").agg(F.collect_list(F.struct("key", "pos", "first")).alias("at"))
    # One row for each candidate text: its first document's.
    wanted = of_text.join(at, "tkey").select("tkey", F.col("rkey").alias("rkey"), "at")
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("rkey")).join(wanted, "rkey").dropDuplicates(["tkey"])
    around = staged(surroundings(texts, min_words, prefix, gram), "surroundings")
    # A text with copies repeats as a whole; where it has windows removed, those stay removed.
    whole = of_text.where(F.col("copied") & (F.col("n_words") >= min_words))
    spans = merged(repeated_windows(around, of_text, min_words), min_words).join(of_text.select("tkey", "doc_id", "rkey", "copied"), "tkey")
    firsts = spans.where("removed or not copied").select("doc_id", "rkey", "start_word", "n_words", "removed")
    firsts = firsts.unionByName(whole.select("doc_id", "rkey", F.lit(0).alias("start_word"), "n_words", F.lit(False).alias("removed")))
    copies = own.select("tkey", F.col("doc_id").alias("own_id"), F.col("rkey").alias("own_key"), F.col("check").alias("own_check")).distinct()
    others = copies.join(whole, "tkey").where("own_key <> rkey and own_check = check")
    return firsts.unionByName(others.select(F.col("own_id").alias("doc_id"), F.col("own_key").alias("rkey"), F.lit(0).alias("start_word"), "n_words", F.lit(True).alias("removed")))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words [start, start + n) of each span and the white space after them."""
    raw, start, end = Roller().spans(text)
    keep = np.ones(len(raw), bool)
    for s, n in spans:
        keep[start[s] : start[s + n] if s + n < len(start) else len(raw)] = False
    return raw[keep].tobytes().decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without repeated passages but their first occurrence; a text left empty goes.

    All columns of docs are kept; n_chars, if there, follows the new text. Of rows equal in
    doc_id and text, all are treated alike.
    """
    rows = keyed_rows(docs)
    cuts = passages(docs, min_words).where("removed").groupBy(F.col("rkey").alias("key")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("cuts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [cut_words(t, [(x["start_word"], x["n_words"]) for x in c]) for t, c in zip(b["text"], b["cuts"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "text": text})

    joined = rows.join(cuts, "key", "left")
    # Texts without cuts needn't pass through Python; of equal rows' texts one does.
    edited = joined.where("cuts is not null").dropDuplicates(["key"]).select("key", "text", "cuts").mapInPandas(run, "key long, text string").withColumnRenamed("text", "cut")
    changed = rows.join(edited, "key").where(F.btrim("cut", F.lit(BLANKS)) != "").withColumn("row", F.col("row").withField("text", F.col("cut")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("row", F.col("row").withField("n_chars", F.char_length("cut").cast(dict(docs.dtypes)["n_chars"])))
    return joined.where("cuts is null").select("row.*").unionByName(changed.select("row.*"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more in all documents, first occurrences included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return passages(docs).select("doc_id", "start_word", "n_words", "removed")
