"""Exact and near duplicates of documents and files, and merging of correspondents.

Groups are keyed by content hashes. Ranking by row_number ships every row of a hash to one task;
where only the first row matters, an aggregate with map-side combining and a join take its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.names import name_penalty, normalize_name, text_fingerprint
from foliant.sources.staging import once, spread

from .forest import roots


def _first_ids(df: DataFrame, by: Column | str, order: list, id_col: str) -> DataFrame:
    """(key, first): id of the first row of each key, combined before the shuffle."""
    return df.groupBy(by).agg(F.min_by(id_col, F.struct(*order, id_col)).alias("first_id"))


def dedup_exact(df: DataFrame, hash_col: str, order: list, id_col: str, keep_unhashed: bool = False) -> DataFrame:
    """The first row of each hash; rows without one are dropped unless keep_unhashed."""
    has = F.coalesce(F.col(hash_col) != "", F.lit(False))
    kept = df.where(has).join(_first_ids(df.where(has), hash_col, order, id_col).select(F.col("first_id").alias(id_col)), id_col, "left_semi")
    return kept.unionByName(df.where(~has)) if keep_unhashed else kept


def mark_duplicates(files: DataFrame, hash_col: str = "hash", priority: str = "priority", path: str = "path") -> DataFrame:
    """is_duplicate and duplicate_of: the first path of the hash by source priority, then path."""
    firsts = files.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(F.struct(priority, path)).alias("f"))
    out = files.join(firsts.select(hash_col, F.col(f"f.{path}").alias("first_path")), hash_col, "left")
    copy = F.coalesce(F.col("first_path") != F.col(path), F.lit(False))
    return out.withColumn("is_duplicate", copy).withColumn("duplicate_of", F.when(copy, F.col("first_path"))).drop("first_path")


#: Classes of a head's grams whose numbers its sketch holds, the words of 64 bits that takes, and the grams' length.
SKETCH_CLASSES, SKETCH, SKETCH_GRAM = 256, 16, 3
#: Numbers modulo eight as four bits, so that as many bits differ as steps lie between two of them, going round.
STEPS = np.array([0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000], np.uint8)
#: Most heads of which common grams are counted, and most such grams. They only steer which grams are looked up.
COUNTED, COMMON = 65536, 100_000
#: Length from which heads have longer grams.
LONG_HEAD = 100
#: Heads whose keys are found together, heads whose windows are chosen together, and bits of a key.
HEADS_AT_ONCE, CHOSEN_AT_ONCE, KEY_BITS = 512, 64, 48
#: Keys that one task groups at once; keys of so many heads have their members' places compared there, so many pairs at a time.
KEYS_OF_A_PART, ENUMERATED, PAIRS_AT_ONCE = 4_000_000, 512, 2_000_000

#: Pairs whose heads are brought together in one group, and pairs whose edit distances are computed at once.
PAIRS_OF_A_CELL, DISTANCES_AT_ONCE = 20_000, 2048


def most_edits(length: int, threshold: float) -> int:
    """Edits by which the longer of two similar heads, of this length, may differ from the other."""
    return int(length * (1 - threshold))


def gram_sizes(threshold: float, chars: int) -> list[tuple[int, int, int, int]]:
    """(least length, most length, gram, window) of the classes of heads.

    Of a head of n characters with t edits the unchanged ones lie in t + 1 runs at most, so one run
    has (n - t) / (t + 1) or more; where gram + window - 1 is that long, its least-hashed gram is the
    same in both heads. A pair belongs to the class of its longer head, so classes overlap by the edits.
    """
    out = []
    for low, high in ((1, min(LONG_HEAD, chars + 1) - 1), (LONG_HEAD, chars)):
        runs = [-(-(n - t) // (t + 1)) for n in range(low, high + 1) if (t := most_edits(n, threshold))]
        if runs:
            gram = max(1, min(runs) * 3 // 4)
            out.append((low - most_edits(low, threshold), high, gram, min(runs) - gram + 1))
    return out


def most_edits_with(length: int, low: int, high: int, threshold: float) -> int:
    """Edits by which a head of this length may differ from a similar one of low to high characters."""
    return max((t for n in range(max(low, length), high + 1) if n - (t := most_edits(n, threshold)) <= length), default=0)


def _coded(heads: list[str], apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heads' characters in one array, each followed by so many zeros; where each head begins, and its length."""
    lengths = np.fromiter(map(len, heads), np.int64, len(heads))
    codes = np.frombuffer("".join(h + "\0" * apart for h in heads).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    return codes, np.cumsum(lengths + apart) - lengths - apart, lengths


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each place."""
    n = max(0, len(codes) - gram + 1)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h + codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., as many as counts[0], then those from starts[1]."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _rarest(cost: np.ndarray, span: int, wanted: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """For each row of cost (by a window's start, infinite beyond the last): starts of so many disjoint windows of span, of least total cost.

    A window begins at most as many places late as are spare in its row. What a row doesn't want is -1.
    """
    rows, most, late = len(cost), wanted.max(), spare.max() + 1
    cost = np.pad(cost, ((0, 0), (0, max(0, (most - 1) * span + late - cost.shape[1]))), constant_values=np.inf)
    best, steps = np.zeros((rows, late), np.float32), []
    for k in range(most):
        best = np.minimum.accumulate(best + cost[:, k * span : k * span + late], axis=1)
        steps.append(best)
    out, end = np.full((rows, most), -1), np.full(rows, late - 1)
    for k in range(most - 1, -1, -1):
        at = np.flatnonzero(k < wanted)
        own = steps[k][at]
        end[at] = (own > own[np.arange(len(at)), end[at], None]).sum(1)
        out[at, k] = end[at] + k * span
    return out


def _keys(heads: list[str], classes: list[tuple[int, int, int, int]], edits_with: list[np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """(head, key, lo, hi, looked_up) of the distinct keys of each head, in order of heads: the hash and the first and last place.

    The looked-up ones are those of as many disjoint windows as may have an edit each (edits_with, by class
    and length), and one more; windows are chosen whose keys are rare by common (keys in order, counts).
    """
    names, counts = common
    out = []
    for kind, (low, high, gram, window) in enumerate(classes):
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        mine = np.flatnonzero((lengths >= max(low, gram)) & (lengths <= high))
        if not len(mine):
            continue
        codes, begins, lengths = _coded([heads[i] for i in mine], gram + window)
        grams = lengths - gram + 1
        h = np.full(len(codes) + window, np.iinfo(np.uint64).max, np.uint64)
        at = _ranges(begins, grams)
        h[at] = _grams(codes, gram)[at]
        least, place = h[: len(codes)].copy(), np.arange(len(codes))
        for k in range(1, window):
            less = h[k : k + len(codes)] < least
            least[less] = h[k : k + len(codes)][less]
            place[less] = np.flatnonzero(less) + k
        windows = np.maximum(grams - window, 0) + 1
        firsts = np.cumsum(windows) - windows
        at, owner = _ranges(begins, windows), np.repeat(np.arange(len(mine)), windows)
        place = place[at]
        new = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]
        occurrence = np.cumsum(new) - 1
        place, owner = place[new], owner[new]
        key = ((least[at][new] * np.uint64(2 * len(classes)) + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - KEY_BITS)
        order = np.argsort(owner.astype(np.uint64) << np.uint64(KEY_BITS) | key, kind="stable")
        own, sorted_key, where = owner[order], key[order].view(np.int64), (place - begins[owner])[order]
        new = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | (own[1:] != own[:-1])]
        distinct = np.empty(len(order), np.int64)
        distinct[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        looked_up = np.zeros(len(starts), bool)

        wanted, span = edits_with[kind][lengths] + 1, gram + window - 1
        fits = wanted * span <= lengths
        looked_up[distinct[occurrence[~np.repeat(fits, windows)]]] = True
        cost = np.ones(len(key), np.float32)
        if len(names):
            near = np.minimum(np.searchsorted(names, key.view(np.int64)), len(names) - 1)
            cost = np.where(names[near] == key.view(np.int64), counts[near], 1).astype(np.float32)
        even = np.zeros(len(mine), bool)
        even[:] = np.maximum.reduceat(cost, np.searchsorted(owner, np.arange(len(mine)))) == 1
        plain = np.flatnonzero(fits & even)
        looked_up[distinct[occurrence[np.repeat(firsts[plain], wanted[plain]) + _ranges(np.zeros(len(plain), np.int64), wanted[plain]) * span]]] = True
        rest = np.flatnonzero(fits & ~even)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        for k in range(0, len(rest), CHOSEN_AT_ONCE):
            some = rest[k : k + CHOSEN_AT_ONCE]
            table = np.full((len(some), windows[some].max()), np.inf, np.float32)
            table[np.repeat(np.arange(len(some)), windows[some]), _ranges(np.zeros(len(some), np.int64), windows[some])] = cost[occurrence[_ranges(firsts[some], windows[some])]]
            chosen = _rarest(table, span, wanted[some], lengths[some] - wanted[some] * span)
            looked_up[distinct[occurrence[(chosen + firsts[some, None])[chosen >= 0]]]] = True
        out.append((mine[own[starts]], sorted_key[starts], np.minimum.reduceat(where, starts), np.maximum.reduceat(where, starts), looked_up))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
    flat = [np.concatenate(x) for x in zip(*out, strict=True)]
    order = np.argsort(flat[0], kind="stable")
    return [x[order] for x in flat]


def _edits_with(threshold: float, chars: int) -> list[np.ndarray]:
    """By class and length of a head: most_edits_with."""
    return [np.array([most_edits_with(n, low, high, threshold) for n in range(chars + 1)]) for low, high, _, _ in gram_sizes(threshold, chars)]


def _keyed_heads(firsts: DataFrame, threshold: float, chars: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(first_id, keys) of firsts (first_id, head): a head's keys with their first and last place and whether they are looked up."""
    classes, edits_with = gram_sizes(threshold, chars), _edits_with(threshold, chars)
    kinds = [("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("looked_up", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, HEADS_AT_ONCE):
                some = b.slice(at, HEADS_AT_ONCE)
                head, *columns = _keys(some.column("head").to_pylist(), classes, edits_with, common)
                ends = np.r_[0, np.cumsum(np.bincount(head, minlength=some.num_rows))]
                arrays = [pa.array(x, kind) for x, (_, kind) in zip(columns, kinds, strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=[pa.field(*f) for f in kinds]))
                yield pa.RecordBatch.from_arrays([some.column("first_id"), listed], names=["first_id", "keys"])

    return firsts.select("first_id", "head").mapInArrow(run, f"first_id {dict(firsts.dtypes)['first_id']}, keys array<struct<key: bigint, lo: int, hi: int, looked_up: boolean>>")


def _common_keys(firsts: DataFrame, threshold: float, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest keys, in order, and in how many of at most about COUNTED heads, picked by hash, each is."""
    share = min(1.0, COUNTED / max(firsts.count(), 1))
    some = firsts.where(F.pmod(F.xxhash64("head"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = _keyed_heads(spread(some, "first_id"), threshold, chars, none).select(F.explode("keys.key").alias("key"))
    found = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 2").orderBy(F.desc("m"), "key").limit(COMMON).collect()  # bounded
    found = np.array(sorted((r["key"], r["m"]) for r in found), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])


SKETCHES = [f"s{k}" for k in range(SKETCH)]


def _sketches(heads: list[str]) -> np.ndarray:
    """Of each head SKETCH words: the numbers of its grams in each class, modulo eight, as STEPS.

    An edit takes SKETCH_GRAM grams away and brings as many, so it changes as many bits twice at most.
    """
    codes, begins, lengths = _coded(heads, SKETCH_GRAM)
    grams = np.maximum(lengths - SKETCH_GRAM + 1, 0)
    h = _grams(codes, SKETCH_GRAM)[_ranges(begins, grams)]
    kinds = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % SKETCH_CLASSES
    counts = np.bincount(np.repeat(np.arange(len(heads)), grams) * SKETCH_CLASSES + kinds, minlength=len(heads) * SKETCH_CLASSES)
    bits = STEPS[counts & 7].reshape(len(heads), SKETCH_CLASSES)
    return np.ascontiguousarray(bits[:, ::2] | bits[:, 1::2] << 4).view(np.int64)


def _sketched_heads(firsts: DataFrame, threshold: float) -> DataFrame:
    """(first_id, n, edits, s0, s1, ...) of firsts (first_id, head): length, edits allowed and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, HEADS_AT_ONCE):
                some = b.slice(at, HEADS_AT_ONCE)
                heads = some.column("head").to_pylist()
                words = [pa.array(np.ascontiguousarray(x)) for x in _sketches(heads).T]
                yield pa.RecordBatch.from_arrays([some.column("first_id"), pa.array([len(h) for h in heads], pa.int32()), pa.array([most_edits(len(h), threshold) for h in heads], pa.int32()), *words], names=["first_id", "n", "edits", *SKETCHES])

    return firsts.select("first_id", "head").mapInArrow(run, f"first_id {dict(firsts.dtypes)['first_id']}, n int, edits int, " + ", ".join(f"{s} long" for s in SKETCHES))


def _dealt_keys(firsts: DataFrame, threshold: float, chars: int, common: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """Keys of firsts' heads dealt over parts by key, a row a part and batch: its heads (ids, lengths, number of keys) and their keys.

    A key's row of its own would take several times as many bytes, nearly all for keys that one head alone has.
    """
    classes, edits_with = gram_sizes(threshold, chars), _edits_with(threshold, chars)
    kind = dict(firsts.dtypes)["first_id"]
    names = ["part", "ids", "n", "own", "key", "lo", "wide", "looked_up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column("first_id"), []
            heads = b.column("head").to_pylist()
            for at in range(0, len(heads), HEADS_AT_ONCE):
                head, key, lo, hi, looked_up = _keys(heads[at : at + HEADS_AT_ONCE], classes, edits_with, common)
                found.append(((head + at).astype(np.int32), (key % parts).astype(np.int32), (key // parts).astype(np.uint64).astype(np.uint32), lo.astype(np.int32), (hi - lo).astype(np.int32), looked_up))
            head, part, key, lo, wide, looked_up = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(part, kind="stable")
            head, part = head[order], part[order]
            lengths = np.fromiter(map(len, heads), np.int32, len(heads))
            new = np.r_[True, (head[1:] != head[:-1]) | (part[1:] != part[:-1])][: len(part)]
            runs = np.flatnonzero(new)
            own = np.diff(np.r_[runs, len(head)]).astype(np.int32)
            given, first = np.unique(part, return_index=True)
            of_keys, of_heads = pa.array(np.r_[first, len(part)], pa.int32()), pa.array(np.r_[np.searchsorted(runs, first), len(runs)], pa.int32())
            by_head = [ids.take(pa.array(head[runs])), pa.array(lengths[head[runs]]), pa.array(own)]
            by_key = [pa.array(x[order]) for x in (key.view(np.int32), lo, wide, looked_up)]
            yield pa.RecordBatch.from_arrays([pa.array(given, pa.int32()), *(pa.ListArray.from_arrays(of_heads, x) for x in by_head), *(pa.ListArray.from_arrays(of_keys, x) for x in by_key)], names=names)

    return firsts.select("first_id", "head").mapInArrow(run, f"part int, ids array<{kind}>, n array<int>, own array<int>, key array<int>, lo array<int>, wide array<int>, looked_up array<boolean>")


def _met(ids: pa.Array, n: np.ndarray, own: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, looked_up: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(head, key, lo, hi, looked_up, h, m) of the keys that a head looks up and an earlier one has at a possible place.

    h is the earliest such head (-1 where none is looked up), m the number of the key's heads that are left.
    Of keys of over ENUMERATED heads all are left, and the key's first head is their h.
    """
    distinct = ids.dictionary_encode()
    rank = np.empty(len(distinct.dictionary), np.int64)
    rank[pc.sort_indices(distinct.dictionary).to_numpy()] = np.arange(len(rank))
    rank = rank[distinct.indices.to_numpy()]
    head = np.repeat(np.arange(len(n)), own)
    order = np.argsort(key.view(np.uint32).astype(np.uint64) << np.uint64(32) | rank[head].astype(np.uint64))
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    asked = looked_up[order] & ~new
    used = (np.bincount(group, asked, minlength=len(starts)) > 0)[group]
    order, key, asked, group = order[used], key[used], asked[used], group[used]
    head, lo, hi, looked_up = head[order], lo[order], hi[order], looked_up[order]
    new = np.r_[True, group[1:] != group[:-1]][: len(group)]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.r_[starts, len(group)])
    e, length = edits[n[head]], n[head]
    large = (size > ENUMERATED)[group]
    earliest = np.where(asked & large, starts[group] if len(starts) else 0, -1)
    held = large.copy()
    ask = np.flatnonzero(asked & ~large)
    earlier = ask - starts[group[ask]] if len(ask) else ask
    for some in np.split(ask, np.searchsorted(np.cumsum(earlier), np.arange(PAIRS_AT_ONCE, earlier.sum(), PAIRS_AT_ONCE))):
        first = starts[group[some]] if len(some) else some
        u, v = _ranges(first, some - first), np.repeat(some, some - first)
        most = np.maximum(e[u], e[v])
        fit = (lo[u] <= hi[v] + most) & (hi[u] >= lo[v] - most) & (np.abs(length[u] - length[v]) <= most)
        u, v = u[fit], v[fit]
        held[u] = True
        who, at = np.unique(v, return_index=True)
        earliest[who] = u[at]
    left = held | (earliest >= 0)
    m = np.bincount(group[left], minlength=len(starts))[group[left]]
    h = np.where(earliest[left] >= 0, head[np.maximum(earliest[left], 0)], -1) if len(left) else earliest
    return head[left], key[left], lo[left], hi[left], earliest[left] >= 0, h, m


def _shared_keys(firsts: DataFrame, threshold: float, chars: int) -> DataFrame:
    """(key, first_id, n, edits, lo, hi, looked_up, h, m): keys that several heads have, as _met leaves them, a row a head.

    All keys are shuffled once, packed, and grouped part by part; what one head alone has goes no further.
    """
    parts = max(int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-firsts.count() * chars // (3 * KEYS_OF_A_PART)))
    kind = dict(firsts.dtypes)["first_id"]
    edits = np.array([most_edits(k, threshold) for k in range(chars + 1)], np.int32)
    names = ["key", "first_id", "n", "edits", "lo", "hi", "looked_up", "h", "m"]
    dealt = _dealt_keys(firsts, threshold, chars, _common_keys(firsts, threshold, chars), parts)

    def grouped(part: int, blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        flat = {c: [b.column(c).flatten() for b in blocks] for c in blocks[0].schema.names if c != "part"}
        ids = pa.concat_arrays(flat["ids"])
        n, own, key, lo, wide = (np.concatenate([x.to_numpy() for x in flat[c]]) for c in ("n", "own", "key", "lo", "wide"))
        looked_up = np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat["looked_up"]])
        head, key, lo, hi, looked_up, h, m = _met(ids, n, own, key, lo, lo + wide, looked_up, edits)
        columns = [pa.array(key.view(np.uint32).astype(np.int64) * parts + part), ids.take(pa.array(head)), pa.array(n[head]), pa.array(edits[n[head]]), pa.array(lo), pa.array(hi), pa.array(looked_up), ids.take(pa.array(h, mask=h < 0)), pa.array(m.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for b in batches:
            given = b.column("part").to_numpy()
            starts = np.flatnonzero(np.r_[True, given[1:] != given[:-1]][: len(given)])
            for at, end in zip(starts, [*starts[1:], len(given)], strict=True):
                if blocks and given[at] != part:
                    yield grouped(part, blocks)
                    blocks = []
                part = int(given[at])
                blocks.append(b.slice(at, end - at))
        if blocks:
            yield grouped(part, blocks)

    return spread(dealt, "part").sortWithinPartitions("part").mapInArrow(run, f"key long, first_id {kind}, n int, edits int, lo int, hi int, looked_up boolean, h {kind}, m long")


def _sized() -> Column:
    return F.abs(F.col("n_u") - F.col("n_v")) <= F.greatest("edits_u", "edits_v")


def _alike() -> Column:
    """Whether lengths and sketches of u and v allow as few edits as similar heads have."""
    differing = sum((F.bit_count(F.col(f"{s}_u").bitwiseXOR(F.col(f"{s}_v"))) for s in SKETCHES), F.lit(0))
    return _sized() & (differing <= 2 * SKETCH_GRAM * F.greatest("edits_u", "edits_v"))


def edit_distances(codes: np.ndarray, lengths: np.ndarray, u: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of each pair of rows (u, v) of codes, most + 1 if it is over most.

    Rows are padded by one code that occurs nowhere else, by most // 2 + 1 or more, which adds no edits. Cells of a
    diagonal of all pairs' tables are computed at once; only those within most of the main one matter.
    """
    kind = np.uint8 if most < 250 else np.uint16
    a, b = np.ascontiguousarray(codes[u].T), np.ascontiguousarray(codes[v].T[::-1])
    middle, one = most + 1, kind(1)
    over = np.full((most + 2, len(u)), most + 1, kind)
    # Every other diagonal, so that those computed together lie together.
    planes = [over.copy(), over.copy()]
    planes[middle % 2][middle // 2] = 0
    moved = over.copy()
    for s in range(1, 2 * int(max(lengths[u].max(), lengths[v].max())) + 1):
        low = -min(s, most)
        if (s - low) % 2:
            low += 1
        own, other = planes[(middle + low) % 2], planes[(middle + low + 1) % 2]
        if s <= most:
            own[(middle - s) // 2] = own[(middle + s) // 2] = s
            low += 2
        if low > -low:
            continue
        at, before, n = (middle + low) // 2, (middle + low - 1) // 2, 1 - low
        left, cells = moved[:n], own[at : at + n]
        np.minimum(other[before : before + n], other[before + 1 : before + 1 + n], out=left)
        left += one
        differ = a[(s + low) // 2 - 1 : (s - low) // 2] != b[len(b) - (s - low) // 2 : len(b) - (s + low) // 2 + 1]
        cells += differ.view(np.uint8)
        np.minimum(cells, left, out=cells)
        np.minimum(cells, over[:n], out=cells)
    apart = lengths[u] - lengths[v]
    row = np.clip(middle + apart, 0, 2 * most + 2)
    found = np.where(row % 2, planes[1][np.minimum(row // 2, most + 1), np.arange(len(u))], planes[0][row // 2, np.arange(len(u))])
    return np.where(np.abs(apart) <= most, found, most + 1)


def _edits(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """(u, v, edits, longest) of pairs (u, v) of heads (first_id, head): edit distances, over the edits allowed if they are more.

    Pairs are dealt by both heads into cells of bounded size, to which a head goes once, not once a pair.
    """
    spark, kind = pairs.sparkSession, dict(heads.dtypes)["first_id"]
    side = math.ceil(max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() / PAIRS_OF_A_CELL) ** 0.5)
    cell = F.pmod(F.xxhash64("u"), F.lit(side)) * side + F.pmod(F.xxhash64("v"), F.lit(side))
    order = F.row_number().over(Window.partitionBy("cell").orderBy("u", "v"))
    cells = once(pairs.withColumn("cell", cell).select("u", "v", "cell", F.floor((order - 1) / PAIRS_OF_A_CELL).alias("piece")))
    texts = cells.select(F.col("cell").alias("of_cell"), F.col("piece").alias("of_piece"), F.explode(F.array("u", "v")).alias("first_id")).distinct().join(heads, "first_id")

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        u, v = (pc.index_in(pairs[x], value_set=texts["first_id"]).to_numpy() for x in "uv")
        heads = texts["head"].to_pylist()
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        longest = np.maximum(lengths[u], lengths[v])
        most = most_edits(int(lengths.max()), threshold)
        flat = np.frombuffer("".join(heads).encode("utf-32-le", "replace"), "<u4")
        kinds, flat = np.unique(flat, return_inverse=True)
        codes = np.full((len(heads), int(lengths.max()) + most + 1), len(kinds), np.uint8 if len(kinds) < 256 else np.uint32)
        codes[np.repeat(np.arange(len(heads)), lengths), _ranges(np.zeros(len(heads), np.int64), lengths)] = flat
        edits = np.concatenate([edit_distances(codes, lengths, u[k : k + DISTANCES_AT_ONCE], v[k : k + DISTANCES_AT_ONCE], most) for k in range(0, len(u), DISTANCES_AT_ONCE)])
        return pa.table({"u": pairs["u"], "v": pairs["v"], "edits": pa.array(edits, pa.int32()), "longest": pa.array(longest, pa.int32())})

    return cells.groupBy("cell", "piece").cogroup(texts.groupBy("of_cell", "of_piece")).applyInArrow(run, f"u {kind}, v {kind}, edits int, longest int")


def _closest(pairs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """(v, u, similarity): of the pairs (u, v) that are similar, the one with the least u for each v."""
    # Heads are long and few are in pairs, so they are picked once and only they are dealt for the pairs.
    paired = pairs.select(F.explode(F.array("u", "v")).alias("first_id")).distinct()
    heads = once(firsts.join(paired, "first_id", "left_semi").select("first_id", "head"))

    def similar(some: DataFrame) -> DataFrame:
        met = once(_edits(some, heads, threshold))
        return met.where(F.col("edits") <= F.floor(F.col("longest") * (1 - threshold))).select("v", "u", (1 - F.col("edits") / F.col("longest")).alias("similarity"))

    # The least u of most v is similar; only where it isn't the others are compared.
    least = pairs.groupBy("v").agg(F.min("u").alias("u"))
    first = similar(least)
    others = once(pairs.join(first.select("v"), "v", "left_anti").join(least, ["v", "u"], "left_anti"))
    found = first.unionByName(similar(others))
    return once(found.groupBy("v").agg(F.min_by(F.struct("u", "similarity"), "u").alias("b")).select("v", "b.*"))


def _earliest(firsts: DataFrame, threshold: float, chars: int, hot: int) -> DataFrame:
    """(v, u, similarity): for each head v that has a similar one with a lesser first id, the least such u.

    v looks up some of its keys, of which a similar head has one at places as far apart as edits can move
    them. It is compared with the earliest head of each key first. What is found bounds u, so keys whose earliest
    head isn't less are done: a group of copies costs one comparison a member. Members of a key of over
    ``hot`` heads have their sketches beside them, so that only possible pairs leave the join.
    """
    keys = once(_shared_keys(firsts, threshold, chars))
    heads = once(_sketched_heads(firsts, threshold))
    columns = ("first_id", "n", "edits", "lo", "hi")
    asked = keys.where("looked_up and h < first_id").select("key", "h", "m", *[F.col(c).alias("v" if c == "first_id" else f"{c}_v") for c in columns])
    held = keys.select("key", *[F.col(c).alias("u" if c == "first_id" else f"{c}_u") for c in columns])
    u, v = (heads.select(F.col("first_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "edits", *SKETCHES)]) for x in "uv")

    def alike(pairs: DataFrame) -> DataFrame:
        return once(pairs.join(u, "u").join(v, "v").where(_alike()).select("u", "v"))

    first = _closest(alike(asked.select(F.col("h").alias("u"), "v").distinct()), firsts, threshold)
    open_ = asked.join(first.select("v", F.col("u").alias("most")), "v", "left").where("most is null or h < most")
    open_ = once(open_.withColumn("most", F.coalesce("most", "v")))
    placed = "u < most and u <> h and lo_u <= hi_v + greatest(edits_u, edits_v) and hi_u >= lo_v - greatest(edits_u, edits_v)"

    few = spread(open_.where(F.col("m") <= hot), "key").join(spread(held, "key"), "key").where(placed).where(_sized()).select("u", "v").distinct()
    crowd = open_.where(F.col("m") > hot)
    crowded = held.join(crowd.select("key").distinct(), "key", "left_semi").join(u.drop("n_u", "edits_u"), "u")
    crowd = spread(crowd.join(v.drop("n_v", "edits_v"), "v"), "key").join(spread(crowded, "key"), "key").where(placed).where(_alike()).select("u", "v").distinct()
    rest = _closest(once(alike(few).unionByName(crowd).distinct()), firsts, threshold)
    return first.unionByName(rest).groupBy("v").agg(F.min_by(F.struct("u", "similarity"), "u").alias("b")).select("v", "b.*")


def _heads(docs: DataFrame, chars: int) -> DataFrame:
    """(doc_id, digest, head): the first characters of texts that aren't empty; the digest stands for them in groups and joins."""
    heads = docs.select("doc_id", F.substring("text", 1, chars).alias("head")).where("doc_id is not null").where(F.length("head") > 0)
    return heads.select("doc_id", F.unhex(F.sha2("head", 256)).alias("digest"), "head")


def _near(heads: DataFrame, members: DataFrame, threshold: float, chars: int, hot: int) -> DataFrame:
    """(doc_id, duplicate_of, similarity) of members (doc_id, digest), whose heads are among heads (doc_id, digest, head)."""
    by_digest = once(members.groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    firsts = heads.withColumnRenamed("doc_id", "first_id").join(by_digest, ["first_id", "digest"], "left_semi")
    firsts = once(firsts.dropDuplicates(["first_id", "digest"]).select("first_id", "head"))
    found = _earliest(firsts, threshold, chars, hot).select(F.col("v").alias("first_id"), F.col("u").alias("other"), "similarity")
    best = by_digest.join(found, "first_id", "left").select("digest", F.coalesce("other", "first_id").alias("duplicate_of"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return members.join(best, "digest").where("duplicate_of < doc_id").select("doc_id", "duplicate_of", "similarity")


def near_duplicates(docs: DataFrame, threshold: float = 0.95, chars: int = 1000, hot: int = 64) -> DataFrame:
    """(doc_id, duplicate_of, similarity): earliest document whose first characters are that similar.

    Similarity is one minus the edit distance over the longer length. Equal heads are compared once.
    Heads that share no least-hashed gram of a window can't be similar (gram_sizes), so no document's
    earliest is lost. Null and empty texts are similar to none.
    """
    heads = _heads(docs, chars)
    return _near(heads, once(heads.select("doc_id", "digest")), threshold, chars, hot)


def dedup_cascade(docs: DataFrame, threshold: float = 0.95, chars: int = 1000, hot: int = 64) -> DataFrame:
    """(doc_id, reason, matched): duplicates by file hash, else text fingerprint, else similarity.

    Only documents that no cheaper stage caught go on to the next. Texts are read where they lie: what is
    grouped and joined are ids and hashes, and the heads that are first of their kind.
    """
    digest = F.when(F.length("text") > 0, F.unhex(F.sha2(F.substring("text", 1, chars), 256)))
    hashed = once(docs.select("doc_id", "file_hash", text_fingerprint(F.col("text")).alias("fp"), digest.alias("digest")))
    by_hash = hashed.where("file_hash is not null").groupBy("file_hash").agg(F.min("doc_id").alias("matched"))
    first = once(hashed.join(by_hash, "file_hash").where("matched < doc_id").select("doc_id", F.lit("file_hash").alias("reason"), "matched"))
    rest = once(hashed.drop("file_hash").join(first, "doc_id", "left_anti"))
    by_text = rest.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("matched"))
    second = once(rest.join(by_text, "fp").where("matched < doc_id").select("doc_id", F.lit("text_hash").alias("reason"), "matched"))
    last = once(rest.join(second, "doc_id", "left_anti").where("doc_id is not null and digest is not null").select("doc_id", "digest"))
    third = _near(_heads(docs, chars), last, threshold, chars, hot).select("doc_id", F.lit("similarity").alias("reason"), F.col("duplicate_of").alias("matched"))
    return first.unionByName(second).unionByName(third)


def duplicate_clusters(found: DataFrame) -> DataFrame:
    """(doc_id, cluster_id, reason, matched) of everything in the cascade's rows (doc_id, reason, matched), a row a document.

    Each duplicate has one earlier match, so matches are a forest; a cluster is a tree, named by its
    first document, which has no reason and no match itself.
    """
    found = once(found)
    tops = roots(found.select(F.col("doc_id").alias("id"), F.col("matched").alias("parent"))).withColumnsRenamed({"id": "doc_id", "root": "cluster_id"})
    return tops.join(found, "doc_id", "left").select("doc_id", "cluster_id", "reason", "matched")


def cross_location(files: DataFrame, primary: str) -> DataFrame:
    """(hash, primary_path, location, path): copies elsewhere of what the primary location holds."""
    own = files.where(F.col("location") == primary).groupBy("hash").agg(F.min("path").alias("primary_path"))
    return files.where((F.col("location") != primary) & F.col("hash").isNotNull()).join(own, "hash").select("hash", "primary_path", "location", "path")


def copies_report(files: DataFrame, least: int = 3) -> DataFrame:
    """(hash, copies, locations, bytes) of hashes with that many copies or more."""
    g = files.where("hash is not null").groupBy("hash").agg(F.count("*").alias("copies"), F.countDistinct("location").alias("locations"), F.max("size").alias("bytes"))
    return g.where(F.col("copies") >= least)


def savings(files: DataFrame) -> DataFrame:
    """One row: files, distinct contents, surplus copies, bytes to be reclaimed."""
    per = files.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("unique"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("size")).alias("reclaimable"))


def new_only(df: DataFrame, existing: DataFrame, hash_col: str = "hash", title: str | None = None) -> DataFrame:
    """Rows whose hash (or lower-cased title) isn't in existing."""
    out = df.join(existing.select(hash_col).where(F.col(hash_col).isNotNull()).distinct(), hash_col, "left_anti")
    if title:
        known = existing.select(F.lower(title).alias("_t")).where("_t is not null").distinct()
        out = out.join(known, F.lower(out[title]) == known["_t"], "left_anti")
    return out


def name_groups(correspondents: DataFrame, min_docs: int = 0) -> DataFrame:
    """correspondents (id, name, document_count) in groups of two or more by normal form."""
    named = correspondents.withColumn("norm", normalize_name(F.col("name"))).where("norm <> ''")
    good = named.groupBy("norm").agg(F.count("*").alias("members"), F.sum("document_count").alias("documents")).where((F.col("members") > 1) & (F.col("documents") >= min_docs))
    return named.join(good, "norm")


def canonical_names(groups: DataFrame) -> DataFrame:
    return groups.groupBy("norm").agg(F.min_by("name", name_penalty(F.col("name"))).alias("canonical"))


def merge_plan(correspondents: DataFrame, min_docs: int = 0) -> DataFrame:
    """(id, primary_id, target_name): who merges into whom; the most documents, then least id, leads."""
    groups = name_groups(correspondents, min_docs)
    lead = groups.groupBy("norm").agg(F.min_by("id", F.struct(F.negative("document_count"), "id")).alias("primary_id"), F.min_by("name", name_penalty(F.col("name"))).alias("target_name"))
    return groups.join(lead, "norm").where("id <> primary_id").select("id", "primary_id", "target_name")


def apply_merge(documents: DataFrame, plan: DataFrame, column: str = "correspondent_id") -> DataFrame:
    """documents with merged correspondents replaced, and moved telling which."""
    out = documents.join(plan.select(F.col("id").alias(column), "primary_id"), column, "left")
    return out.withColumn("moved", F.col("primary_id").isNotNull()).withColumn(column, F.coalesce("primary_id", column)).drop("primary_id")


def newest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
