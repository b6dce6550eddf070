"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits link at ``tau`` or fewer differing bits. The bits are put into groups,
correlated bits together, and group i gets a threshold t_i >= -1 (-1: not searched) with
sum(t_i) = tau - groups + 1. Two linked fingerprints then differ by at most t_i bits within some
group i. Dynamic programming chooses the thresholds, and the number of groups, by the signatures
written and the candidates expected from bit statistics over all fingerprints. Signatures probe
an equi-join; candidates are verified by counting differing bits.

Equal fingerprints are one node. Signatures shared by over HOT fingerprints aren't paired: their
members are exploded into themselves and their one-bit neighbours, and all that meet at a key are
linked to the least there. Two fingerprints meet at a key exactly when they differ by at most two
bits, so nothing is lost, and the work is 65 rows a member whatever the group's size.

Defined results: a null or blank text has fingerprint zero, linked like any other; texts of fewer
words than a shingle hash whole; null ids take part but never name a component unless it has no
other; repeated rows are returned each; other input columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, with_values
from .components import connected_components

BITS = 64
#: Most fingerprints, picked by hash, whose pairs show how far apart fingerprints are within a group.
SAMPLE = 2048
#: Most fingerprints at one signature that are paired; beyond, the neighbour keys take over.
HOT = 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 if it has no word."""
    import xxhash

    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    w = (text or "").encode("utf-8", "replace").translate(lower).split()
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 16384):
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), seed) for i in range(at, min(n, at + 16384))]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and fp (long) of every row of docs, which has text."""
    return with_values(docs, keep, lambda: lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))], "fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of fps (fp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            rows += len(x)
        if rows:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total.ravel(), rows).astype(np.int64)})

    sums = fps.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, rows = np.zeros((BITS, BITS)), 0
    for i, j, n in sums.collect():  # at most 4097 rows, whatever the corpus
        if i < 0:
            rows = int(n)
        else:
            both[i, j] = n
    return rows, both


def bit_groups(rows: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """The bits in groups of nearly equal width, each grown from a bit by highest correlation."""
    p = both / max(rows, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tie = np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = np.ones(len(p), bool), []
    for g in range(groups):
        width = int(free.sum()) // (groups - g)
        own = [int(np.where(free, tie @ free, -1).argmax())]
        free[own[0]] = False
        near = tie[own[0]].copy()
        while len(own) < width:
            own.append(int(np.where(free, near, -1).argmax()))
            free[own[-1]] = False
            near += tie[own[-1]]
        out.append(sorted(own))
    return out


def sampled(fps: DataFrame, rows: int, size: int = SAMPLE) -> np.ndarray:
    """Bits (fingerprints, 64) of about size of fps (fp), at most twice as many; picked by hash."""
    picked = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, size / max(rows, 1)) * (1 << 30)) + 1)
    found = np.array([r["fp"] for r in picked.limit(2 * size).collect()], np.int64)  # bounded
    return np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def shares_within(bits: np.ndarray, most: int) -> np.ndarray:
    """Share of the pairs of rows of bits that differ in at most 0, 1, ..., most places."""
    x = bits.astype(np.float32)
    ones = x.sum(1)
    apart = (ones[:, None] + ones[None, :] - 2 * x @ x.T)[np.triu_indices(len(x), 1)]
    return np.array([(apart <= t + 0.5).mean() if len(apart) else 0.0 for t in range(most + 1)])


def expected_cost(rows: int, differ: np.ndarray, seen: np.ndarray, threshold: int) -> float:
    """Signatures written plus candidates expected for a group at a threshold.

    differ: for each bit of the group, the share of pairs that differ in it; seen: shares_within of
    the sample's pairs. Bits of a group are correlated, so that the first, taken for independent,
    give too few near pairs; they serve where the sample has none.
    """
    if threshold < 0:
        return 0.0
    at = np.array([1.0])
    for d in differ:
        at = np.convolve(at, [1 - d, d])
    signatures = rows * (1 + sum(comb(len(differ), k) for k in range(threshold + 1)))
    return signatures + rows * rows / 2 * max(at[: threshold + 1].sum(), seen[threshold])


def allocate(rows: int, both: np.ndarray, sample: np.ndarray, tau: int, most_groups: int = 5) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to search, with the least expected cost."""
    mean = np.diag(both) / max(rows, 1)
    differ = 2 * mean * (1 - mean)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, most_groups + 1):
        groups = bit_groups(rows, both, m)
        #: states[s] = least cost and thresholds of the groups so far whose thresholds sum to s.
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            seen = shares_within(sample[:, bits], tau)
            cost = {t: expected_cost(rows, differ[bits], seen, t) for t in range(-1, tau + 1)}
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, ts) in states.items():
                for t, more in cost.items():
                    if s + t not in after or c + more < after[s + t][0]:
                        after[s + t] = (c + more, (*ts, t))
            states = after
        found = states.get(tau - m + 1)
        if found and found[0] < best[0]:
            best = (found[0], [(b, t) for b, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(bits: list[int], most: int) -> list[int]:
    """The masks that flip at most so many of the bits."""
    from itertools import combinations

    return [signed(sum(1 << b for b in some)) for k in range(most + 1) for some in combinations(bits, k)]


def flipped(fp: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: fp.bitwiseXOR(x))


def links(fps: DataFrame, tau: int = 2, hot: int = HOT) -> DataFrame:
    """Links (u, v), u > v, that connect all distinct fingerprints fps (fp) within tau <= 2 bits.

    Every link is of tau or fewer bits. Pairs within a hot signature appear through the least
    fingerprint at a shared neighbour key, which joins the same components.
    """
    if not 0 <= tau <= 2:
        raise ValueError("hot signatures are resolved for thresholds up to 2 bits")
    rows, both = bit_statistics(fps)
    plan = allocate(rows, both, sampled(fps, rows), tau)
    parts = []
    for g, (bits, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))).cast("long"))
        home = fps.select("fp", F.lit(g).alias("g"), own.alias("key"), F.lit(True).alias("home"))
        parts.append(home)
        if t > 0:
            probes = [x for x in masks(bits, t) if x]
            parts.append(fps.select("fp", F.lit(g).alias("g"), F.explode(flipped(own, probes)).alias("key"), F.lit(False).alias("home")))
    signatures = parts[0]
    for p in parts[1:]:
        signatures = signatures.unionByName(p)
    shared = signatures.groupBy("g", "key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    met = staged(signatures.join(shared.select("g", "key", "n"), ["g", "key"]), "signatures")
    few = met.where(F.col("n") <= hot)
    a, b = (few.select("g", "key", F.col("fp").alias(x), F.col("home").alias(f"home_{x}")) for x in "uv")
    pairs = a.join(b, ["g", "key"]).where("u > v and (home_u or home_v)").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau).select("u", "v")
    crowd = met.where(F.col("n") > hot).select("fp").distinct()
    return pairs.unionByName(neighbour_links(crowd, tau)).distinct()


def neighbour_links(fps: DataFrame, tau: int) -> DataFrame:
    """Links of fps (fp) through the keys they share: their own values and one-bit neighbours.

    A key within one bit of two fingerprints puts them within two bits of each other, and two
    bits apart leaves such a key between them. A key has at most 65 fingerprints. For tau 1 the
    links are verified, for tau 0 there are none.
    """
    keys = fps.select("fp", F.explode(flipped(F.col("fp"), [0, *[signed(1 << b) for b in range(BITS)]])).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    if tau < 2:
        least = least.join(keys.groupBy("key").agg(F.collect_list("fp").alias("all")), "key").select("key", F.explode("all").alias("v"))
    met = keys.join(least.select("key", "v"), "key").where("fp > v").select(F.col("fp").alias("u"), "v").distinct()
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau)


def classes(found: DataFrame, tau: int = 2) -> DataFrame:
    """found (doc_id, fp, ...) -> (fp, component_id): the least doc_id among linked fingerprints."""
    fps = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = connected_components(links(fps.select("fp"), tau)).select(F.col("node").alias("fp"), "root")
    rooted = staged(fps.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text)."""
    found = staged(fingerprints(docs, ["doc_id"]), "simhash")
    out = found.join(classes(found, tau), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, tau: int = 2) -> DataFrame:
    """The row with the least doc_id (then the least text hash) of each group; all columns of docs.

    A null doc_id comes last. Of repeated rows one stays.
    """
    rows = keyed_rows(docs)
    found = staged(fingerprints(rows.select("doc_id", "text", "key"), ["doc_id", "key"]), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    fps = staged(found.groupBy("fp").agg(first.alias("first")), "fingerprints")
    roots = connected_components(links(fps.select("fp"), tau)).select(F.col("node").alias("fp"), "root")
    stay = fps.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return rows_of(rows, stay.select("first.key"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, key) of docs: row holds all columns, whatever their names, key hashes id and text."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def rows_of(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """The columns of rows (row, key, doc_id, text) whose key is in stay (key); one of rows equal in doc_id and text."""
    # Rows of equal key are in one partition after the join, so dropping repeats shuffles no more.
    kept = rows.select("row", "key", "doc_id", F.md5("text").alias("_text")).join(stay.distinct(), "key", "left_semi").dropDuplicates(["key", "doc_id", "_text"])
    return kept.select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; 3-word shingles, links at 2 bits or fewer."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 2)
