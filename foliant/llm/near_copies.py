"""Near copies by wide SimHash fingerprints: one document kept of each group.

Texts are linked if the Jaccard similarity of their sets of five-word shingles is at least 4/5. At
that similarity about 15 % of a SimHash's bits differ, so 64 bits and a few flips can't find such
pairs. For sets of more than SMALL shingles the same search is done with WORDS * 64 bits: they are put into groups, correlated bits
together, dynamic programming leaves out the groups that cost most in candidates (threshold -1) and
searches the rest for equality (threshold 0), so that fingerprints within tau bits agree in some
group. Further groupings of the same bits, dealt at random, find those that lie farther apart:
groups are about log2(nodes) + SPARE bits wide, and there are so many that a pair at 4/5 is missed
with probability MISS (a more similar one with less). Candidates are probed by an equi-join on (group, bits), sifted by
their distance in one word and then in all, and verified by their whole shingle sets. The bits of small
sets differ too unevenly for that; sets of up to SMALL * 5/4 shingles are found by prefix filtering
instead, which misses none: in the order of their hashes, two sets at 4/5 share one of the first
n - 4/5 n + 1 shingles.

Keys that over HOT sets share belong to groups of copies and aren't paired. Their members are
compared with the key's hub first, the member with most such keys. Pairs which the links found so
far connect need no link of their own: what hubs link is put into components before the pairs of
other keys are formed, and again before crowded keys are searched for links between components. What leaves that
join is sifted in it, without loss: one minus the similarity is a metric, so a pair's distances to
the hub differ by 1/5 at most; and the odd sketches of two sets (a bit for each of ODD_WORDS * 64
classes of hashes: whether the set has an odd number of them) differ in no more bits than the sets
in shingles, since what they share cancels out.

Defined results: equal sets are one node; null and blank texts are copies of each other; texts of
fewer words than a shingle hash whole; of a group the least doc_id stays, null last, and repeated
rows once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, with_values
from .components import connected_components
from .simhash import bit_groups, keyed_rows, rows_of

SHINGLE = 5
#: Words of 64 bits of a fingerprint.
WORDS = 8
#: Bits of a group beyond the logarithm of the number of nodes.
SPARE = 2
#: Share of bits in which a pair at 4/5 differs, and with what probability it may be missed.
APART = 0.152
MISS = 0.02
#: Most differing bits of a candidate, in one word and in all: the mean at 4/5 and 4.5 deviations.
NEAR_WORD, NEAR_ALL = 23, 115
#: Most sets at one key that are paired.
HOT = 8
#: Most fingerprints, picked by hash, from which bits are grouped and candidates estimated.
SAMPLE = 2048
#: Most shingles of a set that is found by prefix filtering alone; a partner at 4/5 has 5/4 as many.
SMALL = 32
SMALL_PARTNER = SMALL * 5 // 4
#: Words of 64 bits of an odd sketch.
ODD_WORDS = 16
#: A similarity of 4/5, in whole numbers: 5 * both >= 4 * (a + b - both).
LINKED = "9 * both >= 4 * (n_u + n_v)"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not w:
        return np.array([], np.int64)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return np.unique(np.array(h, np.uint64).view(np.int64))


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of a set of 64-bit hashes, each mixed anew for every word of the fingerprint."""
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 16384):
        for k in range(words):
            x = hashes[at : at + 16384].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.int64).ravel()


def odd_sketch(hashes: np.ndarray, words: int = ODD_WORDS) -> np.ndarray:
    """Parities of the numbers of hashes in each of words * 64 classes."""
    counts = np.bincount((hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def prefix_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a small set: negative, of the shingles of which a set at 4/5 has one; none for a large set."""
    n = len(hashes)
    return (hashes[: n - -(-4 * n // 5) + 1] | np.int64(-(2**63))).tolist() if 0 < n <= SMALL_PARTNER else []


FP = [f"f{k}" for k in range(WORDS)]
ODD = [f"odd{k}" for k in range(ODD_WORDS)]


def fingerprinted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, node (names the shingle set), n (its size), f0, f1, ... (its fingerprint), and for small sets odd (a short odd sketch) and prefix (keys), of docs (keep, text)."""

    def start() -> Callable[[list], list[pa.Array]]:
        import xxhash

        def make(texts: list) -> list[pa.Array]:
            sets = [shingle_set(t) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            fps = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(len(sets), WORDS)
            small = [int(odd_sketch(s, 1)[0]) if len(s) <= SMALL_PARTNER else 0 for s in sets]
            return [pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.ascontiguousarray(f)) for f in fps.T), pa.array(small, pa.int64()), pa.array([prefix_keys(s) for s in sets], pa.list_(pa.int64()))]

        return make

    return with_values(docs, keep, start, ", ".join(["node long, n int", *(f"{f} long" for f in FP), "odd long, prefix array<long>"]))


def unpacked(fps: np.ndarray) -> np.ndarray:
    """Bits of the rows of fps (rows, WORDS)."""
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(len(fps), 8 * WORDS), axis=1, bitorder="little")


def groupings(nodes: int, sample: np.ndarray, miss: float = MISS) -> list[list[int]]:
    """The groups of bits to search, by how many nodes there are and the bits of a sample of them.

    The first grouping is by correlation. Of its groups those are searched whose candidates and
    signatures are fewest; as many bits may differ as there are others, less one, and one such group
    still agrees. The choice is by dynamic programming over thresholds -1 and 0.
    """
    bits = 64 * WORDS
    width = min(48, max(8, ceil(log2(nodes + 1)) + SPARE))
    m = bits // width
    rng = np.random.default_rng(1)
    # All groups are of the same bits, so that a pair's own share of differing bits counts.
    alone = 1 - (1 - rng.binomial(bits, APART, 4000) / bits) ** width
    wanted = 1
    while (alone**wanted).mean() > miss:
        wanted += 1
    x = sample.astype(np.float32)
    pairs = rng.integers(0, len(x), (20000, 2))
    differ = sample[pairs[:, 0]] != sample[pairs[:, 1]]
    out: list[list[int]] = []
    for r in range(ceil(wanted / m)):
        groups = bit_groups(len(x), x.T @ x, m) if r == 0 else [sorted(g.tolist()) for g in np.array_split(rng.permutation(bits), m)]
        share = [np.prod(1 - differ[:, g].mean(0)) for g in groups]
        cost = [nodes + nodes * nodes / 2 * max(s, (~differ[:, g].any(1)).mean()) for g, s in zip(groups, share, strict=True)]
        #: best[k]: least cost of k groups searched among those so far, and which.
        most = min(m, wanted - len(out))
        best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(float("inf"), ())] * most
        for i, c in enumerate(cost):
            for k in range(most, 0, -1):
                if best[k - 1][0] + c < best[k][0]:
                    best[k] = (best[k - 1][0] + c, (*best[k - 1][1], i))
        out += [groups[i] for i in best[most][1]]
    return out


def signatures(nodes: DataFrame, groups: list[list[int]]) -> DataFrame:
    """(key, node, f0) of each node: its bits in each group with the group's number, and the keys of a small set.

    With a negative key, one of a small set, f0 holds the short odd sketch instead of a word of the fingerprint.
    """

    def start() -> Callable[[list], list[pa.Array]]:
        powers = [1 << np.arange(len(g), dtype=np.int64) for g in groups]

        def make(given: list) -> list[pa.Array]:
            bits = unpacked(np.array([[x[f] for f in FP] for x in given], np.int64)).astype(np.int64)
            keys = np.stack([bits[:, g] @ p | (k << 49) for k, (g, p) in enumerate(zip(groups, powers, strict=True))], 1)
            return [pa.array([k if x["n"] > SMALL else [] for x, k in zip(given, keys, strict=True)], pa.list_(pa.int64()))]

        return make

    rows = nodes.select("node", "odd", "prefix", "f0", F.struct("n", *FP).alias("given"))
    found = with_values(rows, ["node", "odd", "prefix", "f0"], start, "keys array<long>", "given")
    found = found.select("node", "odd", "f0", F.explode(F.concat("keys", "prefix")).alias("key"))
    return found.select("node", F.when(F.col("key") < 0, F.col("odd")).otherwise(F.col("f0")).alias("f0"), "key")


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_at(key: Column, u: Column, v: Column) -> Column:
    """Whether what two rows carry beside a key allows a similarity of 4/5: sets at 4/5 differ in a ninth of their shingles."""
    return apart(u, v) <= F.when(key < 0, 2 * SMALL_PARTNER // 9).otherwise(NEAR_WORD)


def differing(words: list[str]) -> Column:
    return sum((apart(F.col(f"{f}_u"), F.col(f"{f}_v")) for f in words), F.lit(0))


def sized() -> Column:
    return F.expr("5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)")


def possible() -> Column:
    """Whether the sizes and whole fingerprints of u and v allow a similarity of 4/5; small sets' fingerprints don't count."""
    return sized() & ((differing(FP) <= NEAR_ALL) | (F.least("n_u", "n_v") <= SMALL))


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose sizes and whole fingerprints allow a similarity of 4/5."""
    u, v = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(f).alias(f"{f}_{x}") for f in FP]) for x in "uv")
    return pairs.select("u", "v").distinct().join(u, "u").join(v, "v").where(possible()).select("u", "v")


def whole_sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, keys, odd0, odd1, ...) with all shingles of the wanted nodes and their odd sketches; texts has key and text, nodes node and key."""

    def make(texts: list) -> list[pa.Array]:
        sets = [shingle_set(t) for t in texts]
        odd = np.array([odd_sketch(s) for s in sets], np.int64).reshape(len(sets), ODD_WORDS)
        return [pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(o)) for o in odd.T)]

    rows = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "key")
    one = texts.join(rows, "key").dropDuplicates(["node"])
    return with_values(one, ["node"], lambda: make, ", ".join(["n int, keys array<long>", *(f"{o} long" for o in ODD)]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v, ...) with n_u, n_v and both, the number of shingles in common."""
    u, v = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}")) for x in "uv")
    met = pairs.join(u, "u").join(v, "v")
    return met.withColumn("both", F.size(F.array_intersect("keys_u", "keys_v"))).drop("keys_u", "keys_v")


def pairs_at(a: DataFrame, b: DataFrame) -> DataFrame:
    """(u, v, ...) of the rows of a and b (key, node, f0) that meet at a key and are near in one word."""
    left, right = (x.select("key", *[F.col(c).alias(f"{c}_{s}") for c in x.columns if c != "key"]) for x, s in ((a, "u"), (b, "v")))
    met = left.join(right, "key").where("node_u <> node_v").where(near_at(F.col("key"), F.col("f0_u"), F.col("f0_v")))
    return met.withColumnsRenamed({"node_u": "u", "node_v": "v"})


def with_root(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """rows with root_<column>: the root of the node in column, which is its own if it has no link."""
    found = rows.join(roots.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left")
    return found.withColumn(f"root_{column}", F.coalesce("_root", column)).drop("_root")


def parted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose two are not of one component."""
    return with_root(with_root(pairs, "u", roots), "v", roots).where("root_u <> root_v").select("u", "v")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def copy_links(texts: DataFrame, nodes: DataFrame, hot: int = HOT, miss: float = MISS) -> DataFrame:
    """Links (u, v) among nodes; each is of similarity 4/5 or more.

    texts has key and text; nodes has node, n, f0, f1, ..., odd, prefix and the key of one text of each node.
    """
    some = nodes.where("n > 0")
    total = some.count()
    picked = some.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30)) + 1)
    sample = picked.select(*FP).limit(2 * SAMPLE).collect()  # bounded
    if not sample:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    keyed = signatures(some, groupings(total, unpacked(np.array(sample, np.int64)), miss))
    # The two nodes of most keys that are shared at all stand in the aggregate itself.
    one = F.struct("node", "f0")
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min(one).alias("a"), F.max(one).alias("b")).where("m > 1"), "shared-signatures")
    two = shared.where("m = 2").where(near_at(F.col("key"), F.col("a.f0"), F.col("b.f0"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    met = staged(keyed.join(shared.where("m > 2").select("key", "m"), "key"), "met")
    few, crowd = met.where(F.col("m") <= hot).drop("m"), met.where(F.col("m") > hot).drop("m")

    # Hubs of crowded keys: the member with most of them, which lies in the middle of its copies.
    often = crowd.groupBy("node").agg(F.count("*").alias("h"))
    crowd = staged(crowd.join(often, "node"), "crowd")
    hubs = crowd.groupBy("key").agg(F.max(F.struct("h", "node")).alias("hub")).select("key", F.col("hub.node").alias("v"))
    to_hub = crowd.join(hubs, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    sets = staged(whole_sets(texts, nodes, crowd.select("node")), "shingle-sets")
    to_hub = staged(verified(to_hub, sets), "to-hub")
    linked = to_hub.where(LINKED).select("u", "v")
    # Pairs of one component are connected already; in a large group that is most of them, so they aren't formed.
    roots = connected_components(linked).select("node", "root")
    few = with_root(few, "node", roots).withColumnRenamed("root_node", "root")
    # Pairs that share many keys look up their roots once.
    plain = parted(ordered(two).distinct(), roots).unionByName(pairs_at(few, few).where("u > v and root_u <> root_v").select("u", "v"))
    plain = staged(near(ordered(plain), some), "pairs")
    known = sets.select("node")
    ends = plain.select(F.col("u").alias("node")).unionByName(plain.select(F.col("v").alias("node")))
    sets = sets.unionByName(staged(whole_sets(texts, nodes, ends.join(known, "node", "left_anti")), "shingle-sets"))
    linked = linked.unionByName(staged(verified(plain, sets).where(LINKED).select("u", "v"), "found"))
    roots = connected_components(linked).select("node", "root")
    # Roots are looked up for each hub's key and for each member's hub, not for each of its keys.
    away = to_hub.select(F.col("u").alias("node"), "v", (1 - F.col("both") / (F.col("n_u") + F.col("n_v") - F.col("both"))).alias("far"))
    placed = crowd.select("key", "node").join(with_root(hubs, "v", roots), "key").join(with_root(away, "node", roots), ["node", "v"])
    placed = placed.select("key", "node", "far", F.col("root_node").alias("root"), (F.col("root_node") == F.col("root_v")).alias("inside"))
    placed = placed.join(sets.select("node", "n", *ODD), "node")
    outside = placed.where("not inside")
    left, right = (x.select("key", *[F.col(c).alias(f"{c}_{s}") for c in x.columns if c != "key"]) for x, s in ((outside, "u"), (placed, "v")))
    rest = left.join(right, "key").where("root_u <> root_v and (inside_v or node_u > node_v)")
    rest = rest.where("far_v >= far_u - 0.2 - 1e-9 and far_v <= far_u + 0.2 + 1e-9").where(sized()).where(9 * differing(ODD) <= F.col("n_u") + F.col("n_v"))
    rest = staged(ordered(rest.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))).distinct(), "rest")
    return linked.unionByName(verified(rest, sets).where(LINKED).select("u", "v"))


def keep_first(docs: DataFrame, hot: int = HOT, miss: float = MISS) -> DataFrame:
    """The row with the least doc_id (then the least text hash) of each group of near copies; all columns of docs."""
    rows = keyed_rows(docs)
    found = staged(fingerprinted(rows.select("doc_id", "text", "key"), ["doc_id", "key"]), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    nodes = staged(found.groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("n", *FP, "odd", "prefix")]).withColumn("key", F.col("first.key")), "nodes")
    roots = connected_components(copy_links(rows.select("key", "text"), nodes, hot, miss)).select("node", "root")
    stay = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows_of(rows, stay.select("first.key"))
