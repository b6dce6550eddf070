"""The trie of conversations' prefixes: which beginnings are shared, by whom, and what sharing saves.

A node is a distinct sequence of first turns (role, text). A stream over each partition, sorted by
conversation and turn, chains 128-bit digests: one row for each conversation and depth, with the
digest of the prefix, of its parent and the words of its last turn. Grouping these by digest gives the
nodes with their members; a second hash of the chain, the depth and the parent must agree within a
group, or the job ends with an error.

What is summed over subtrees (leaves, savings, children) is summed by shard. A shard is a set of
conversations, dealt by a hash of their ids, so a first turn that a third of all conversations share
makes no large shard. It enumerates the distinct digests on its conversations' paths and gives them
slots by a minimal perfect hash, whose table keeps the digests to verify each look-up. A node's own
counts enter in one shard only, that of its smallest member, and are scattered into flat arrays; then
one pass over the slots in order of falling depth adds each to its parent's slot. As the smallest
member's whole path is in its shard, the sums over shards of a node's slot are the sums over its
subtree. A shard holds about SHARD_ROWS rows; only a longer conversation makes it larger.

Members that end at a node are hashed in the order of their ids by a stream sorted by node and id.

Defined results: rows with a null conv_id belong to no conversation and are left out; null turns come
first; rows of equal turn go by role, then text, repeated rows one after the other; a null role or
text is empty; other columns are ignored; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Rows of paths in a shard, about.
SHARD_ROWS = 1_000_000
#: Levels of a perfect hash; each holds about three fifths of what is left.
MOST_LEVELS = 200
NODE = ["hi", "lo"]


class SlotTable:
    """Slots 0 to n - 1 for n distinct digests; slots() raises for a digest that isn't among them.

    Each level hashes the digests left over to twice as many places; those alone at their place
    stay, numbered by the places taken before, the others go on to the next level.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        n = len(hi)
        self.hi, self.lo = np.empty(n, np.int64), np.empty(n, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, used = np.arange(n), 0
        while len(left):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("digests that are not distinct have no slots of their own")
            size = 2 * len(left) + 1
            place = self.place(hi[left], lo[left], len(self.levels), size)
            taken = np.bincount(place, minlength=size) == 1
            rank = (np.cumsum(taken) - 1 + used).astype(np.int64)
            alone = taken[place]
            slots = rank[place[alone]]
            self.hi[slots], self.lo[slots] = hi[left[alone]], lo[left[alone]]
            self.levels.append((taken, rank))
            used += len(slots)
            left = left[~alone]

    @staticmethod
    def place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        odd = (0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64 | 1
        x = hi.view(np.uint64) * np.uint64(odd) + lo.view(np.uint64) * np.uint64(odd * odd % 2**64) + np.uint64(level)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (taken, rank) in enumerate(self.levels):
            place = self.place(hi[todo], lo[todo], level, len(taken))
            hit = taken[place]
            out[todo[hit]] = rank[place[hit]]
            todo = todo[~hit]
        if len(todo) or (self.hi[out] != hi).any() or (self.lo[out] != lo).any():
            raise ValueError("a digest is not in the table")
        return out


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.ones(len(hi), bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[first], lo[first]


def paths(turns: DataFrame) -> DataFrame:
    """The nodes on every conversation's path, from turns (conv_id, skip, given, turn, role, text).

    Rows with a place in ``given`` come first, in its order; of the others the first ``skip`` are left
    out. Columns: conv_id, depth, hi and lo (digest), up_hi and up_lo (the parent's), words (of the last
    turn), proof (a second hash), ends (whether the conversation ends here).
    """
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("given").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "text")
    names = {"conv_id": pa.int64(), "depth": pa.int64(), "hi": pa.int64(), "lo": pa.int64(), "up_hi": pa.int64(), "up_lo": pa.int64(), "words": pa.int64(), "proof": pa.int64(), "ends": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        out: list[tuple] = []
        now, skipped, digest, proof, depth = None, 0, bytes(16), 0, 0
        pending: tuple | None = None

        def put(ends: bool) -> None:
            if pending:
                out.append((*pending, ends))

        def node(words: int, up: bytes) -> tuple:
            halves = [int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:], up[:8], up[8:])]
            return (now, depth, *halves, words, proof - (1 << 63))

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), names.values(), strict=True)], names=list(names))

        for b in batches:
            for conv, skip, given, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "skip", "given", "role", "text")), strict=True):
                if conv != now:
                    put(True)
                    now, skipped, digest, proof, depth = conv, 0, bytes(16), 0, 0
                    pending = node(0, digest)
                if given is None and skipped < skip:
                    skipped += 1
                    continue
                put(False)
                raw, said = role.encode("utf-8", "replace"), text.encode("utf-8", "replace")
                up = digest
                digest = hashlib.blake2b(b"".join((up, len(raw).to_bytes(8, "little"), raw, said)), digest_size=16).digest()
                proof = xxhash.xxh64_intdigest(raw + b"\n" + said, proof)
                depth += 1
                pending = node(len(said.split()), up)
            if len(out) >= 10_000:
                yield block()
                out = []
        put(True)
        if out:
            yield block()

    return rows.mapInArrow(run, ", ".join(f"{c} {'boolean' if t == pa.bool_() else 'long'}" for c, t in names.items()))


def nodes_of(steps: DataFrame) -> DataFrame:
    """The distinct nodes of paths: smallest member, number of members, whether all end there."""
    same = [(F.min(c) == F.max(c)) for c in ("depth", "up_hi", "up_lo", "words", "proof")]
    agreed = same[0]
    for s in same[1:]:
        agreed = agreed & s
    found = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "up_hi", "up_lo", "words")], F.bool_and("ends").alias("leaf"), agreed.alias("agreed"))
    checked = F.when(F.col("agreed"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return found.select(*NODE, "conv_id", checked.alias("n_convs"), "depth", "up_hi", "up_lo", "words", "leaf")


def subtree_sums(steps: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """(hi, lo, n_leaves, saved_tokens, n_children) of every node, from the paths and the nodes' own counts."""
    own = nodes.select("conv_id", *NODE, "up_hi", "up_lo", "depth", F.col("leaf").cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    on_path = steps.select("conv_id", *NODE, "up_hi", "up_lo", "depth", F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("long").alias("saved"))
    rows = on_path.unionByName(own).repartition(shards, "conv_id").drop("conv_id")
    given = [*NODE, "up_hi", "up_lo", "depth"]
    names = [*NODE, "n_leaves", "saved_tokens", "n_children"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [(*(b.column(c).to_numpy() for c in given), b.column("leaf").is_valid().to_numpy(False), b.column("leaf").fill_null(0).to_numpy(), b.column("saved").fill_null(0).to_numpy()) for b in batches]
        if not blocks:
            return
        hi, lo, up_hi, up_lo, depth, counted, leaf, saved = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        table = SlotTable(*distinct(hi, lo))
        n = len(table.hi)
        slot = table.slots(hi, lo)
        parent, depths = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parent[slot], depths[slot] = table.slots(up_hi, up_lo), depth
        sums = np.zeros((3, n), np.int64)
        # A node is counted once, so its slot occurs once among the counted rows.
        sums[0, slot[counted]], sums[1, slot[counted]] = leaf[counted], saved[counted]
        children = slot[counted & (depth > 0)]
        np.add.at(sums[2], parent[children], 1)
        order = np.argsort(-depths, kind="stable")
        ends = np.flatnonzero(np.diff(depths[order], append=-1)) + 1
        at = 0
        for end in ends[:-1]:  # the root, last of all, has no parent
            level = order[at:end]
            np.add.at(sums[0], parent[level], sums[0, level])
            np.add.at(sums[1], parent[level], sums[1, level])
            at = end
        for at in range(0, n, 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (table.hi, table.lo, *sums)], names=names)

    found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in names[2:]])


def end_digests(steps: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes at which conversations end."""
    rows = steps.where("ends").select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said = None, hashlib.sha256()
        out: list[tuple] = []

        def block() -> pa.RecordBatch:
            hi, lo, digest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(digest, pa.string())], names=[*NODE, "ends_sha256"])

        for b in batches:
            for *node, conv in zip(*(b.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
                if node != now:
                    if now:
                        out.append((*now, said.hexdigest()))
                    now, said = node, hashlib.sha256(str(conv).encode())
                else:
                    said.update(f",{conv}".encode())
            if len(out) >= 10_000:
                yield block()
                out = []
        if now:
            out.append((*now, said.hexdigest()))
        if out:
            yield block()

    return rows.mapInArrow(run, "hi long, lo long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each node of the trie of turns (as paths() takes them).

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Paths and nodes, digests without texts, are written to
    the shared folder when this is called.
    """
    steps = staged(paths(turns), "trie-paths")
    nodes = staged(nodes_of(steps), "trie-nodes")
    spark = turns.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-steps.count() // shard_rows))
    parents = nodes.where("not leaf").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["up_hi", "up_lo"], "left").join(subtree_sums(steps, nodes, shards), NODE).join(end_digests(steps), NODE, "left")
    none = F.lit(hashlib.sha256().hexdigest())
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation c of turns as its first h turns of conversation c - c % 20, then its own turns after its first h; h = crc32(c) % 4."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    firsts = rows.withColumn("given", F.row_number().over(order)).where("given <= 3").select(F.col("conv_id").alias("donor"), "given", "turn", "role", "text")
    takers = rows.select("conv_id").distinct().select("conv_id", skip.alias("skip"), F.expr("conv_id - conv_id % 20").alias("donor")).where("skip > 0")
    gifts = takers.join(firsts, "donor").where("given <= skip").select("conv_id", "skip", "given", "turn", "role", "text")
    return rows.select("conv_id", skip.alias("skip"), F.lit(None).cast("int").alias("given"), "turn", "role", "text").unionByName(gifts)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that groups of 20 share beginnings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(turns))


#: DuckDB: CRC-32 by its polynomial, prefixes as lists of their turns' hashes, every node joined with its ancestors.
OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) AS said,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(k)), lambda i: ascii(k[i + 1])::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS k FROM own)),
turns AS (
  SELECT c.conv_id, 0 AS part, pos, said, words FROM convs c JOIN own o ON o.conv_id = c.donor AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, said, words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
lists AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS path, coalesce(list(words ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS (
  SELECT conv_id, d, list_slice(path, 1, d) AS prefix, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, d = len(path) AS ends
  FROM lists, unnest(range(0, len(path) + 1)) AS r(d)),
nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(words) AS words, bool_and(ends) AS leaf,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM steps GROUP BY prefix),
sums AS (
  SELECT list_slice(prefix, 1, a) AS prefix, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved, count(*) FILTER (depth = a + 1) AS n_children
  FROM nodes, unnest(range(0, depth + 1)) AS r(a) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
"""
