"""Byte-level BPE encoding and decoding by DuckDB queries in every partition.

Encoding. Texts are split by the vocabulary's pattern; each piece is encoded on its own. Pieces
become rows (piece, position, token), one a byte. A recursive query joins neighbouring tokens with
the merge table, contracts in every piece its leftmost pair of least rank, and goes on with the
pieces that still had one. The last state of a piece, ordered by position, is its ids. A query goes
on for ROUNDS rounds at most, and pieces not done by then begin another, so a query's rows have the
bound QUERY_ROWS whatever the texts. A worker encodes each distinct piece once and remembers up to
MOST_PIECES.

Decoding. Ids become rows (text, position, id), joined with the vocabulary and aggregated in order
of position to the text's bytes.

A piece of n bytes takes up to n rounds. Pieces over CUT_PIECE bytes are first cut where no token of
the vocabulary spans the place; no merge can cross it. What is still longer than LONG_PIECE bytes
(a sign repeated over and over, say) is contracted as an array by the same rule, all pairs of the
least rank at once as far as no lower rank comes up between them.

Defined results: a null text is empty and has no ids; repeated rows and null ids are encoded like
any others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_worker, with_values

#: Pieces that a worker remembers, and of which it splits a text at a time.
MOST_PIECES = 700_000
SLICE_PIECES = 300_000
#: Bytes beyond which a piece is cut, and beyond which what is left isn't given to the query.
CUT_PIECE = 64
LONG_PIECE = 512
#: Rounds of one recursive query, and rows of all its rounds together, about.
ROUNDS = 24
QUERY_ROWS = 3_000_000
#: Bytes of text that are encoded together.
ROUND_BYTES = 3_000_000
#: Ids decoded in one query, and at most so many of them as one ordered group.
ROUND_IDS = 1_000_000
SLICE_IDS = 200_000

ENCODE = """
WITH RECURSIVE state(piece, pos, token, round) AS (
  SELECT piece, pos, token, 0 FROM fresh
  UNION ALL
  SELECT s.piece, s.pos - (s.pos > best.place)::INT, CASE WHEN s.pos = best.place THEN best.merged ELSE s.token END, s.round + 1
  FROM state s JOIN (
    SELECT l.piece, min(merged) AS merged, arg_min(l.pos, merged * 65536::BIGINT + l.pos) AS place
    FROM state l JOIN state r ON r.piece = l.piece AND r.pos = l.pos + 1 JOIN merges m ON m.first = l.token AND m.second = r.token
    WHERE l.round < %d
    GROUP BY l.piece) best ON s.piece = best.piece
  WHERE s.pos <> best.place + 1)
SELECT piece, list(token ORDER BY pos) AS ids, any_value(round) AS round
FROM state JOIN (SELECT piece, max(round) AS round FROM state GROUP BY piece) USING (piece, round)
GROUP BY piece
""" % ROUNDS

DECODE = "SELECT text, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY text"


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token in a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (first, second, merged): every way in which two tokens make a third."""
    rows = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
    return np.array(rows, np.int32).reshape(-1, 3)


class Coder:
    """Encoder and decoder of one worker, with its own DuckDB connection in memory."""

    def __init__(self, tokens: list[bytes], ids: np.ndarray, merges: np.ndarray, pattern: str):
        import duckdb
        import regex

        self.pieces_of = regex.compile(pattern).finditer
        self.ids = dict(zip(tokens, ids.tolist(), strict=True))
        self.of_byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)
        self.merges = merges
        self.spans = self.pair = None
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        given = pd.DataFrame(merges, columns=["first", "second", "merged"])  # noqa: F841  read by the query
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        given = pd.DataFrame({"id": ids.astype(np.int32), "hex": [t.hex() for t in tokens]})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")

    @staticmethod
    def rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group number and position in the group for groups of these lengths."""
        ends = np.cumsum(lengths)
        return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)).astype(np.int32)

    def cut(self, raw: bytes) -> list[bytes]:
        """raw in parts, cut at every place that no occurrence of a token spans."""
        import ahocorasick

        if self.spans is None:
            self.spans = ahocorasick.Automaton()
            for t in self.ids:
                if len(t) > 1:
                    self.spans.add_word(t.decode("latin-1"), len(t))
            self.spans.make_automaton()
        edges = np.zeros(len(raw) + 1, np.int32)
        for end, n in self.spans.iter(raw.decode("latin-1")):
            edges[end - n + 2] += 1
            edges[end + 1] -= 1
        at = [0, *np.flatnonzero(np.cumsum(edges)[1:-1] == 0) + 1, len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """What each pair makes; a number beyond all ids for none."""
        if self.pair is None:
            key = self.merges[:, 0].astype(np.int64) << 32 | self.merges[:, 1]
            order = np.argsort(key)
            self.pair = np.append(key[order], 1 << 62), np.append(self.merges[order, 2].astype(np.int64), 1 << 40)
        key = first.astype(np.int64) << 32 | second
        at = np.searchsorted(self.pair[0], key)
        return np.where(self.pair[0][at] == key, self.pair[1][at], 1 << 40)

    def contract(self, raw: bytes) -> list[int]:
        """Ids of a long part: the pairs of least rank from the left, until one makes a lower rank beside it."""
        token = self.of_byte[np.frombuffer(raw, np.uint8)].astype(np.int64)
        while len(token) > 1:
            found = self.ranks(token[:-1], token[1:])
            least = found.min()
            if least >= 1 << 40:
                break
            at = np.flatnonzero(found == least)
            new = np.insert(np.diff(at) > 1, 0, True)
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            before = np.where(np.insert(np.diff(at) == 2, 0, False), least, token[at - 1])
            beside = np.minimum(np.where(at > 0, self.ranks(before, np.full(len(at), least)), 1 << 40), np.where(at + 2 < len(token), self.ranks(np.full(len(at), least), token[np.minimum(at + 2, len(token) - 1)]), 1 << 40))
            if (beside < least).any():
                at = at[: (beside < least).argmax() + 1]
            token[at] = least
            token = np.delete(token, at + 1)
        return token.tolist()

    def query(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of the parts, given as tokens of single bytes, in queries of about QUERY_ROWS rows."""
        out: list[np.ndarray] = parts[:]
        todo = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        while todo:
            cost = np.cumsum([len(out[k]) * min(len(out[k]), ROUNDS) for k in todo])
            n = max(1, int(np.searchsorted(cost, QUERY_ROWS)))
            some, todo = todo[:n], todo[n:]
            piece, pos = self.rows(np.array([len(out[k]) for k in some]))
            fresh = pd.DataFrame({"piece": piece, "pos": pos, "token": np.concatenate([out[k] for k in some])})  # noqa: F841  read by the query
            found = self.db.execute(ENCODE).fetchnumpy()
            for k, ids, done in zip(found["piece"].tolist(), found["ids"], found["round"].tolist(), strict=True):
                out[some[k]] = np.asarray(ids, np.int32)
                if done == ROUNDS:
                    todo.append(some[k])
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not yet known and remember them."""
        if len(self.known) + len(pieces) > MOST_PIECES:
            self.known = {}
        parts, owners = [], []
        long: dict[str, list] = {}
        for p in pieces - self.known.keys():
            b = p.encode()
            if (whole := self.ids.get(b)) is not None:
                self.known[p] = np.array([whole], "<u4").tobytes()
            elif len(b) <= CUT_PIECE:
                parts.append(self.of_byte[np.frombuffer(b, np.uint8)])
                owners.append(p)
            else:
                long[p] = []
                for x in self.cut(b):
                    if len(x) > LONG_PIECE:
                        long[p].append(np.array(self.contract(x), np.int32))
                    else:
                        long[p].append(len(parts))
                        parts.append(self.of_byte[np.frombuffer(x, np.uint8)])
                        owners.append(None)
        ids = self.query(parts)
        for p, x in zip(owners, ids, strict=True):
            if p is not None:
                self.known[p] = x.astype("<u4").tobytes()
        for p, xs in long.items():
            self.known[p] = np.concatenate([ids[x] if isinstance(x, int) else x for x in xs]).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; long texts are split in slices."""
        out: list[list[bytes]] = [[] for _ in texts]
        some: list[tuple[int, list[str]]] = []
        size = 0

        def give() -> None:
            self.learn(set().union(*[pieces for _, pieces in some]))
            for k, pieces in some:
                out[k].append(b"".join([self.known[p] for p in pieces]))

        for k, t in enumerate(texts):
            found = (m.group() for m in self.pieces_of(t))
            while pieces := list(islice(found, SLICE_PIECES)):
                some.append((k, pieces))
                size += len(pieces)
                if size >= SLICE_PIECES:
                    give()
                    some, size = [], 0
        give()
        return [b"".join(x) for x in out]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids; long sequences are aggregated in slices."""
        parts: list[list[bytes]] = [[] for _ in ids]
        some: list[tuple[int, bytes]] = []
        size = 0
        for k, x in enumerate(ids):
            for at in range(0, len(x), 4 * SLICE_IDS):
                some.append((k, x[at : at + 4 * SLICE_IDS]))
                size += len(some[-1][1]) // 4
                if size >= ROUND_IDS:
                    self._aggregate(some, parts)
                    some, size = [], 0
        self._aggregate(some, parts)
        return [b"".join(p) for p in parts]

    def _aggregate(self, some: list[tuple[int, bytes]], parts: list[list[bytes]]) -> None:
        text, pos = self.rows(np.array([len(x) // 4 for _, x in some], np.int64))
        tokens = pd.DataFrame({"text": text, "pos": pos, "id": np.frombuffer(b"".join([x for _, x in some]), "<u4").astype(np.int32)})  # noqa: F841  read by the query
        found = dict(self.db.execute(DECODE).fetchall())
        for i, (k, _) in enumerate(some):
            parts[k].append(bytes(found[i]))


def rounds(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts (null: empty), about ROUND_BYTES of UTF-8 at a time."""
    some, size = [], 0
    for t in texts:
        t = t or ""
        some.append(t)
        size += len(t) if t.isascii() else len(t.encode())
        if size >= ROUND_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def coder_parts(ranks_path: str, pattern: str) -> tuple:
    """What a partition needs for its Coder; read on the driver, bounded by the vocabulary."""
    ranks = read_ranks(ranks_path)
    return list(ranks), np.array(list(ranks.values()), np.int32), merge_table(ranks), pattern


def coder_of(parts: tuple) -> Coder:
    """The worker's coder for these parts; kept for the tasks that follow."""
    return per_worker("byte-bpe", hashlib.md5(parts[2].tobytes() + parts[3].encode(), usedforsecurity=False).hexdigest(), lambda: Coder(*parts))


def encode(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str) -> DataFrame:
    """keep and ids (array<int>) of every row of docs, which has text."""
    parts = coder_parts(ranks_path, pattern)

    def start() -> Callable[[list], list[pa.Array]]:
        coder = coder_of(parts)
        return lambda texts: [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for some in rounds(texts) for x in coder.encode(some)], pa.list_(pa.int32()))]

    return with_values(docs, keep, start, "ids array<int>")


def decode(rows: DataFrame, keep: list[str], ranks_path: str, pattern: str) -> DataFrame:
    """keep and bytes (binary) of every row of rows, which has ids (array<int>; null: none)."""
    parts = coder_parts(ranks_path, pattern)

    def start() -> Callable[[list], list[pa.Array]]:
        coder = coder_of(parts)
        return lambda ids: [pa.array(coder.decode([np.array(x or [], "<u4").tobytes() for x in ids]), pa.binary())]

    return with_values(rows, keep, start, "bytes binary", "ids")


def digests(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str) -> DataFrame:
    """keep, n_tokens and digests of the ids and of the bytes decoded from them, in one pass."""
    parts = coder_parts(ranks_path, pattern)

    def start() -> Callable[[list], list[pa.Array]]:
        coder = coder_of(parts)

        def make(texts: list) -> list[pa.Array]:
            out = []
            for some in rounds(texts):
                ids = coder.encode(some)
                out += [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()) for x, y in zip(ids, coder.decode(ids), strict=True)]
            n, encoded, decoded = zip(*out, strict=True)
            return [pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)]

        return make

    return with_values(docs, keep, start, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Number of ids of every document, and digests of the ids and of what they decode to."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, ["doc_id"], ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
