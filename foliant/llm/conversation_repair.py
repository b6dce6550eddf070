"""Repair of the turn structure of conversations at least cost, by one sorted stream a partition.

A conversation's roles, by their initials, must read (s?(ua)+)?. A row is kept, given the role of user
or assistant, or deleted; turns with an empty text may be inserted anywhere. Blank rows and copies of
earlier rows must go; a truncated row that stays costs extra. Of the cheapest ways the one is taken
whose edits' initials are least in ASCII.

Rows are dealt by conversation and sorted by it and by descending turn. Read from its end, the cost of
repairing a conversation from a row on depends on four states of the pattern alone, so the stream
carries four numbers across Arrow batches, whatever a conversation's length. For each row it keeps
the best edit in each state, two bits apiece, with the row itself: in memory up to SPILL_BYTES, beyond
that in blocks of a file of the task's own, which ends with the task and is read by no other. At the
first turn the edits are followed forward from there, and the repaired text goes through a hash row
by row. Every edit's initial leads to one state only; therefore the least initial among the cheapest
edits of a state begins its least sequence, and no sequences are compared.

Copies are marked before the stream, by a window on (conversation, role, text) that needs no further
shuffle, so no task remembers a conversation's rows.

Defined results: rows with a null conv_id are one conversation; null turns come first; rows of equal
turn go by role, then text; a null or empty role fits nowhere in the pattern; a null text is blank;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of rows and edits that a conversation holds in memory, about.
SPILL_BYTES = 32_000_000
#: States of the pattern: nothing yet, after s, after u, after a. The turn that each expects, and the state after it.
EXPECTED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
#: Edits by their two bits, in ASCII order.
EDITS = "DIKR"
FAR = 1 << 60
MOST_LONG = (1 << 63) - 1


class Backlog:
    """A conversation's rows, last one first, to be read from the first; beyond SPILL_BYTES in a file."""

    def __init__(self, spill_bytes: int):
        self.most, self.size, self.rows = spill_bytes, 0, []
        self.file, self.blocks = None, []

    def push(self, choices: int, role: str, text: str) -> None:
        self.rows.append((choices, role, text))
        self.size += len(role) + len(text) + 100
        if self.size > self.most:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  ends with the conversation
            self.blocks.append(self.file.seek(0, 2))
            pickle.dump(self.rows, self.file, pickle.HIGHEST_PROTOCOL)
            self.rows, self.size = [], 0

    def forward(self) -> Iterator[tuple[int, str, str]]:
        yield from reversed(self.rows)
        for at in reversed(self.blocks):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))
        if self.file:
            self.file.close()


def inserted(costs: list[int]) -> tuple[list[int], list[bool]]:
    """costs where turns may be inserted first, and in which states that is as cheap as anything else."""
    best = costs[:]
    for _ in range(2):  # more than two insertions in a row lead back to the same state
        best = [min(c, INSERT + best[AFTER[s]]) for s, c in enumerate(best)]
    return best, [best[s] == INSERT + best[AFTER[s]] for s in range(4)]


class Repair:
    """What the stream knows of one conversation, its later rows read."""

    def __init__(self, spill_bytes: int):
        self.backlog = Backlog(spill_bytes)
        self.ends, self.end_inserts = inserted([0, FAR, FAR, 0])
        self.costs = self.ends
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.most = None
        self.after: str | None = None

    def row(self, turn: int | None, role: str, text: str, fault: str) -> None:
        """The row before those read so far."""
        if turn is not None:
            self.most = turn if self.most is None else self.most
            self.turns += turn != self.last
            self.last = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += self.after is not None and initial + self.after not in ("su", "ua", "au")
        self.after = initial
        costs = [DELETE + c for c in self.costs]
        edits = [0, 0, 0, 0]
        if fault not in ("blank", "duplicate"):
            stay = TRUNCATED * (fault == "truncated")
            for s in range(4):
                kept = stay + self.costs[AFTER[s]] if initial == EXPECTED[s][0] else stay + self.costs[1] if s == 0 and initial == "s" else FAR
                changed = stay + REROLE + self.costs[AFTER[s]]
                costs[s], edits[s] = min((costs[s], 0), (kept, 2), (changed, 3))
        self.costs, inserts = inserted(costs)
        choices = 0
        for s in range(4):
            edit = edits[s] if costs[s] == self.costs[s] else 1
            choices |= (min(edit, 1) if inserts[s] else edit) << 2 * s
        self.backlog.push(choices, role, text)

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit and the hash of the repaired rows."""
        state, audit, said = 0, [], hashlib.sha256()
        cost = self.costs[0]

        def say(role: str, text: str) -> None:
            said.update(f"{separator}{role}:{text}".encode("utf-8", "replace"))

        separator = ""
        for choices, role, text in self.backlog.forward():
            while (edit := EDITS[choices >> 2 * state & 3]) == "I":
                audit.append("I")
                say(EXPECTED[state], "")
                separator, state = "\n", AFTER[state]
            audit.append(edit)
            if edit == "D":
                continue
            say(role if edit == "K" else EXPECTED[state], text)
            separator, state = "\n", 1 if edit == "K" and role[0] == "s" else AFTER[state]
        while state in (1, 2):
            audit.append("I")
            say(EXPECTED[state], "")
            separator, state = "\n", AFTER[state]
        gaps = 0 if self.most is None else min(self.most - self.last + 1 - self.turns, MOST_LONG)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(audit), said.hexdigest()


#: The columns of repaired() after conv_id.
REPORT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def fault_of(text: Column, copy: Column) -> Column:
    """A row's first fault, or an empty string."""
    end = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    return F.when(end == "", "blank").when(copy, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")


def repaired(turns: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """conv_id and the REPORT of every conversation of turns (conv_id, turn, role, text, gone).

    Rows that are gone count for nothing but that their conversation is named.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "gone")
    rows = rows.repartition("conv_id")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")))
    rows = rows.select("*", fault_of(F.col("text"), F.col("copy") > 1).alias("fault"))
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        state: Repair | None = None
        out: list[tuple] = []

        def report() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *REPORT.values()), strict=True)], names=["conv_id", *REPORT])

        for b in batches:
            for conv, turn, role, text, gone, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")), strict=True):
                if now != (conv,):
                    if state:
                        out.append((*now, *state.result()))
                    now, state = (conv,), Repair(spill_bytes)
                if not gone:
                    state.row(turn, role, text, fault)
            if len(out) >= 1000:
                yield report()
                out = []
        if state:
            out.append((*now, *state.result()))
        if out:
            yield report()

    schema = "conv_id long, " + ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in REPORT.items())
    return rows.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with a fifth of them damaged by a hash of conversation and turn; nulls are one space.

    Of 20 remainders 0 drops the row (it stays as gone), 1 empties its text, 2 takes out its full stops,
    question and exclamation marks, 3 repeats it, 4 makes it the user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time"))
    return rows.drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired rows' hash of every conversation, after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(turns))


#: DuckDB: CRC-32 by its polynomial, then the same recursion from the last row of each conversation, all
#: conversations at a time. Each state carries its cost, edits and repaired rows.
OP13_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(range(0, length(k)), lambda i: ascii(k[i + 1])::BIGINT) AS bytes
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM turns),
damage AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS time
  FROM hashed WHERE kind <> 0),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damage)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
-- From the end: s0 nothing yet, s1 after s, s2 after u, s3 after a; each has its least (cost, edits, rows).
best AS (
  SELECT conv_id, n AS pos, (0::BIGINT, '', []::VARCHAR[]) AS s0, (6::BIGINT, 'II', ['user:', 'assistant:']) AS s1,
    (3::BIGINT, 'I', ['assistant:']) AS s2, (0::BIGINT, '', []::VARCHAR[]) AS s3 FROM counts
  UNION ALL
  SELECT conv_id, pos - 1, least(t0, (3 + r2[1], 'I' || r2[2], list_prepend('user:', r2[3]))),
    least(t1, (3 + r2[1], 'I' || r2[2], list_prepend('user:', r2[3]))), r2, r3
  FROM (
    SELECT *, least(t2, (3 + t3[1], 'I' || t3[2], list_prepend('assistant:', t3[3]))) AS r2,
      least(t3, (3 + t2[1], 'I' || t2[2], list_prepend('user:', t2[3]))) AS r3
    FROM (
      SELECT conv_id, pos, least(d0, CASE WHEN i = 'u' THEN ku WHEN i = 's' THEN ks ELSE ru END, ru) AS t0,
        least(d1, CASE WHEN i = 'u' THEN ku ELSE ru END, ru) AS t1, least(d2, CASE WHEN i = 'a' THEN ka ELSE ra END, ra) AS t2,
        least(d3, CASE WHEN i = 'u' THEN ku ELSE ru END, ru) AS t3
      FROM (
        SELECT b.conv_id, b.pos, left(j.role, 1) AS i,
          (4 + s0[1], 'D' || s0[2], s0[3]) AS d0, (4 + s1[1], 'D' || s1[2], s1[3]) AS d1, (4 + s2[1], 'D' || s2[2], s2[3]) AS d2, (4 + s3[1], 'D' || s3[2], s3[3]) AS d3,
          (stay + s1[1], 'K' || s1[2], list_prepend(j.role || ':' || j.text, s1[3])) AS ks,
          (stay + s2[1], 'K' || s2[2], list_prepend(j.role || ':' || j.text, s2[3])) AS ku,
          (stay + s3[1], 'K' || s3[2], list_prepend(j.role || ':' || j.text, s3[3])) AS ka,
          (3 + stay + s2[1], 'R' || s2[2], list_prepend('user:' || j.text, s2[3])) AS ru,
          (3 + stay + s3[1], 'R' || s3[2], list_prepend('assistant:' || j.text, s3[3])) AS ra
        FROM best b JOIN (
          SELECT *, CASE fault WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 WHEN 'truncated' THEN 3 ELSE 0 END AS stay FROM judged) j
          ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.pos = b.pos))))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(s0[1], 0)::BIGINT AS cost, coalesce(s0[2], '') AS audit, sha256(coalesce(array_to_string(s0[3], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = 0
"""
