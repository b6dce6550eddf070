"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Every rule is a Column expression over statistics of the text or the text itself. On a sample each
rule is timed, with the statistics that it reads, and its rejections counted; the cascade then tries the rules in falling order
of rejections per second, and a text that one rule rejects is not given to the next. Which texts
are kept doesn't depend on the order, only how much is computed.

Defined results: a null text has no words and fails; so does an empty one. Repeated rows and null
ids are judged row by row. Other columns of the input are ignored. An empty table gives an empty
result and the rules keep the order in which they were given.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, let, staged, words

#: Most documents in the sample on which the rules are timed, about.
SAMPLE_DOCS = 2000
#: Most runs in which a rule is timed, and seconds over which one is enough.
RUNS = 3
SLOW = 2.0
SYMBOLS = "#*$%&|<>"


def repeated_words(w: Column, n: int = 5) -> Column:
    """How many of the words w lie in n-word windows that occur twice or more among them.

    Windows are compared by 64-bit hashes. Most texts repeat none, which a hash set shows; for
    the rest the hashes are sorted with their positions and equal neighbours give the windows,
    whose union is measured from gap to gap. Time n log n in the words, no pairs.
    """

    def covered(g: Column) -> Column:
        def among(s: Column) -> Column:
            same = lambda e, i: F.when((e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]), e["i"])
            at = F.sort_array(F.array_compact(F.transform(s, same)))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(n), F.get(p, i + 1) - x), F.lit(n))), F.lit(0), lambda a, x: a + x))

        return let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), among)

    windows = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))
    return F.coalesce(let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))), F.lit(0)).cast("long")


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a text, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "_words": of_words,
        "_lines": of_lines,
        "word_chars": F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
    }


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and the statistics of every text, all in one projection over the scan."""
    found = docs.select(*keep, *[c.alias(n) for n, c in text_statistics(F.col(text)).items()])
    return found.select(*keep, "_words.*", "word_chars", "n_symbols", "_lines.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def from_text(text: Column) -> dict[str, Column]:
    """The statistics as expressions over the text, so that a rule computes only those that it reads."""
    text = F.coalesce(text, F.lit(""))
    found = text_statistics(text)
    return {
        "n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "n_repeat_words": let(words(text), lambda w: repeated_words(w)),
        "word_chars": found["word_chars"],
        "n_symbols": found["n_symbols"],
        "n_lines": found["_lines"]["n_lines"],
        "n_dup_lines": found["_lines"]["n_dup_lines"],
    }


def from_columns() -> dict[str, Column]:
    """The statistics as with_statistics gives them."""
    return {c: F.col(c) for c in ("n_words", "n_repeat_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")}


#: Rules over statistics s and the text; each is true for a text to reject. The first two are the base.
def rules(s: dict[str, Column]) -> dict[str, Column]:
    n, text = s["n_words"], F.coalesce("text", F.lit(""))
    return {
        "few_words": n < 10,
        "repeated_words": 100 * s["n_repeat_words"] > 20 * n,
        "symbols": s["n_symbols"] * 10 > n,
        "word_length": let(s["word_chars"], lambda c: (c < 2 * n) | (c > 15 * n)),
        "repeated_lines": s["n_dup_lines"] * 10 > 3 * s["n_lines"],
        "no_letters": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")) * 10 > 3 * n,
        "shouting": F.regexp_count(text, F.lit(r"[!?]{2,}")) * 10 > n,
        "capitals": 2 * F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > s["word_chars"],
    }


Rules = Callable[[dict[str, Column]], dict[str, Column]]


def cascade_order(docs: DataFrame, make: Rules = rules, sample_docs: int = SAMPLE_DOCS, runs: int = RUNS) -> list[tuple[str, float, int]]:
    """(rule, seconds, rejections) on a sample, most rejections per second first.

    docs has text. The sample is a share of all documents picked by a hash of each text, so that it
    doesn't depend on how the table is split; ties keep the given order. A rule's time, with the
    statistics that it reads, is the least of several runs over the sample's texts less that of a
    rule which only looks at them, so that the cost of a Spark job isn't counted.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    picked = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = staged(docs.where(picked).select("text"), "rule-sample")

    def timed(test: Column) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(runs):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(test).alias("n")).first()["n"] or 0
            best = min(best, time.perf_counter() - began)
            if best > SLOW:  # beyond what noise could turn
                break
        return best, int(rejected)

    idle = timed(F.length("text") < 0)[0]
    measured = [(name, max(took - idle, 1e-3), rejected) for name, test in make(from_text(F.col("text"))).items() for took, rejected in [timed(test)]]
    return sorted(measured, key=lambda x: -x[2] / x[1])


def cascade(tests: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in order that rejects, null for none; later rules aren't computed."""
    out = None
    for name in order:
        out = F.when(tests[name], F.lit(name)) if out is None else out.when(tests[name], F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, keep: list[str], make: Rules = rules) -> DataFrame:
    """keep, text, the statistics, base_failed and kept for every row of docs (which has text)."""
    order = [x[0] for x in cascade_order(docs.select("text"), make)]
    found = with_statistics(docs, [*dict.fromkeys([*keep, "text"])]).withColumn("base_failed", base_failed())
    return found.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(make(from_columns()), order).isNull()))


def keep_passing(docs: DataFrame, make: Rules = rules) -> DataFrame:
    """The rows of docs that are kept, all columns, whatever their names; a rule's statistics are computed when its turn comes."""
    order = [x[0] for x in cascade_order(docs.select("text"), make)]
    rows, stats = docs.select(F.struct("*").alias("_row"), "text"), from_text(F.col("text"))
    # All rules but few read the number of words, so it is counted once.
    passes = let(stats["n_words"], lambda n: cascade(make({**stats, "n_words": n}), order).isNull())
    return rows.where(passes).select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows in DuckDB.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT r, i, w[i:i + 4] AS g FROM p),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM t, range(0, 5) AS x(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (
  SELECT d.r, d.doc_id, d.text, len(w.w) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, len(l.l) AS n_lines, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    len(list_filter(w.w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_bare,
    len(regexp_extract_all(d.text, '[!?]{2,}')) AS n_shout, len(regexp_extract_all(d.text, '\p{Lu}')) AS n_upper
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR n_dup_lines * 10 > 3 * n_lines OR n_bare * 10 > 3 * n_words OR n_shout * 10 > n_words OR 2 * n_upper > word_chars) AS kept
FROM s
"""
