"""URL filter: rules first, then trust and distrust propagated over the host link graph.

A rule names a host and a path prefix; it fits that host and its subdomains, and the longest that
fits decides. For the rest hosts are judged. Each host is seeded with the share of its pages that a
rule allows (trust) or blocks (distrust). Trust flows along links by personalised PageRank,
``T = (1 - d) t + d A' T`` with A the host link shares; distrust flows against them, to the hosts
that link to bad ones. A host is blocked if its distrust exceeds its trust by more than
``MARGIN * (1 - d)``: by what half of its pages blocked would seed.

In the graph a host goes without user info and port. Edges are summed to one row for each pair of
hosts before anything is joined; each round is one join of scores and edges for either direction and
one aggregation, written every few rounds. The flow shrinks by DAMPING in every round, so the rounds
needed have a bound; scores that have not settled by then are an error.

Defined results: a null url or one without :// has an empty host and path and is judged as the
host ""; null html has no links; repeated pages count each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: (host, path prefix, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DAMPING = 0.8
MARGIN = 0.5
TOLERANCE = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null for none."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): shares of a host's links to each other host; pages has node (its bare host) and html."""
    links = pages.select(F.col("node").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    counted = links.select("src", bare_host(F.translate("to", UPPER, LOWER)).alias("dst")).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = 120, per_write: int = 3) -> DataFrame:
    """(host, trust, distrust) from seeds (host, t, b) over edges (src, dst, share).

    Ends once no host's score moves by over tolerance in the last round written.
    """
    # Distrust runs backwards: a host takes its share of what it links to.
    ways = edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("share").alias("f"), F.lit(0.0).alias("r"))
    ways = staged(ways.unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("f"), F.col("share").alias("r"))), "edges")
    score = seeds.select("host", ((1 - damping) * F.col("t")).alias("trust"), ((1 - damping) * F.col("b")).alias("distrust"))
    start = score
    for _ in range(0, most_rounds, per_write):
        for _ in range(per_write):
            before = score
            flow = before.join(ways, F.col("host") == F.col("from")).select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("f")).alias("trust"), (damping * F.col("distrust") * F.col("r")).alias("distrust"))
            score = start.unionByName(flow).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        old = before.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = score.join(old, "host", "left").select("host", "trust", "distrust", F.greatest(F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0)))).alias("moved"))
        moved = staged(moved, "ranks")
        score = moved.select("host", "trust", "distrust")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return score
    raise RuntimeError(f"host scores have not settled in {most_rounds} rounds")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of pages (page_id, url, html)."""
    host = host_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), bare_host(host).alias("node"), path_of(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    nodes = ruled.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("_rule.verdict") == "allow").alias("a"), F.count_if(F.col("_rule.verdict") == "block").alias("z"))
    seeds = staged(nodes.select(F.col("node").alias("host"), (F.col("a") / F.col("n")).alias("t"), (F.col("z") / F.col("n")).alias("b")), "seeds")
    scores = propagate(seeds, host_edges(parsed), damping).withColumnRenamed("host", "node")
    out = ruled.drop("html").join(scores, "node", "left")
    bad = F.col("distrust") - F.col("trust") > MARGIN * (1 - damping) + 1e-9
    verdict = F.coalesce("_rule.verdict", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("trust", "distrust")


#: The same rows in DuckDB: sixty rounds over the host graph, by when 0.8 ** 60 of the flow is left.
OP5_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, html, coalesce(url, '') AS url, coalesce(strpos(url, '://'), 0) AS mark FROM pages),
h AS (SELECT page_id, html, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
j AS (SELECT row_number() OVER () AS r, p.*, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS node FROM p),
f AS (SELECT r, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict FROM j, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY r),
g AS (SELECT j.*, f.rule, f.verdict FROM j LEFT JOIN f USING (r)),
s AS (SELECT node, count(*) FILTER (verdict = 'allow') / count(*) AS t, count(*) FILTER (verdict = 'block') / count(*) AS b FROM g GROUP BY node),
l AS (SELECT node AS src, regexp_replace(translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^.*@|:[0-9]*$', '', 'g') AS dst FROM g),
c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND dst <> '' GROUP BY src, dst),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM c),
w AS (SELECT src AS a, dst AS z, share AS f, 0 AS r FROM e UNION ALL SELECT dst, src, 0, share FROM e),
i(k, node, trust, distrust) AS (
  SELECT 0, node, 0.2::DOUBLE * t, 0.2::DOUBLE * b FROM s
  UNION ALL
  SELECT k, node, sum(trust), sum(distrust) FROM (
    SELECT i.k + 1 AS k, w.z AS node, 0.8::DOUBLE * i.trust * w.f AS trust, 0.8::DOUBLE * i.distrust * w.r AS distrust FROM i JOIN w ON i.node = w.a WHERE i.k < 60
    UNION ALL SELECT m.k + 1, s.node, 0.2::DOUBLE * t, 0.2::DOUBLE * b FROM s, (SELECT max(k) AS k FROM i) m WHERE m.k < 60) GROUP BY k, node)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN i.distrust - i.trust > 0.1 + 1e-9 THEN 'block' ELSE 'allow' END) AS verdict
FROM g LEFT JOIN i ON i.node = g.node AND i.k = 60
"""
