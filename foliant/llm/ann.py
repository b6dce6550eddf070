"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of BOOKS full-dimensional codewords, one from each codebook. Codebooks
are fitted on a bounded sample: each by k-means on what the ones before leave over, then by
least squares on beam-searched codes, one book at a time with the others held. Every vector is encoded by beam search,
keeping the BEAM best partial sums at each book, and stored as its codes and the ratio of its own
norm to its reconstruction's.

A query's inner products with all codewords form its lookup table; a vector's score is the sum of
BOOKS entries times the stored ratio. Blocks of queries meet blocks of codes, each query keeps its
CANDIDATES best, and these are ranked again by exact inner products of the original vectors.

Equal vectors are coded once. A group of them carries its MEMBERS = k + 1 least ids, all that k
nearest can need, so copies don't crowd out other candidates.

The scan is exhaustive: its work is queries times vectors over BOOKS additions, without random
access. What moves is each block of codes once for each block of queries, and CANDIDATES of every
query for each block of codes; so both blocks are as large as a task's memory allows, and the
queries are divided further only while there would be fewer pairs of blocks than TASKS.

Defined results: vectors null, zero, of another length than most, or with null or non-finite
components take no part, nor do null ids; rows of equal id count once, with the least vector;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, staged

#: Most vectors on which codebooks are fitted, picked by hash of the id.
SAMPLE = 8192
BOOKS = 24
WORDS = 256
BEAM = 8
CANDIDATES = 256
#: Most queries and codes that meet in a task, and queries whose tables it holds at once.
QUERY_BLOCK = 16384
CODE_BLOCK = 262144
TABLES = 256
TASKS = 32


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) with the least error found by beam search."""
    out = np.zeros((len(x), len(books)), np.uint8)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        left, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        for c in books:
            # Error of each partial sum with each word added, but for what all share.
            error = (left * left).sum(2)[:, :, None] - 2 * (left @ c.T) + (c * c).sum(1)
            flat = error.reshape(len(part), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
            path, word = np.divmod(best, len(c))
            rows = np.arange(len(part))[:, None]
            left = left[rows, path] - c[word]
            codes = np.concatenate([codes[rows, path], word[:, :, None].astype(np.uint8)], 2)
        out[at : at + 1024] = codes[:, 0]
    return out


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 11, refine: int = 2) -> np.ndarray:
    """Codebooks (books, words, dims) of the sample x."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    left, found = x.copy(), []
    for _ in range(books):
        c = kmeans(left, words, rng)
        left = left - c[(left @ c.T - (c * c).sum(1) / 2).argmax(1)]
        found.append(c)
    c = np.stack(found)
    for _ in range(refine):
        codes = beam_encode(x, c, 4)
        error = x - c[np.arange(books), codes].sum(1)
        for _ in range(3):
            for i in range(books):
                # The least-squares words of one book with the others held: means of what they leave.
                own = error + c[i][codes[:, i]]
                n = np.bincount(codes[:, i], minlength=words)
                sums = np.zeros_like(c[i])
                np.add.at(sums, codes[:, i], own)
                c[i] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c[i])
                error = own - c[i][codes[:, i]]
    return c


def usable(vector: Column, dims: int) -> Column:
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def vectors_of(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and the number of dimensions that most have."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where("vec_id is not null and v is not null")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = int(most["d"]) if most else 0
    return rows.where(usable(F.col("v"), dims)).groupBy("vec_id").agg(F.min("v").alias("v")), dims


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64).reshape(len(column), dims)


def nearest(table: DataFrame, queries: Column, k: int = 20, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id where queries holds its k nearest found.

    table has vec_id and embedding; queries is a condition on vec_id.
    """
    rows, dims = vectors_of(table)
    rows = staged(rows, "vectors")
    spark = table.sparkSession
    # The k + 1 least ids of each distinct vector; rows beyond them go before the shuffle.
    place = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
    groups = staged(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).select(F.get("members", F.lit(0)).alias("gid"), "v", "members"), "groups")
    asked = staged(rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    n, n_asked = groups.count(), asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = hash_sample(groups.select("gid", "v"), "gid", SAMPLE, n).collect()  # at most SAMPLE vectors
    books = fit_books(np.array([r["v"] for r in sample], np.float64))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["v"], dims)
            codes = beam_encode(x, books)
            back = books[np.arange(len(books)), codes].sum(1)
            ratio = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(back, axis=1), 1e-12)
            yield pd.DataFrame({"gid": b["gid"], "code": [c.tobytes() for c in codes], "ratio": ratio})

    codes = staged(groups.select("gid", "v").mapInPandas(encode, "gid long, code binary, ratio double"), "codes")
    n_code = ceil(n / CODE_BLOCK)
    n_query = max(ceil(n_asked / QUERY_BLOCK), min(ceil(TASKS / n_code), ceil(n_asked / TABLES)))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    left = asked.select("query_id", "q", block("query_id", n_query).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_code - 1).cast("long"))).alias("b"))
    right = codes.select("gid", "code", "ratio", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_query - 1).cast("long"))).alias("a"), block("gid", n_code).alias("b"))

    def scan(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "gid": [], "near": []}).astype({"query_id": "int64", "gid": "int64"})
        cs = cs.sort_values("gid")
        gid, ratio = cs["gid"].to_numpy(), cs["ratio"].to_numpy(np.float32)
        code = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1)
        columns = [np.ascontiguousarray(code[:, m]) for m in range(code.shape[1])]
        keep, ids, tops, nears = min(candidates, len(cs)), qs["query_id"].to_numpy(), [], []
        for at in range(0, len(qs), TABLES):
            for table in np.einsum("qd,mwd->qmw", matrix(qs["q"].iloc[at : at + TABLES], dims), books).astype(np.float32):
                near = table[0][columns[0]]
                for m in range(1, len(columns)):
                    near += table[m][columns[m]]
                near *= ratio
                top = np.argpartition(-near, keep - 1)[:keep] if keep < len(cs) else np.arange(len(cs))
                tops.append(top.astype(np.int32))
                nears.append(near[top])
        return pd.DataFrame({"query_id": np.repeat(ids, keep), "gid": gid[np.concatenate(tops)], "near": np.concatenate(nears).astype(np.float64)})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(scan, "query_id long, gid long, near double")
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "gid")
    found = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= candidates).select("query_id", "gid")
    return rerank(found, groups, asked, k)


def rerank(found: DataFrame, groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query by exact inner product among found (query_id, gid)."""
    both = found.join(groups, "gid").join(asked, "query_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_id", "gid", "members", product.alias("score"))
    by_group = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    near = scored.withColumn("_n", F.row_number().over(by_group)).where(F.col("_n") <= k + 1)
    each = near.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    by_row = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product of every vector whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
