"""Quality classifier from positive and unlabelled texts.

A linear model over bounded text features is fitted with the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

under the logistic loss, where R_p averages over trusted positives and R_u over unlabelled web
text. Whenever the bracket of a batch falls below -SLACK the step goes up its gradient instead,
which keeps the model from fitting the unlabelled sample; SLACK allows for the error of the
estimated prior. The class prior is estimated from the same two samples: on halves of them a
positive-against-unlabelled model is fitted, and on the other halves the least ratio of the shares
of unlabelled and positive texts above a score bounds the share of positives from above; the
median over several splits is taken.

Features are shares of character classes and their pairs, how much words and lines repeat, and
hashed words and pairs of words. The model is fitted on bounded samples (MOST_POSITIVES,
MOST_UNLABELLED), neither of them from the held-out third; every text is scored.

Defined results: null and blank texts have the same features, all zero but the bias, and get a
score like any other; a null doc_id is not held out; labels with a null id or quality are unused
and an id with contradicting labels isn't trusted; rows are scored one by one, so repeated rows
agree. With no positive or no unlabelled sample every score is the prior, 0.5. Other columns of
the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP, hash_sample, with_values

#: Bounds of the samples on which the model is fitted, picked by hash of doc_id.
MOST_POSITIVES = 5000
MOST_UNLABELLED = 10000
#: Parts in which the samples' features are fetched.
FETCHES = 8
#: How far the risk on the negative side may fall below zero.
SLACK = 0.04
#: Classes of characters: lower, upper, other letter, digit, blank, line end, full stop, comma, !?, quotes, symbols, bar, other punctuation, rest.
CLASSES = 14
#: Buckets of hashed words and of hashed pairs of words.
BUCKETS = 256
SHAPE = CLASSES + CLASSES * CLASSES
FEATURES = SHAPE + 2 * BUCKETS + 12
#: Scale of the hashed features beside the others; small, since they are many and each says little.
WORD_WEIGHT = 0.1


def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry serves for all beyond."""
    table = np.full(65537, 13, np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        table[c] = {"Ll": 0, "Lu": 1}.get(kind, 2 if kind[0] in "LM" else 3 if kind[0] == "N" else 4 if kind[0] == "Z" else 12 if kind[0] in "PS" else 13)
    for chars, k in ((" \t\x0b\x0c\r", 4), ("\n", 5), (".", 6), (",", 7), ("!?", 8), ("'\"", 9), ("#*$%&<>@~^_=+\\/", 10), ("|", 11)):
        for ch in chars:
            table[ord(ch)] = k
    return table


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """Shares of character classes and of their pairs, of hashed words and pairs, and how much words and lines repeat."""
    out = np.zeros(FEATURES, np.float32)
    text = text or ""
    w = text.split()
    if not w:
        return out
    c = table[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 65536)]
    out[:CLASSES] = np.sqrt(np.bincount(c, minlength=CLASSES) / len(c))
    out[CLASSES:SHAPE] = np.sqrt(np.bincount(c[:-1].astype(np.int64) * CLASSES + c[1:], minlength=CLASSES * CLASSES) / len(c))
    n = len(w)
    hashes = {x: zlib.crc32(x.encode("utf-8", "replace")) for x in set(w)}
    h = np.fromiter(map(hashes.__getitem__, w), np.int64, n) * 0x9E3779B97F4A7C1
    out[SHAPE : SHAPE + BUCKETS] = np.sqrt(np.bincount((h >> 20) % BUCKETS, minlength=BUCKETS) / n)
    out[SHAPE + BUCKETS : -12] = np.sqrt(np.bincount((h[:-1] * 31 + h[1:] >> 20) % BUCKETS, minlength=BUCKETS) / n)
    _, times = np.unique(h, return_counts=True)
    windows = h
    if n >= 5:
        windows = h[:-4] + 3 * h[1:-3] + 5 * h[2:-2] + 7 * h[3:-1] + 11 * h[4:]
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, w), np.int64, n)
    out[-12:] = (
        np.log1p(n) / 10,
        lengths.mean() / 10,
        lengths.std() / 10,
        np.sqrt(len(times) / n),
        times.max() / n,
        1 - len(np.unique(windows)) / len(windows),
        1 - len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)) / 10,
        1 / n,
        (times == 1).sum() / n,
        (h[1:] == h[:-1]).sum() / n,
        1 - len(np.unique(h[:-1] + 3 * h[1:])) / max(n - 1, 1) if n > 1 else 0.0,
    )
    return out


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, seed: int = 7, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weights (bias last) of least non-negative risk, by Adam over batches; own: the rows to be used, all if not given."""
    rng = np.random.default_rng(seed)
    of_p, of_u = own or (np.arange(len(xp)), np.arange(len(xu)))
    d = xp.shape[1]
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        p, u = xp[of_p[rng.integers(0, len(of_p), 512)]], xu[of_u[rng.integers(0, len(of_u), 1024)]]
        single = w.astype(np.float32)  # else every batch is copied as doubles
        zp, zu = (p @ single).astype(float), (u @ single).astype(float)
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_plus = -prior * (sigmoid(-zp).astype(np.float32) @ p) / len(p)
        g_minus = (sigmoid(zu).astype(np.float32) @ u) / len(u) - prior * (sigmoid(zp).astype(np.float32) @ p) / len(p)
        g = (g_plus + g_minus if bracket >= -SLACK else -g_minus) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(xp: np.ndarray, xu: np.ndarray, splits: int = 5) -> float:
    """Share of positives in xu: least ratio of the tails of a positive-against-unlabelled score."""
    found = []
    for k in range(splits):
        rng = np.random.default_rng(k)
        p, u = rng.permutation(len(xp)), rng.permutation(len(xu))
        half_p, half_u = (len(p) + 1) // 2, (len(u) + 1) // 2
        w = _descend(xp, xu, 0.5, 800, k, (p[:half_p], u[:half_u])).astype(np.float32)
        sp, su = np.sort((xp @ w)[p[half_p:] if half_p < len(p) else p]), np.sort((xu @ w)[u[half_u:] if half_u < len(u) else u])
        cuts = np.quantile(sp, np.linspace(0.002, 0.3, 40))
        above = lambda s: 1 - np.searchsorted(s, cuts, "left") / len(s)  # noqa: B023, E731
        found.append(np.min(above(su) / np.maximum(above(sp), 1e-9)))
    return float(np.clip(np.median(found), 0.05, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 3000) -> dict:
    """Model of the two samples' features, the last of which is 1 for the bias: centre, scale, weights and the estimated prior.

    The samples are scaled in place; they are the largest objects that the driver holds.
    """
    if not len(xp) or not len(xu):
        return {"prior": 0.5, "weights": None}
    centre = xu[:, :-1].mean(0)
    square = sum((np.square(xu[at : at + 1000, :-1] - centre).sum(0, dtype=np.float64) for at in range(0, len(xu), 1000)), np.zeros(FEATURES))
    scale = np.maximum(np.sqrt(square / len(xu)), 1e-3).astype(np.float32)
    scale[SHAPE : SHAPE + 2 * BUCKETS] /= max(WORD_WEIGHT, 1e-9)
    for x in (xp, xu):
        x[:, :-1] -= centre
        x[:, :-1] /= scale
        np.clip(x, -8, 8, out=x)
    prior = estimate_prior(xp, xu)
    return {"prior": prior, "weights": _descend(xp, xu, prior, steps), "centre": centre, "scale": scale}


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if model["weights"] is None:
        return np.full(len(x), model["prior"])
    z = np.clip((x - model["centre"]) / model["scale"], -8, 8) @ model["weights"][:-1] + model["weights"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """True for the third of ids from which no label is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = MOST_POSITIVES, unlabelled: int = MOST_UNLABELLED) -> dict:
    """Model from docs (doc_id, text) and labels (doc_id, quality).

    Positives are the ids whose labels all say 1, unlabelled the ids without a label; both without
    the held-out third, whose labels are never looked at. Both are picked by the order of a hash of
    the id, at most so many, so that the samples of features on the driver have a fixed bound.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = known.where("quality = 1").select("doc_id")
    free = docs.select("doc_id").where("doc_id is not null").where(~held_out(F.col("doc_id"))).distinct().join(known, "doc_id", "left_anti")
    pos, free = (hash_sample(x, "doc_id", n, x.count()) for x, n in ((trusted, positives), (free, unlabelled)))
    ids = pos.select("doc_id", F.lit(1).alias("positive")).unionByName(free.select("doc_id", F.lit(0).alias("positive")))
    table = class_table()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "positive": b["positive"], "x": [features(t, table).tobytes() for t in b["text"]]})

    # At most positives + unlabelled ids, so this side has a fixed bound; repeated rows count once.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInPandas(run, "doc_id long, positive int, x binary")
    rows = rows.groupBy("doc_id", "positive").agg(F.min("x").alias("x")).coalesce(FETCHES)
    # Fetched a partition at a time into one array: neither the JVM nor Python holds the sample twice.
    x, keys = np.ones((positives + unlabelled, FEATURES + 1), np.float32), []
    for k, r in enumerate(rows.toLocalIterator()):
        keys.append((r["positive"], r["doc_id"]))
        x[k, :-1] = np.frombuffer(r["x"], np.float32)
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    n = sum(1 for positive, _ in keys if not positive)
    return fit(x[order[n:]], x[order[:n]])


def scorer(model: dict) -> Callable[[list], np.ndarray]:
    """Scores of a list of texts."""
    table = class_table()
    return lambda texts: score(np.array([features(t, table) for t in texts], np.float32).reshape(len(texts), FEATURES), model)


def score_texts(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep and score of every row of docs, which has text."""

    def start() -> Callable[[list], list[pa.Array]]:
        scores = scorer(model)
        return lambda texts: [pa.array(scores(texts).astype(np.float64))]

    return with_values(docs, keep, start, "score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they are."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(model)
        for b in batches:
            for low in range(0, b.num_rows, STEP):
                some = b.slice(low, STEP)
                yield some.filter(pa.array(scores(some.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_texts(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
