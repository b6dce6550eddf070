"""Text model: TF-IDF of words and word pairs with multinomial naive Bayes, and when to retrain it."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, RegexTokenizer, SQLTransformer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.staging import once

LEAST_SAMPLES = 10
#: Words as RegexTokenizer below cuts them: runs of letters and digits, two at least.
WORD = re.compile(r"[^\W_]{2,}")
#: Terms that a task holds before it gives their counts away.
MOST_TERMS = 200_000
#: Words, about, that a sieve of pairs may hold; with more equally rare ones at its edge all pairs are counted.
MOST_WORDS = 100_000


def term_counts(labeled: DataFrame, words_of_pairs: frozenset[str] | None = None, pairs: bool = False) -> DataFrame:
    """(label, term, n, df) of labeled (text, label): occurrences and texts of each word, or, with pairs, of each pair of words.

    The null term counts the texts themselves. words_of_pairs: only pairs of two of these are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for label, (n, df) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())], names=["label", "term", "n", "df"])
            held.clear()

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms = WORD.findall(text.lower())
                if pairs:
                    both = zip(terms, terms[1:], strict=False)
                    terms = [f"{x} {y}" for x, y in both if words_of_pairs is None or x in words_of_pairs and y in words_of_pairs]
                n, df = held.setdefault(label, (Counter(), Counter()))
                n.update(terms)
                df.update(set(terms))
                n[None] += 1
                df[None] += 1
                if sum(len(c) for c, _ in held.values()) > MOST_TERMS:
                    yield from flushed()
        yield from flushed()

    counts = labeled.select("text", F.col("label").cast("string").alias("label")).mapInArrow(run, "label string, term string, n long, df long")
    return counts.groupBy("label", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def most_frequent(counts: DataFrame, features: int, least_df: float) -> DataFrame:
    """(term, n, df) of the most frequent terms that least_df texts or more hold, ties by term."""
    found = counts.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return found.where(F.col("df") >= least_df).orderBy(F.desc("n"), "term").limit(features)


def train_text_model(labeled: DataFrame, features: int = 5000, min_df: float = 2.0, smoothing: float = 0.1) -> PipelineModel | None:
    """Model of labeled (text, label); None for fewer than LEAST_SAMPLES rows.

    Texts are read for the counts of terms by label, and from these come the vocabulary (the most
    frequent terms of min_df texts or more, ties by term), the weights and the model: a label's sum
    of TF-IDF vectors is its counts times the weights. A pair occurs no more often than either word,
    so once as many words as there are features are known to occur t times or more, only pairs of
    words that do can be features, and no others are counted. What reaches the driver is features
    terms with a count for each label, and the words of that sieve.
    """
    rows = labeled.where("text is not null and label is not null")
    if len(rows.select("label").limit(LEAST_SAMPLES).collect()) < LEAST_SAMPLES:
        return None
    words = once(term_counts(rows))
    texts = {r["label"]: r["n"] for r in words.where("term is null").collect()}  # one row a label
    total = sum(texts.values())
    least_df = min_df if min_df >= 1 else min_df * total
    known = most_frequent(words, features, least_df).collect()
    sieve = None
    if len(known) == features:
        often = words.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= known[-1]["n"]).select("term").limit(MOST_WORDS + 1).collect()
        sieve = frozenset(r["term"] for r in often) if len(often) <= MOST_WORDS else None
    counts = words.where("term is not null").unionByName(once(term_counts(rows, sieve, pairs=True)).where("term is not null"))
    best = most_frequent(counts, features, least_df).collect()
    if not best:
        raise ValueError(f"no term occurs in {min_df:g} texts or more")
    at = {r["term"]: k for k, r in enumerate(best)}
    weights = [math.log((total + 1) / (r["df"] + 1)) for r in best]
    labels = sorted(texts, key=lambda x: (-texts[x], x))
    sums = {x: [0.0] * len(at) for x in labels}
    vocabulary = labeled.sparkSession.createDataFrame([(t,) for t in at], "term string")
    for r in counts.join(F.broadcast(vocabulary), "term").select("label", "term", "n").toLocalIterator():
        sums[r["label"]][at[r["term"]]] = r["n"] * weights[at[r["term"]]] / texts[r["label"]]
    means = labeled.sparkSession.createDataFrame([(float(k), float(texts[x]), Vectors.dense(sums[x])) for k, x in enumerate(labels)], ["label_index", "texts", "tfidf"])
    bayes = NaiveBayes(featuresCol="tfidf", labelCol="label_index", weightCol="texts", smoothing=smoothing).fit(means)
    return PipelineModel([
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(list(at), inputCol="terms", outputCol="counts"),
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="counts", outputCol="tfidf"),
        StringIndexerModel.from_labels(labels, inputCol="label", outputCol="label_index", handleInvalid="keep"),
        bayes,
    ])


def predict_text(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """(doc_id, label, confidence, probabilities) of docs (doc_id, text)."""
    labels = model.stages[-2].labels
    scored = model.transform(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(labels[0]).alias("label")))
    p = vector_to_array("probability")
    out = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*labels, "__unknown"]).transform(scored)
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.slice(p, 1, len(labels)))
    return out.select("doc_id", F.col("predicted").alias("label"), F.array_max(p).alias("confidence"), named.alias("probabilities"))


def should_retrain(training: DataFrame, history: DataFrame, least: int = 50) -> DataFrame:
    """One row: training rows newer than the last training event and whether they are enough."""
    last = history.where("method = 'training'").agg(F.max("at").alias("last"))
    fresh = training.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("last").isNull() | (F.col("created_at") > F.col("last"))).alias("fresh"))  # last is one row
    return fresh.withColumn("retrain", F.col("fresh") >= least)
