"""Extension surface: registries of extractors and classifiers, observed statistics, similarity on pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Extractor = Callable[[DataFrame], DataFrame]


def run_extractors(docs: DataFrame, registry: dict[str, Extractor]) -> DataFrame:
    """Each extractor on the documents of its type; results unioned by name, missing columns null."""
    out = None
    for kind, extract in registry.items():
        part = extract(docs.where(F.col("document_type") == kind)).withColumn("extractor", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no extractors are registered")
    return out


def run_classifiers(docs: DataFrame, registry: dict[str, Extractor]) -> DataFrame:
    """Votes (doc_id, method, ordinal, label, confidence) of all registered classifiers."""
    out = None
    for k, (method, classify) in enumerate(registry.items()):
        part = classify(docs).select("doc_id", F.lit(method).alias("method"), F.lit(k).alias("ordinal"), "label", "confidence")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no classifiers are registered")
    return out


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """df with metrics that are computed as it runs; read them from the observation afterwards."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def sequence_similarity(pairs: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Exact matching-block ratio of two columns, for candidate pairs only."""
    from difflib import SequenceMatcher

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [SequenceMatcher(None, a or "", c or "", autojunk=False).ratio() for a, c in zip(b[left], b[right], strict=True)]})

    return pairs.mapInPandas(run, f"{kinds}, {out} double")
