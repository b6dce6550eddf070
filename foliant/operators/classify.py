"""Classification: rule tables and score cards over texts, votes of several classifiers, learned context.

Rules are data. Small rule tables are folded into one expression over the text, large ones into one
automaton a task, so a corpus is scanned once and nothing is multiplied; votes are long tables (doc_id, method, label, confidence).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .rules import MOST_FOLDED, any_like, count_contained, first_match, folded


def _labels(rows: list) -> dict[str, list]:
    """Label -> its rules, labels in the order of the configuration."""
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["label"], []).append(r)
    return out


SCORE = "array<struct<hits: int, ord: int, label: string, n_rules: int>>"


def _scores(labels: dict[str, list]) -> Column:
    """(hits, -ord, label, n_rules) of the labels with a hit: distinct keywords in the lower-cased text."""
    text = F.lower(F.coalesce("text", F.lit("")))
    each = [F.struct(count_contained(text, [r["pattern"].lower() for r in own]).alias("hits"), F.lit(-own[0]["ord"]).alias("ord"), F.lit(label).alias("label"), F.lit(len(own)).alias("n_rules")) for label, own in labels.items()]
    return F.filter(F.array(*each), lambda x: x["hits"] > 0).cast(SCORE)


def _contained(rows: DataFrame, keywords: list[str], make: Callable[[list[int]], Any], out: DataType, name: str) -> DataFrame:
    """rows (..., _low) with make() of the numbers of the keywords that each _low contains, by one automaton a task.

    For rule tables too large for an expression: one pass over a text, whatever the number of keywords.
    """
    places: dict[str, list[int]] = {}
    for k, w in enumerate(keywords):
        places.setdefault(w, []).append(k)
    keep = [c for c in rows.columns if c != "_low"]
    kind = to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        always = places.get("", [])
        automaton = ahocorasick.Automaton()
        for w, own in places.items():
            if w:
                automaton.add_word(w, own)
        automaton.make_automaton()
        for b in batches:
            found = []
            for text in b.column("_low").to_pylist():
                hits = {id(own): own for _, own in automaton.iter(text)} if len(automaton) else {}
                found.append(make(sorted([*always, *(k for own in hits.values() for k in own)])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(found, kind)], names=[*keep, name])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField(name, out)]))


def _low(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))


def _all_scores(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, scores) of every row of docs: one projection, or one automaton for over MOST_FOLDED rules."""
    rows = folded(rules)
    labels = _labels(rows)
    if len(rows) <= MOST_FOLDED:
        return docs.select("doc_id", _scores(labels).alias("scores"))
    label_of = [r["label"] for r in rows]
    heads = {label: (-own[0]["ord"], label, len(own)) for label, own in labels.items()}

    def scores(hits: list[int]) -> list[dict]:
        n: dict[str, int] = {}
        for k in hits:
            n[label_of[k]] = n.get(label_of[k], 0) + 1
        return [dict(zip(("hits", "ord", "label", "n_rules"), (x, *heads[label]), strict=True)) for label, x in n.items()]

    kind = docs.sparkSession.createDataFrame([], f"scores {SCORE}").schema["scores"].dataType
    return _contained(_low(docs), [r["pattern"].lower() for r in rows], scores, kind, "scores")


def keyword_scores(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, label, ord, n_rules, hits) for labels with a hit: distinct keywords in the lower-cased text."""
    each = _all_scores(docs, rules).select("doc_id", F.explode("scores").alias("s"))
    return each.select("doc_id", "s.label", F.negative("s.ord").alias("ord"), "s.n_rules", "s.hits")


def _best(docs: DataFrame, scores: DataFrame, *order: Column) -> DataFrame:
    """docs' ids with the first score row of each in order, null where there is none."""
    ranked = scores.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("_n = 1").drop("_n")
    return docs.select("doc_id").join(ranked, "doc_id", "left")


def classify_keywords(docs: DataFrame, rules: DataFrame, mode: str = "ratio", default: str = "other") -> DataFrame:
    """(doc_id, label, confidence): most keywords wins, earlier rules break ties.

    ratio: hits over the label's keywords, 0.3 for none. tiered: 0.85, 0.70, 0.50 for three, two
    or one keyword, 0.2 for none.
    """
    best = _all_scores(docs, rules).select("doc_id", F.array_max("scores").alias("b"))
    hits = F.col("b.hits")
    if mode == "ratio":
        conf = F.when(hits.isNull(), 0.3).otherwise(F.least(F.lit(1.0), hits / F.col("b.n_rules")))
    else:
        conf = F.when(hits >= 3, 0.85).when(hits == 2, 0.70).when(hits == 1, 0.50).otherwise(0.2)
    return best.select("doc_id", F.coalesce("b.label", F.lit(default)).alias("label"), conf.alias("confidence"))


def matched_keywords(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, keywords): the rules' keywords that the text contains, in rule order."""
    rows = folded(rules)
    names = [r["pattern"] for r in rows]
    if len(rows) > MOST_FOLDED:
        return _contained(_low(docs), [n.lower() for n in names], lambda hits: [names[k] for k in hits], ArrayType(StringType()), "keywords")
    text = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.array_compact(F.array(*[F.when(text.contains(n.lower()), F.lit(n)) for n in names], F.lit(None).cast("string"))).alias("keywords"))


def classify_regex_counts(docs: DataFrame, rules: DataFrame, default: str = "other") -> DataFrame:
    """(doc_id, label, score): ten points for each occurrence, 95 at most; below 30 the default.

    Patterns of a label are a literal array that one expression runs through, so the plan grows with
    the labels, not with the patterns.
    """
    text = F.coalesce("text", F.lit(""))
    scores = []
    for k, (label, own) in enumerate(_labels(folded(rules)).items()):
        patterns = F.array(*[F.lit("(?iu)" + r["pattern"]) for r in own])
        total = F.aggregate(patterns, F.lit(0), lambda n, p: n + F.regexp_count(text, p)) if len(own) > MOST_FOLDED else sum((F.regexp_count(text, F.lit("(?iu)" + r["pattern"])) for r in own), F.lit(0))
        scores.append(F.struct(F.least(F.lit(95), total * 10).alias("score"), F.lit(-k).alias("ord"), F.lit(label).alias("label")))
    if not scores:
        return docs.select("doc_id", F.lit(default).alias("label"), F.lit(50).alias("score"))
    best = docs.select("doc_id", F.array_max(F.array(*scores)).alias("b"))
    score = F.when(F.col("b.score") == 0, 50).otherwise(F.col("b.score"))
    return best.select("doc_id", F.when(F.col("b.score") >= 30, F.col("b.label")).otherwise(default).alias("label"), score.alias("score"))


def cards_of(rules: DataFrame) -> dict[str, dict]:
    """Score cards from a rule table: kinds keyword, required, bonus and negative; a label's base is the greatest weight of its keywords."""
    cards: dict[str, dict] = {}
    kinds = {"keyword": "keywords", "required": "required", "bonus": "bonus", "negative": "negative"}
    for r in folded(rules.where(F.col("kind").isin(*kinds))):
        card = cards.setdefault(r["label"], {"base": 0, "keywords": [], "required": [], "bonus": [], "negative": []})
        card[kinds[r["kind"]]].append(r["pattern"])
        if r["kind"] == "keyword":
            card["base"] = max(card["base"], int(r["weight"] or 0))
    return cards


def scorecard(docs: DataFrame, cards: dict[str, dict], default: str = "unknown") -> DataFrame:
    """(doc_id, label, score, candidates) of score cards.

    A card has keywords, required, bonus and negative patterns and a base: base if any keyword,
    int(50 * share of required), 5 for each bonus, -50 for each negative. Cards over 0 are
    candidates (best three kept), the best needs 50, scores end at 200.
    """
    text = F.coalesce("text", F.lit(""))
    hit = lambda p: text.rlike("(?iu)" + p).cast("int")
    total = lambda ps: sum((hit(p) for p in ps), F.lit(0))
    scores = []
    for k, (label, c) in enumerate(cards.items()):
        required = c.get("required", [])
        score = F.when(total(c["keywords"]) > 0, c["base"]).otherwise(0)
        if required:
            score = score + F.floor(50 * total(required) / len(required)).cast("int")
        score = F.least(F.lit(200), score + 5 * total(c.get("bonus", [])) - 50 * total(c.get("negative", [])))
        scores.append(F.struct(score.cast("int").alias("score"), F.lit(-k).alias("ord"), F.lit(label).alias("label")))
    ranked = F.slice(F.reverse(F.array_sort(F.filter(F.array(*scores), lambda x: x["score"] > 0))), 1, 3)
    out = docs.select("doc_id", ranked.alias("r"))
    best = F.get("r", F.lit(0))
    sure = F.coalesce(best["score"] >= 50, F.lit(False))
    return out.select("doc_id", F.when(sure, best["label"]).otherwise(default).alias("label"), F.when(sure, best["score"]).otherwise(0).alias("score"), F.array_join(F.transform("r", lambda x: F.concat(x["label"], F.lit(":"), x["score"].cast("string"))), ",").alias("candidates"))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 150, "VERY_HIGH").when(score >= 100, "HIGH").when(score >= 70, "MEDIUM").otherwise("LOW")


def detect_ads(text: Column, keywords: list[str], patterns: list[str]) -> Column:
    """Struct (score, is_ad): a weighted sum of keywords and patterns over five, ad over 0.5."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = 0.6 * count_contained(low, keywords) + 0.4 * sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))
    score = F.least(F.lit(1.0), hits / 5)
    return F.struct(score.alias("score"), (score > 0.5).alias("is_ad"))


def ad_features(text: Column, unsubscribe: list[str], discount: list[str], call: list[str]) -> list[Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda ws: count_contained(low, ws) > 0
    percent = F.regexp_extract(low, r"(\d{1,3})\s*%", 1)
    return [some(unsubscribe).alias("has_unsubscribe"), some(discount).alias("has_discount"), some(call).alias("has_call"), F.when(percent != "", percent.cast("int")).alias("percent")]


def detect_legal(text: Column, keywords: list[str], patterns: list[str], courts: list[str]) -> Column:
    """Struct (score, is_legal): over three, legal over 0.5 or if any court is named."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = count_contained(low, courts)
    score = F.least(F.lit(1.0), (0.4 * count_contained(low, keywords) + 0.3 * sum((low.rlike(p).cast("int") for p in patterns), F.lit(0)) + 0.3 * named) / 3)
    return F.struct(score.alias("score"), ((score > 0.5) | (named > 0)).alias("is_legal"))


def legal_features(text: Column, subtypes: list[tuple[str, str]]) -> list[Column]:
    case = F.regexp_extract(text, r"(?U)\b(\d{1,3}\s*[A-Z]{1,3}\s*\d{1,5}/\d{2,4})\b", 1)
    paragraphs = F.regexp_extract_all(text, F.lit(r"§\s*\d+"), F.lit(0))
    return [F.nullif(case, F.lit("")).alias("case_number"), F.array_join(paragraphs, ";").alias("paragraphs"), first_match(F.lower(text), subtypes).alias("subtype")]


def pre_classify(columns: list[tuple[Column, list[tuple[str, str]]]]) -> Column:
    """First rule that matches, column by column; null for none."""
    return F.coalesce(*[first_match(F.lower(F.coalesce(c, F.lit(""))), rules) for c, rules in columns])


def force_classify(label: Column, text: Column, groups: list[tuple[str, list[str]]], other: str = "other", default: str = "correspondence") -> Column:
    """Labels other than ``other`` stay; else the first group with a keyword, else the default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for name, words in reversed(groups):
        out = F.when(count_contained(low, words) > 0, name).otherwise(out)
    return F.when(label == other, out).otherwise(label)


def ensemble_vote(votes: DataFrame, weights: dict[str, float], final: tuple[str, ...] = ("advert", "legal")) -> DataFrame:
    """(doc_id, label, confidence, agreeing) of votes (doc_id, method, label, confidence).

    A verdict of a final label ends the vote. Else each vote counts confidence times its method's
    weight; a label scores the average over its votes, at most 1; ties go to the label first by name.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))]), F.col("method")), F.lit(1.0))
    ended = F.col("label").isin(list(final))
    per = votes.groupBy("doc_id", "label").agg(F.avg(F.col("confidence") * weight).alias("score"), F.max("confidence").alias("top"), F.count("*").alias("agreeing"))
    per = per.withColumn("score", F.least(F.lit(1.0), F.when(ended, F.col("top")).otherwise(F.col("score"))))
    order = Window.partitionBy("doc_id").orderBy(F.desc(ended), F.desc("score"), "label")
    return per.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "label", F.col("score").alias("confidence"), "agreeing")


def agreement_boost(confidence: Column, agreeing: Column) -> Column:
    return F.least(F.lit(1.0), confidence * (1 + 0.1 * (agreeing - 1)))


def allowlist_boost(confidence: Column, allowed: Column, label: Column, text: Column, order_words: list[str], note_words: list[str], shipping_words: list[str]) -> Column:
    """+0.15 for allowed senders; +0.05 only where an order or delivery note lacks its words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    weak = ((label == "order") & (count_contained(low, order_words) == 0)) | ((label == "delivery_note") & (count_contained(low, note_words) == 0) & (count_contained(low, shipping_words) == 0))
    return F.when(allowed, F.least(F.lit(1.0), confidence + F.when(weak, 0.05).otherwise(0.15))).otherwise(confidence)


def learn_context(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sender and subject statistics and per-type thresholds from confirmed history.

    docs: doc_id, sender, subject, document_type, ai_confidence.
    """
    senders = docs.where("sender is not null").groupBy("sender", "document_type").agg(F.count("*").alias("n")).where("n >= 3")
    subjects = docs.where("subject is not null").groupBy("subject", "document_type").agg(F.count("*").alias("n")).where("n >= 2")
    limits = docs.where("ai_confidence is not null").groupBy("document_type").agg(F.avg("ai_confidence").alias("mean"), F.count("*").alias("n")).where("n >= 5")
    return senders, subjects, limits.select("document_type", F.greatest(F.col("mean") - 0.1, F.lit(0.5)).alias("threshold"))


def sender_shares(senders: DataFrame) -> DataFrame:
    """(sender, document_type, n, share): a type's share of its sender's documents."""
    return senders.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sender")))


#: Words of a subject that hint at a type; fixed values.
SUBJECT_WORDS = {"invoice": ["faktura", "invoice", "rechnung"], "receipt": ["receipt", "stvrzenka", "pokladní"], "payment_reminder": ["upomínka", "reminder", "zaplatit"], "advert": ["newsletter", "akce", "sleva", "sale"]}


def apply_context(docs: DataFrame, senders: DataFrame, subjects: DataFrame, thresholds: DataFrame, subject_words: dict[str, list[str]] = SUBJECT_WORDS) -> DataFrame:
    """(doc_id, boosted, below): confidence raised by context; whether the confidence before misses its type's threshold.

    A type's share of its sender's documents raises by 0.05 to 0.15; a subject known for the type by
    0.10, else one with a word that hints at it by 0.05.
    """
    shares = sender_shares(senders).select("sender", "document_type", "share")
    known = subjects.select("subject", "document_type", F.lit(True).alias("known_subject"))
    out = docs.join(shares, ["sender", "document_type"], "left").join(known, ["subject", "document_type"], "left").join(thresholds, "document_type", "left")
    boost = F.when(F.col("share") > 0.8, 0.15).when(F.col("share") > 0.5, 0.10).when(F.col("share") > 0.3, 0.05).otherwise(0.0)
    low, hint = F.lower(F.coalesce("subject", F.lit(""))), F.lit(False)
    for label, ws in subject_words.items():
        hint = hint | ((F.col("document_type") == label) & (count_contained(low, ws) > 0))
    boost = boost + F.when(F.coalesce("known_subject", F.lit(False)), 0.10).when(hint, 0.05).otherwise(0.0)
    base = F.coalesce("ai_confidence", F.lit(0.0))
    return out.select("doc_id", F.least(F.lit(1.0), base + boost).alias("boosted"), (base < F.coalesce("threshold", F.lit(0.6))).alias("below"))


def suggest_alternative(docs: DataFrame, senders: DataFrame, limit: float = 0.7) -> DataFrame:
    """(doc_id, suggestion, share) for uncertain documents: their sender's most common type."""
    top = sender_shares(senders).withColumn("_n", F.row_number().over(Window.partitionBy("sender").orderBy(F.desc("n"), "document_type"))).where("_n = 1")
    return docs.where(F.coalesce("ai_confidence", F.lit(0.0)) < limit).join(top.select("sender", F.col("document_type").alias("suggestion"), "share"), "sender").select("doc_id", "suggestion", "share")


def context_stats(senders: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row: known senders and subjects."""
    return senders.agg(F.countDistinct("sender").alias("senders")).crossJoin(subjects.agg(F.countDistinct("subject").alias("subjects")))  # one row each


def sender_types(senders: DataFrame, k: int = 10) -> DataFrame:
    """(sender, n, types): the k senders of most documents with a map of their types' counts; ties by name."""
    top = senders.groupBy("sender").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sender").limit(k)
    own = senders.select("sender", "document_type", F.col("n").alias("of_type")).join(F.broadcast(top), "sender")  # k rows
    return own.groupBy("sender", "n").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("document_type", "of_type")))).alias("types"))


def method_weights(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """(document_type, ai, keywords, ml): weights by how well the model does on a type, the mean of its confidences over ``least``; the middle ones without any."""
    mean = docs.groupBy("document_type").agg(F.avg(F.when(F.col("ai_confidence") >= least, F.col("ai_confidence"))).alias("m"))
    pick = lambda high, mid, low: F.when(F.col("m") > 0.95, high).when(F.col("m").isNull() | (F.col("m") > 0.85), mid).otherwise(low)
    return mean.select("document_type", pick(0.9, 0.7, 0.5).alias("ai"), pick(0.05, 0.2, 0.3).alias("keywords"), pick(0.05, 0.1, 0.2).alias("ml"))


def vote_consensus(docs: DataFrame, votes: DataFrame, threshold: int = 2) -> DataFrame:
    """(doc_id, label, confidence, consensus): most votes wins, the first voter breaks ties.

    votes: doc_id, ordinal, label. No votes or a text under 50 characters: OTHER at 0.
    """
    per = votes.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    per = per.withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    best = _best(docs, per, F.desc("n"), F.asc("first")).join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id")
    void = F.col("n").isNull() | (F.coalesce("chars", F.lit(0)) < 50)
    return best.select("doc_id", F.when(void, "OTHER").otherwise(F.col("label")).alias("label"), F.when(void, 0.0).otherwise(F.col("n") / F.col("all")).alias("confidence"), (~void & (F.col("n") >= threshold)).alias("consensus"))


def resolve_escalation(fast: DataFrame, big: DataFrame) -> DataFrame:
    """(doc_id, label, confidence): the big model's word counts only where the fast one said OTHER."""
    both = fast.join(big.select("doc_id", F.col("label").alias("big")), "doc_id", "left")
    asked = (F.col("label") == "OTHER") & F.col("big").isNotNull()
    return both.select("doc_id", F.when(asked, F.col("big")).otherwise(F.col("label")).alias("label"), F.when(asked, F.when(F.col("big") == "OTHER", 1.0).otherwise(0.8)).otherwise(F.col("confidence")).alias("confidence"))


def count_consensus(extractions: DataFrame) -> DataFrame:
    """(doc_id, item_count, agreeing, strength, level, accepted) of counts by several models.

    Failed models don't vote. perfect at 1, partial from 0.5. Two models must both agree, of more
    any two.
    """
    good = extractions.where(~F.col("failed"))
    per = good.groupBy("doc_id", "item_count").agg(F.count("*").alias("agreeing")).withColumn("models", F.sum("agreeing").over(Window.partitionBy("doc_id")))
    best = _best(extractions.select("doc_id").distinct(), per, F.desc("agreeing"), F.desc("item_count"))
    strength = F.coalesce(F.col("agreeing") / F.col("models"), F.lit(0.0))
    level = F.when(strength >= 1, "perfect").when(strength >= 0.5, "partial").otherwise("none")
    accepted = F.coalesce(F.when(F.col("models") <= 2, F.col("agreeing") == F.col("models")).otherwise(F.col("agreeing") >= 2), F.lit(False))
    return best.select("doc_id", "item_count", F.coalesce("agreeing", F.lit(0)).alias("agreeing"), strength.alias("strength"), level.alias("level"), accepted.alias("accepted"))


def item_type(description: Column, services: list[str], goods: list[str]) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(count_contained(low, services) > count_contained(low, goods), "service").otherwise("goods")


def overall_item_type(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_type): service or goods if all items are, else mixed; mixed without items."""
    per = items.groupBy("doc_id").agg(F.count_if(F.col("item_type") == "service").alias("s"), F.count("*").alias("n"))
    kind = F.when(F.col("s") == F.col("n"), "service").when(F.col("s") == 0, "goods").otherwise("mixed")
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("n").isNotNull(), kind), F.lit("mixed")).alias("item_type"))


def direction(text: Column, sender: Column, income: list[str], expense: list[str], own_domains: list[str]) -> Column:
    """Indicators of either side; own senders count two for income, others one for expense."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = F.coalesce(any_like(F.lower(sender), [d.replace(".", r"\.") + "$" for d in own_domains]), F.lit(False)) if own_domains else F.lit(False)
    plus = count_contained(low, income) + F.when(own, 2).otherwise(0)
    minus = count_contained(low, expense) + F.when(own, 0).otherwise(1)
    return F.when(plus > minus, "income").when(minus > plus, "expense").otherwise("unknown")


def subtype(document_type: Column, direction_: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *ws: count_contained(low, ws) > 0
    invoice = F.when(has("záloh", "advance", "proforma"), "advance_invoice").when(has("dobropis", "credit note"), "credit_note").when(direction_ == "income", "issued_invoice").otherwise("received_invoice")
    receipt = F.when(has("benz", "nafta", "diesel", "fuel"), "fuel_receipt").when(has("park"), "parking_receipt").otherwise("receipt")
    order = F.when(direction_ == "income", "received_order").otherwise("issued_order")
    return F.when(document_type == "invoice", invoice).when(document_type == "receipt", receipt).when(document_type == "order", order)


def expense_category(text: Column, categories: dict[str, list[str]], default: str = "other") -> Column:
    """Category with most keywords, the first of equals; the default for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [F.struct(count_contained(low, ws).alias("n"), F.lit(-k).alias("ord"), F.lit(name).alias("name")) for k, (name, ws) in enumerate(categories.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


#: Parts of names that tell companies and institutions, and endings of women's names; fixed values.
COMPANY_MARKS = ["s.r.o.", "a.s.", "spol.", "gmbh", "inc", "ltd", "corp", "@"]
INSTITUTION_MARKS = ["ministerstvo", "úřad", "soud", "policie", "čssz", "vfp", "ossz"]
FEMALE_ENDINGS = ["ová", "á", "ice", "ka"]


def recipient_type(name: Column, text: Column) -> Column:
    """company or institution by the name; else person_female or person_male by how the text addresses it, then by its ending."""
    low, who = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    addressed = lambda *forms: F.greatest(*[low.contains(F.concat(F.lit(f"{f} "), who)) for f in forms])
    female = F.greatest(*[who.endswith(e) for e in FEMALE_ENDINGS])
    return (
        F.when(count_contained(who, COMPANY_MARKS) > 0, "company")
        .when(count_contained(who, INSTITUTION_MARKS) > 0, "institution")
        .when(addressed("paní", "pani"), "person_female")
        .when(addressed("pan", "pane"), "person_male")
        .when(female, "person_female")
        .otherwise("person_male")
    )


def detect_language(text: Column, stop_words: dict[str, list[str]], marks: list[tuple[str, str]] = (), least: int = 3, default: str = "en") -> Column:
    """First language whose character class occurs, else most stop words if over ``least``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_distinct(F.split(low, r"[\x20\x09-\x0D]+"))
    scores = [F.struct(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))).alias("n"), F.lit(-k).alias("ord"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(stop_words.items())]
    best = F.array_max(F.array(*scores))
    out = F.when(best["n"] > least, best["lang"]).otherwise(default)
    for lang, chars in reversed(list(marks)):
        out = F.when(low.rlike(f"[{chars}]"), lang).otherwise(out)
    return out


def service_type(text: Column, services: list[tuple[str, list[str]]]) -> list[Column]:
    """service: the first with a keyword; service_name: the word after the keyword."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kind, after = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, ws in reversed(services):
        hit = count_contained(low, ws) > 0
        kind = F.when(hit, name).otherwise(kind)
        after = F.when(hit, F.nullif(F.regexp_extract(low, "(?:" + "|".join(ws) + r")\s+([\p{L}\p{N}]+)", 1), F.lit(""))).otherwise(after)
    return [kind.alias("service"), after.alias("service_name")]


def payment_status(text: Column) -> Column:
    """unpaid before paid, since either word contains the other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("nezaplaceno|neuhrazeno|unpaid|unbezahlt"), "unpaid").when(low.rlike("zaplaceno|uhrazeno|paid|bezahlt"), "paid").when(low.rlike("po splatnosti|overdue"), "overdue")


def currency(text: Column, default: str = "CZK") -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("€|\\beur\\b"), "EUR").when(low.rlike("\\$|\\busd\\b"), "USD").when(low.rlike("£|\\bgbp\\b"), "GBP").otherwise(default)


def suggest_tags(document_type: Column, recipient: Column, date: Column, source: Column, confidence: Column, type_tags: dict[str, str]) -> Column:
    """Tags by type, recipient, year within 2000 to 2030, source and confidence."""
    by_type = F.element_at(F.create_map(*[F.lit(x) for t in type_tags.items() for x in t]), document_type)
    year = F.year(date)
    sure = F.when(confidence >= 0.9, "high_confidence").when(confidence < 0.7, "low_confidence")
    return F.array_compact(F.array(by_type, F.when(recipient.isNotNull(), F.concat(F.lit("recipient_"), recipient)), F.when(year.between(2000, 2030), F.concat(F.lit("Rok_"), year.cast("string"))), F.when(source.isNotNull(), F.concat(F.lit("source_"), source)), sure))


def text_statement_score(text: Column, points: list[tuple[str, int]], banks: dict[str, list[str]]) -> list[Column]:
    """Additive points of a text as a bank statement, and the first bank with an alias in it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum((F.when(low.contains(w), p).otherwise(0) for w, p in points), F.lit(0))
    bank = first_match(low, [(b, a) for b, aliases in banks.items() for a in aliases])
    return [score.alias("score"), bank.alias("bank")]


def label_failures(failed: DataFrame, domains: dict[str, str]) -> DataFrame:
    """label for failures from a known device domain, null for those to pass on."""
    domain = F.element_at(F.split(F.lower("sender"), "@"), -1)
    return failed.withColumn("label", F.element_at(F.create_map(*[F.lit(x) for d in domains.items() for x in d]), domain))


def fallback_cascade(attempts: DataFrame, good: Column, fallback_order: Column) -> DataFrame:
    """The first good attempt of each document, else its best by fallback_order; attempts used.

    attempts: doc_id, attempt and whatever good and fallback_order read.
    """
    marked = attempts.withColumn("_good", good)
    own = Window.partitionBy("doc_id")
    ranked = marked.withColumn("_n", F.row_number().over(own.orderBy(F.desc("_good"), F.when(F.col("_good"), F.col("attempt")), fallback_order, "attempt"))).withColumn("_all", F.max("attempt").over(own))
    return ranked.where("_n = 1").withColumn("attempts_used", F.when(F.col("_good"), F.col("attempt")).otherwise(F.col("_all"))).withColumn("found", F.col("_good")).drop("_n", "_all", "_good")


def receipt_signals(text: Column) -> list[Column]:
    """Flags of a receipt: an id (company, VAT or fiscal) together with an amount."""
    t = F.coalesce(text, F.lit(""))
    ids = t.rlike(r"(?iu)\bI[ČC]O?[\s:]*\d{8}|\bDI[ČC][\s:]*[A-Z]{2}\d{8,10}|\b(?:FIK|BKP)\b")
    amount = t.rlike(r"(?iu)\d+[.,]\d{2}\s*(?:Kč|CZK|EUR|€)")
    return [ids.alias("has_id"), amount.alias("has_amount"), (ids & amount).alias("is_receipt")]
