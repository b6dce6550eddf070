"""Queries of classification (C*) over the corpus, with rules over words that occur in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import classify as O
from .base import ARCHIVE, RULES_SQL, WORD_RULES, archive, table, texts, word_rules
from .registry import query

WITH = f"WITH {ARCHIVE} "
SCORES = f"WITH {RULES_SQL}, scores AS (SELECT doc_id, label, ord, count(*) AS hits FROM documents JOIN rules ON contains(lower(text), pattern) GROUP BY ALL), best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) = 1) "


@query("c1_keyword_scores", SCORES + "SELECT doc_id, label, hits FROM scores")
def _(s, d):
    return O.keyword_scores(texts(s, d), word_rules(s)).select("doc_id", "label", "hits")


#: More rules than an expression takes: every pair of letters at a word's beginning, by its first letter.
MANY = "rules AS (SELECT chr(97 + i::INT) AS label, i::INT AS ord, ' ' || chr(97 + i::INT) || chr(97 + j::INT) AS pattern FROM range(26) a(i), range(26) b(j)), hits AS (SELECT doc_id, label, ord, count(*) AS hits FROM documents, rules WHERE contains(lower(text), pattern) GROUP BY ALL) "


def many_rules(s):
    from foliant.operators.rules import rules_table

    return rules_table(s, [("keyword", chr(97 + i), i, f" {chr(97 + i)}{chr(97 + j)}", 1.0) for i in range(26) for j in range(26)])


@query("c1_scores_of_many_rules", "WITH " + MANY + "SELECT doc_id, label, ord, 26 AS n_rules, hits FROM hits")
def _(s, d):
    return O.keyword_scores(texts(s, d), many_rules(s))


@query("c2_ratio_of_many_rules", "WITH " + MANY + ", best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) = 1) SELECT doc_id, coalesce(label, 'other') AS label, coalesce(hits / 26.0, 0.3)::DOUBLE AS confidence FROM documents LEFT JOIN best USING (doc_id)")
def _(s, d):
    return O.classify_keywords(texts(s, d), many_rules(s), "ratio")


@query("c2_classify_ratio", SCORES + "SELECT doc_id, coalesce(label, 'other') AS label, coalesce(hits / 5.0, 0.3)::DOUBLE AS confidence FROM documents LEFT JOIN best USING (doc_id)")
def _(s, d):
    return O.classify_keywords(texts(s, d), word_rules(s), "ratio")


TIERED = SCORES + "SELECT doc_id, coalesce(label, 'other') AS label, CASE WHEN hits >= 3 THEN 0.85 WHEN hits = 2 THEN 0.7 WHEN hits = 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence FROM documents LEFT JOIN best USING (doc_id)"


@query("c3_classify_tiered", TIERED)
def _(s, d):
    return O.classify_keywords(texts(s, d), word_rules(s), "tiered")


@query("c3_matched_keywords", f"WITH {RULES_SQL} SELECT doc_id, coalesce((SELECT string_agg(trim(pattern), ',' ORDER BY ord, label, pattern) FROM rules WHERE contains(lower(text), pattern)), '') AS keywords FROM documents")
def _(s, d):
    return O.matched_keywords(texts(s, d), word_rules(s)).select("doc_id", F.array_join(F.transform("keywords", lambda x: F.trim(x)), ",").alias("keywords"))


@query(
    "c4_regex_counts",
    f"""WITH {RULES_SQL}, n AS (SELECT doc_id, label, ord, least(95, 10 * sum(len(regexp_extract_all(lower(text), pattern))))::INT AS score FROM documents, rules GROUP BY ALL)
    SELECT doc_id, CASE WHEN score >= 30 THEN label ELSE 'other' END AS label, CASE WHEN score = 0 THEN 50 ELSE score END AS score FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1""",
)
def _(s, d):
    return O.classify_regex_counts(texts(s, d), word_rules(s))


CARDS = {
    "table": {"keywords": [r"\|"], "required": [r"\|[^|]+\|", "token", "@"], "bonus": ["the", "que"], "negative": ["!!"], "base": 60},
    "shout": {"keywords": ["!!"], "required": [], "bonus": ["THE", "und"], "negative": [r"\|"], "base": 80},
    "licensed": {"keywords": ["licensed under"], "required": ["license", "version"], "bonus": ["apache", "gnu"], "negative": [], "base": 100},
}


@query(
    "c5_scorecard",
    r"""WITH p AS (SELECT doc_id, lower(text) AS t, contains(text, '|')::INT AS bar, contains(text, '!!')::INT AS bang FROM documents),
    s AS (SELECT doc_id, unnest([
      {'label': 'table', 'ord': 0, 'score': 60 * bar + floor(50 * (regexp_matches(t, '\|[^|]+\|')::INT + contains(t, 'token')::INT + contains(t, '@')::INT) / 3)::INT + 5 * (contains(t, 'the')::INT + contains(t, 'que')::INT) - 50 * bang},
      {'label': 'shout', 'ord': 1, 'score': 80 * bang + 5 * (contains(t, 'the')::INT + contains(t, 'und')::INT) - 50 * bar},
      {'label': 'licensed', 'ord': 2, 'score': 100 * contains(t, 'licensed under')::INT + floor(50 * (contains(t, 'license')::INT + contains(t, 'version')::INT) / 2)::INT + 5 * (contains(t, 'apache')::INT + contains(t, 'gnu')::INT)}], recursive := true) FROM p),
    r AS (SELECT doc_id, label, least(200, score) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY least(200, score) DESC, ord) AS n FROM s WHERE score > 0),
    g AS (SELECT doc_id, max(CASE WHEN n = 1 THEN label END) AS label, max(CASE WHEN n = 1 THEN score END) AS score, string_agg(label || ':' || score, ',' ORDER BY n) AS candidates FROM r WHERE n <= 3 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN score >= 50 THEN label ELSE 'unknown' END AS label, CASE WHEN score >= 50 THEN score ELSE 0 END AS score, coalesce(candidates, '') AS candidates FROM documents LEFT JOIN g USING (doc_id)""",
)
def _(s, d):
    return O.scorecard(texts(s, d), CARDS)


@query("c6_confidence_level", "SELECT doc_id, CASE WHEN n_chars >= 1500 THEN 'VERY_HIGH' WHEN n_chars >= 1000 THEN 'HIGH' WHEN n_chars >= 700 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", O.confidence_level(F.col("n_chars") / 10).alias("level"))


ADS, AD_PATTERNS = ["worthless", "stupid", "token", "!!", "the ", "que "], [r"\$\$\$", r"!!\s", r"\d{4}"]


@query(
    "c7_detect_ads",
    r"""WITH p AS (SELECT doc_id, lower(text) AS t FROM documents), q AS (SELECT doc_id, least(1.0, (0.6 * (contains(t, 'worthless')::INT + contains(t, 'stupid')::INT + contains(t, 'token')::INT + contains(t, '!!')::INT + contains(t, 'the ')::INT + contains(t, 'que ')::INT)
    + 0.4 * (contains(t, '$$$')::INT + regexp_matches(t, '!!\s')::INT + regexp_matches(t, '[0-9]{4}')::INT)) / 5) AS score FROM p) SELECT doc_id, round(score, 6)::DOUBLE AS score, score > 0.5 AS is_ad FROM q""",
)
def _(s, d):
    found = texts(s, d).select("doc_id", O.detect_ads(F.col("text"), ADS, AD_PATTERNS).alias("a"))
    return found.select("doc_id", F.round("a.score", 6).alias("score"), "a.is_ad")


@query(
    "c8_ad_features",
    r"SELECT doc_id, contains(lower(text), 'stupid') AS has_unsubscribe, contains(lower(text), '%%%') AS has_discount, contains(lower(text), '!!') AS has_call, try_cast(nullif(regexp_extract(lower(text), '([0-9]{1,3})\s*%', 1), '') AS INT) AS percent FROM documents",
)
def _(s, d):
    return texts(s, d).select("doc_id", *O.ad_features(F.col("text"), ["stupid"], ["%%%"], ["!!"]))


@query(
    "c9_detect_legal",
    "WITH p AS (SELECT doc_id, lower(text) AS t FROM documents), q AS (SELECT doc_id, contains(t, 'gnu') AS court, least(1.0, (0.4 * (contains(t, 'license')::INT + contains(t, 'version')::INT) + 0.3 * regexp_matches(t, 'version [0-9]')::INT + 0.3 * contains(t, 'gnu')::INT) / 3) AS score FROM p) SELECT doc_id, round(score, 6)::DOUBLE AS score, score > 0.5 OR court AS is_legal FROM q",
)
def _(s, d):
    found = texts(s, d).select("doc_id", O.detect_legal(F.col("text"), ["license", "version"], ["version [0-9]"], ["gnu"]).alias("a"))
    return found.select("doc_id", F.round("a.score", 6).alias("score"), "a.is_legal")


@query(
    "c10_legal_features",
    WITH + "SELECT doc_id, doc_id % 100 || ' C ' || doc_id % 1000 || '/2024' AS case_number, '§ ' || doc_id % 90 || ';§ 12' AS paragraphs, CASE WHEN doc_id % 2 = 0 THEN 'judgment' ELSE 'summons' END AS subtype FROM archive",
)
def _(s, d):
    letter = archive(s, d).select("doc_id", F.expr("concat('Case ', doc_id % 100, ' C ', doc_id % 1000, '/2024 under § ', doc_id % 90, ' and § 12: ', if(doc_id % 2 = 0, 'Judgment', 'Summons'))").alias("text"))
    return letter.select("doc_id", *O.legal_features(F.col("text"), [("judgment", "judgment"), ("summons", "summons")]))


@query("c11_pre_classify", WITH + "SELECT doc_id, CASE WHEN contains(sender, '@d1.') THEN 'bank' WHEN contains(sender, '@d2.') THEN 'shop' WHEN contains(subject, 'Order 4') THEN 'order' END AS label FROM archive")
def _(s, d):
    return archive(s, d).select("doc_id", O.pre_classify([(F.col("sender"), [("bank", "@d1."), ("shop", "@d2.")]), (F.col("subject"), [("order", "order 4")])]).alias("label"))


@query("c12_force_classify", "SELECT doc_id, CASE WHEN source <> 'src1' THEN source WHEN contains(lower(text), 'stupid') THEN 'insult' WHEN contains(lower(text), 'token') OR contains(lower(text), 'license') THEN 'secret' ELSE 'correspondence' END AS label FROM documents")
def _(s, d):
    return texts(s, d).select("doc_id", O.force_classify(F.col("source"), F.col("text"), [("insult", ["stupid"]), ("secret", ["token", "license"])], other="src1").alias("label"))


@query("c13_first_match", "SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), 'license') THEN 'licence' WHEN contains(lower(text), '|') THEN 'table' ELSE 'other' END AS label FROM documents")
def _(s, d):
    from foliant.operators.rules import first_match

    return texts(s, d).select("doc_id", first_match(F.col("lower_text"), [("secret", "token"), ("licence", "license"), ("table", "|")], "other").alias("label"))


VOTES = f"""WITH {ARCHIVE}, votes AS (SELECT doc_id, 'ml' AS method, 0 AS ordinal, document_type AS label, coalesce(ai_confidence, 0.5) AS confidence FROM archive
  UNION ALL SELECT doc_id, 'llm', 1, CASE WHEN doc_id % 3 = 0 THEN 'order' ELSE document_type END, coalesce(ocr_confidence, 0.5) FROM archive
  UNION ALL SELECT doc_id, 'keyword', 2, CASE WHEN doc_id % 5 = 0 THEN 'advert' WHEN doc_id % 4 = 0 THEN 'receipt' ELSE document_type END, 0.5 FROM archive WHERE doc_id % 7 <> 0) """


def votes(s, d):
    a = archive(s, d)
    ml = a.selectExpr("doc_id", "'ml' AS method", "0 AS ordinal", "document_type AS label", "coalesce(ai_confidence, 0.5D) AS confidence")
    llm = a.selectExpr("doc_id", "'llm' AS method", "1 AS ordinal", "if(doc_id % 3 = 0, 'order', document_type) AS label", "coalesce(ocr_confidence, 0.5D) AS confidence")
    kw = a.where("doc_id % 7 <> 0").selectExpr("doc_id", "'keyword' AS method", "2 AS ordinal", "CASE WHEN doc_id % 5 = 0 THEN 'advert' WHEN doc_id % 4 = 0 THEN 'receipt' ELSE document_type END AS label", "0.5D AS confidence")
    return ml.unionByName(llm).unionByName(kw)


ENSEMBLE = VOTES + """, per AS (SELECT doc_id, label, least(1.0, CASE WHEN label = 'advert' THEN max(confidence) ELSE avg(confidence * CASE method WHEN 'ml' THEN 1.5 WHEN 'llm' THEN 1.3 ELSE 1.0 END) END) AS score, count(*) AS agreeing FROM votes GROUP BY doc_id, label),
  best AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (label = 'advert') DESC, round(score, 9) DESC, label) = 1) """
WEIGHTS = {"ml": 1.5, "llm": 1.3, "keyword": 1.0}


@query("c16_ensemble_vote", ENSEMBLE + "SELECT doc_id, label, round(score, 6)::DOUBLE AS confidence, agreeing FROM best")
def _(s, d):
    return O.ensemble_vote(votes(s, d), WEIGHTS).withColumn("confidence", F.round("confidence", 6))


@query("c17_agreement_boost", ENSEMBLE + "SELECT doc_id, round(least(1.0, score * (1 + 0.1 * (agreeing - 1))), 6)::DOUBLE AS confidence FROM best")
def _(s, d):
    return O.ensemble_vote(votes(s, d), WEIGHTS).select("doc_id", F.round(O.agreement_boost(F.col("confidence"), F.col("agreeing")), 6).alias("confidence"))


@query("c18_allowlist_boost", WITH + "SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN least(1.0, coalesce(ai_confidence, 0) + CASE WHEN document_type = 'order' AND NOT contains(subject, '1') OR document_type = 'delivery_note' AND NOT contains(subject, '2') AND NOT contains(subject, '3') THEN 0.05 ELSE 0.15 END) ELSE coalesce(ai_confidence, 0) END, 6)::DOUBLE AS confidence FROM archive")
def _(s, d):
    c = O.allowlist_boost(F.coalesce("ai_confidence", F.lit(0.0)), F.col("doc_id") % 2 == 0, F.col("document_type"), F.col("subject"), ["1"], ["2"], ["3"])
    return archive(s, d).select("doc_id", F.round(c, 6).alias("confidence"))


CONTEXT = WITH + """, sn AS (SELECT sender, document_type, count(*) AS n FROM archive WHERE sender IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), sb AS (SELECT subject, document_type, count(*) AS n FROM archive GROUP BY ALL HAVING count(*) >= 2),
  th AS (SELECT document_type, greatest(avg(ai_confidence) - 0.1, 0.5) AS threshold FROM archive WHERE ai_confidence IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY sender) AS share FROM sn) """


@query("c19_sender_stats", CONTEXT + "SELECT sender, document_type, n FROM sn")
def _(s, d):
    return O.learn_context(archive(s, d))[0]


@query("c19_subject_stats", CONTEXT + "SELECT subject, document_type, n FROM sb")
def _(s, d):
    return O.learn_context(archive(s, d))[1]


@query("c19_thresholds", CONTEXT + "SELECT document_type, round(threshold, 6) AS threshold FROM th")
def _(s, d):
    return O.learn_context(archive(s, d))[2].withColumn("threshold", F.round("threshold", 6))


@query(
    "c20_apply_context",
    CONTEXT + """, b AS (SELECT doc_id, round(least(1.0, coalesce(ai_confidence, 0) + CASE WHEN share > 0.8 THEN 0.15 WHEN share > 0.5 THEN 0.1 WHEN share > 0.3 THEN 0.05 ELSE 0 END + CASE WHEN sb.n IS NOT NULL THEN 0.1 ELSE 0 END), 6)::DOUBLE AS boosted, coalesce(ai_confidence, 0) < coalesce(threshold, 0.6) AS below
    FROM archive LEFT JOIN sh USING (sender, document_type) LEFT JOIN sb USING (subject, document_type) LEFT JOIN th USING (document_type)) SELECT doc_id, boosted, below FROM b""",
)
def _(s, d):
    a = archive(s, d)
    return O.apply_context(a, *O.learn_context(a)).select("doc_id", F.round("boosted", 6).alias("boosted"), "below")


@query("c21_suggest_alternative", CONTEXT + "SELECT doc_id, t.document_type AS suggestion, round(share, 6) AS share FROM archive JOIN (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY sender ORDER BY n DESC, document_type) = 1) t USING (sender) WHERE coalesce(ai_confidence, 0) < 0.7")
def _(s, d):
    a = archive(s, d)
    return O.suggest_alternative(a, O.learn_context(a)[0]).withColumn("share", F.round("share", 6))


@query("c22_context_stats", CONTEXT + "SELECT (SELECT count(DISTINCT sender) FROM sn) AS senders, (SELECT count(DISTINCT subject) FROM sb) AS subjects")
def _(s, d):
    senders, subjects, _ = O.learn_context(archive(s, d))
    return O.context_stats(senders, subjects)


@query("c22_sender_types", CONTEXT + "SELECT sender, sum(n)::BIGINT AS n, string_agg(document_type || ':' || n, ',' ORDER BY document_type) AS types FROM sn GROUP BY sender ORDER BY sum(n) DESC, sender LIMIT 10")
def _(s, d):
    top = O.sender_types(O.learn_context(archive(s, d))[0])
    return top.select("sender", "n", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("types"))


@query("c23_method_weights", WITH + ", m AS (SELECT document_type, avg(CASE WHEN ai_confidence >= 0.9 THEN ai_confidence END) AS m FROM archive GROUP BY ALL) SELECT document_type, CASE WHEN m > 0.95 THEN 0.9 WHEN m > 0.85 OR m IS NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS ai, CASE WHEN m > 0.95 THEN 0.05 WHEN m > 0.85 OR m IS NULL THEN 0.2 ELSE 0.3 END::DOUBLE AS keywords, CASE WHEN m > 0.95 THEN 0.05 WHEN m > 0.85 OR m IS NULL THEN 0.1 ELSE 0.2 END::DOUBLE AS ml FROM m")
def _(s, d):
    return O.method_weights(archive(s, d), 0.9)


@query(
    "c24_vote_consensus",
    VOTES + """, per AS (SELECT doc_id, label, count(*) AS n, min(ordinal) AS f FROM votes GROUP BY ALL), best AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS a FROM per QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)
    SELECT doc_id, CASE WHEN n IS NULL OR length(text) < 50 THEN 'OTHER' ELSE label END AS label, CASE WHEN n IS NULL OR length(text) < 50 THEN 0 ELSE round(n / a, 6) END::DOUBLE AS confidence, coalesce(length(text) >= 50 AND n >= 2, false) AS consensus FROM documents LEFT JOIN best USING (doc_id)""",
)
def _(s, d):
    return O.vote_consensus(texts(s, d), votes(s, d)).withColumn("confidence", F.round("confidence", 6))


@query("c25_resolve_escalation", WITH + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN (CASE WHEN doc_id % 5 = 0 THEN 'OTHER' ELSE 'order' END) WHEN doc_id % 3 = 0 THEN 'OTHER' ELSE document_type END AS label, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN (CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.8 END) ELSE ai_confidence END::DOUBLE AS confidence FROM archive")
def _(s, d):
    a = archive(s, d)
    fast = a.selectExpr("doc_id", "if(doc_id % 3 = 0, 'OTHER', document_type) AS label", "ai_confidence AS confidence")
    return O.resolve_escalation(fast, a.where("doc_id % 2 = 0").selectExpr("doc_id", "if(doc_id % 5 = 0, 'OTHER', 'order') AS label"))


@query(
    "c26_count_consensus",
    """WITH e AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS m, count(*) AS item_count, l_suppkey % 3 = 2 AND l_orderkey % 4 = 0 AS failed FROM lineitem GROUP BY ALL), g AS (SELECT doc_id, item_count, count(*) AS agreeing FROM e WHERE NOT failed GROUP BY ALL),
    b AS (SELECT *, sum(agreeing) OVER (PARTITION BY doc_id) AS models FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY agreeing DESC, item_count DESC) = 1)
    SELECT doc_id, item_count, coalesce(agreeing, 0) AS agreeing, round(coalesce(agreeing / models, 0), 6) AS strength, CASE WHEN agreeing = models THEN 'perfect' WHEN agreeing / models >= 0.5 THEN 'partial' ELSE 'none' END AS level, coalesce(CASE WHEN models <= 2 THEN agreeing = models ELSE agreeing >= 2 END, false) AS accepted FROM (SELECT DISTINCT doc_id FROM e) LEFT JOIN b USING (doc_id)""",
)
def _(s, d):
    e = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("m")).agg(F.count("*").alias("item_count")).withColumn("failed", F.expr("m = 2 AND doc_id % 4 = 0"))
    return O.count_consensus(e).withColumn("strength", F.round("strength", 6))


@query("c27_item_type", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'blue') THEN 'service' ELSE 'goods' END AS item_type FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", O.item_type(F.col("p_name"), ["ring", "blue"], []).alias("item_type"))


@query("c28_overall_item_type", "SELECT o_orderkey AS doc_id, coalesce((SELECT CASE WHEN count(*) = 0 THEN 'mixed' WHEN bool_and(l_returnflag = 'A') THEN 'service' WHEN bool_and(l_returnflag <> 'A') THEN 'goods' ELSE 'mixed' END FROM lineitem WHERE l_orderkey = o_orderkey), 'mixed') AS item_type FROM orders")
def _(s, d):
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "service").otherwise("goods").alias("item_type"))
    return O.overall_item_type(table(s, d, "orders").selectExpr("o_orderkey AS doc_id"), items)


@query("c29_direction", WITH + ", p AS (SELECT doc_id, contains(subject, '1')::INT + contains(subject, '2')::INT + CASE WHEN coalesce(contains(sender, '@d3.'), false) THEN 2 ELSE 0 END AS plus, contains(subject, '3')::INT + CASE WHEN coalesce(contains(sender, '@d3.'), false) THEN 0 ELSE 1 END AS minus FROM archive) SELECT doc_id, CASE WHEN plus > minus THEN 'income' WHEN minus > plus THEN 'expense' ELSE 'unknown' END AS direction FROM p")
def _(s, d):
    return archive(s, d).select("doc_id", O.direction(F.col("subject"), F.col("sender"), ["1", "2"], ["3"], ["d3.example.com"]).alias("direction"))


@query("c30_subtype", WITH + "SELECT doc_id, CASE document_type WHEN 'invoice' THEN CASE WHEN doc_id % 4 = 0 THEN 'advance_invoice' WHEN doc_id % 4 = 1 THEN 'credit_note' WHEN doc_id % 2 = 0 THEN 'issued_invoice' ELSE 'received_invoice' END WHEN 'receipt' THEN CASE WHEN doc_id % 4 = 2 THEN 'fuel_receipt' ELSE 'receipt' END WHEN 'order' THEN CASE WHEN doc_id % 2 = 0 THEN 'received_order' ELSE 'issued_order' END END AS subtype FROM archive")
def _(s, d):
    text = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Proforma' WHEN 1 THEN 'Credit note' WHEN 2 THEN 'Diesel 20 l' ELSE 'Plain' END")
    return archive(s, d).select("doc_id", O.subtype(F.col("document_type"), F.when(F.col("doc_id") % 2 == 0, "income").otherwise("expense"), text).alias("subtype"))


@query("c31_expense_category", "WITH c AS (SELECT doc_id, contains(lower(text), 'stupid')::INT + contains(lower(text), 'worthless')::INT AS a, contains(lower(text), 'token')::INT + contains(lower(text), '@mail')::INT AS b FROM documents) SELECT doc_id, CASE WHEN a >= b AND a > 0 THEN 'fun' WHEN b > 0 THEN 'it' ELSE 'other' END AS category FROM c")
def _(s, d):
    return texts(s, d).select("doc_id", O.expense_category(F.col("text"), {"fun": ["stupid", "worthless"], "it": ["token", "@mail"]}).alias("category"))


@query("c32_recipient_type", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'company' WHEN 1 THEN 'institution' WHEN 2 THEN 'person_female' WHEN 3 THEN 'person_male' WHEN 4 THEN 'person_female' ELSE 'person_male' END AS recipient FROM customer")
def _(s, d):
    name = F.expr("CASE c_custkey % 6 WHEN 0 THEN concat(c_name, ' s.r.o.') WHEN 1 THEN concat('Úřad ', c_name) WHEN 3 THEN concat(c_name, ' Svoboda-Hrůza á') WHEN 4 THEN concat(c_name, ' Nováková') ELSE c_name END")
    text = F.expr("CASE c_custkey % 6 WHEN 2 THEN concat('Pro paní ', c_name, ',') WHEN 3 THEN concat('Vážený pane ', c_name, ' Svoboda-Hrůza á,') ELSE 'Vážená paní, vážený pane,' END")
    return table(s, d, "customer").select("c_custkey", O.recipient_type(name, text).alias("recipient"))


STOP = {"en": ["the", "and", "that", "with", "of"], "fr": ["les", "que", "pour", "des", "la"], "de": ["und", "der", "die", "nicht", "von"], "es": ["los", "con", "del", "por", "las"]}


@query(
    "c33_detect_language",
    "WITH w AS (SELECT doc_id, text, list_distinct(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+')) AS w FROM documents), n AS (SELECT doc_id, text, "
    + ", ".join(f"len(list_intersect(w, {ws!r})) AS {k}" for k, ws in STOP.items())
    + " FROM w) SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[ßäü]') THEN 'de' WHEN regexp_matches(lower(text), '[ñ]') THEN 'es' WHEN greatest(en, fr, de, es) <= 3 THEN 'en' WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS language FROM n",
)
def _(s, d):
    return texts(s, d).select("doc_id", O.detect_language(F.col("text"), STOP, [("de", "ßäü"), ("es", "ñ")]).alias("language"))


@query("c34_service_type", WITH + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hosting' WHEN doc_id % 3 = 1 THEN 'energy' END AS service, CASE WHEN doc_id % 3 < 2 THEN 'plan' || doc_id % 10 END AS service_name FROM archive")
def _(s, d):
    text = F.expr("concat('Your ', CASE doc_id % 3 WHEN 0 THEN 'hosting' WHEN 1 THEN 'power' ELSE 'other' END, ' Plan', doc_id % 10, ' is due')")
    return archive(s, d).select("doc_id", *O.service_type(text, [("hosting", ["hosting", "domain"]), ("energy", ["power", "gas"])]))


@query("c35_payment_and_currency", WITH + "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unpaid' WHEN 1 THEN 'paid' WHEN 2 THEN 'overdue' END AS payment_status, CASE doc_id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'CZK' END AS currency FROM archive")
def _(s, d):
    text = F.expr("concat(CASE doc_id % 4 WHEN 0 THEN 'NEZAPLACENO' WHEN 1 THEN 'Paid' WHEN 2 THEN 'overdue' ELSE '-' END, ' 10 ', CASE doc_id % 3 WHEN 0 THEN '€' WHEN 1 THEN 'USD' ELSE 'Kč' END)")
    return archive(s, d).select("doc_id", O.payment_status(text).alias("payment_status"), O.currency(text).alias("currency"))


@query("c36_suggest_tags", WITH + "SELECT doc_id, concat_ws(',', CASE document_type WHEN 'invoice' THEN 'accounting' WHEN 'receipt' THEN 'costs' END, 'recipient_' || o_orderstatus, CASE WHEN year(created_at) BETWEEN 2000 AND 2030 THEN 'Rok_' || year(created_at) END, 'source_mail', CASE WHEN ai_confidence >= 0.9 THEN 'high_confidence' WHEN ai_confidence < 0.7 THEN 'low_confidence' END) AS tags FROM archive")
def _(s, d):
    tags = O.suggest_tags(F.col("document_type"), F.col("o_orderstatus"), F.col("created_at"), F.lit("mail"), F.col("ai_confidence"), {"invoice": "accounting", "receipt": "costs"})
    return archive(s, d).select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("c37_statement_score", "SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 30 ELSE 0 END + CASE WHEN contains(lower(text), '@mail') THEN 20 ELSE 0 END + CASE WHEN contains(lower(text), '|') THEN 10 ELSE 0 END AS score, CASE WHEN contains(lower(text), '@mail1.') OR contains(lower(text), '@mail2.') THEN 'first' WHEN contains(lower(text), '@mail5.') THEN 'second' END AS bank FROM documents")
def _(s, d):
    return texts(s, d).select("doc_id", *O.text_statement_score(F.col("text"), [("token", 30), ("@mail", 20), ("|", 10)], {"first": ["@mail1.", "@mail2."], "second": ["@mail5."]}))


@query("c38_label_failures", WITH + "SELECT doc_id, CASE WHEN contains(sender, '@d4.') THEN 'device_report' END AS label FROM archive WHERE NOT confirmed")
def _(s, d):
    return O.label_failures(archive(s, d).where("not confirmed"), {"d4.example.com": "device_report"}).select("doc_id", "label")


@query(
    "c39_fallback_cascade",
    "WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS attempt, l_quantity AS conf, l_quantity >= 40 AS good FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1), r AS (SELECT *, max(attempt) OVER (PARTITION BY doc_id) AS a FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY good DESC, CASE WHEN good THEN attempt END, conf DESC, attempt) = 1) SELECT doc_id, attempt, good AS found, CASE WHEN good THEN attempt ELSE a END AS attempts_used FROM r",
)
def _(s, d):
    from pyspark.sql.window import Window

    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    a = table(s, d, "lineitem").withColumn("n", F.row_number().over(one)).where("n = 1").selectExpr("l_orderkey AS doc_id", "l_linenumber AS attempt", "l_quantity AS conf")
    return O.fallback_cascade(a, F.col("conf") >= 40, F.desc("conf")).select("doc_id", "attempt", "found", "attempts_used")


@query("c40_receipt_signals", WITH + "SELECT doc_id, doc_id % 2 = 0 AS has_id, doc_id % 3 = 0 AS has_amount, doc_id % 6 = 0 AS is_receipt FROM archive")
def _(s, d):
    text = F.expr("concat(if(doc_id % 2 = 0, 'IČO: 12345678 ', 'Shop '), if(doc_id % 3 = 0, 'celkem 12,50 Kč', 'celkem nic'))")
    return archive(s, d).select("doc_id", *O.receipt_signals(text))
