"""Agreement, metrics and grids on the reviewers' and models' labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.operators import cube, evaluate
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"
# the assessment's own decision, from its evidence fields, is the prediction; the first reviewer's label is gold
_PAIR = f"""WITH {T.SQL_ASSESS}, r AS (SELECT * FROM reviewer_labels WHERE reviewer_label IN ('include', 'exclude') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY labelled_at, reviewer_id) = 1),
pair AS (SELECT document_id, reviewer_label AS gold, CASE WHEN event_connection IN ('explicit', 'supported') AND meaningful_content_present THEN 'include' ELSE 'exclude' END AS predicted, coalesce(confidence, 0) AS confidence, event_connection, primary_content_type FROM r JOIN assess USING (document_id))"""


def pairs(spark, d):
    r = T.one_per_key(T.read(spark, d, "reviewer_labels").filter(F.col("reviewer_label").isin("include", "exclude")), ["document_id"], F.col("labelled_at"), F.col("reviewer_id"))
    a = T.assessments(spark, d)
    predicted = F.when(F.col("event_connection").isin("explicit", "supported") & F.col("meaningful_content_present"), "include").otherwise("exclude")
    return r.join(a, "document_id").select("document_id", F.col("reviewer_label").alias("gold"), predicted.alias("predicted"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "event_connection", "primary_content_type")


def _labels(spark):
    return cube.dimension(spark, "label", ("include", "exclude"))


@query("class_metrics", _PAIR + """, l AS (SELECT unnest(['include', 'exclude']) AS label), c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (predicted = label) AS pr, count(*) FILTER (gold = label AND predicted = label) AS tp FROM l LEFT JOIN pair ON true GROUP BY 1)
SELECT label, support, coalesce(tp::DOUBLE / nullif(pr, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp::DOUBLE / nullif(pr + support, 0), 0) AS f1 FROM c""")
def class_metrics(spark, d):
    """Precision, recall and F1 of each label (V1)."""
    return evaluate.per_class(pairs(spark, d), "gold", "predicted", _labels(spark))


@query("confusion_matrix", _PAIR + " SELECT a.label AS gold, b.label AS predicted, count(document_id) AS n FROM (SELECT unnest(['include', 'exclude']) AS label) a CROSS JOIN (SELECT unnest(['include', 'exclude']) AS label) b LEFT JOIN pair p ON p.gold = a.label AND p.predicted = b.label GROUP BY 1, 2")
def confusion_matrix(spark, d):
    """Dense confusion counts (V2)."""
    return evaluate.confusion(pairs(spark, d), "gold", "predicted", _labels(spark))


_TWO = "WITH two AS (SELECT a.document_id, a.reviewer_id AS ra, b.reviewer_id AS rb, a.offensive AS a, b.offensive AS b FROM reviewer_labels a JOIN reviewer_labels b ON a.document_id = b.document_id AND a.reviewer_id < b.reviewer_id WHERE a.offensive IS NOT NULL AND b.offensive IS NOT NULL)"


def _two(spark, d):
    """Pairs of reviewers of one document: a document has a handful of reviewers, so this join cannot explode."""
    r = T.read(spark, d, "reviewer_labels", "document_id", "reviewer_id", "offensive").filter("offensive IS NOT NULL")
    a, b = r.select("document_id", F.col("reviewer_id").alias("ra"), F.col("offensive").alias("a")), r.select("document_id", F.col("reviewer_id").alias("rb"), F.col("offensive").alias("b"))
    return a.join(b, "document_id").filter("ra < rb")


@query("reviewer_agreement", _TWO + """, c AS (SELECT ra, rb, a, b, count(*) AS n FROM two GROUP BY ALL), t AS (SELECT ra, rb, sum(n) AS t, sum(n) FILTER (a = b) AS same FROM c GROUP BY ALL), m AS (SELECT ra, rb, sum(x.na * coalesce(y.nb, 0)) AS e FROM (SELECT ra, rb, a AS l, sum(n) AS na FROM c GROUP BY ALL) x LEFT JOIN (SELECT ra, rb, b AS l, sum(n) AS nb FROM c GROUP BY ALL) y USING (ra, rb, l) GROUP BY ALL)
SELECT ra, rb, CAST(t AS BIGINT) AS pairs, coalesce(same, 0)::DOUBLE / t AS agreement, round(CASE WHEN e::DOUBLE / t / t < 1 THEN (coalesce(same, 0)::DOUBLE / t - e::DOUBLE / t / t) / (1 - e::DOUBLE / t / t) END, 9) AS kappa, 2 * (coalesce(same, 0)::DOUBLE / t) - 1 AS pabak FROM t JOIN m USING (ra, rb)""")
def reviewer_agreement(spark, d):
    """Agreement of each pair of reviewers (V3)."""
    x = evaluate.agreement(_two(spark, d), "a", "b", ["ra", "rb"])
    return x.select("ra", "rb", "pairs", "agreement", F.round("kappa", 9).alias("kappa"), "pabak")


@query("subgroup_metrics", _PAIR + """, long AS (SELECT 'event_connection' AS dimension, event_connection AS value, * FROM pair UNION ALL SELECT 'primary_content_type', primary_content_type, * FROM pair UNION ALL SELECT 'gold', gold, * FROM pair)
SELECT dimension, value, count(*) AS n, count(*) FILTER (gold = predicted)::DOUBLE / count(*) AS accuracy, count(*) FILTER (gold = 'include') AS include_gold, count(*) FILTER (predicted = 'include') AS include_predicted FROM long GROUP BY ALL""")
def subgroup_metrics(spark, d):
    """Many dimensions in one pass, in long form (V5)."""
    hit = F.count_if(F.col("gold") == F.col("predicted"))
    return cube.unpivot_dimensions(pairs(spark, d), ["event_connection", "primary_content_type", "gold"], F.count("*").alias("n"), cube.ratio(hit, F.count("*")).alias("accuracy"), F.count_if(F.col("gold") == "include").alias("include_gold"), F.count_if(F.col("predicted") == "include").alias("include_predicted"))


@query("threshold_grid", _PAIR + """, g AS (SELECT low, high FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS low) CROSS JOIN (SELECT unnest([0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS high) WHERE low < high)
SELECT low, high, count(*) FILTER (confidence >= high AND gold = 'include') AS tp, count(*) FILTER (confidence >= high AND gold <> 'include') AS fp, count(*) FILTER (confidence < low AND gold = 'include') AS fn, count(*) FILTER (confidence < low AND gold <> 'include') AS tn, count(*) FILTER (confidence >= low AND confidence < high) AS review FROM g CROSS JOIN pair GROUP BY ALL""")
def threshold_grid(spark, d):
    """All pairs of thresholds in one pass (V8)."""
    return evaluate.threshold_grid(pairs(spark, d), F.col("confidence"), F.col("gold") == "include", [0.5, 0.6, 0.7, 0.8], [0.7, 0.8, 0.9, 0.95])


_GP = f"""{_D}, g AS (SELECT document_id, aspect, sentiment, mention_id FROM ments WHERE expression_type IN ('explicit', 'implicit')), p AS (SELECT document_id, aspect, sentiment, mention_id FROM ments WHERE expression_type <> 'implicit' AND confidence >= 0.7)"""


def _gold_predicted(spark, d):
    """Two overlapping sets of mentions stand for two annotations of the same documents."""
    m = T.mentions(spark, d, "aspect", "sentiment", "expression_type", "confidence")
    cols = ["document_id", "aspect", "sentiment", "mention_id"]
    return m.filter(F.col("expression_type").isin("explicit", "implicit")).select(*cols), m.filter((F.col("expression_type") != "implicit") & (F.col("confidence") >= 0.7)).select(*cols)


@query("mention_matching", _GP + """, gc AS (SELECT document_id, aspect, count(*) AS gold FROM g GROUP BY ALL), pc AS (SELECT document_id, aspect, count(*) AS predicted FROM p GROUP BY ALL), f AS (SELECT aspect, coalesce(gold, 0) AS gold, coalesce(predicted, 0) AS predicted, least(coalesce(gold, 0), coalesce(predicted, 0)) AS matched FROM gc FULL JOIN pc USING (document_id, aspect))
SELECT aspect, CAST(sum(matched) AS BIGINT) AS tp, CAST(sum(predicted - matched) AS BIGINT) AS fp, CAST(sum(gold - matched) AS BIGINT) AS fn, coalesce(sum(matched)::DOUBLE / nullif(sum(predicted), 0), 0) AS precision, coalesce(sum(matched)::DOUBLE / nullif(sum(gold), 0), 0) AS recall FROM f GROUP BY 1""")
def mention_matching(spark, d):
    """True and false mentions per aspect by multiset matching."""
    g, p = _gold_predicted(spark, d)
    f = evaluate.match_counts(g, p, ["document_id", "aspect"])
    a = f.groupBy("aspect").agg(F.sum("matched").alias("tp"), F.sum(F.col("predicted") - F.col("matched")).alias("fp"), F.sum(F.col("gold") - F.col("matched")).alias("fn"))
    pr, re, _ = evaluate.binary_metrics(F.col("tp"), F.col("fp"), F.col("fn"))
    return a.select("aspect", "tp", "fp", "fn", pr.alias("precision"), re.alias("recall"))


@query("matched_sentiment", _GP + """, gr AS (SELECT *, row_number() OVER (PARTITION BY document_id, aspect ORDER BY mention_id) AS k FROM g), pr AS (SELECT *, row_number() OVER (PARTITION BY document_id, aspect ORDER BY mention_id) AS k FROM p)
SELECT gr.aspect, count(*) AS matched, count(*) FILTER (gr.sentiment = pr.sentiment) AS same_sentiment FROM gr JOIN pr ON gr.document_id = pr.document_id AND gr.aspect = pr.aspect AND gr.k = pr.k GROUP BY 1""")
def matched_sentiment(spark, d):
    """Sentiment of the matched mentions."""
    g, p = _gold_predicted(spark, d)
    j = evaluate.match_ordinal(g, p, ["document_id", "aspect"], "mention_id").filter("mention_id IS NOT NULL AND p_mention_id IS NOT NULL")
    return j.groupBy("aspect").agg(F.count("*").alias("matched"), F.count_if(F.col("sentiment") == F.col("p_sentiment")).alias("same_sentiment"))


@query("aspect_set_overlap", _GP + """, gs AS (SELECT document_id, list(DISTINCT aspect) AS a FROM g GROUP BY 1), ps AS (SELECT document_id, list(DISTINCT aspect) AS b FROM p GROUP BY 1), j AS (SELECT c.document_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM caps c LEFT JOIN gs USING (document_id) LEFT JOIN ps USING (document_id))
SELECT count(*) AS documents, count(*) FILTER (len(a) = 0 AND len(b) = 0) AS both_empty, count(*) FILTER ((len(a) = 0) = (len(b) = 0))::DOUBLE / count(*) AS zero_agreement, round(avg(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END), 9) AS mean_jaccard FROM j""")
def aspect_set_overlap(spark, d):
    """Sets of aspects per document, documents without any included."""
    g, p = _gold_predicted(spark, d)
    s = lambda x, n: x.groupBy("document_id").agg(F.collect_set("aspect").alias(n))  # noqa: E731  (at most as many as there are aspects)
    none = F.array().cast("array<string>")
    j = T.captions(spark, d).select("document_id").join(s(g, "a"), "document_id", "left").join(s(p, "b"), "document_id", "left").select(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    na, nb, both = F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b"))
    return j.agg(F.count("*").alias("documents"), F.count_if((na == 0) & (nb == 0)).alias("both_empty"), cube.ratio(F.count_if((na == 0) == (nb == 0)), F.count("*")).alias("zero_agreement"), F.round(F.avg(F.when(na + nb == 0, 1.0).otherwise(both / F.nullif(na + nb - both, F.lit(0)).cast("double"))), 9).alias("mean_jaccard"))


@query("confidence_interval")
def confidence_interval(spark, d):
    """Bootstrap interval of the assessments' mean confidence (V6)."""
    a = T.assessments(spark, d).filter("confidence IS NOT NULL")
    return evaluate.bootstrap(a, F.col("confidence"), "document_id")
