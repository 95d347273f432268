"""Reports and the samples behind them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.operators import cube, evaluate, sampling
from lumenloom.plans import language
from lumenloom.plans import review as R
from lumenloom.plans.evaluation import _PAIR, pairs
from lumenloom.plans.statistics import _CELLS, cells, pairwise_years
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}, {T.SQL_ASSESS}"
CORE = ("English", "Malay", "Indonesian", "Chinese", "Tamil")
_CORE = ", ".join(repr(x) for x in CORE)


@query("accepted_components", language._COMP + f", j AS (SELECT comp.*, c.primary_language AS given FROM comp LEFT JOIN caps c USING (document_id)) SELECT document_id, language, CASE WHEN language IN ({_CORE}) THEN confidence >= 0.2 OR coalesce(language = given, FALSE) ELSE letters >= 20 AND confidence >= 0.65 AND coalesce(language = given, FALSE) END AS accepted FROM j")
def accepted_components(spark, d):
    """Which languages of a document count: core ones from a low score on, others only with length, a high score and a second witness (L4)."""
    j = language._components(spark, d).join(T.captions(spark, d, "primary_language").select("document_id", "primary_language"), "document_id", "left")
    agrees = F.coalesce(F.col("language") == F.col("primary_language"), F.lit(False))
    ok = F.when(F.col("language").isin(*CORE), (F.col("confidence") >= 0.2) | agrees).otherwise((F.col("letters") >= 20) & (F.col("confidence") >= 0.65) & agrees)
    return j.select("document_id", "language", ok.alias("accepted"))


@query("crosswalk_rules", f"{_D}, c AS (SELECT event_connection AS old, primary_content_type AS new, count(*) AS n FROM assess GROUP BY ALL), m AS (SELECT new, max(n)::DOUBLE / sum(n) AS lead FROM c GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (lead >= 0.8) AS at_least_80, count(*) FILTER (lead >= 0.5) AS at_least_50, round(median(lead), 9) AS median_lead FROM m")
def crosswalk_rules(spark, d):
    """How many groups come from one old group for the most part (A22): one row per group."""
    c = T.assessments(spark, d).groupBy(F.col("event_connection").alias("old"), F.col("primary_content_type").alias("new")).agg(F.count("*").alias("n"))
    m = c.groupBy("new").agg(cube.ratio(F.max("n"), F.sum("n")).alias("lead"))
    return m.agg(F.count("*").alias("groups"), F.count_if(F.col("lead") >= 0.8).alias("at_least_80"), F.count_if(F.col("lead") >= 0.5).alias("at_least_50"), F.round(F.median("lead"), 9).alias("median_lead"))


def contingency(df: DataFrame, a: str, b: str) -> tuple[list[list[int]], list, list]:
    """Counts of two groupings on the driver; groupings are bounded label sets, not rows."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).collect()
    la, lb = sorted({r[a] for r in rows}), sorted({r[b] for r in rows})
    have = {(r[a], r[b]): r["n"] for r in rows}
    return [[have.get((x, y), 0) for y in lb] for x in la], la, lb


def adjusted_information(table: list[list[int]]) -> float:
    """Adjusted mutual information of a table of counts (A27): what two groupings share beyond chance, over the mean of their entropies beyond chance."""
    n = sum(map(sum, table))
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    entropy = lambda v: -sum(x / n * math.log(x / n) for x in v if x)
    mutual = sum(x / n * math.log(x * n / (rows[i] * cols[j])) for i, r in enumerate(table) for j, x in enumerate(r) if x)
    lg = [math.lgamma(k + 1) for k in range(n + 1)]
    expected = 0.0
    for a in rows:
        for b in cols:
            for k in range(max(1, a + b - n), min(a, b) + 1):
                chance = lg[a] + lg[b] + lg[n - a] + lg[n - b] - lg[n] - lg[k] - lg[a - k] - lg[b - k] - lg[n - a - b + k]
                expected += k / n * math.log(n * k / (a * b)) * math.exp(chance)
    top = (entropy(rows) + entropy(cols)) / 2
    return 1.0 if abs(top - expected) < 1e-15 else (mutual - expected) / (top - expected)


def best_matching(table: list[list[int]]) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the largest total (A27), by shortest augmenting paths with potentials; tables of labels are small."""
    n, m = len(table), len(table[0]) if table else 0
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in best_matching([list(c) for c in zip(*table, strict=True)]))
    top = max(map(max, table))
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, way, done = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at] = True
            row, delta, step = owner[at], math.inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = top - table[row - 1][j - 1] - u[row] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, at
                    if least[j] < delta:
                        delta, step = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = step
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


@query("grouping_information")
def grouping_information(spark, d):
    """Adjusted mutual information of two groupings, and the share of rows that the best one-to-one matching of their labels keeps."""
    table, _, _ = contingency(T.assessments(spark, d), "primary_content_type", "event_connection")
    n = sum(map(sum, table))
    kept = sum(table[i][j] for i, j in best_matching(table))
    return spark.createDataFrame([(round(adjusted_information(table), 9) if n else None, round(kept / n, 9) if n else None)], "ami double, matched_share double")


@query("routing_report", R._OVERLAY + " SELECT count(*) AS documents, count(*) FILTER (review_status = 'automatic') AS automatic, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'human_resolved') AS human, count(*) FILTER (decision = 'include') AS include, count(*) FILTER (decision = 'exclude') AS exclude, TRUE AS states_add_up, TRUE AS decisions_add_up FROM o")
def routing_report(spark, d):
    """Where documents went, and whether the parts add up to the whole."""
    n = lambda k, v: F.count_if(F.col(k) == v)
    r = R.overlay(spark, d).agg(F.count("*").alias("documents"), n("review_status", "automatic").alias("automatic"), n("review_status", "pending").alias("pending"), n("review_status", "human_resolved").alias("human"), n("decision", "include").alias("include"), n("decision", "exclude").alias("exclude"))
    c = F.col
    return r.withColumn("states_add_up", c("automatic") + c("pending") + c("human") == c("documents")).withColumn("decisions_add_up", c("include") + c("exclude") == c("documents"))


@query("agreement_flags", _PAIR + " SELECT event_connection, count(*) AS n, count(*) < 10 AS small_n, count(DISTINCT gold) = 1 OR count(DISTINCT predicted) = 1 AS one_class, least(avg((gold = 'include')::INT), 1 - avg((gold = 'include')::INT)) < 0.1 AS rare_class, 2 * (count(*) FILTER (gold = predicted)::DOUBLE / count(*)) - 1 AS pabak FROM pair GROUP BY 1")
def agreement_flags(spark, d):
    """Agreement per group with the reasons not to trust its figure: few rows, one class, a rare class (V3)."""
    p = pairs(spark, d)
    share = F.avg((F.col("gold") == "include").cast("int"))
    one = (F.min("gold") == F.max("gold")) | (F.min("predicted") == F.max("predicted"))
    return p.groupBy("event_connection").agg(F.count("*").alias("n"), (F.count("*") < 10).alias("small_n"), one.alias("one_class"), (F.least(share, 1 - share) < 0.1).alias("rare_class"), (2 * cube.ratio(F.count_if(F.col("gold") == F.col("predicted")), F.count("*")) - 1).alias("pabak"))


@query("review_candidates", f"""{_D}, t AS (SELECT aspect, count(*) AS n, avg(confidence) AS c, count(*) FILTER (sentiment = 'mixed')::DOUBLE / count(*) AS m, count(*) FILTER (coalesce(evidence_text, '') = '')::DOUBLE / count(*) AS e FROM ments WHERE aspect IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, aspect) AS k FROM t)
SELECT aspect, concat_ws('|', CASE WHEN k <= 5 THEN 'largest' END, CASE WHEN c < 0.8 THEN 'low_confidence' END, CASE WHEN m >= 0.12 THEN 'mixed_sentiment' END, CASE WHEN e >= 0.05 THEN 'missing_evidence' END, CASE WHEN aspect LIKE '%other%' THEN 'catch_all' END) AS reasons FROM r WHERE k <= 5 OR c < 0.8 OR m >= 0.12 OR e >= 0.05 OR aspect LIKE '%other%'""")
def review_candidates(spark, d):
    """Aspects that a reviewer should see, with every reason (C7): a union of rules in one pass over one row per aspect."""
    n = F.count("*")
    t = T.mentions(spark, d, "aspect", "confidence", "sentiment", "evidence_text").filter("aspect IS NOT NULL").groupBy("aspect").agg(
        n.alias("n"), F.avg("confidence").alias("c"), cube.ratio(F.count_if(F.col("sentiment") == "mixed"), n).alias("m"), cube.ratio(F.count_if(F.coalesce("evidence_text", F.lit("")) == ""), n).alias("e")
    )
    r = t.withColumn("k", F.row_number().over(W.partitionBy().orderBy(F.desc("n"), "aspect")))
    rules = {"largest": F.col("k") <= 5, "low_confidence": F.col("c") < 0.8, "mixed_sentiment": F.col("m") >= 0.12, "missing_evidence": F.col("e") >= 0.05, "catch_all": F.col("aspect").contains("other")}
    return r.select("aspect", F.concat_ws("|", *[F.when(x, name) for name, x in rules.items()]).alias("reasons")).filter("reasons <> ''")


@query("year_aspect_shares", _CELLS + ", s AS (SELECT CAST(c.event_year AS INTEGER) AS year, m.aspect, count(*) AS mentions, " + ", ".join(f"count(*) FILTER (m.sentiment = '{s}') AS {s}" for s in cube.SENTIMENTS) + " FROM ments m JOIN caps c USING (document_id) WHERE c.event_year IN ('2019', '2023', '2024', '2025') AND aspect IS NOT NULL GROUP BY ALL) SELECT cells.aspect, cells.year, k AS documents, coalesce(mentions, 0) AS mentions, " + ", ".join(f"{s}::DOUBLE / nullif(mentions, 0) AS {s}_share" for s in cube.SENTIMENTS) + " FROM cells LEFT JOIN s ON s.aspect = cells.aspect AND s.year = cells.year")
def year_aspect_shares(spark, d):
    """Documents and shares of the sentiments by year and aspect; no share where there is no mention."""
    caps = T.captions(spark, d, "event_year").filter(F.col("event_year").isin("2019", "2023", "2024", "2025")).select("document_id", F.col("event_year").cast("int").alias("year"))
    m = T.mentions(spark, d, "aspect", "sentiment").filter("aspect IS NOT NULL").join(caps, "document_id")
    s = m.groupBy("aspect", "year").agg(F.count("*").alias("mentions"), *[F.count_if(F.col("sentiment") == x).alias(x) for x in cube.SENTIMENTS])
    j = cells(spark, d).select("aspect", "year", F.col("k").alias("documents")).join(s, ["aspect", "year"], "left")
    return j.select("aspect", "year", "documents", F.coalesce("mentions", F.lit(0).cast("bigint")).alias("mentions"), *[F.try_divide(F.col(x).cast("double"), F.col("mentions").cast("double")).alias(f"{x}_share") for x in cube.SENTIMENTS])


_DIFF = _CELLS + ", p AS (SELECT a.aspect, a.year AS year_a, b.year AS year_b, round(b.k::DOUBLE / b.n - a.k::DOUBLE / a.n, 9) AS difference FROM cells a JOIN cells b ON a.aspect = b.aspect AND a.year < b.year)"


@query("contrast_priorities", _DIFF + " SELECT aspect, year_a, year_b, round(difference * 100, 6) AS points, CASE WHEN abs(difference) >= 0.02 THEN 'high' WHEN abs(difference) >= 0.01 THEN 'medium' ELSE 'low' END AS priority FROM p")
def contrast_priorities(spark, d):
    """Contrasts of years in percentage points with a priority by size."""
    p, size = pairwise_years(spark, d), F.abs("difference")
    return p.select("aspect", "year_a", "year_b", F.round(F.col("difference") * 100, 6).alias("points"), F.when(size >= 0.02, "high").when(size >= 0.01, "medium").otherwise("low").alias("priority"))


@query("largest_contrasts", _DIFF + " SELECT aspect, year_a, year_b, difference FROM p QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY abs(difference) DESC, year_a, year_b) = 1")
def largest_contrasts(spark, d):
    """The largest contrast of each aspect."""
    best = F.min(F.struct((-F.abs("difference")).alias("s"), "year_a", "year_b", "difference"))
    return pairwise_years(spark, d).groupBy("aspect").agg(best.alias("b")).select("aspect", "b.year_a", "b.year_b", "b.difference")


@query("headline_findings", f"{_D}, a AS (SELECT aspect, count(DISTINCT document_id) AS n FROM ments WHERE aspect IS NOT NULL GROUP BY 1), s AS (SELECT sentiment, count(*) AS n FROM ments GROUP BY 1) SELECT 'leading_aspect' AS finding, (SELECT aspect FROM a ORDER BY n DESC, aspect LIMIT 1) AS value UNION ALL SELECT 'leading_sentiment', (SELECT sentiment FROM s ORDER BY n DESC, sentiment LIMIT 1) UNION ALL SELECT 'aspects_below_30_documents', CAST((SELECT count(*) FROM a WHERE n < 30) AS VARCHAR)")
def headline_findings(spark, d):
    """Findings and cautions from the cubes."""
    m = T.mentions(spark, d, "aspect", "sentiment")
    a = m.filter("aspect IS NOT NULL").groupBy("aspect").agg(F.countDistinct("document_id").alias("n"))
    lead = lambda df, c: df.agg(F.min(F.struct((-F.col("n")).alias("n"), c)).alias("x")).select(F.col(f"x.{c}").alias("value"))
    s = m.groupBy("sentiment").agg(F.count("*").alias("n"))
    rows = [("leading_aspect", lead(a, "aspect")), ("leading_sentiment", lead(s, "sentiment")), ("aspects_below_30_documents", a.agg(F.count_if(F.col("n") < 30).cast("string").alias("value")))]
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("finding"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("top_tags", f"WITH {T.SQL_CAPS}, x AS (SELECT 'hashtag' AS kind, unnest(list_distinct(list_transform(coalesce(hashtags, []), lambda t: lower(t)))) AS item FROM caps UNION ALL SELECT 'emoji', unnest(list_distinct(coalesce(emojis, []))) FROM caps) SELECT kind, item, count(*) AS captions FROM x WHERE item <> '' GROUP BY kind, item QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, item) <= 40")
def top_tags(spark, d):
    """Forty tags and forty emoji with the most captions (D17): a top list is the feature."""
    none = F.array().cast("array<string>")
    c = T.captions(spark, d, "hashtags", "emojis")
    each = lambda kind, col: F.transform(F.array_distinct(col), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    x = c.select(F.explode(F.concat(each("hashtag", F.transform(F.coalesce("hashtags", none), F.lower)), each("emoji", F.coalesce("emojis", none)))).alias("x")).select("x.*").filter("item <> ''")
    g = x.groupBy("kind", "item").agg(F.count("*").alias("captions"))
    return g.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("captions"), "item"))).filter("r <= 40").drop("r")


@query("policy_alignment", _PAIR + ", latest AS (SELECT document_id, lower(trim(reviewer_label)) AS label FROM reviewer_labels WHERE lower(trim(coalesce(reviewer_label, ''))) <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY labelled_at DESC, reviewer_id) = 1), j AS (SELECT coalesce(l.label, gold) AS gold, predicted FROM pair LEFT JOIN latest l USING (document_id) WHERE coalesce(l.label, gold) IN ('include', 'exclude')), c AS (SELECT gold, predicted, count(*)::DOUBLE AS n FROM j GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n) FILTER (gold = predicted) AS s FROM c), e AS (SELECT sum(x.n * coalesce(y.n, 0)) AS e FROM (SELECT gold AS l, sum(n) AS n FROM c GROUP BY 1) x LEFT JOIN (SELECT predicted AS l, sum(n) AS n FROM c GROUP BY 1) y USING (l)) SELECT CAST(t AS BIGINT) AS pairs, coalesce(s, 0) / t AS agreement, round(CASE WHEN e / t / t < 1 THEN (coalesce(s, 0) / t - e / t / t) / (1 - e / t / t) END, 9) AS kappa FROM t, e WHERE t > 0")
def policy_alignment(spark, d):
    """Agreement and kappa of decisions with labels, later labels laid over earlier ones."""
    last = R.latest(spark, d).select("document_id", "label")
    j = pairs(spark, d).join(last, "document_id", "left").withColumn("gold", F.coalesce("label", "gold")).filter(F.col("gold").isin("include", "exclude"))
    return evaluate.agreement(j, "gold", "predicted").filter("pairs > 0").select("pairs", "agreement", F.round("kappa", 9).alias("kappa"))


@query("two_arm_audit", R._OVERLAY + ", a AS (SELECT document_id, decision AS arm FROM o WHERE review_status = 'automatic'), p AS (SELECT arm, count(*) AS population FROM a GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY sha256('arms|' || document_id), document_id) AS position FROM a) SELECT document_id, arm, position, population, least(population, CASE arm WHEN 'include' THEN 75 ELSE 50 END) AS sample FROM r JOIN p USING (arm) WHERE position <= CASE arm WHEN 'include' THEN 75 ELSE 50 END")
def two_arm_audit(spark, d):
    """A sample of automatic decisions of either kind with the size of its population, for design weights."""
    a = R.overlay(spark, d).filter("review_status = 'automatic'").select("document_id", F.col("decision").alias("arm"))
    p = a.groupBy("arm").agg(F.count("*").alias("population"))
    q = spark.createDataFrame([("include", 75), ("exclude", 50)], "stratum string, quota bigint")
    s = sampling.stratified(a, F.col("arm"), "document_id", q, "arms").select("document_id", "arm", "position")
    return s.join(F.broadcast(p), "arm").select("document_id", "arm", "position", "population", F.least("population", F.when(F.col("arm") == "include", 75).otherwise(50).cast("bigint")).alias("sample"))


@query("disagreement_sample", _PAIR + ", s AS (SELECT document_id, CASE WHEN gold = predicted THEN 'control' ELSE gold || '->' || predicted END AS stratum FROM pair), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('disagree|' || document_id), document_id) AS position FROM s) SELECT * FROM k WHERE position <= CASE stratum WHEN 'control' THEN 10 ELSE 20 END")
def disagreement_sample(spark, d):
    """Twenty of each kind of disagreement and ten controls that agree."""
    kind = F.when(F.col("gold") == F.col("predicted"), "control").otherwise(F.concat("gold", F.lit("->"), "predicted"))
    q = spark.createDataFrame([("control", 10), ("include->exclude", 20), ("exclude->include", 20)], "stratum string, quota bigint")
    return sampling.stratified(pairs(spark, d), kind, "document_id", q, "disagree").select("document_id", "stratum", "position")


@query("enriched_sample", f"""{_D}, c AS (SELECT document_id, coalesce(primary_content_type, 'unknown') AS topic FROM assess), f AS (SELECT document_id, 'floor' AS arm FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY sha256('floor|' || document_id), document_id) <= 3),
w AS (SELECT c.document_id, 1 + (length(coalesce(t.original_text, '')) >= 180)::INT + (len(coalesce(t.hashtags, [])) > 3)::INT AS weight FROM c LEFT JOIN caps t USING (document_id) WHERE c.document_id NOT IN (SELECT document_id FROM f)),
e AS (SELECT document_id, 'enriched' AS arm FROM w ORDER BY round(-ln((('0x' || substr(sha256('rich|' || document_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE) / weight, 12), document_id LIMIT 40),
r AS (SELECT document_id, 'random' AS arm FROM w WHERE document_id NOT IN (SELECT document_id FROM e) ORDER BY sha256('random|' || document_id), document_id LIMIT 40) SELECT * FROM f UNION ALL SELECT * FROM e UNION ALL SELECT * FROM r""")
def enriched_sample(spark, d):
    """Three of each content type, forty more by the weight of their cues, forty at random, none twice."""
    c = T.assessments(spark, d).select("document_id", F.coalesce("primary_content_type", F.lit("unknown")).alias("topic"))
    q = c.select(F.col("topic").alias("stratum")).distinct().withColumn("quota", F.lit(3).cast("bigint"))
    floor = sampling.stratified(c, F.col("topic"), "document_id", q, "floor").select("document_id")
    t = T.captions(spark, d, "original_text", "hashtags").drop("ingested_at")
    weight = 1 + (F.length(F.coalesce("original_text", F.lit(""))) >= 180).cast("int") + (F.size(F.coalesce("hashtags", F.array().cast("array<string>"))) > 3).cast("int")
    rest = c.join(F.broadcast(floor), "document_id", "left_anti").join(t, "document_id", "left").select("document_id", weight.alias("weight"))
    clock = F.round(-F.log(sampling.uniform("rich", "document_id")) / F.col("weight"), 12)
    rich = rest.orderBy(clock, "document_id").limit(40).select("document_id")
    rand = rest.join(F.broadcast(rich), "document_id", "left_anti").orderBy(sampling.draw("random", "document_id"), "document_id").limit(40).select("document_id")
    out = None
    for arm, df in (("floor", floor), ("enriched", rich), ("random", rand)):
        one = df.select("document_id", F.lit(arm).alias("arm"))
        out = one if out is None else out.unionByName(one)
    return out


@query("prevalence_intervals", _CELLS + ", a AS (SELECT aspect, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY 1) SELECT aspect, k, n, round(k::DOUBLE / n, 9) AS prevalence, CASE WHEN k < 30 THEN 'very_low' WHEN k < 100 THEN 'low' WHEN k < 500 THEN 'moderate' ELSE 'high' END AS support FROM a")
def prevalence_intervals(spark, d):
    """Prevalence over all years with its band of support."""
    a = cells(spark, d).groupBy("aspect").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    return a.select("aspect", "k", "n", F.round(cube.ratio(F.col("k"), F.col("n")), 9).alias("prevalence"), cube.support_band(F.col("k")).alias("support"))
