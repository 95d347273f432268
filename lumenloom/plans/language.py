"""Language columns: spans, components, status, checks (L2, L3, L5-L9, L11). Scores come as columns; rules are expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.operators import cube
from lumenloom.registry import query
from lumenloom.sources import tables as T

#: Parameters of the rules.
MIN_LETTERS, WINDOW, STEP = 8, 16, 11
MIXED_COVERAGE, MIXED_LETTERS, MIXED_CONFIDENCE = 0.2, 10, 0.35
SURE, MARGIN, HINT = 0.8, 0.15, 0.85


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(X.or_empty(c), r"[^\p{L}]+", "")).cast("bigint")


def spans(text: Column) -> Column:
    """Sentences with enough letters, and windows of words where a text has more than one window; the whole text where nothing is left (L2)."""
    enough = lambda s: letters(s) >= MIN_LETTERS
    words = F.filter(F.split(X.collapse(text), " "), lambda w: w != "")
    windows = F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(STEP)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " "))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.filter(X.sentences(text), enough), F.filter(windows, enough))
    return F.when(F.size(found) > 0, found).otherwise(F.array(X.or_empty(text)))


_TEXT = "coalesce(linguistic_text, '')"
_SQL_LETTERS = "length(regexp_replace({}, '[^\\p{{L}}]+', '', 'g'))"


@query("language_spans", f"""WITH {T.SQL_CAPS}, s AS (SELECT document_id, {_TEXT} AS t, list_filter(list_transform(string_split(regexp_replace(regexp_replace({_TEXT}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sentences, list_filter(string_split(trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM caps),
p AS (SELECT document_id, t, list_filter(sentences, lambda x: {_SQL_LETTERS.format('x')} >= 8) AS a, list_filter(CASE WHEN len(words) > 16 THEN list_transform(range(0, len(words), 11), lambda i: array_to_string(words[i + 1 : i + 16], ' ')) ELSE [] END, lambda x: {_SQL_LETTERS.format('x')} >= 8) AS b FROM s),
q AS (SELECT document_id, CASE WHEN len(a) + len(b) = 0 THEN [t] ELSE list_concat(a, b) END AS spans FROM p)
SELECT document_id, len(spans) AS spans, CAST(list_sum(list_transform(spans, lambda x: {_SQL_LETTERS.format('x')})) AS BIGINT) AS letters, md5(array_to_string(spans, '|')) AS content FROM q""")
def language_spans(spark, d):
    """Spans of each caption for detection, counted and hashed (L2)."""
    c = T.captions(spark, d, "linguistic_text").select("document_id", spans(F.col("linguistic_text")).alias("s"))
    total = F.aggregate(F.transform("s", letters), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return c.select("document_id", F.size("s").cast("bigint").alias("spans"), total.alias("letters"), F.md5(F.array_join("s", "|")).alias("content"))


def components(parts: DataFrame, document: str, language: str, text: str, confidence: str) -> DataFrame:
    """Languages of a document from labelled parts: letters, coverage and letter-weighted confidence of each (L6). Parts are summed before the shuffle."""
    p = parts.filter(F.col(language).isNotNull() & (F.col(language) != "")).select(document, F.col(language).alias("language"), letters(F.col(text)).alias("n"), F.coalesce(confidence, F.lit(0.0)).alias("c"))
    g = p.groupBy(document, "language").agg(F.sum("n").alias("letters"), F.sum(F.col("n") * F.col("c")).alias("w")).filter("letters > 0")
    total = g.groupBy(document).agg(F.sum("letters").alias("all_letters"))
    return g.join(total, document).select(document, "language", "letters", F.round(F.col("letters") / F.col("all_letters"), 4).alias("coverage"), F.round(F.col("w") / F.col("letters"), 4).alias("confidence"))


_COMP = f"""WITH {T.SQL_CAPS}, {T.SQL_MENTS}, g AS (SELECT document_id, mention_language AS language, CAST(sum({_SQL_LETTERS.format("coalesce(evidence_text, '')")}) AS BIGINT) AS letters, sum({_SQL_LETTERS.format("coalesce(evidence_text, '')")} * coalesce(confidence, 0)) AS w FROM ments WHERE coalesce(mention_language, '') <> '' AND document_id IS NOT NULL GROUP BY ALL HAVING letters > 0),
comp AS (SELECT document_id, language, letters, round(letters::DOUBLE / sum(letters) OVER (PARTITION BY document_id), 4) AS coverage, round(w / letters, 4) AS confidence FROM g)"""


def _components(spark, d):
    m = T.mentions(spark, d, "mention_language", "evidence_text", "confidence").filter("document_id IS NOT NULL")
    return components(m, "document_id", "mention_language", "evidence_text", "confidence")


@query("language_components", _COMP + " SELECT * FROM comp")
def language_components(spark, d):
    """Languages of each document by its labelled evidence."""
    return _components(spark, d)


_HINT = "regexp_extract_all(lower(coalesce(c.linguistic_text, '')), '[a-z]+')"
_FORMS = ", ".join(f"'{w}'" for w in X.SHORT_FORMS)


@query("language_states", _COMP + f""", best AS (SELECT document_id, max_by(struct_pack(l := language, c := confidence), struct_pack(v := coverage, l := language)) AS b, count(*) FILTER (coverage >= 0.2 AND letters >= 10 AND confidence >= 0.35) > 1 AS mixed FROM comp GROUP BY 1),
j AS (SELECT c.document_id, trim(coalesce(c.original_text, '')) AS t, {_SQL_LETTERS.format("coalesce(c.linguistic_text, '')")} AS letters, len(list_filter({_HINT}, lambda w: w IN ({_FORMS}))) >= 2 AS hint, CASE WHEN c.primary_language IN ('', 'no_text', 'insufficient_text', 'undetermined') THEN NULL ELSE c.primary_language END AS given, coalesce(c.language_confidence, 0) AS score, b.b.l AS component, b.b.c AS component_confidence, coalesce(b.mixed, FALSE) AS mixed FROM caps c LEFT JOIN best b USING (document_id)),
k AS (SELECT *, CASE WHEN hint THEN 'Malay' WHEN score >= 0.7 AND given IS NOT NULL THEN given WHEN component IS NOT NULL THEN component ELSE 'undetermined' END AS primary_choice, CASE WHEN hint THEN greatest(score, 0.85) WHEN score >= 0.7 AND given IS NOT NULL THEN score ELSE coalesce(component_confidence, score) END AS confidence FROM j)
SELECT document_id, CASE WHEN t = '' THEN 'no_text' WHEN letters < 8 THEN 'insufficient_text' ELSE primary_choice END AS language, CASE WHEN t = '' THEN 'no_text' WHEN letters < 8 THEN 'insufficient_text' WHEN primary_choice = 'undetermined' THEN 'undetermined' WHEN coalesce(given, '') IN ('Malay', 'Indonesian') AND primary_choice IN ('Malay', 'Indonesian') AND given <> primary_choice THEN 'review_required' WHEN mixed THEN 'mixed' WHEN confidence < 0.8 THEN 'low_confidence' WHEN given IS DISTINCT FROM primary_choice THEN 'review_required' ELSE 'ok' END AS status, round(CASE WHEN t = '' OR letters < 8 THEN 0 ELSE confidence END, 6) AS confidence, mixed FROM k""")
def language_states(spark, d):
    """Language and status of each caption by rules in a fixed order (L3, L5, L7, L8): short forms, then a sure given label, then the largest component."""
    comp = _components(spark, d)
    big = (F.col("coverage") >= MIXED_COVERAGE) & (F.col("letters") >= MIXED_LETTERS) & (F.col("confidence") >= MIXED_CONFIDENCE)
    best = comp.groupBy("document_id").agg(F.max_by(F.struct("language", "confidence"), F.struct("coverage", "language")).alias("b"), (F.count_if(big) > 1).alias("mixed"))
    c = T.captions(spark, d, "original_text", "linguistic_text", "primary_language", "language_confidence").join(best, "document_id", "left")
    given = F.when(~F.col("primary_language").isin("", "no_text", "insufficient_text", "undetermined"), F.col("primary_language"))
    c = c.select("document_id", F.trim(X.or_empty(F.col("original_text"))).alias("t"), letters(F.col("linguistic_text")).alias("n"), (X.short_form_hits(F.col("linguistic_text")) >= 2).alias("hint"), given.alias("given"), F.coalesce("language_confidence", F.lit(0.0)).alias("score"), "b", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    trusted = (F.col("score") >= 0.7) & F.col("given").isNotNull()
    primary = F.when(F.col("hint"), "Malay").when(trusted, F.col("given")).otherwise(F.coalesce("b.language", F.lit("undetermined")))
    confidence = F.when(F.col("hint"), F.greatest("score", F.lit(HINT))).when(trusted, F.col("score")).otherwise(F.coalesce("b.confidence", "score"))
    c = c.withColumn("primary", primary).withColumn("confidence", confidence)
    near = ("Malay", "Indonesian")
    nothing = F.when(F.col("t") == "", "no_text").when(F.col("n") < MIN_LETTERS, "insufficient_text")
    status = F.coalesce(
        nothing,
        F.when(F.col("primary") == "undetermined", "undetermined").when(F.coalesce(F.col("given").isin(*near) & F.col("primary").isin(*near) & (F.col("given") != F.col("primary")), F.lit(False)), "review_required")
        .when(F.col("mixed"), "mixed").when(F.col("confidence") < SURE, "low_confidence").when(~F.col("given").eqNullSafe(F.col("primary")), "review_required").otherwise("ok"),
    )
    return c.select("document_id", F.coalesce(nothing, F.col("primary")).alias("language"), status.alias("status"), F.round(F.when(nothing.isNotNull(), 0.0).otherwise(F.col("confidence")), 6).alias("confidence"), "mixed")


_SENT = f"len(list_filter(string_split(regexp_replace(regexp_replace({_TEXT}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))"


@query("language_routes", f"WITH {T.SQL_CAPS} SELECT CASE WHEN coalesce(language_confidence, 0) >= 0.8 AND primary_language IN ('English', 'Chinese', 'Tamil') AND {_SENT} <= 1 THEN 'fast' ELSE 'full' END AS route, count(*) AS documents FROM caps WHERE {_SQL_LETTERS.format(_TEXT)} >= 8 GROUP BY 1")
def language_routes(spark, d):
    """Captions that a quick detector settles, and those that need the whole rule set: the filter stands before any dear function."""
    c = T.captions(spark, d, "linguistic_text", "primary_language", "language_confidence").filter(letters(F.col("linguistic_text")) >= MIN_LETTERS)
    fast = (F.coalesce("language_confidence", F.lit(0.0)) >= SURE) & F.coalesce(F.col("primary_language").isin("English", "Chinese", "Tamil"), F.lit(False)) & (F.size(X.sentences(F.col("linguistic_text"))) <= 1)
    return c.groupBy(F.when(fast, "fast").otherwise("full").alias("route")).agg(F.count("*").alias("documents"))


@query("language_quality", f"WITH {T.SQL_CAPS}, r AS (SELECT document_id, min(language_observed) AS observed FROM reviewer_labels WHERE language_observed IS NOT NULL AND language_observed NOT LIKE '%+%' GROUP BY 1 HAVING count(DISTINCT language_observed) = 1) SELECT observed AS language, count(*) AS labelled, count(*) FILTER (primary_language = observed)::DOUBLE / count(*) AS accuracy, count(*) FILTER (language_status = 'undetermined')::DOUBLE / count(*) AS undetermined_rate, count(*) FILTER (coalesce(language_confidence, 0) < 0.8)::DOUBLE / count(*) AS low_confidence_rate FROM caps JOIN r USING (document_id) GROUP BY 1")
def language_quality(spark, d):
    """Labels against what all reviewers of a caption observed, per language."""
    r = T.read(spark, d, "reviewer_labels", "document_id", "language_observed").filter("language_observed IS NOT NULL AND language_observed NOT LIKE '%+%'")
    r = r.groupBy("document_id").agg(F.min("language_observed").alias("language"), F.max("language_observed").alias("hi")).filter("language = hi").drop("hi")
    j = T.captions(spark, d, "primary_language", "language_status", "language_confidence").join(r, "document_id")
    n = F.count("*")
    return j.groupBy("language").agg(n.alias("labelled"), cube.ratio(F.count_if(F.col("primary_language") == F.col("language")), n).alias("accuracy"), cube.ratio(F.count_if(F.col("language_status") == "undetermined"), n).alias("undetermined_rate"), cube.ratio(F.count_if(F.coalesce("language_confidence", F.lit(0.0)) < SURE), n).alias("low_confidence_rate"))
