"""Themes: decisions, merges, lineage, statuses, corpus for topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lumenloom.functions import text as X
from lumenloom.operators import cube, graphs
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"
_URL = "(?i)(?:https?://|www\\.)\\S+"


# --- the corpus for topics --------------------------------------------------------------------------------------------------------------

_SEM = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(original_text, ''), '{_URL}', ' ', 'g'), '@[\\p{{L}}\\p{{N}}_.]+', ' ', 'g'), '#([^\\s#]+)', ' \\1 ', 'g'), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def topic_text(c: Column) -> Column:
    """Text for topics: without addresses and handles, tags as their words."""
    c = F.regexp_replace(F.regexp_replace(X.or_empty(c), X.URL, " "), X.HANDLE, " ")
    return X.collapse(F.regexp_replace(F.regexp_replace(c, X.TAG, " $1 "), r"[_\-]+", " "))


@query("topic_corpus", f"""WITH {T.SQL_CAPS}, s AS (SELECT document_id, {_SEM} AS t FROM caps), e AS (SELECT *, regexp_matches(t, '\\p{{L}}') AS says FROM s),
r AS (SELECT *, CASE WHEN says THEN min(document_id) OVER (PARTITION BY says, lower(t)) END AS representative FROM e)
SELECT document_id, representative, CASE WHEN NOT says THEN 'no_words' WHEN representative <> document_id THEN 'exact_duplicate_semantic_text' END AS reason, says AND representative = document_id AS included FROM r""")
def topic_corpus(spark, d):
    """Captions that may enter topics: those with words, each text once under its smallest id, with the reason for all others.

    Copies are found by an aggregate over hashes and a join back, so a text copied millions of times is summed before the shuffle.
    """
    e = T.captions(spark, d, "original_text").select("document_id", topic_text(F.col("original_text")).alias("t"))
    e = e.select("document_id", F.col("t").rlike(r"\p{L}").alias("says"), F.sha2(F.lower("t"), 256).alias("h"))
    first = e.filter("says").groupBy("h").agg(F.min("document_id").alias("representative"))
    j = e.join(first, "h", "left").withColumn("representative", F.when(F.col("says"), F.col("representative")))
    own = F.col("representative") == F.col("document_id")
    return j.select("document_id", "representative", F.when(~F.col("says"), "no_words").when(~own, "exact_duplicate_semantic_text").alias("reason"), (F.col("says") & F.coalesce(own, F.lit(False))).alias("included"))


# Words that say nothing about a topic, and words of the domain.
STOP = ("the", "and", "for", "was", "with", "but", "that", "this", "yang", "dan", "saya", "untuk", "dengan", "tidak", "kami", "di", "ke", "ini", "itu")
DOMAIN = "klscm|marathon|half|full|race|runner|running|finish|training|pacer|route|water|(?:10|21|42)km"
_TAGS = "list_distinct(list_transform(coalesce(hashtags, []), lambda x: lower(x)))"


@query("refined_texts", f"""WITH {T.SQL_CAPS}, w AS (SELECT document_id, list_filter(regexp_extract_all(lower(coalesce(linguistic_text, '')), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in STOP)})) AS words, coalesce(hashtags, []) AS tags FROM caps),
o AS (SELECT document_id, words, list_transform(list_filter(list_transform(tags, lambda x, i: struct_pack(v := lower(x), i := i)), lambda y: list_position(list_transform(tags, lambda z: lower(z)), y.v) = y.i), lambda y: y.v) AS tags FROM w)
SELECT document_id, array_to_string(words, ' ') AS representation, array_to_string(CASE WHEN len(tags) > 12 THEN list_concat(list_filter(tags, lambda x: regexp_matches(x, '{DOMAIN}')), list_filter(tags, lambda x: NOT regexp_matches(x, '{DOMAIN}')))[1:12] ELSE tags END, ' ') AS kept_tags FROM o""")
def refined_texts(spark, d):
    """Words that describe a text, without stop words, and its tags once each without regard to case, at most twelve with those of the domain first (X11)."""
    low = F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), F.lower)
    c = T.captions(spark, d, "linguistic_text", "hashtags").withColumn("tags", F.array_distinct(low))
    words = F.filter(F.regexp_extract_all(F.lower(X.or_empty(F.col("linguistic_text"))), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP))
    is_domain = lambda t: t.rlike(DOMAIN)
    kept = F.when(F.size("tags") > 12, F.slice(F.concat(F.filter("tags", is_domain), F.filter("tags", lambda t: ~is_domain(t))), 1, 12)).otherwise(F.col("tags"))
    return c.select("document_id", F.array_join(words, " ").alias("representation"), F.array_join(kept, " ").alias("kept_tags"))


@query("redacted_reviews", f"WITH b AS (SELECT * FROM blog_reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1), names AS (SELECT list(author ORDER BY length(author) DESC, author) AS n FROM (SELECT DISTINCT author FROM b WHERE length(author) > 2)) SELECT document_id, regexp_replace(list_reduce(list_prepend(coalesce(original_text, ''), n), lambda t, a: regexp_replace(t, '(?i)\\b' || regexp_escape(a) || '\\b', '[AUTHOR]', 'g')), '{_URL}', '[URL]', 'g') AS redacted FROM b, names")
def redacted_reviews(spark, d):
    """Reviews without the names of their authors, longest first in any case, and without addresses.

    Names are found by a join of runs of one to four words with the words of names, so neither a list of all names nor a
    pattern of them is ever in one place, and a frequent first word matches nothing by itself.
    """
    b = T.one_per_key(T.read(spark, d, "blog_reviews", "document_id", "ingested_at", "author", "original_text"), ["document_id"], F.col("ingested_at"))
    words = lambda c: F.regexp_extract_all(F.lower(X.or_empty(c)), F.lit(r"\w+"), F.lit(0))
    names = b.filter(F.length("author") > 2).select(F.col("author").alias("name"), F.array_join(words(F.col("author")), " ").alias("k")).distinct()
    t = b.select("document_id", words(F.col("original_text")).alias("w"))
    runs = F.array_distinct(F.flatten(F.transform("w", lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size("w") - i)), lambda n: F.array_join(F.slice("w", i + 1, n), " ")))))
    inside = t.select("document_id", F.explode(runs).alias("k")).join(names, "k").groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), "name"))).alias("names"))
    j = b.join(inside, "document_id", "left")
    cut = F.aggregate(F.coalesce("names", F.array().cast("array<struct<n:int,name:string>>")), X.or_empty(F.col("original_text")), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b\Q"), x["name"], F.lit(r"\E\b")), F.lit("[AUTHOR]")))
    return j.select("document_id", F.regexp_replace(cut, X.URL, "[URL]").alias("redacted"))


# --- themes from mentions: a theme is an aspect with a target; decisions follow from its support -----------------------------------------

_THEMES = f"""{_D}, src AS (SELECT aspect || '/' || target AS theme_id, aspect, target, document_id, mention_id, evidence_text, confidence FROM ments WHERE aspect IS NOT NULL AND coalesce(target, '') <> '' AND document_id IS NOT NULL),
sup AS (SELECT theme_id, aspect, target, count(DISTINCT document_id) AS documents, count(*) AS mentions FROM src GROUP BY ALL),
top AS (SELECT aspect, theme_id AS head FROM sup QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY documents DESC, theme_id) = 1),
dec AS (SELECT s.*, CASE WHEN s.theme_id = t.head THEN 'KEEP' WHEN s.documents < 3 THEN 'EXCLUDE' WHEN s.target IN ('water', 'crew') THEN 'MERGE' ELSE 'KEEP' END AS decision, CASE WHEN s.theme_id <> t.head AND s.documents >= 3 AND s.target IN ('water', 'crew') THEN t.head END AS merge_into FROM sup s JOIN top t USING (aspect))"""


def theme_source(spark, d) -> DataFrame:
    m = T.mentions(spark, d, "aspect", "target", "evidence_text", "confidence").filter("aspect IS NOT NULL AND target <> '' AND document_id IS NOT NULL")
    return m.select(F.concat("aspect", F.lit("/"), "target").alias("theme_id"), "aspect", "target", "document_id", "mention_id", "evidence_text", "confidence")


def decisions(src: DataFrame) -> DataFrame:
    """Support of each theme and what becomes of it: kept, merged into the best of its aspect, or left out. One row per theme."""
    sup = src.groupBy("theme_id", "aspect", "target").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("mentions"))
    head = sup.groupBy("aspect").agg(F.min(F.struct((-F.col("documents")).alias("n"), "theme_id")).alias("h")).select("aspect", F.col("h.theme_id").alias("head"))
    s = sup.join(head, "aspect")
    merge = (F.col("theme_id") != F.col("head")) & (F.col("documents") >= 3) & F.col("target").isin("water", "crew")
    return s.select("theme_id", "aspect", "target", "documents", "mentions", F.when(F.col("theme_id") == F.col("head"), "KEEP").when(F.col("documents") < 3, "EXCLUDE").when(merge, "MERGE").otherwise("KEEP").alias("decision"), F.when(merge, F.col("head")).alias("merge_into"))


@query("merge_policy", _THEMES + " SELECT d.theme_id, d.decision, d.merge_into, CASE WHEN d.merge_into IS NULL THEN 'no_merge' WHEN t.theme_id IS NULL THEN 'unknown_target' WHEN t.theme_id = d.theme_id THEN 'self' WHEN t.aspect <> d.aspect THEN 'other_aspect' WHEN t.decision <> 'KEEP' THEN 'target_not_kept' ELSE 'valid' END AS verdict FROM dec d LEFT JOIN dec t ON d.merge_into = t.theme_id")
def merge_policy(spark, d):
    """Every merge against the rules: one level, into a kept theme of the same aspect, not into itself."""
    x = decisions(theme_source(spark, d))
    t = x.select(F.col("theme_id").alias("merge_into"), F.col("aspect").alias("t_aspect"), F.col("decision").alias("t_decision"))
    j = x.join(t, "merge_into", "left")
    verdict = F.when(F.col("merge_into").isNull(), "no_merge").when(F.col("t_aspect").isNull(), "unknown_target").when(F.col("merge_into") == F.col("theme_id"), "self").when(F.col("t_aspect") != F.col("aspect"), "other_aspect").when(F.col("t_decision") != "KEEP", "target_not_kept").otherwise("valid")
    return j.select("theme_id", "decision", "merge_into", verdict.alias("verdict"))


@query("theme_taxonomy", _THEMES + """, root AS (SELECT theme_id, aspect, coalesce(merge_into, theme_id) AS root FROM dec WHERE decision <> 'EXCLUDE')
SELECT r.aspect || '_' || substr(sha256(r.root), 1, 8) AS final_theme_id, r.root, count(DISTINCT src.document_id) AS support_documents, count(DISTINCT src.mention_id) AS support_mentions, count(DISTINCT r.theme_id) AS merged_themes, round(count(DISTINCT src.document_id)::DOUBLE / (SELECT count(DISTINCT document_id) FROM src), 9) AS prevalence, count(DISTINCT src.document_id) < 30 AS low_support, count(DISTINCT src.document_id) = 1 AS singleton FROM root r JOIN src USING (theme_id) GROUP BY r.aspect, r.root""")
def theme_taxonomy(spark, d):
    """Final themes after merges, with their support and prevalence over all documents with themes."""
    src = theme_source(spark, d)
    root = decisions(src).filter("decision <> 'EXCLUDE'").select("theme_id", F.coalesce("merge_into", "theme_id").alias("root"))
    n = src.agg(F.countDistinct("document_id").alias("all_documents"))
    g = src.join(root, "theme_id").groupBy("aspect", "root").agg(F.countDistinct("document_id").alias("support_documents"), F.countDistinct("mention_id").alias("support_mentions"), F.countDistinct("theme_id").alias("merged_themes"))
    g = g.crossJoin(F.broadcast(n))  # one row
    return g.select(F.concat("aspect", F.lit("_"), F.substring(F.sha2("root", 256), 1, 8)).alias("final_theme_id"), "root", "support_documents", "support_mentions", "merged_themes", F.round(F.col("support_documents") / F.col("all_documents"), 9).alias("prevalence"), (F.col("support_documents") < 30).alias("low_support"), (F.col("support_documents") == 1).alias("singleton"))


@query("theme_lineage", _THEMES + " SELECT src.mention_id, src.theme_id, dec.decision, CASE WHEN dec.decision <> 'EXCLUDE' THEN coalesce(dec.merge_into, dec.theme_id) END AS final_theme FROM src JOIN dec USING (theme_id)")
def theme_lineage(spark, d):
    """Where each mention ends up, mentions of excluded themes included."""
    src = theme_source(spark, d)
    return src.join(decisions(src), "theme_id").select("mention_id", "theme_id", "decision", F.when(F.col("decision") != "EXCLUDE", F.coalesce("merge_into", "theme_id")).alias("final_theme"))


@query("theme_partition", _THEMES + ", m AS (SELECT src.document_id, bool_or(decision = 'KEEP') AS k, bool_or(decision = 'MERGE') AS g FROM src JOIN dec USING (theme_id) GROUP BY 1) SELECT c.document_id, CASE WHEN m.document_id IS NULL THEN 'outlier' WHEN k THEN 'substantive' WHEN g THEN 'merged_only' ELSE 'excluded' END AS part FROM caps c LEFT JOIN m USING (document_id)")
def theme_partition(spark, d):
    """Every caption in exactly one part of the corpus by what became of its themes."""
    src = theme_source(spark, d)
    m = src.join(decisions(src).select("theme_id", "decision"), "theme_id").groupBy("document_id").agg(F.bool_or(F.col("decision") == "KEEP").alias("k"), F.bool_or(F.col("decision") == "MERGE").alias("g"))
    c = T.captions(spark, d).select("document_id").join(m, "document_id", "left")
    return c.select("document_id", F.when(F.col("k").isNull(), "outlier").when(F.col("k"), "substantive").when(F.col("g"), "merged_only").otherwise("excluded").alias("part"))


@query("theme_review_frame", _THEMES + ", t AS (SELECT sum(documents) AS n FROM sup), r AS (SELECT theme_id, document_id, row_number() OVER (PARTITION BY theme_id ORDER BY sha256('review|' || document_id), document_id) AS k FROM (SELECT DISTINCT theme_id, document_id FROM src)) SELECT sup.theme_id, documents, mentions, round(documents::DOUBLE / n, 9) AS share, (SELECT string_agg(document_id, ',' ORDER BY k) FROM r WHERE r.theme_id = sup.theme_id AND k <= 5) AS examples FROM sup, t")
def theme_review_frame(spark, d):
    """Size, share and five examples by hash of each theme (N10): the examples are the smallest hashes, kept by partial top lists."""
    src = theme_source(spark, d)
    sup = decisions(src).select("theme_id", "documents", "mentions")
    docs = src.select("theme_id", "document_id").distinct().withColumn("h", F.sha2(F.concat(F.lit("review|"), "document_id"), 256))
    k = docs.withColumn("k", F.row_number().over(W.partitionBy("theme_id").orderBy("h", "document_id"))).filter("k <= 5")
    ex = k.groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "document_id"))), lambda x: x["document_id"]), ",").alias("examples"))
    n = sup.agg(F.sum("documents").alias("n"))
    return sup.crossJoin(F.broadcast(n)).join(ex, "theme_id").select("theme_id", "documents", "mentions", F.round(F.col("documents") / F.col("n"), 9).alias("share"), "examples")


@query("theme_review_summary", _THEMES + ", cat AS (SELECT unnest(['KEEP', 'MERGE', 'EXCLUDE']) AS decision) SELECT cat.decision, count(dec.theme_id) AS themes, CAST(coalesce(sum(dec.documents), 0) AS BIGINT) AS documents, coalesce(sum(dec.documents)::DOUBLE / (SELECT sum(documents) FROM dec), 0) AS share FROM cat LEFT JOIN dec USING (decision) GROUP BY 1")
def theme_review_summary(spark, d):
    """Themes and documents per decision, decisions without themes included."""
    x = decisions(theme_source(spark, d)).groupBy("decision").agg(F.count("*").alias("themes"), F.sum("documents").alias("documents"))
    total = x.agg(F.sum("documents").alias("n"))
    dims = cube.dimension(spark, "decision", ("KEEP", "MERGE", "EXCLUDE"))
    j = cube.densify(dims, x, ["decision"], ["themes", "documents"]).crossJoin(F.broadcast(total))
    return j.select("decision", "themes", "documents", cube.ratio(F.col("documents"), F.col("n")).alias("share"))


@query("theme_statuses", _THEMES + ", a AS (SELECT aspect, sum(mentions) AS mentions, sum(documents) AS documents FROM sup GROUP BY 1), s AS (SELECT sup.*, CASE WHEN a.mentions < 60 OR a.documents < 40 THEN 'insufficient_support' WHEN sup.mentions < least(50, greatest(10, ceil(sqrt(a.mentions)))) THEN 'noise' ELSE 'stable_cluster' END AS status FROM sup JOIN a USING (aspect)) SELECT aspect, status, count(*) AS themes, CAST(sum(mentions) AS BIGINT) AS mentions, round(sum(mentions)::DOUBLE / sum(sum(mentions)) OVER (PARTITION BY aspect), 9) AS share FROM s GROUP BY aspect, status")
def theme_statuses(spark, d):
    """Themes by whether their aspect and they themselves have enough support, with the share that is noise."""
    sup = decisions(theme_source(spark, d))
    a = sup.groupBy("aspect").agg(F.sum("mentions").alias("am"), F.sum("documents").alias("ad"))
    floor = F.least(F.lit(50), F.greatest(F.lit(10), F.ceil(F.sqrt("am"))))
    status = F.when((F.col("am") < 60) | (F.col("ad") < 40), "insufficient_support").when(F.col("mentions") < floor, "noise").otherwise("stable_cluster")
    g = sup.join(a, "aspect").groupBy("aspect", "am", status.alias("status")).agg(F.count("*").alias("themes"), F.sum("mentions").alias("mentions"))
    return g.select("aspect", "status", "themes", "mentions", F.round(F.col("mentions") / F.col("am"), 9).alias("share"))


@query("theme_quality", _THEMES + ", q AS (SELECT theme_id, CASE WHEN avg(confidence) >= 0.8 THEN 1 WHEN avg(confidence) >= 0.7 THEN 2 ELSE 3 END AS grade FROM src GROUP BY 1) SELECT coalesce(merge_into, dec.theme_id) AS final_theme, max(grade) AS worst_grade, count(*) AS merged FROM dec JOIN q USING (theme_id) WHERE decision <> 'EXCLUDE' GROUP BY 1")
def theme_quality(spark, d):
    """The grade of a merged theme is that of its worst part."""
    src = theme_source(spark, d)
    m = F.avg("confidence")
    q = src.groupBy("theme_id").agg(F.when(m >= 0.8, 1).when(m >= 0.7, 2).otherwise(3).alias("grade"))
    return decisions(src).filter("decision <> 'EXCLUDE'").join(q, "theme_id").groupBy(F.coalesce("merge_into", "theme_id").alias("final_theme")).agg(F.max("grade").alias("worst_grade"), F.count("*").alias("merged"))


@query("theme_label_similarity", _THEMES + " SELECT a.theme_id AS theme_a, b.theme_id AS theme_b, round(1 - levenshtein(a.target, b.target)::DOUBLE / greatest(length(a.target), length(b.target)), 9) AS similarity FROM sup a JOIN sup b ON a.aspect = b.aspect AND a.theme_id < b.theme_id")
def theme_label_similarity(spark, d):
    """Likeness of the labels of all themes of an aspect (N13, J7): pairs of labels, of which an aspect has a handful, never of rows."""
    t = theme_source(spark, d).select("theme_id", "aspect", "target").distinct()
    a, b = (t.select("aspect", F.col("theme_id").alias(f"theme_{x}"), F.col("target").alias(f"l{x}")) for x in "ab")
    j = a.join(b, "aspect").filter("theme_a < theme_b")
    return j.select("theme_a", "theme_b", F.round(1 - F.levenshtein("la", "lb") / F.greatest(F.length("la"), F.length("lb")), 9).alias("similarity"))


_SETS = _THEMES + ", ts AS (SELECT theme_id, aspect, list(DISTINCT document_id) AS docs FROM src GROUP BY ALL), pairs AS (SELECT a.theme_id AS a, b.theme_id AS b, n::DOUBLE / (sa.documents + sb.documents - n) AS score FROM (SELECT x.theme_id AS ta, y.theme_id AS tb, count(*) AS n FROM (SELECT DISTINCT theme_id, document_id FROM src) x JOIN (SELECT DISTINCT theme_id, document_id FROM src) y ON x.document_id = y.document_id AND x.theme_id < y.theme_id GROUP BY ALL) p JOIN sup sa ON sa.theme_id = p.ta JOIN sup sb ON sb.theme_id = p.tb JOIN sup a ON a.theme_id = p.ta JOIN sup b ON b.theme_id = p.tb)"


@query("merge_suggestions", _SETS + ", best AS (SELECT * FROM pairs ORDER BY round(score, 9) DESC, a, b LIMIT 40), sides AS (SELECT a AS theme_id, b AS other, score, a, b FROM best UNION ALL SELECT b, a, score, a, b FROM best) SELECT theme_id, other, round(score, 9) AS score, row_number() OVER (PARTITION BY theme_id ORDER BY round(score, 9) DESC, a, b) AS rank FROM sides QUALIFY rank <= 3")
def merge_suggestions(spark, d):
    """Pairs of themes that share documents, the forty closest, at most three for each theme (N12): a top list is the feature.

    A document has a handful of themes, so pairs inside documents cannot explode; they are counted before the shuffle.
    """
    src = theme_source(spark, d)
    x = src.select("theme_id", "document_id").distinct()
    sup = x.groupBy("theme_id").agg(F.count("*").alias("n"))
    sets = x.groupBy("document_id").agg(F.array_sort(F.collect_set("theme_id")).alias("s"))  # at most as many as there are mentions of a document
    both = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = sets.filter(F.size("s") > 1).select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    p = p.join(sup.select(F.col("theme_id").alias("a"), F.col("n").alias("na")), "a").join(sup.select(F.col("theme_id").alias("b"), F.col("n").alias("nb")), "b")
    best = p.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 9).alias("score")).orderBy(F.desc("score"), "a", "b").limit(40)
    sides = best.select("a", "b", "score", F.explode(F.array(F.struct(F.col("a").alias("theme_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("theme_id"), F.col("a").alias("other")))).alias("x"))
    w = W.partitionBy("theme_id").orderBy(F.desc("score"), "a", "b")
    return sides.select("x.theme_id", "x.other", "score", "a", "b").withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 3").drop("a", "b")


@query("document_roots", "WITH RECURSIVE e AS (SELECT doc_id, CASE WHEN (doc_id - 1) % 4 <> 0 THEN doc_id - 1 END AS t FROM documents), r AS (SELECT doc_id, doc_id AS pos, 0 AS steps FROM e UNION ALL SELECT r.doc_id, e.t, r.steps + 1 FROM r JOIN e ON e.doc_id = r.pos WHERE e.t IS NOT NULL AND e.t IN (SELECT doc_id FROM documents)) SELECT doc_id, max_by(pos, steps) AS root, CAST(max(steps) AS INTEGER) AS steps FROM r GROUP BY 1")
def document_roots(spark, d):
    """Roots of pointers over all documents (U4): each points at the one before it, every fourth at none."""
    e = T.read(spark, d, "documents", "doc_id").withColumn("t", F.when((F.col("doc_id") - 1) % 4 != 0, F.col("doc_id") - 1))
    return graphs.roots(e, "doc_id", "t").select(F.col("id").alias("doc_id"), "root", F.col("steps").cast("int").alias("steps"))


@query("source_descriptors", f"{_D}, b AS (SELECT * FROM blog_reviews QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at) = 1), y AS (SELECT year, sum(i) AS captions, sum(r) AS reviews FROM (SELECT event_year AS year, 1 AS i, 0 AS r FROM caps UNION ALL SELECT event_year, 0, 1 FROM b) WHERE regexp_full_match(year, '\\d{{4}}') GROUP BY 1) SELECT year, CAST(captions AS BIGINT) AS captions, CAST(reviews AS BIGINT) AS reviews, CASE WHEN captions > 1 AND reviews > 1 THEN 'both_recurring' WHEN captions > 0 AND reviews > 0 THEN 'both_limited' WHEN captions > 1 THEN 'captions_recurring' WHEN captions = 1 THEN 'single_caption' WHEN reviews > 1 THEN 'reviews_recurring' ELSE 'single_review' END AS descriptor FROM y")
def source_descriptors(spark, d):
    """How two sources support a year, from two counts that are never pooled."""
    b = T.one_per_key(T.read(spark, d, "blog_reviews", "document_id", "ingested_at", "event_year"), ["document_id"], F.col("ingested_at"))
    both = T.captions(spark, d, "event_year").select(F.col("event_year").alias("year"), F.lit(1).alias("i"), F.lit(0).alias("r")).unionByName(b.select(F.col("event_year").alias("year"), F.lit(0).alias("i"), F.lit(1).alias("r")))
    g = both.filter(F.col("year").rlike(r"^\d{4}$")).groupBy("year").agg(F.sum("i").alias("captions"), F.sum("r").alias("reviews"))
    i, r = F.col("captions"), F.col("reviews")
    return g.withColumn("descriptor", F.when((i > 1) & (r > 1), "both_recurring").when((i > 0) & (r > 0), "both_limited").when(i > 1, "captions_recurring").when(i == 1, "single_caption").when(r > 1, "reviews_recurring").otherwise("single_review"))


_GRAMS = _THEMES + ", labels AS (SELECT theme_id, aspect, string_split(replace(aspect, '_', ' ') || ' ' || target, ' ') AS w FROM sup), g AS (SELECT theme_id, aspect, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM labels), df AS (SELECT term, count(*) AS df FROM g GROUP BY 1), n AS (SELECT count(*) AS n FROM labels), v AS (SELECT theme_id, aspect, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS x FROM g JOIN df USING (term), n), u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY theme_id)) AS y FROM v)"


@query("label_cosines", _GRAMS + " SELECT a.theme_id AS theme_a, b.theme_id AS theme_b, round(sum(a.y * b.y), 8) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.aspect = b.aspect AND a.theme_id < b.theme_id GROUP BY ALL")
def label_cosines(spark, d):
    """Cosine of the words and pairs of words of theme labels within an aspect (A26, W9): labels, not rows, are joined on their terms."""
    labels = theme_source(spark, d).select("theme_id", "aspect", "target").distinct().withColumn("w", F.split(F.concat(F.replace("aspect", F.lit("_"), F.lit(" ")), F.lit(" "), "target"), " "))
    pairs_ = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    g = labels.select("theme_id", "aspect", F.explode(F.array_distinct(F.concat("w", pairs_))).alias("term"))
    df, n = g.groupBy("term").agg(F.count("*").alias("df")), labels.agg(F.count("*").alias("n"))
    v = g.join(df, "term").crossJoin(F.broadcast(n)).select("theme_id", "aspect", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("x"))
    norm = v.groupBy("theme_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    u = v.join(norm, "theme_id").select("theme_id", "aspect", "term", (F.col("x") / F.col("l")).alias("y"))
    a, b = (u.select("aspect", "term", F.col("theme_id").alias(f"theme_{k}"), F.col("y").alias(k)) for k in "ab")
    return a.join(b, ["aspect", "term"]).filter("theme_a < theme_b").groupBy("theme_a", "theme_b").agg(F.round(F.sum(F.col("a") * F.col("b")), 8).alias("cosine"))


@query("top_terms", f"{_D}, w AS (SELECT aspect, mention_id, unnest(regexp_extract_all(lower(coalesce(english_gloss, '')), '[a-z]{{3,}}')) AS term FROM ments WHERE aspect IS NOT NULL), t AS (SELECT aspect, term, count(*) AS tf, count(DISTINCT mention_id) AS df FROM w GROUP BY ALL), n AS (SELECT aspect, count(*) AS n FROM ments WHERE aspect IS NOT NULL GROUP BY 1) SELECT aspect, term, tf, round(tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) / n, 8) AS weight FROM t JOIN n USING (aspect) WHERE df >= 2 QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY round(tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) / n, 8) DESC, term) <= 8")
def top_terms(spark, d):
    """Mean weight of the terms of an aspect's mentions, eight each, terms of one mention left out."""
    m = T.mentions(spark, d, "aspect", "english_gloss").filter("aspect IS NOT NULL")
    words = F.regexp_extract_all(F.lower(X.or_empty(F.col("english_gloss"))), F.lit("[a-z]{3,}"), F.lit(0))
    # per mention: how often a term occurs in it, so that one aggregate gives both counts
    t = m.select("aspect", words.alias("w")).select("aspect", F.explode(F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.size(F.filter("w", lambda y: y == x)).alias("k")))).alias("x"))
    t = t.groupBy("aspect", "x.term").agg(F.sum("x.k").alias("tf"), F.count("*").alias("df")).filter("df >= 2")
    n = m.groupBy("aspect").agg(F.count("*").alias("n"))
    v = t.join(n, "aspect").withColumn("weight", F.round(F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1) / F.col("n"), 8))
    return v.withColumn("r", F.row_number().over(W.partitionBy("aspect").orderBy(F.desc("weight"), "term"))).filter("r <= 8").select("aspect", "term", "tf", "weight")
