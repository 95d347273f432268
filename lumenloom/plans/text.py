"""Text views, word tables and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import text as X
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"
_COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_CANON = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}\\x{20E3}]"


def _chain(c: str, *patterns: str) -> str:
    c = f"coalesce({c}, '')"
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return c


_URL, _HANDLE, _ANY, _EVENT = "(?i)(?:https?://|www\\.)\\S+", "@[\\p{L}\\p{N}_.]+", "#\\S*", "(?i)\\bKLSCM(?:(?:19|20)?\\d{2})?\\b"
_STOP = ["the", "and", "for", "with", "yang", "dan", "saya", "ini", "was", "were"]
_STOP_SQL = "[" + ",".join(f"'{w}'" for w in _STOP) + "]"


@query("caption_hashtags", f"{_D} SELECT tag, count(*) AS uses, count(DISTINCT document_id) AS documents FROM (SELECT document_id, unnest(list_transform(regexp_extract_all(coalesce(original_text, ''), '#([^\\s#]+)', 1), lambda x: lower(regexp_replace(x, '[.,!?:;)\\]}}]+$', '')))) AS tag FROM caps) GROUP BY 1")
def caption_hashtags(spark, d):
    """Tags as written in the texts."""
    t = T.captions(spark, d, "original_text").select("document_id", F.explode(X.hashtags(F.col("original_text"))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("uses"), F.countDistinct("document_id").alias("documents"))


@query("linguistic_view", f"{_D} SELECT document_id, md5({_COLLAPSE.format(_chain('original_text', _URL, _HANDLE, _ANY, _EVENT, _EMOJI))}) AS linguistic_md5 FROM caps")
def linguistic_view(spark, d):
    """The text that is language."""
    return T.captions(spark, d, "original_text").select("document_id", F.md5(X.linguistic(F.col("original_text"))).alias("linguistic_md5"))


_SEMANTIC = _COLLAPSE.format(f"regexp_replace({_chain('original_text', _URL, _HANDLE)}, '#([^\\s#]+)', ' hashtag_\\1 ', 'g')")


@query("semantic_view", f"{_D} SELECT document_id, md5({_SEMANTIC}) AS semantic_md5 FROM caps")
def semantic_view(spark, d):
    """Tags as words, noise out."""
    return T.captions(spark, d, "original_text").select("document_id", F.md5(X.semantic(F.col("original_text"))).alias("semantic_md5"))


@query("text_hashes", f"SELECT doc_id, sha256({_CANON.format('text')}) AS text_hash, substr(sha256(coalesce(source, '') || '|' || coalesce(author, '') || '|' || coalesce(url, '')), 1, 20) AS stable_id, sha256(coalesce(source, '') || chr(31) || coalesce(author, '') || chr(31) || coalesce(CAST(n_chars AS VARCHAR), '')) AS row_hash FROM documents")
def text_hashes(spark, d):
    """Hash of the canonical text, stable id, hash of a row."""
    c = F.col
    return T.read(spark, d, "documents", "doc_id", "text", "source", "author", "url", "n_chars").select("doc_id", X.text_hash(c("text")).alias("text_hash"), X.stable_id(c("source"), c("author"), c("url")).alias("stable_id"), X.row_hash(c("source"), c("author"), c("n_chars")).alias("row_hash"))


@query("years", f"{_D} SELECT document_id, coalesce(nullif(regexp_extract(coalesce(nullif(event_year, ''), coalesce(post_timestamp, '')), '((?:19|20)\\d{{2}})', 1), ''), 'Unknown') AS year FROM caps")
def years(spark, d):
    """Year of the event, from the time of the post where it is missing."""
    return T.captions(spark, d, "event_year", "post_timestamp").select("document_id", X.year(F.col("event_year"), F.col("post_timestamp")).alias("year"))


_TAG_WORDS = "tag"
for _from, _to in (("[_\\-]+", " "), ("([a-z])([A-Z])", "\\1 \\2"), ("(\\p{L})(\\d)", "\\1 \\2"), ("(\\d)(\\p{L})", "\\1 \\2")):
    _TAG_WORDS = f"regexp_replace({_TAG_WORDS}, '{_from}', '{_to}', 'g')"


@query("tag_words", f"{_D} SELECT DISTINCT tag, {_COLLAPSE.format(_TAG_WORDS)} AS words FROM (SELECT unnest(hashtags) AS tag FROM caps)")
def tag_words(spark, d):
    """Words inside tags."""
    t = T.captions(spark, d, "hashtags").select(F.explode("hashtags").alias("tag")).filter("tag IS NOT NULL").distinct()
    return t.select("tag", X.tag_words(F.col("tag")).alias("words"))


@query("quality_reasons", f"""{_D}, q AS (SELECT document_id, trim(coalesce(original_text, '')) AS t FROM caps),
q2 AS (SELECT *, trim(regexp_replace(regexp_replace(t, '{_URL}', ' ', 'g'), '{_HANDLE}', ' ', 'g')) AS bare FROM q), q3 AS (SELECT *, trim(regexp_replace(bare, '{_ANY}', ' ', 'g')) AS nt FROM q2), q4 AS (SELECT *, trim(regexp_replace(nt, '{_EMOJI}', '', 'g')) AS ne FROM q3)
SELECT document_id, CASE WHEN t = '' THEN 'empty_text' WHEN trim(regexp_replace(t, '{_URL}', '', 'g')) = '' THEN 'url_only' WHEN trim(regexp_replace(t, '{_HANDLE}', '', 'g')) = '' THEN 'mention_only' WHEN nt = '' THEN 'empty_after_normalization' WHEN ne = '' THEN 'emoji_only' WHEN NOT regexp_matches(ne, '[\\p{{L}}\\p{{N}}]') THEN 'punctuation_only' END AS reason FROM q4""")
def quality_reasons(spark, d):
    """Why captions say nothing."""
    return T.captions(spark, d, "original_text").select("document_id", X.quality(F.col("original_text")).alias("reason"))


@query("word_frequencies", f"""SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>|&[a-z]+;', ' ', 'g'), '{_URL}', ' ', 'g'), '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_.-]+', ' ', 'g')), '[a-zà-öø-ÿ0-9_'']+'), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^\\d+$') AND NOT list_contains({_STOP_SQL}, x))) AS term FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def word_frequencies(spark, d):
    """Terms with their occurrences and documents, two documents at least."""
    words = F.filter(X.word_tokens(F.col("text"), _STOP), lambda w: ~w.rlike("[㐀-鿿]"))
    return _frequencies(T.read(spark, d, "documents", "text").select(words.alias("w")), "term").filter("documents >= 2")


def _frequencies(df, name):
    """Occurrences and documents of the tokens in ``w``, one row a document: sorted inside the row, so that the first of equal ones counts the document and one shuffle with partial sums does."""
    s = F.array_sort("w")
    marked = df.select(s.alias("s")).select(F.explode(F.transform("s", lambda x, i: F.struct(x.alias("t"), F.when((i == 0) | (F.try_element_at(F.col("s"), F.greatest(i, F.lit(1))) != x), 1).otherwise(0).alias("first")))).alias("x"))
    return marked.groupBy(F.col("x.t").alias(name)).agg(F.count("*").alias("occurrences"), F.sum("x.first").alias("documents"))


@query("han_tokens", "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿]+')) AS run FROM documents), t AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(run) + 1), lambda i: substr(run, i, 1)), list_transform(range(1, length(run)), lambda i: substr(run, i, 2)))) AS token FROM r) SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t GROUP BY 1")
def han_tokens(spark, d):
    """Han characters and bigrams."""
    tokens = F.filter(X.multilingual_tokens(F.col("text")), lambda w: w.rlike("^[㐀-䶿一-鿿]"))
    return _frequencies(T.read(spark, d, "documents", "text").select(tokens.alias("w")), "token")


@query("expressions", f"""{_D}, e AS (SELECT *, lower(regexp_replace({_COLLAPSE.format("coalesce(evidence_text, '')")}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS expression FROM ments)
SELECT expression, aspect, sentiment, count(*) AS occurrences, count(DISTINCT document_id) AS documents, arg_min(evidence_text, mention_id) AS first_text FROM e WHERE expression <> '' GROUP BY ALL""")
def expressions(spark, d):
    """Equal expressions together, the first original kept."""
    m = T.mentions(spark, d, "aspect", "sentiment", "evidence_text").withColumn("expression", X.expression(F.col("evidence_text"))).filter("expression <> ''")
    return m.groupBy("expression", "aspect", "sentiment").agg(F.count("*").alias("occurrences"), F.countDistinct("document_id").alias("documents"), F.min_by("evidence_text", "mention_id").alias("first_text"))


@query("emoji_counts", f"{_D} SELECT emoji, count(DISTINCT mention_id) AS mentions, count(*) AS uses FROM (SELECT mention_id, unnest(list_distinct(contributing_emoji)) AS emoji FROM ments) GROUP BY 1")
def emoji_counts(spark, d):
    """Each item once per row."""
    m = T.mentions(spark, d, "contributing_emoji").select("mention_id", F.explode(F.array_distinct("contributing_emoji")).alias("emoji"))
    return m.groupBy("emoji").agg(F.countDistinct("mention_id").alias("mentions"), F.count("*").alias("uses"))


@query("length_groups", f"""WITH w AS (SELECT doc_id, len(list_filter(string_split({_COLLAPSE.format("coalesce(text, '')")}, ' '), lambda x: x <> '')) AS n, octet_length(encode(coalesce(text, ''))) AS b FROM documents)
SELECT CASE WHEN n < 8 THEN 'very_short' WHEN n < 25 THEN 'short' WHEN n < 75 THEN 'medium' ELSE 'long' END AS length_group, count(*) AS documents, CAST(sum(greatest(1, CAST(ceil(b / 3.5) AS BIGINT))) AS BIGINT) AS tokens FROM w GROUP BY 1""")
def length_groups(spark, d):
    """Groups by words with the estimated tokens."""
    t = T.read(spark, d, "documents", "text").select(X.length_group(F.col("text")).alias("length_group"), X.token_estimate(F.col("text")).alias("tokens"))
    return t.groupBy("length_group").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


@query("cue_profile", f"""{_D}, q AS (SELECT coalesce(original_text, '') AS t FROM caps), c AS (SELECT concat_ws('|', CASE WHEN length(t) >= 180 THEN 'long' END, CASE WHEN length(regexp_replace(t, '[^.!?。！？;]', '', 'g')) >= 2 THEN 'clauses' END, CASE WHEN regexp_matches(t, '{_EMOJI}') THEN 'emoji' END, CASE WHEN regexp_matches(t, '#([^\\s#]+)') THEN 'hashtag' END, CASE WHEN regexp_matches(lower(t), '(?:^|[^\\p{{L}}\\p{{N}}_])(i|my|me|we|our|saya|aku|kami|kita)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'first_person' END) AS cues FROM q) SELECT cues, count(*) AS captions FROM c GROUP BY 1""")
def cue_profile(spark, d):
    """Cues of captions."""
    return T.captions(spark, d, "original_text").select(X.cues(F.col("original_text")).alias("cues")).groupBy("cues").agg(F.count("*").alias("captions"))


@query("malay_short_forms", f"{_D} SELECT document_id, len(list_filter(regexp_extract_all(lower(coalesce(original_text, '')), '[a-z]+'), lambda x: list_contains([{','.join(repr(k) for k in X.SHORT_FORMS)}], x))) AS hits FROM caps")
def malay_short_forms(spark, d):
    """Short forms that mark colloquial Malay."""
    return T.captions(spark, d, "original_text").select("document_id", X.short_form_hits(F.col("original_text")).alias("hits"))


@query("joined_parts", f"{_D} SELECT mention_id, list_aggregate(list_filter(list_transform(range(1, 4), lambda i: CASE WHEN p[i] <> '' AND list_position(lp, lp[i]) = i THEN p[i] END), lambda x: x IS NOT NULL), 'string_agg', ' | ') AS joined FROM (SELECT mention_id, p, list_transform(p, lambda x: lower(x)) AS lp FROM (SELECT mention_id, [trim(coalesce(target, '')), trim(coalesce(evidence_text, '')), trim(coalesce(english_gloss, ''))] AS p FROM ments)) WHERE p <> ['', '', '']")
def joined_parts(spark, d):
    """Target, evidence and gloss joined, each once."""
    m = T.mentions(spark, d, "target", "evidence_text", "english_gloss")
    return m.select("mention_id", F.nullif(X.join_distinct(F.col("target"), F.col("evidence_text"), F.col("english_gloss")), F.lit("")).alias("joined")).filter("joined IS NOT NULL")


@query("sentence_counts", "SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS sentences FROM documents")
def sentence_counts(spark, d):
    """Sentences of each document."""
    return T.read(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("sentences"))
