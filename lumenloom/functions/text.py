"""Text functions as column expressions: all of them stay in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of social text.
URL = r"(?i)(?:https?://|www\.)\S+"
HANDLE = r"@[\p{L}\p{N}_.]+"
TAG_ANY = r"#\S*"
TAG = r"#([^\s#]+)"
EVENT = r"(?i)\bKLSCM(?:(?:19|20)?\d{2})?\b"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}\x{20E3}]"
SENTENCE_END = r"([.!?。！？])\s+"
# Malay short forms and what they stand for, as far as they mark the language.
SHORT_FORMS = {"yg": "yang", "dgn": "dengan", "utk": "untuk", "sbb": "sebab", "dh": "sudah", "dah": "sudah", "nk": "nak", "sy": "saya", "mcm": "macam", "blh": "boleh", "jgn": "jangan", "org": "orang", "je": "sahaja", "tak": "tidak", "xde": "tidak ada", "ni": "ini", "tu": "itu", "kat": "dekat", "mmg": "memang", "tgh": "tengah", "skrg": "sekarang", "dkt": "dekat", "lg": "lagi"}


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(or_empty(c), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility form; the JVM has no such built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def emoji_aliases(texts: pd.Series) -> pd.Series:
    """Unicode names of the pictographs of a text, in order."""
    return texts.map(lambda t: [] if not t else [unicodedata.name(c, "").lower().replace(" ", "_") for c in t if 0x1F000 <= ord(c) <= 0x1FAFF or 0x2600 <= ord(c) <= 0x27BF])


def hashtags(c: Column) -> Column:
    """Tags without '#', trailing punctuation cut, lower case."""
    found = F.regexp_extract_all(or_empty(c), F.lit(TAG), F.lit(1))
    return F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"[.,!?:;)\]}]+$", "")))


def linguistic(c: Column) -> Column:
    """Text without addresses, handles, tags, the event's name and emoji."""
    for pattern in (URL, HANDLE, TAG_ANY, EVENT, EMOJI):
        c = F.regexp_replace(or_empty(c), pattern, " ")
    return collapse(c)


def semantic(c: Column) -> Column:
    """Text without addresses and handles, with tags as words."""
    c = F.regexp_replace(F.regexp_replace(or_empty(c), URL, " "), HANDLE, " ")
    return collapse(F.regexp_replace(c, TAG, " hashtag_$1 "))


def canonical(c: Column) -> Column:
    """Lower case, anything but letters, digits and '_' as one blank."""
    return F.trim(F.regexp_replace(F.lower(or_empty(c)), r"[^\p{L}\p{N}_]+", " "))


def text_hash(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def stable_id(*parts: Column) -> Column:
    """First 20 hex digits over parts joined by '|', NULL as an empty part."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit("|")] if i else []) + [or_empty(p.cast("string"))]])
    return F.substring(F.sha2(joined, 256), 1, 20)


def year(value: Column, fallback: Column) -> Column:
    """First year in a value; the fallback is read only where the value is missing; 'Unknown' without one."""
    y = F.regexp_extract(F.coalesce(F.nullif(value, F.lit("")), or_empty(fallback)), r"((?:19|20)\d{2})", 1)
    return F.coalesce(F.nullif(y, F.lit("")), F.lit("Unknown"))


def tag_words(c: Column) -> Column:
    """Words of a tag: at '_', '-', a change of case, between letters and digits."""
    c = F.regexp_replace(or_empty(c), r"[_\-]+", " ")
    c = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, r"(\p{L})(\d)", "$1 $2")
    return collapse(F.regexp_replace(c, r"(\d)(\p{L})", "$1 $2"))


def multilingual_tokens(c: Column) -> Column:
    """Latin words, then per run of Han its characters and its bigrams."""
    latin = F.regexp_extract_all(F.lower(or_empty(c)), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))
    runs = F.regexp_extract_all(or_empty(c), F.lit(r"[㐀-䶿一-鿿]+"), F.lit(0))
    seq = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(latin, F.flatten(F.transform(runs, lambda r: F.concat(seq(r, 1), seq(r, 2)))))


def quality(c: Column) -> Column:
    """Why a text says nothing, first reason in this order; NULL where it does."""
    t = F.trim(or_empty(c))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, URL, " "), HANDLE, " "))
    no_tags = F.trim(F.regexp_replace(bare, TAG_ANY, " "))
    no_emoji = F.trim(F.regexp_replace(no_tags, EMOJI, ""))
    return (
        F.when(t == "", "empty_text")
        .when(F.trim(F.regexp_replace(t, URL, "")) == "", "url_only")
        .when(F.trim(F.regexp_replace(t, HANDLE, "")) == "", "mention_only")
        .when(no_tags == "", "empty_after_normalization")
        .when(no_emoji == "", "emoji_only")
        .when(~no_emoji.rlike(r"[\p{L}\p{N}]"), "punctuation_only")
    )


def expression(c: Column) -> Column:
    """Collapsed, without punctuation at the ends, lower case."""
    return F.lower(F.regexp_replace(collapse(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def leakage_key(c: Column) -> Column:
    """Lower case without addresses, tags and punctuation."""
    c = F.regexp_replace(F.regexp_replace(F.lower(or_empty(c)), URL, " "), r"#[\p{L}\p{N}_]+", " ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def sentences(c: Column) -> Column:
    """Sentences of a text: after an end mark with white space, and at line ends."""
    marked = F.regexp_replace(F.regexp_replace(or_empty(c), SENTENCE_END, "$1\u0001"), r"\n+", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    """Tokens by bytes: at least one, three and a half bytes each."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(or_empty(c)) / 3.5)).cast("bigint")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(collapse(c), " "), lambda w: w != "")).cast("bigint")


def length_group(c: Column) -> Column:
    """Length by words."""
    n = word_count(c)
    return F.when(n < 8, "very_short").when(n < 25, "short").when(n < 75, "medium").otherwise("long")


def confidence_band(c: Column) -> Column:
    """Band of a confidence."""
    return F.when(c.isNull(), "missing").when(c < 0.5, "below_0_50").when(c < 0.8, "0_50_to_0_80").when(c < 0.93, "0_80_to_0_93").otherwise("0_93_and_above")


def first_match(tags: Column, patterns: list[tuple[str, str]], other: str = "other") -> Column:
    """Name of the first pattern that any of the tags matches."""
    joined = F.concat(F.lit(" "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.lit(" "))
    out = None
    for name, pattern in patterns:
        out = F.when(joined.rlike(pattern), name) if out is None else out.when(joined.rlike(pattern), name)
    return out.otherwise(other)


def cues(c: Column) -> Column:
    """Cues of a text as a list joined by '|' (X22)."""
    t = or_empty(c)
    one = lambda cond, name: F.when(cond, F.lit(name))
    return F.concat_ws("|", one(F.length(t) >= 180, "long"), one(F.regexp_count(t, F.lit(r"[.!?。！？;]")) >= 2, "clauses"), one(t.rlike(EMOJI), "emoji"), one(t.rlike(TAG), "hashtag"), one(F.lower(t).rlike(r"(?:^|[^\p{L}\p{N}_])(i|my|me|we|our|saya|aku|kami|kita)(?:$|[^\p{L}\p{N}_])"), "first_person"))


def short_form_hits(c: Column) -> Column:
    """Malay short forms in a text."""
    words = F.regexp_extract_all(F.lower(or_empty(c)), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(list(SHORT_FORMS)))).cast("bigint")


def expand_short_forms(c: Column) -> Column:
    """Short forms written out where a text has two or more."""
    table = F.create_map(*[F.lit(x) for kv in SHORT_FORMS.items() for x in kv])
    words = F.transform(F.split(collapse(c), " "), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w))
    return F.when(short_form_hits(c) >= 2, F.array_join(words, " ")).otherwise(collapse(c))


def join_distinct(*parts: Column) -> Column:
    """Parts joined by ' | ', each once without regard to case, the first spelling kept."""
    arr = F.filter(F.array(*[F.trim(or_empty(p)) for p in parts]), lambda p: p != "")
    low = F.transform(arr, F.lower)
    keep = F.filter(arr, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)
    return F.array_join(keep, " | ")


def row_hash(*cols: Column) -> Column:
    """Hash of a row."""
    return F.sha2(F.concat_ws("\u001f", *[or_empty(c.cast("string")) for c in cols]), 256)


def word_tokens(c: Column, stop: list[str], shortest: int = 3) -> Column:
    """Words for frequency tables: mark-up, addresses and mails out, Han as bigrams, stop words, numbers and short words out."""
    t = F.regexp_replace(or_empty(c), r"<[^>]+>|&[a-z]+;", " ")
    t = F.lower(F.regexp_replace(F.regexp_replace(t, URL, " "), r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+", " "))
    words = F.regexp_extract_all(t, F.lit(r"[a-zà-öø-ÿ0-9_']+"), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.rlike(r"^\d+$") & ~w.isin(stop))
    runs = F.regexp_extract_all(t, F.lit(r"[㐀-䶿一-鿿]{2,}"), F.lit(0))
    return F.concat(words, F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
