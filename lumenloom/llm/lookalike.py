"""Problem 5: one consistent form for text that looks the same.

A trie holds the corpus' own vocabulary: words seen in plain spelling, with
their document counts. A token that holds anything suspicious (a styled or
foreign look-alike, an ignorable, a base letter with a separate mark) is read
by a weighted edit automaton over the trie: look-alikes and ignorables cost
nothing, a change of letter case costs a little, other edits cost one each and
the budget bounds them. A character may look like several letters; the cheapest,
then most frequent word that fits the text's script gives the canonical
spelling. Tokens without such a word are normalised by table. Only
the most frequent words are broadcast; where there are more, the looks of a
text's tokens are joined with the table of all others, so the bound of the list
never decides whether a field is normalised.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.chars import IGNORABLE, LIKE, SPACES, is_emoji, is_mark, plain, script, skeleton

#: The broadcast vocabulary holds at most this many words, the most frequent ones: some MB in every worker. The others are found by a join.
VOCABULARY = 20_000
MIN_DOCUMENTS = 3
#: What a canonical spelling may cost: changes of case in any number that a word has, but no other edit, which would be another word.
BUDGET = 0.9
CASE_COST = 0.01


class Trie:
    """Words by their look (skeleton); a node holds the words that end there with their counts."""

    __slots__ = ("next", "words")

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.words: list[tuple[str, int]] = []

    def add(self, word: str, count: int) -> None:
        node = self
        for ch in unicodedata.normalize("NFC", word):
            node = node.next.setdefault(ch, Trie())
        node.words.append((word, count))

    def search(self, token: str, budget: float = BUDGET) -> list[tuple[float, int, str]]:
        """All words within ``budget`` of ``token`` as (cost, -count, word), best first, each once."""
        chars = unicodedata.normalize("NFC", token)
        out: dict[str, tuple[float, int, str]] = {}
        best: dict[tuple[int, int], float] = {}
        stack = [(self, 0, 0.0)]
        while stack:
            node, at, cost = stack.pop()
            key = (id(node), at)
            if best.get(key, 1e9) <= cost:
                continue
            best[key] = cost
            if at == len(chars):
                for w, n in node.words:
                    if w not in out or cost < out[w][0]:
                        out[w] = (cost, -n, w)
            else:
                if chars[at] in IGNORABLE:
                    stack.append((node, at + 1, cost))
                    continue
                for letters, more in readings(chars[at]):
                    here: Trie | None = node
                    for c in letters:
                        here = here.next.get(c)
                        if here is None:
                            break
                    if here is not None and cost + more <= budget:
                        stack.append((here, at + 1, cost + more))
                if cost + 1 <= budget:
                    stack.append((node, at + 1, cost + 1))
                    stack += [(child, at + 1, cost + 1) for child in node.next.values()]
            if cost + 1 <= budget:
                stack += [(child, at, cost + 1) for child in node.next.values()]
        return sorted(out.values())


# Foreign letters that are drawn like either of two Latin ones, besides what LIKE has.
ALSO = {"ӏ": "i", "Ӏ": "l", "І": "l", "Ι": "l", "і": "l", "ı": "l", "ɩ": "l", "η": "h", "ν": "u", "υ": "v", "п": "p", "γ": "v", "ω": "o", "р": "r"}


@lru_cache(maxsize=65536)
def readings(ch: str) -> tuple[tuple[str, float], ...]:
    """Letters that a character may stand for, each with its cost: itself, its plain form and look-alikes at no cost, another case for little."""
    shown = plain(ch)
    forms = {ch: 0.0, shown: 0.0, "".join(LIKE.get(c, c) for c in shown): 0.0, "".join(_BACK.get(c, c) for c in shown): 0.0}
    if ch in ALSO:
        forms[ALSO[ch]] = 0.0
    for f in list(forms):
        low = f.lower()
        forms[low] = min(forms.get(low, 9.0), CASE_COST * sum(a != b for a, b in zip(f, low, strict=False)))
    return tuple(forms.items())


class Joined:
    """Two tries searched as one: the broadcast list and the words that a join found for one text."""

    __slots__ = ("tries",)

    def __init__(self, *tries: Trie) -> None:
        self.tries = tries

    def search(self, token: str, budget: float = BUDGET) -> list[tuple[float, int, str]]:
        return sorted(x for t in self.tries for x in t.search(token, budget))


_BACK = {v: k for k, v in LIKE.items() if script(k) == "CYRILLIC"}


#: A run of letters, marks, digits, styled forms and what hides between them.
_TOKEN = re.compile(r"(?:[^\W_]|[̀-゙゚ͯ­͏​-‍⁠-⁤﻿᠋-᠎‎‏‪-‮⁦-⁩஀-௿฀-๿\U0001d400-\U0001d7ff])+")
_JOINED = re.compile("[ऀ-෿؀-ۿក-៿က-႟]")
_CJK = re.compile("[⺀-鿿豈-﫿＀-￯가-힣]")
_SUSPECT = re.compile("[^\x00-\x7f]")


def _joiner_is_proper(text: str, i: int) -> bool:
    """A joiner between emoji or inside a script that needs joiners."""
    before = next((text[k] for k in range(i - 1, -1, -1) if not (text[k] == "️" or 0x1F3FB <= ord(text[k]) <= 0x1F3FF)), "")
    after = text[i + 1 : i + 2]
    if text[i] == "‍" and before and after and is_emoji(before) and is_emoji(after):
        return True
    return bool(before and after and _JOINED.match(before) and _JOINED.match(after))


def _odd(ch: str) -> bool:
    """Styled letter or digit, by itself a look-alike."""
    return ch >= "\x80" and plain(ch) != ch


@lru_cache(maxsize=1)
def _empty() -> Trie:
    return Trie()


def _compose(text: str) -> str:
    """Canonical composition that leaves alone what only re-orders or replaces symbols."""
    return unicodedata.normalize("NFC", text)


def _token(token: str, main: str, trie: Trie | Joined, near: str = "") -> str:
    """Canonical spelling of one token; ``main`` is the script most letters of the text are in, ``near`` the tokens beside this one."""
    bare = _compose("".join(map(plain, (c for c in token if c not in IGNORABLE))))
    scripts = {script(c) for c in bare if not is_mark(c)} - {""}
    mixed = [s for s in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "LISU") if s in scripts]
    foreign = any(c in LIKE for c in bare)
    lonely = not foreign and mixed == ["LATIN"] and main == "CYRILLIC"
    if bare == token and not foreign and not lonely:
        return token
    whole = foreign and "LATIN" not in mixed and len(mixed) == 1
    if whole and (main != "LATIN" or any(c not in LIKE for c in bare if c.isalpha()) or any(script(c) == mixed[0] and c not in LIKE for c in near)):
        return bare  # a word properly in its own script, by its letters or its neighbours
    found = trie.search(token)
    if found:
        prefer = "LATIN" if main != "CYRILLIC" or any(c not in _BACK for c in bare if script(c) == "LATIN") else "CYRILLIC"
        if lonely:
            # a Latin word amid Cyrillic is one, if it is known
            prefer = "LATIN" if any(script(w[0]) == "LATIN" for _, _, w in found) else "CYRILLIC"
        return _cased(min(found, key=lambda x: (x[0] >= 1, script(x[2][0]) != prefer, x))[2], bare)
    # by table
    if lonely or (whole and len(bare) > 1):
        return bare
    as_latin = "".join(LIKE.get(c, c) for c in bare)
    if len(mixed) > 1 and not ("LATIN" in mixed and all(script(c) in ("LATIN", "") or is_mark(c) for c in as_latin)):
        return _to(bare, mixed)
    return as_latin if foreign else bare


def _cased(word: str, like: str) -> str:
    """A word in the case of a token; a character read as another letter than it shows takes the case of the letters around it."""
    if len(word) != len(like):
        return word
    own = [LIKE.get(x, x).lower() == w or x.lower() == w for w, x in zip(word, like, strict=True)]
    shouted = all(x.isupper() for x, o in zip(like, own, strict=True) if o and x.isalpha())
    return "".join(w.upper() if (x.isupper() if o else shouted) else w for w, x, o in zip(word, like, own, strict=True))


def _cyrillic(text: str) -> str:
    return "".join(_BACK.get(c, c) for c in text)


def _to(bare: str, mixed: list[str]) -> str:
    """A word of another script with Latin look-alikes inside goes back to that script."""
    if "CYRILLIC" in mixed:
        back = _cyrillic(bare)
        if all(script(c) in ("CYRILLIC", "") or is_mark(c) for c in back):
            return back
    return bare


#: Joiners between emoji, and characters that are their own consistent form whatever stands beside them.
_PROPER = re.compile("[\U0001f000-\U0001faff☀-➿️]‍(?=[\U0001f000-\U0001faff☀-➿])")
_PLAIN_ONLY = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ¡-©«¬®-±´-¸»-¿ạ-ỹẠ-ỸđĐơƠưƯăĂĩũ‐-‧‰-⁞€™☀-➿️、-〿ぁ-ゖァ-ヺー一-鿿가-힣，！？。：；（）\U0001f000-\U0001faff]*")


def canonical(text: str, trie: Trie | None = None) -> str:
    """The consistent form of a text: plain letters, digits and spaces, composed letters, nothing invisible."""
    if text.isascii() or _PLAIN_ONLY.fullmatch(_PROPER.sub("", text)):
        return text
    trie = trie or _empty()
    scripts = Counter(map(script, text))
    scripts.pop("", 0)
    main = scripts.most_common(1)[0][0] if scripts else ""
    out, at = [], 0

    def between(part: str, start: int) -> str:
        keep = []
        for k, ch in enumerate(part):
            i = start + k
            if ch in IGNORABLE:
                if ch in "‌‍" and _joiner_is_proper(text, i):
                    keep.append(ch)
            elif ch == "　":
                near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
                keep.append(ch if near and all(_CJK.match(c) for c in near) else " ")
            elif ch in SPACES:
                keep.append(" ")
            else:
                keep.append(ch)
        return "".join(keep)

    tokens = list(_TOKEN.finditer(text))
    for n, m in enumerate(tokens):
        out.append(between(text[at : m.start()], at))
        token = m.group()
        if not token.isascii():
            if _JOINED.search(token) and all(_joiner_is_proper(text, m.start() + k) for k, c in enumerate(token) if c in IGNORABLE):
                token = _compose(token)
            elif _CJK.search(token) or len(set(map(script, token)) - {"", "LATIN", "CYRILLIC", "GREEK"}) > 2:
                token = _compose("".join(map(plain, (c for c in token if c not in IGNORABLE))))
            else:
                # a joiner at the edge may belong to the emoji beside it
                near = (tokens[n - 1].group() if n else "") + (tokens[n + 1].group() if n + 1 < len(tokens) else "")
                token = _token(token, main, trie, near) if not all(c in IGNORABLE for c in token) else between(token, m.start())
        out.append(token)
        at = m.end()
    out.append(between(text[at:], at))
    return "".join(out)


class Words(list):
    """The most frequent words with their counts, and in ``tail`` a table of all others (``look``, ``word``, ``n``) where there are more."""

    tail: DataFrame | None = None


def _look(word: str) -> str:
    """What words and tokens that the automaton takes for each other share: one letter stands for all that a character may be read as."""
    return "".join(_ONE.get(c, c) for ch in unicodedata.normalize("NFC", word) if ch not in IGNORABLE for c in skeleton(ch))


def _classes() -> dict[str, str]:
    """One letter for each class of letters that some character can be read as."""
    of: dict[str, str] = {}

    def top(c: str) -> str:
        while of.get(c, c) != c:
            c = of[c]
        return c

    for ch, other in ALSO.items():
        a, b = top(skeleton(ch)), top(other)
        if a != b:
            of[max(a, b)] = min(a, b)
    return {c: top(c) for c in of}


_ONE = _classes()


def looks(text: str) -> list[str]:
    """Looks of the tokens of a text that may be looked up."""
    out = {_look(m.group().lower()) for m in _TOKEN.finditer(text) if not m.group().isascii() and not _CJK.search(m.group())}
    return sorted(out - {""})


def vocabulary(columns: list[DataFrame], limit: int = VOCABULARY, min_documents: int = MIN_DOCUMENTS) -> Words:
    """The most frequent plainly spelled words over all given one-column frames of texts, with document counts, and all others as a table.

    Counted over every row; only the ``limit`` best come to the driver (a bounded list).
    """
    parts = []
    for df in columns:
        t = F.col(df.columns[0])
        words = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("(?<![^\\x00-\\x7F])(?:[a-z]{2,24}|[Ѐ-ӿ]{2,24})(?![^\\x00-\\x7F])"), F.lit(0)))
        parts.append(df.select(F.explode(words).alias("word")))
    all_words = parts[0]
    for p in parts[1:]:
        all_words = all_words.unionAll(p)
    counted = all_words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents)
    top = [(r["word"], r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(limit + 1).collect()]
    words = Words(top[:limit])
    if len(top) > limit:
        look = F.pandas_udf("string")(_look_all)
        listed = counted.sparkSession.createDataFrame([(w,) for w, _ in words], "word string")
        words.tail = counted.join(F.broadcast(listed), "word", "left_anti").select(look("word").alias("look"), "word", "n")
    return words


def _look_all(words: pd.Series) -> pd.Series:
    return words.map(_look)


def with_own(df: DataFrame, texts: Column, words: list[tuple[str, int]]) -> DataFrame:
    """Add ``__own``: the words beyond the list that the tokens of ``texts`` (an array) may spell; NULL where the list holds all. Equal texts are joined once."""
    tail = getattr(words, "tail", None)
    if tail is None:
        return df.withColumn("__own", F.lit(None).cast("array<struct<word:string,n:bigint>>"))

    @F.pandas_udf("array<string>")
    def udf(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: sorted({k for t in x if t for k in looks(t)}))

    key = F.sha2(F.to_json(F.struct(texts.alias("t"))), 256)
    df = df.withColumn("__k", key)
    odd = df.filter(F.exists(texts, lambda x: F.coalesce(not_ascii(x), F.lit(False)))).select("__k", texts.alias("__t")).dropDuplicates(["__k"])
    own = odd.select("__k", F.explode(udf.asNondeterministic()("__t")).alias("look")).join(tail, "look")
    own = own.groupBy("__k").agg(F.collect_set(F.struct("word", F.col("n").cast("bigint").alias("n"))).alias("__own"))
    return df.join(own, "__k", "left").drop("__k")


def joined(trie: Trie, own) -> Trie | Joined:
    return trie if own is None or not len(own) else Joined(trie, trie_of([(x["word"], x["n"]) for x in own]))


def trie_of(words: list[tuple[str, int]]) -> Trie:
    root = Trie()
    for w, n in words:
        root.add(w, n)
    return root


def canonical_udf(spark: SparkSession, words: list[tuple[str, int]]):
    """An Arrow function (text, words beyond the list) -> canonical text, NULL -> NULL. The vocabulary is broadcast once; its size is bounded."""
    shared = spark.sparkContext.broadcast(list(words))

    @F.pandas_udf("string")
    def udf(texts: pd.Series, more: pd.Series) -> pd.Series:
        trie = _worker_trie(shared)
        return pd.Series([None if t is None else canonical(t, joined(trie, own)) for t, own in zip(texts, more, strict=True)], dtype=object)

    return udf


_tries: list[tuple[list, Trie]] = []


def _worker_trie(shared) -> Trie:
    """The trie of a broadcast list, built once in a worker."""
    if not _tries or _tries[0][0] != shared.value:
        _tries[:] = [(shared.value, trie_of(shared.value))]
    return _tries[0][1]


def not_ascii(c: Column) -> Column:
    return c.rlike("[^\\x00-\\x7F]")


def normalize(df: DataFrame, text: str, words: list[tuple[str, int]], out: str = "canonical_text") -> DataFrame:
    """Add the consistent form of ``text`` as ``out``; NULL stays NULL, plain ASCII passes through in the JVM."""
    udf = canonical_udf(df.sparkSession, words)
    t = F.col(text)
    df = with_own(df, F.array(t), words)
    df = df.withColumn("__c", udf.asNondeterministic()(F.when(not_ascii(t), t), F.col("__own")))
    return df.withColumn(out, F.when(not_ascii(t), F.col("__c")).otherwise(t)).drop("__c", "__own")


def normalize_all(df: DataFrame, texts: str, words: list[tuple[str, int]], out: str = "canonical_tags") -> DataFrame:
    """Add the consistent forms of an array of texts as ``out``, in the same order; NULL stays NULL, plain ASCII passes through in the JVM."""
    shared = df.sparkSession.sparkContext.broadcast(list(words))

    @F.pandas_udf("array<string>")
    def udf(lists: pd.Series, more: pd.Series) -> pd.Series:
        trie = _worker_trie(shared)
        return pd.Series([None if x is None else [None if t is None else canonical(t, joined(trie, own)) for t in x] for x, own in zip(lists, more, strict=True)], dtype=object)

    t, odd = F.col(texts), F.coalesce(F.exists(texts, lambda x: F.coalesce(not_ascii(x), F.lit(False))), F.lit(False))
    df = with_own(df, t, words)
    df = df.withColumn("__a", udf.asNondeterministic()(F.when(odd, t), F.col("__own")))
    return df.withColumn(out, F.when(odd, F.col("__a")).otherwise(t)).drop("__a", "__own")
