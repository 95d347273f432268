"""Problem 9: template residue and error-page text.

Labelled exemplars of residue (and of ordinary sentences about such things)
stand in an inverted index from token to exemplar. Each document is read in
overlapping windows of its passages; a window fetches the exemplars that
share rare tokens with it, and the TF-IDF containment (share of the
exemplar's weight found in the window, in order) decides. The weights come
from token counts over all documents. Placeholders become typed tokens first
(<ph_...>, so their inner names do not matter), and so do the words of filler
(<key>, <rep>, <latin>, <qwerty>); exemplars hold these tokens. Two checks may
follow a match: matches of short exemplars must make up much of the sentences
they stand in, and a field must be written like one that nobody filled in.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containment from which a window counts as a match.
COVERAGE = 0.72

# Exemplars of residue by kind, in the public wording of browsers, servers, site builders and publishing tools. <n> stands for a number, <u> for an address.
RESIDUE = {
    "scripts": """
javascript is disabled in your browser | please enable javascript to view this page | you need to enable javascript to run this app | this site requires javascript | this page requires javascript | javascript is required to use this site
please enable javascript and cookies to continue | enable javascript and cookies to continue | javascript must be enabled to use this site | turn on javascript and reload the page | scripts are required to view this content | turn on scripts to continue
please turn on javascript in your browser and refresh the page | this page uses javascript your browser does not support it | we're sorry but this app doesn't work properly without javascript enabled | your browser does not support javascript | please allow scripts for this site
bitte aktivieren sie javascript um diese seite anzuzeigen | javascript ist in ihrem browser deaktiviert | veuillez activer javascript pour afficher cette page | javascript est désactivé dans votre navigateur | para usar este sitio debe habilitar javascript en su navegador | habilite los scripts de su navegador | javascript está deshabilitado en su navegador
sila aktifkan javascript pada pelayar anda | sila aktifkan skrip pada pelayar anda | aktifkan javascript di peramban anda untuk melanjutkan | ative o javascript no seu navegador para continuar | abilita javascript nel tuo browser
请启用javascript后继续 | 您的浏览器未启用javascript | 请开启浏览器的脚本功能 | 請啟用javascript | このページを表示するにはjavascriptを有効にしてください | 자바스크립트를 활성화해 주세요 | пожалуйста включите javascript в вашем браузере | vui lòng bật javascript để xem trang này | กรุณาเปิดใช้งาน javascript
""",
    "error": """
<n> not found | <n> forbidden | <n> bad gateway | <n> service unavailable | <n> gateway timeout | <n> internal server error | <n> bad request | <n> unauthorized | internal server error | http error <n> | error <n> service unavailable | error <n> page not found | error <n> on <u> | error <n> en <u> | status code <n>
the requested url <u> was not found on this server | you don't have permission to access this resource | you don't have permission to access <u> on this server | additionally a <n> not found error was encountered while trying to use an errordocument
that page can't be found | it looks like nothing was found at this location maybe try a search | sorry this page isn't available | the link you followed may be broken or the page may have been removed | this page could not be found | the page you are looking for does not exist | page not found
error establishing a database connection | the server is temporarily unable to service your request due to maintenance downtime or capacity problems | this content is not available in your country | this content is no longer available | this video is not available in your region
the resource has been moved permanently | moved permanently the document has moved here | object moved to here | apache server at <u> port <n> | too many requests please try again later | too many requests retry in <n> seconds | your session has expired please sign in again to continue
traceback most recent call last | keyerror <w> | file <u> line <n> in <w> | warning include failed to open stream | warning include failed opening <u> for inclusion in <u> on line <n> | fatal error uncaught exception in <u> on line <n> | notice undefined index in <u> on line <n> | nullpointerexception at java lang | stack trace
something went wrong please try again later | an unexpected error occurred | this site can't be reached | the connection has timed out | bad request your browser sent a request that this server could not understand | site under construction come back soon | this site is under maintenance we'll be back soon
halaman tidak dijumpai | sila kembali ke laman utama | halaman yang anda cari tidak ditemukan | página no encontrada | la página que busca no existe | cette page n'existe pas ou a été déplacée | page introuvable | die angeforderte seite wurde nicht gefunden | seite nicht gefunden | página não encontrada | страница не найдена | không tìm thấy trang | ไม่พบหน้าที่คุณต้องการ | hindi nahanap ang pahina
页面不存在 | 您访问的页面不存在或已被删除 | 秒后返回首页 | 找不到页面 | 服务器内部错误 | 系统繁忙请稍后再试 | お探しのページは見つかりませんでした | ページが見つかりません | 페이지를 찾을 수 없습니다 | பக்கம் கிடைக்கவில்லை
""",
    "block": """
checking your browser before accessing <u> | this process is automatic your browser will redirect to your requested content shortly | ddos protection by cloudflare | please stand by while we are checking your browser | verify you are human by completing the action below
access denied your ip has been blocked by the site owner | access denied you don't have permission to access | our systems have detected unusual traffic from your computer network | unusual traffic detected | tick the box to confirm you are not a robot | please confirm that you are not a robot | please complete the security check to access
log in to see photos and videos from friends | log in forgot password sign up | you must be logged in to view this content | log in to continue | sign up to continue | subscribe to continue reading
we value your privacy accept all cookies reject manage preferences | accept all cookies reject all manage preferences | accept all cookies reject manage preferences | this website uses cookies to improve your experience
sorry you have been blocked | ray id performance and security by | attention required please enable cookies
""",
    "filler": """
lorem ipsum | lorem ipsum dolor sit amet | <latin> <latin> <latin> <latin> <latin> | <key> <key> <key> <key> <key> | <rep> <rep> <rep> <rep> <rep> | <qwerty>
this is a placeholder post edit or delete it then start writing | welcome to wordpress this is your first post edit or delete it then start writing | hello world this is your first post | this is an example page | sample text | placeholder text | dummy text | replace this text | replace this paragraph with your own words | edit this text
title goes here | subtitle goes here | body goes here | text goes here | your text goes here | content goes here | description goes here | your text here | insert text here | add your content here | write something here | enter a description max <n> words
draft do not publish | content to follow | paragraph <n> content to follow | text to come | content coming soon | tbd | to be written
contenu à venir | votre texte ici | remplacez ce texte | texto de ejemplo | texto de relleno | inserte aquí su texto | escriba aquí | blindtext | bitte ersetzen | hier steht ihr text | hier kommt ihr text | teks contoh | gantikan teks ini dengan kandungan sebenar | isi berita di sini | tulis isi di sini | masukkan teks di sini | insira seu texto aqui | вставьте текст сюда | текст заглушка | nội dung đang cập nhật
此处输入正文 | 此处填写内容 | 请在此输入内容 | 示例文本 | ここに本文を入力してください | ダミーテキスト | サンプルテキスト | 여기에 내용을 입력하세요
""",
}
# Exemplars with fields (typed by their syntax, see _FIELDS; <ph_word> is one bracketed word, a field only in such a place).
RESIDUE["placeholder"] = """
<ph_code> | <ph_sign> | <ph_caps> | <ph_label> | <ph_date> | <ph_name> | <ph_null>
dear <ph_word> | hello <ph_word> | hi <ph_word> | hey <ph_word> | hai <ph_word> | hallo <ph_word> | hola <ph_word> | kepada <ph_word> | estimado <ph_word> | estimada <ph_word> | estimado a <ph_word> | sehr geehrte <ph_word> | sehr geehrter <ph_word> | sehr geehrte r <ph_word>
cher <ph_word> | chère <ph_word> | caro <ph_word> | cara <ph_word> | prezado <ph_word> | prezada <ph_word> | 亲爱的 <ph_word> | 尊敬的 <ph_word> | 様 <ph_word> | thank <ph_word> | thanks <ph_word> | thanks to <ph_word> | thank you <ph_word> | gracias <ph_word>
welcome to <ph_word> | congratulations <ph_word> | see you <ph_word> | by <ph_word> | on <ph_word> | at <ph_word> | in <ph_word> | of <ph_word> | from <ph_word> | for <ph_word> | to <ph_word> | the <ph_word> | your <ph_word> | our <ph_word> | is <ph_word> | was <ph_word> | day <ph_word>
"""
# Ordinary sentences about the same things; a window nearer to one of these is no match.
ORDINARY = """
the website gave me error <n> when i tried to sign up | the site kept showing an error all morning | the server crashed when registration opened | the page would not load for an hour | the tracking app asked me to turn on location
we were told access denied at the gate | i had to prove that i am not a robot | i write javascript for a living | the results were not available until monday | he said hello world to everybody | i saw it <ph_word> photo | look easy <ph_word>
"""

# a field name: words joined by _ or -, or a few words of a label; never numbers or sentences
_NAME = r"[A-Za-zÀ-ÿ][\w.\-|]*"
_PLACEHOLDERS = [
    re.compile(r"\{\{[^{}\n]{0,80}\}\}|\{%[^%\n]{0,120}%\}|<%[^%\n]{0,120}%>|\$\{[^{}\n]{1,60}\}|\*\|[^|\n]{1,60}\|\*|\[\[[^\[\]\n]{0,60}\]\]|@@\w{1,40}@@|\$\$\w{2,40}\$\$|%%\w{2,40}%%|%\([A-Za-z_]\w*\)[sd]|<<\s?\w[\w ]{1,40}>>|\[%[^%\n]{1,60}%\]|#\{[^{}\n]{1,60}\}"),
    re.compile(r"(?<![\w#])#[A-Za-z]+(?:_[A-Za-z]+)*#(?!\w)|(?<![\w%])%[A-Za-z]+(?:_[A-Za-z]+)*%(?!\w)|(?<![\w$])\$[A-Za-z]+(?:_[A-Za-z]+)*\$(?!\w)|(?<!\w)__[A-Za-z]+(?:_[A-Za-z]+)*__(?!\w)"),
    re.compile(r"\b[A-Za-z]\w*_PLACEHOLDER\b|\bPLACEHOLDER_\w+|\b[A-Z]+(?:_[A-Z]+)*_HERE\b|\bINSERT_[A-Z_]+\b|\bYOUR_[A-Z_]+\b|\bREPLACE_ME\b"),
    re.compile(r"<(?:insert|enter|your|add)\s[^<>\n]{1,40}>|[\[(](?:insert|enter|add|your|placeholder|dein|ihr|votre|tu|su|masukkan|isi)\s[^\[\]()\n]{1,40}[\])]|\[(?:gallery|caption|contact-form|embed|shortcode)\b[^\]\n]{0,60}\]|\((?:NAME|TITLE|DATE|PHOTO|QUOTE|TBC|TBA|TBD)(?: TO (?:COME|FOLLOW))?\)", re.I),
    re.compile(r"\b(?:XX[:/.-]){1,3}XX\b|\bDD/MM/YYYY\b|\bMM/DD/YYYY\b|\bYYYY-MM-DD\b"),
]
#: One word in single brackets is a field only where it is written as a name: capitals, several joined words, or after a greeting.
_SINGLE = re.compile(r"[\[{<【]\s?([A-Za-zÀ-ÿ一-鿿]+(?:[_ .][A-Za-zÀ-ÿ]+){0,3})\s?[\]}>】]")
_GREETING = re.compile(r"(?:dear|hello|hi|hey|hai|hallo|hola|kepada|estimad[oa](?:\(a\))?|sehr geehrte/?r?|cher|chère|caro|cara|prezad[oa]|亲爱的|尊敬的|様|thanks?(?: to)?|thank you|gracias|welcome to|congratulations)\s*[^\n.!?]{0,12}$", re.I)
#: Before a word that names a field, any of these shows that the name stands for its value.
_BEFORE = re.compile(r"(?:\b(?:by|on|at|in|of|from|for|to|the|your|our|is|was|see you|day):?)\s*$", re.I)
_FIELD_WORD = re.compile(r"(?:first|last|full|user|given|sur|nick|runner|event|race|city|club|team|sponsor|friend|author|company|customer|your|start|finish|chip|product|order|email|phone|date|time|name|title|rank|distance|coupon|venue|bib|nama|nombre|apellido|vorname|nachname|anrede|nom|prénom|nome|姓名|名字|名前|称呼)", re.I)
_NULLS = re.compile(r"(?:dear|hello|hi|hey)\s+(?:null|undefined|none|nan)\b|\bnull null\b|\bundefined undefined\b|\bin NaN (?:minutes|seconds|hours)\b|\bN/A(?:\s+N/A){2,}", re.I)


#: Type of field by the pattern that it has.
_FIELDS = ("ph_code", "ph_sign", "ph_caps", "ph_label", "ph_date")


def fields(text: str) -> list[tuple[int, int, str, bool]]:
    """Spans that have the syntax of a field, with their type and whether the patterns take them for one that nobody filled in."""
    out = []
    if any(c in text for c in "{[<%$#@_(*【") or "XX" in text or "DD" in text or "YYYY" in text or "MM/" in text:
        for rx, kind in zip(_PLACEHOLDERS, _FIELDS, strict=True):
            out += [(*m.span(), kind, True) for m in rx.finditer(text)]
        for m in _SINGLE.finditer(text):
            inner = m.group(1)
            words = re.split(r"[_ .]", inner)
            greeted = bool(_GREETING.search(text[max(0, m.start() - 40) : m.start()]))
            named = bool(_FIELD_WORD.match(inner))
            if ("_" in inner and (named or inner.isupper() or m.group()[0] == "{")) or (inner.isupper() and len(inner) > 3 and named) or (m.group()[0] == "【" and named):
                out.append((*m.span(), "ph_name", True))
            else:
                valued = named and bool(_BEFORE.search(text[max(0, m.start() - 12) : m.start()]))
                out.append((*m.span(), "ph_word", valued or (greeted and ("_" in inner or (inner.isupper() and len(inner) > 3) or named or len(words) == 1))))
    out += [(*m.span(), "ph_null", True) for m in _NULLS.finditer(text)]
    return out


def placeholders(text: str) -> list[tuple[int, int]]:
    """Spans of fields of a template that nobody filled in, by their patterns alone."""
    return [(a, b) for a, b, _, sure in fields(text) if sure]


def with_fields(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """The text with a typed token in place of every field; of overlapping ones that which the patterns take for a field, then the first and longest."""
    taken: list[tuple[int, int, str]] = []
    for a, b, kind, _ in sorted(spans, key=lambda x: (not x[3], x[0], -x[1])):
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, kind))
    out, last = [], 0
    for a, b, kind in sorted(taken):
        out += [text[last:a], f" <{kind}> "]
        last = b
    return "".join([*out, text[last:]])


_URL = re.compile(r"https?://\S+|(?<!\w)/[\w./-]{2,}|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|my|sg|id|php|html|inc|py)\b(?:/\S*)?", re.I)
_TOKEN = re.compile(r"<(?:n|w|u|ph_[a-z]+|key|rep|qwerty|latin)>|[a-zà-ɏͰ-ԯ]+(?:['’_][a-zà-ɏ]+)*|\d+|[⺀-鿿]|[ぁ-ヿ]|[가-힣]+|[஀-௿]+|[฀-๿]+|[Ḁ-ỿ]+")


_KEYS = re.compile(r"asdf|qwer|qwerty\w*|jkl|zxcv|blah|foo|bar|xxx+|abc|test|lipsum|text|dummy")
_QWERTY = re.compile(r"qwertyuiop\w*|(?:asdf){2,}\w*")
# Latin words of set filler text, for shuffled versions of it.
LATIN = frozenset("dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum vestibulum mauris pellentesque vivamus curabitur praesent suspendisse tincidunt vulputate phasellus fermentum sed quam nunc vitae auctor tempora tempus lectus libero ligula mattis metus morbi neque nibh nisl orci ornare pharetra placerat pulvinar purus risus rutrum sapien scelerisque semper sodales turpis ultrices ultricies urna varius viverra volutpat fringilla adipisci consectetuer diam felis gravida hendrerit iaculis imperdiet justo lacinia lacus laoreet leo lobortis luctus maecenas malesuada".split())
STEMS = ("adipis", "consect", "fringil", "praes", "pellentes", "incidid", "exercitat", "reprehend", "cupidat", "vestibul")
#: Sorts of filler words, and how many of one sort a passage needs before its words are typed.
_RUNS = ("<latin>", "<key>", "<rep>", "<qwerty>")


def tokens(text: str) -> list[str]:
    """Lower-case words, Han and kana by character; numbers and addresses by type."""
    t = text.lower().replace("’", "'")
    t = t if t.isascii() else unicodedata.normalize("NFC", t)
    t = _URL.sub(" <u> ", t)
    return ["<n>" if x.isdigit() else x for x in _TOKEN.findall(t)]


def typed(toks: list[str], sort: str) -> list[str]:
    """The tokens with the filler words of one sort typed."""
    if sort == "<latin>":
        return [sort if t in LATIN or t.startswith(STEMS) else t for t in toks]
    if sort == "<key>":
        return [sort if _KEYS.fullmatch(t) else t for t in toks]
    if sort == "<qwerty>":
        return [sort if _QWERTY.fullmatch(t) else t for t in toks]
    # a word of two letters or more that is one of the two before it
    return [sort if (len(t) > 1 or t == "x") and t[0] != "<" and t in toks[max(0, i - 2) : i] else t for i, t in enumerate(toks)]


#: Typed tokens that any text is full of.
_LIGHT = frozenset(("<n>", "<w>", "<u>"))
#: Other tokens that may stand between a greeting and its field, or among filler words.
LOOSE = 4
#: Share of the tokens of the sentences around a match that matches must make up, where the exemplar has fewer than LONG tokens: talk about an error is mostly other words.
PURE, LONG = 0.4, 8


class Index:
    """Inverted index of the exemplars with their token weights."""

    def __init__(self, idf: dict[str, float], default: float) -> None:
        self.names: list[tuple[str, bool]] = []
        self.sets: list[dict[str, float]] = []
        self.lists: list[list[str]] = []
        self.total: list[float] = []
        self.weights: list[list[float]] = []
        self.post: dict[str, list[int]] = {}
        for kind, text, bad in exemplars():
            toks = tokens(text)
            weight = {t: (0.4 if t in _LIGHT else idf.get(t, default)) for t in toks}
            k = len(self.names)
            self.names.append((kind, bad))
            self.lists.append(toks)
            self.sets.append(weight)
            self.weights.append([weight[t] for t in toks])
            self.total.append(sum(weight[t] for t in toks))
            # the heaviest tokens lead to an exemplar: as many as a window cannot lack that covers enough of it
            lacking = 0.0
            for t in sorted(weight, key=lambda t: (-weight[t], t)):
                if lacking > (1 - COVERAGE) * self.total[k]:
                    break
                lacking += weight[t] * toks.count(t)
                self.post.setdefault(t, []).append(k)

    def containment(self, k: int, window: list[str]) -> float:
        """Weighted share of exemplar ``k`` found in the window in order, with at most a third of other tokens in between."""
        want, w = self.lists[k], self.sets[k]
        # longest common subsequence by weight
        row = [0.0] * (len(want) + 1)
        for tok in window:
            if tok in w:
                last = 0.0
                for j, x in enumerate(want, 1):
                    keep = row[j]
                    if x == tok:
                        row[j] = max(row[j], last + w[x])
                    if row[j - 1] > row[j]:
                        row[j] = row[j - 1]
                    last = keep
        return row[-1] / self.total[k] if self.total[k] else 0.0

    def best(self, toks: list[str], sentence: list[int], only: str = "") -> tuple[float, str] | None:
        """Best match of residue (of one kind) over all windows of a passage whose tokens have sentence numbers; None where ordinary exemplars fit better."""
        hits: dict[int, list[int]] = {}
        for i, t in enumerate(toks):
            if t in self.post:
                for k in self.post[t]:
                    hits.setdefault(k, []).append(i)
        # matches (containment, kind, start, end, exemplar, whether it needs no more than itself), and the best of the ordinary exemplars
        matches: list[tuple[float, str, int, int, int, bool]] = []
        good = 0.0
        for k, at in hits.items():
            kind, bad = self.names[k]
            if only and bad and kind != only:
                continue
            want = self.lists[k]
            n = len(want)
            loose = want[-1] == "<ph_word>" or want[0] == "<latin>"
            size = n + (LOOSE if loose else max(1, n // 4))
            seen = set()
            for i in at:
                # every window that starts such that it can hold the exemplar around this hit
                for start in {max(0, i - size + 1), max(0, i - n + 1), max(0, i - n // 2), i}:
                    if start in seen:
                        continue
                    seen.add(start)
                    window = toks[start : start + size]
                    there = set(window)
                    if want[-1].startswith("<ph_") and want[-1] not in there:
                        continue  # the words around a field without the field
                    if sum(w for t, w in zip(want, self.weights[k], strict=True) if t in there) < COVERAGE * self.total[k]:
                        continue  # not even out of order
                    c = self.containment(k, window)
                    if not bad:
                        good = max(good, c)
                    elif c >= COVERAGE:
                        matches.append((c, kind, start, start + len(window), k, loose or n >= LONG or want[0].startswith("<ph_") or want[0] == "<qwerty>"))
        matches.sort(reverse=True)
        for c, kind, a, b, _, alone in matches:
            if c >= good and (alone or self._pure(matches, toks, sentence, a, b)):
                return c, kind
        return None

    def _pure(self, matches: list[tuple], toks: list[str], sentence: list[int], a: int, b: int) -> bool:
        """Whether the sentences that a match stands in are made of matches for a good part."""
        in_match = [False] * len(toks)
        for _, _, lo, hi, k, _ in matches:
            own = self.sets[k]
            for i in range(lo, hi):
                in_match[i] = in_match[i] or toks[i] in own
        around = {sentence[i] for i in range(a, b) if in_match[i]}
        lo, hi = a, b
        while lo > 0 and sentence[lo - 1] in around:
            lo -= 1
        while hi < len(toks) and sentence[hi] in around:
            hi += 1
        inside = [i for i in range(lo, hi) if sentence[i] in around and toks[i] != "<u>"]
        return sum(in_match[i] for i in inside) >= PURE * len(inside)


def exemplars() -> list[tuple[str, str, bool]]:
    out = []
    for kind, block in RESIDUE.items():
        out += [(kind, x.strip(), True) for line in block.strip().splitlines() for x in line.split("|") if x.strip()]
    return out + [("ordinary", x.strip(), False) for line in ORDINARY.strip().splitlines() for x in line.split("|") if x.strip()]


def passages(text: str) -> list[str]:
    """Lines, with their sentences kept together; windows run over the tokens inside."""
    return [p for p in re.split(r"\n+", text) if p.strip()]


def sentences(passage: str) -> tuple[list[str], list[int]]:
    """Tokens of a passage and the number of the sentence that each stands in; quotes are no sentences of their own."""
    toks: list[str] = []
    number: list[int] = []
    for k, s in enumerate(re.split(r"(?<=[.!?…|])\s+|(?<=[。！？])|\s[|•·]\s", passage)):
        now = tokens(s)
        toks += now
        number += [k] * len(now)
    return toks, number


def classify(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float]]:
    """(kind, coverage) for each kind of residue in a text; empty where there is none."""
    found: dict[str, float] = {}

    def match(toks: list[str], number: list[int], only: str = "") -> None:
        hit = index.best(toks, number, only)
        if hit and hit[0] >= coverage:
            found[hit[1]] = max(found.get(hit[1], 0.0), hit[0])

    for p in passages(text):
        toks, number = sentences(p)
        if toks:
            match(toks, number)
            for sort in _RUNS:
                stream = typed(toks, sort)
                if sort in stream:
                    match(stream, number, "filler")
    spans = fields(text)
    if spans:
        typed_text = with_fields(text, spans)
        before = dict(found)
        for p in passages(typed_text):
            if "<ph_" in p:
                match(*sentences(p), "placeholder")
        # the check after the match: some field must be one that nobody filled in
        if "placeholder" in found and not any(sure for *_, sure in spans):
            found = before
    return sorted(found.items())


def token_weights(docs: DataFrame, text: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequencies over all documents of the exemplars' own tokens: a list as long as the exemplars."""
    own = frozenset(t for _, x, _ in exemplars() for t in tokens(x) if t not in _LIGHT)

    @F.pandas_udf("array<string>")
    def mine(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if not t else sorted(own_tokens(t, own)))

    there = docs.select(F.explode(F.concat(mine.asNondeterministic()(F.col(text)), F.array(F.lit("")))).alias("t"))
    have = {r["t"]: r["n"] for r in there.groupBy("t").agg(F.count("*").alias("n")).collect()}  # no more rows than the exemplars have tokens
    n = max(1, have.get("", 0))
    # weights between those of a word in every third document and of one in a thousandth: the scale does not move with the corpus
    return {t: min(7.0, max(1.0, math.log((n + 1) / (have.get(t, 0) + 1)))) for t in own}, 7.0


def own_tokens(text: str, own: frozenset[str]) -> set[str]:
    """Those of the exemplars' tokens that a text holds, typed ones included."""
    spans = fields(text)
    toks = set(tokens(text))
    out = toks & own | {f"<{kind}>" for _, _, kind, _ in spans}
    out |= {sort for sort in _RUNS[:2] + _RUNS[3:] if any(map(lambda t: t == sort, typed(sorted(toks), sort)))}
    return out & own


def find_residue(docs: DataFrame, id_col: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Documents with residue: id, ``kinds`` (array of kind and coverage). Documents that are NULL or empty are no cases.

    Two narrow passes: one for the weights, one for the matches; no row is shuffled but the small counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(token_weights(docs, text))

    @F.pandas_udf("array<struct<kind:string,coverage:double>>")
    def udf(texts: pd.Series) -> pd.Series:
        index = Index(*shared.value)
        return texts.map(lambda t: [] if not t else [{"kind": k, "coverage": c} for k, c in classify(t, index, coverage)])

    return docs.select(F.col(id_col), udf.asNondeterministic()(F.col(text)).alias("kinds")).filter(F.size("kinds") > 0)
