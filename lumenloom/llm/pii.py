"""Problem 2: personal information inside free text.

Two transducers write a normalised copy of a text beside the source offsets
of every character: the first works on characters (styled forms, look-alikes,
ignorables, odd spaces), the second on words (spelled digits, spaced digits,
``at`` and ``dot`` disguises). Detectors run on the normalised copy; a span
found there is mapped back to source characters, so the rest of the text
stays exactly as it was.

Names need more than their shape: parts of names are first learned from all
rows of the given columns, from patterns that only names have (patronymics,
titles, set phrases); a name is then two or more parts in a row. The most
frequent parts are broadcast; where there are more, the others are a table, and
the words of a record outside the broadcast list are joined with it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.chars import IGNORABLE, LIKE, SPACES, plain, script

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
#: Name parts broadcast to all workers, the most frequent ones: well below a MB. The others are found by a join.
MAX_PARTS = 20_000
MIN_PART_ROWS = 2

# Digits as words in English, Malay/Indonesian and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "kosong": "0", "sifar": "0", "nol": "0", "satu": "1", "dua": "2", "tiga": "3", "empat": "4", "lima": "5", "enam": "6", "tujuh": "7", "lapan": "8", "delapan": "8", "sembilan": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "零": "0", "〇": "0", "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9",
}
# Words of street names and of places, titles, patronymics.
STREET_FIRST = "jalan|jln|jl|lorong|lrg|persiaran|psrn|lebuh|lebuhraya|solok|lengkok|lintang|medan|changkat|pesiaran|leboh|laluan|langgak|gang|rue|avenue|boulevard|calle|avenida|rua|via|đường|phố|kalye|kalsada"
STREET_LAST = "street|st|road|rd|lane|ln|avenue|ave|drive|drv|close|crescent|boulevard|blvd|court|terrace|square|way|grove|mews|walk|straße|strasse|weg|gasse|allee|platz"
PLACE = "menara|dataran|tasik|kampung|kg|stadium|bukit|jambatan|taman|kota|bandar|teluk|pulau|sungai|pantai|masjid|sekolah|hotel|mall|gate|team|kelab|club|jalan|jln|lorong|persiaran|lebuh|solok|pangsapuri|unit|lot|no|hall|park|river|lake|bridge|hill|running|runners|marathon|city|united|harriers|pavilion|plaza|universiti|hospital|pasar"
TITLE = r"dr|encik|en|puan|pn|cik|tuan|mr|mrs|ms|miss|prof|sir|datuk|dato|datin|tan sri|haji|hajah|ustaz|cikgu|herr|frau|señor|señora|sr|sra|don|doña|monsieur|madame|mme"
PATRONYM = r"bin|binti|bte|bt|b\.|a/l|a/p|s/o|d/o|al|anak lelaki|anak perempuan"
# Phrases that a person's name follows.
CUES = r"thanks to|belongs to|birthday|my pacer|my coach|my trainer|jurulatih saya|pelatih saya|pacer saya|kasih kepada|kasih buat|terima kasih banyak buat|banyak buat|milik|atas nama|mi entrenador|mi entrenadora|gracias a|merci à|mon coach|danke an|mein trainer|meu treinador|obrigado a|谢谢|感谢|我的教练|コーチの|contact person|ask for|call me|my name is|nama saya|me llamo|je m'appelle|ich heiße|chiamo|меня зовут|мой тренер|спасибо|я "


_HIGH = re.compile("[^\x00-\x7f]")
_LIKE_SCRIPTS = re.compile("[Ͱ-ԯ]")


def _chars(text: str) -> tuple[list[str], list[int]]:
    """First transducer: one normalised character each with its source offset."""
    if text.isascii():
        return list(text), list(range(len(text)))
    out, at, last = [], [], 0
    latin = bool(_LIKE_SCRIPTS.search(text)) and sum(script(c) == "LATIN" for c in text) * 2 > len(_LIKE_SCRIPTS.findall(text))
    for m in _HIGH.finditer(text):
        i, ch = m.start(), m.group()
        out += text[last:i]
        at += range(last, i)
        last = i + 1
        if ch in IGNORABLE or ch == "️" or ch == "⃣":
            continue
        elif ch in SPACES or ch == "　":
            out.append(" ")
            at.append(i)
        elif ch == "＠" or ch == "﹫":
            out.append("@")
            at.append(i)
        elif ch in "．。" and text[i + 1 : i + 2].isalnum() and text[i + 1 : i + 2] < "\x80" and text[i - 1 : i].isalnum() and text[i - 1 : i] < "\x80":
            out.append(".")
            at.append(i)
        elif ch in "－‐‑–—−﹣":
            out.append("-")
            at.append(i)
        elif ch in "（）＋：，":
            out.append("()+:,"["（）＋：，".index(ch)])
            at.append(i)
        elif "０" <= ch <= "９":
            out.append(chr(ord(ch) - 0xFEE0))
            at.append(i)
        else:
            p = plain(ch)
            if p == ch and latin and ch in LIKE:
                p = LIKE[ch]
            for c in p:
                out.append(c)
                at.append(i)
    out += text[last:]
    at += range(last, len(text))
    return out, at


_AT = re.compile(r"(?<=[\w])\s*(?:[\(\[\{<]\s*(?:at|@|arroba|di)\s*[\)\]\}>])\s*(?=[\w])|(?<=\w)\s+(?:at|arroba)\s+(?=[\w-]+\s*(?:[\(\[\{<]\s*(?:dot|punto|titik)|\s(?:dot|punto|titik)\s))|(?<=\w)\s+@\s+(?=[\w-]+(?:\s*[\(\[\{<]?\s*(?:\.|dot|punto|titik)\s*[\)\]\}>]?\s*)[a-z])", re.I)
_DOT = re.compile(r"(?<=\w)\s*[\(\[\{<]\s*(?:dot|\.|punto|titik)\s*[\)\]\}>]\s*(?=\w)|(?<=\w)\s+(?:dot|punto)\s+(?=\w)", re.I)
_SPELLED = re.compile(r"(?:(?:\b(?:" + "|".join(w for w in DIGIT_WORDS if w.isascii()) + r")\b|\d|[" + "".join(w for w in DIGIT_WORDS if not w.isascii()) + r"])[\s,.\-]*){7,}", re.I)
_ONE = re.compile(r"\b(?:" + "|".join(w for w in DIGIT_WORDS if w.isascii()) + r")\b|[" + "".join(w for w in DIGIT_WORDS if not w.isascii()) + "]", re.I)


_BRACKET_AT = re.compile(r"[\(\[\{<]\s*(?:at|@|arroba|di)\s*[\)\]\}>]|\s@\s")
_HAN_DIGIT = re.compile("[零〇一二三四五六七八九]{2}")
_SPLIT_ASCII = re.compile("[^a-z]+")


def _swap(chars: str, at: list[int], rx: re.Pattern, to) -> tuple[str, list[int]]:
    """Apply one rewriting rule; a rewritten character keeps the offset where its source began."""
    out, pos, last = [], [], 0
    for m in rx.finditer(chars):
        new = to(m)
        if new is None:
            continue
        out.append(chars[last : m.start()])
        pos += at[last : m.start()]
        out.append(new)
        pos += [at[m.start()]] * len(new)
        last = m.end()
    out.append(chars[last:])
    return "".join(out), pos + at[last:]


def normalise(text: str) -> tuple[str, list[int]]:
    """The deobfuscated text and, for each of its characters, the source offset; the list has the source's length at its end."""
    c, at = _chars(text)
    s = "".join(c)
    low = s.lower()
    if "dot" in low or "punto" in low or "titik" in low or "(.)" in low or "[.]" in low:
        s, at = _swap(s, at, _AT, lambda m: "@")
        s, at = _swap(s, at, _DOT, lambda m: "." if "@" in s[max(0, m.start() - 40) : m.end() + 60] else None)
    elif "@ " in s or _BRACKET_AT.search(low):
        s, at = _swap(s, at, _AT, lambda m: "@")
    if (_HAN_DIGIT.search(s) or sum(w in DIGIT_WORDS for w in _SPLIT_ASCII.split(low)) > 1) and _SPELLED.search(s):
        spans = [m.span() for m in _SPELLED.finditer(s) if _ONE.search(m.group())]
        if spans:
            s, at = _swap(s, at, _ONE, lambda m: DIGIT_WORDS[m.group().lower()] if any(a <= m.start() < b for a, b in spans) else None)
    return s, [*at, len(text)]


_MASK = re.compile(r"https?://\S+|(?<![\w.])[#@][\w.]+|\bbib\s+\w+", re.I)
_EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]{0,63}@(?:[a-z0-9](?:[a-z0-9-]{0,62})\.)+[a-z]{2,24}(?![\w@])", re.I)
_DATE = r"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
_ID = re.compile(
    r"(?<![\w+-])(?:"
    rf"\d{{2}}{_DATE}(?P<s>[- ]?)\d{{2}}(?P=s)\d{{4}}"  # birth date, place, serial
    r"|[1-9]\d{5}(?:0[1-9]|[12]\d|3[01]|4[1-9]|[56]\d|7[01])(?:0[1-9]|1[0-2])\d{6}"  # region, day (women +40), month, year, serial
    r"|[1-9]\d{5}(?:19|20)\d{2}" + _DATE + r"\d{3}[\dXx]"  # region, birth date, serial, check
    r"|[STFGMstfgm]\d{7}[A-Za-z]"
    r"|[A-Za-z]\d{7}[A-Za-z]|[A-Za-z]{1,2}[ -]?\d{7,8}"  # passports
    r"|\d{3}-\d{2}-\d{4}|\d{8}[A-Za-z]|[XYZxyz]-?\d{7}-?[A-Za-z]"
    r")(?![\w-]*\d|\w)"
)
_PHONE = re.compile(r"(?<![\w/:.,-])(?:\+\s?\(?\d{1,3}\)?|\(0\d{1,3}\)|00\d{1,3}|0[ .-]?\d{1,3})(?:[ .\-()]{0,3}\d){5,12}(?![\d:/])")
_LOCAL = re.compile(r"(?:call|text|whats ?app|phone|tel|ring|hubungi|telefon|hp|☎|📞|电话|llama al|number is|nombor saya)\D{0,14}?((?<!\d)[2-9]\d{2,3}[ -]?\d{4}(?!\d))", re.I)
_HOUSE = r"(?:(?:(?:no|lot|unit|blok|block|apt|flat|suite|nombor)\b\.?\s*)?[a-z]?-?\d{1,5}[a-z]?(?:\s?[-/]\s?\d{1,4}[a-z]?){0,3})"
_WORD = r"[^\W\d_][\w'’.]*"
_ADDRESS = re.compile(
    rf"(?<![\w:.,/#-])(?<!km )(?<!kilometer )(?<!kilómetro )(?<!pukul )(?<!jam )(?P<h>{_HOUSE}),?\s+(?:(?:pangsapuri|apartment|apartmen|kondominium|flat|residensi|menara|wisma|blok)\s+{_WORD}(?:\s{_WORD})?,\s*)?"
    rf"(?:(?:{STREET_FIRST})\b\.?\s+{_WORD}(?:\s(?-i:[A-ZÀ-Þ])[\w'’]*){{0,2}}(?:\s\d{{1,3}}(?:/\d{{1,3}}[a-z]?)?)?"
    rf"|{_WORD}(?:\s{_WORD})?\s(?:{STREET_LAST})\b\.?)",
    re.I,
)
_ADDRESS_AFTER = re.compile(rf"\b(?:(?:calle|avenida|rua|via)\s{_WORD}(?:\s{_WORD}){{0,3}},?\s(?:n[º°o.]*\s?)?\d{{1,4}}|(?:jl|jalan|jln)\b\.?\s{_WORD}(?:\s{_WORD})?,?\s(?:no|nomor|nomer)\b\.?\s?\d{{1,4}}|{_WORD}(?:straße|strasse|weg|gasse)\s\d{{1,4}})(?!\d|\s?km)", re.I)
_ADDRESS_HAN = re.compile("[一-鿿]{2,8}(?:路|街|道|巷)(?:[一二三四五六七八九十\\d]+巷)?\\d{1,4}(?:号|號|弄)|[一-鿿]{1,6}\\d{1,3}丁目\\d{1,3}")
_UNIT_STREET = re.compile(rf"\b(?:unit|lot|no|blok)\b\.?\s*[a-z]?-?\d{{1,5}}(?:-\d{{1,4}}){{0,3}},\s*(?:[\w' ]{{3,30}},\s*)?(?:{STREET_FIRST})\b\.?\s+{_WORD}", re.I)
_POST = re.compile(rf"[\s,]*(?:\d{{5}}\s+{_WORD}(?:\s[A-ZÀ-Þ][\w'’]*)?|{_WORD}(?:\s{_WORD}){{0,2}}\s\d{{5}})")
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё'’]+(?:-[A-Z][a-z]+)?"
_SEQ = rf"{_CAP}(?:\s{_CAP}){{0,2}}"
_PATRONYMIC = re.compile(rf"(?P<a>{_SEQ})\s(?:{PATRONYM})\s(?P<b>{_CAP}(?:\s{_CAP})?)")
_TITLED = re.compile(rf"(?<!\w)(?:{TITLE})\.?\s(?P<a>{_CAP}(?:\s[A-Z]\.)?(?:\s(?:{PATRONYM}))?(?:\s{_CAP}){{1,3}})")
# a phrase begins a word, where its script has blanks
_CUE = "(?:(?<!\\w)(?i:" + "|".join(c for c in CUES.split("|") if c[0] < "\u2000") + ")|(?:" + "|".join(c for c in CUES.split("|") if c[0] >= "\u2000") + "))"
_CUED = re.compile(rf"{_CUE}\s?(?:(?i:{TITLE})\.?\s)?(?P<a>{_CAP},\s{_CAP}(?:\s{_CAP})?|{_CAP}(?:\s{_CAP})?(?:\s[A-Z]\.)?(?:\s(?:{PATRONYM}))?\s{_CAP})")
# set phrases and titles count in any letter case, the name itself not
_TITLED = re.compile(_TITLED.pattern.replace(f"(?:{TITLE})", f"(?i:{TITLE})", 1))
# words between names that only names have: they count in any letter case
_PATRONYMIC_ANY = re.compile(r"(?<![\w/])(?P<a>[^\W\d_]{3,})\s(?:binti|bte|a/l|a/p|s/o|d/o)\s(?P<b>[^\W\d_]{3,})(?!\w)", re.I)
# where every word has a capital, a name is as short as it can be
_PATRONYMIC_SHORT = re.compile(rf"(?<!\w)(?P<a>{_CAP})\s(?i:bin|binti|bte|a/l|a/p|s/o|d/o)\s(?P<b>{_CAP})")
_CUED_SHORT = re.compile(rf"{_CUE}\s?(?:(?i:{TITLE})\.?\s)?(?P<a>{_CAP}\s(?:(?i:{PATRONYM})\s)?{_CAP})")
# Frequent family names in Han characters, what stands before a name and what may follow it.
SURNAMES = "王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何高林罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾萧蕭田董袁潘蔡余叶葉程苏蘇魏吕呂丁任沈姚卢盧姜崔钟鐘谭譚陆陸范金石廖贾夏韦付方白邹孟熊秦邱江尹薛段雷侯龙龍史陶黎贺顾毛郝龚邵钱严武戴莫孔汤"
_HAN_NAME = re.compile(rf"(?:(?:我叫|名叫|名字是|姓名[:：]?|联系人[:：]?|聯絡人[:：]?)(?P<a>[{SURNAMES}][一-鿿]{{1,2}})(?![一-鿿])|(?:感谢|谢谢|感謝|謝謝)?(?P<b>[{SURNAMES}][一-鿿]{{1,2}})(?=教练|教練|老师|老師|先生|女士|小姐|同学|同學))")
_IS_PLACE = re.compile(rf"(?:{PLACE})", re.I)
_WORDS = re.compile(r"[^\W\d_][\w'’-]*|[a-z]/[a-z]", re.I)


@lru_cache(maxsize=200_000)
def _place(word: str) -> bool:
    return bool(_IS_PLACE.fullmatch(word.rstrip(".")))


_CUE_FIRST = frozenset(w.split()[0].lower() for w in CUES.split("|") if w.isascii() or w[0] < "\u2000")
_CUE_INSIDE = tuple(w for w in CUES.split("|") if w[0] >= "\u2000")
_TITLE_WORDS = frozenset(w.split()[-1] for w in TITLE.split("|"))
_PATRONYM_WORDS = frozenset(PATRONYM.split("|")) - {"b\\.", "anak lelaki", "anak perempuan"} | {"b", "anak"}
_STREETS = frozenset(f"{STREET_FIRST}|{STREET_LAST}".split("|"))
_HAN_STREET = re.compile("[路街道巷目]")
_SPLIT = re.compile(r"[^\w/]+")


_UPPER, _LOWER = re.compile(r"(?<!\S)[A-ZÀ-ÖØ-ÞА-ЯЁ]"), re.compile(r"(?<!\S)[a-zß-öø-ÿа-яё]")


def _street(words: frozenset[str], s: str) -> bool:
    """Whether a text holds a word that an address needs."""
    return not words.isdisjoint(_STREETS) or any(w.endswith(("straße", "strasse", "weg", "gasse")) for w in words) or (not s.isascii() and bool(_HAN_STREET.search(s)))


def _shouted(s: str) -> bool:
    """Whether most words of a text have a capital, so that capitals say nothing."""
    capitals = len(_UPPER.findall(s))
    return capitals > 0.6 * (capitals + len(_LOWER.findall(s))) > 4


def _patterns(s: str, known: frozenset[str] | None = None) -> list[re.Pattern]:
    """The name patterns that can match in a text; none where every word has a capital, as these say nothing then."""
    known = frozenset(_SPLIT.split(s.lower())) if known is None else known
    out = [_PATRONYMIC] * (not known.isdisjoint(_PATRONYM_WORDS)) + [_TITLED] * (not known.isdisjoint(_TITLE_WORDS)) + [_CUED] * (not known.isdisjoint(_CUE_FIRST) or (not s.isascii() and any(c in s for c in _CUE_INSIDE)))
    return [] if out and _shouted(s) else out


def seed_parts(text: str) -> list[str]:
    """Name parts that a text gives away by patterns that only names have, lower-cased."""
    s, _ = normalise(text)
    out = set()
    for rx in _patterns(s):
        for m in rx.finditer(s):
            words = [w for g in m.groups() if g for w in _WORDS.findall(g)]
            words = [w for w in words if len(w) > 2 and not re.fullmatch(PATRONYM, w, re.I)]
            if not any(map(_place, words)):
                out.update(w.lower() for w in words)
    return sorted(out)


_PAT = re.compile(rf"(?:{PATRONYM})", re.I)


def _names(s: str, parts: frozenset[str]) -> list[tuple[int, int]]:
    spans = []
    known = frozenset(_SPLIT.split(s.lower()))
    patterns = _patterns(s, known)
    for rx in patterns:
        for m in rx.finditer(s):
            if any(map(_place, _WORDS.findall(m.group("a")))):
                continue
            spans.append((m.start("a"), m.end()))
    if not known.isdisjoint(_PATRONYM_WORDS):
        spans += [(m.start("a"), m.end()) for m in _PATRONYMIC_ANY.finditer(s) if not (_place(m.group("a")) or _place(m.group("b")))]
    if not patterns and not known.isdisjoint(_PATRONYM_WORDS | _CUE_FIRST) and _shouted(s):
        if not known.isdisjoint(_PATRONYM_WORDS):
            spans += [m.span() for m in _PATRONYMIC_SHORT.finditer(s) if not (_place(m.group("a")) or _place(m.group("b")))]
        if not known.isdisjoint(_CUE_FIRST):
            # one known part makes sure that the two words are a name
            spans += [m.span("a") for m in _CUED_SHORT.finditer(s) if not parts.isdisjoint(w.lower() for w in _WORDS.findall(m.group("a")))]
    if not s.isascii():
        spans += [m.span("a") if m.group("a") else m.span("b") for m in _HAN_NAME.finditer(s)]
    if parts and not parts.isdisjoint(_WORDS.findall(s.lower())):
        run: list[tuple[int, int]] = []
        linked = True

        def close() -> None:
            if len(run) >= 2:
                spans.append((run[0][0], run[-1][1]))
            run.clear()

        for m in _WORDS.finditer(s):
            w = m.group().lower()
            if run:
                gap = s[run[-1][1] : m.start()]
                linked = bool(re.fullmatch(r"(?:\s+(?:[A-Za-z]\.\s+)?(?:(?:bin|binti|bte|bt|a/l|a/p|s/o|d/o|al)\s+)?|,\s+)", gap, re.I))
            if len(w) == 1 or _PAT.fullmatch(w):
                continue
            if w in parts:
                if run and not linked:
                    close()
                run.append(m.span())
            else:
                close()
        close()
    return spans


_DIGIT = re.compile(r"\d")
#: Characters that the first transducer may turn into letters, digits or signs of plain text, or leave out.
_ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿĀ-ſƠ-ưḀ-ỿ‘-”–—…一-鿿、。「-』ぁ-ゖァ-ヺー가-힣！，？஀-௿฀-๿\U0001f000-\U0001faff☀-➿️‍]|\u200d(?![☀-➿\U0001f000-\U0001faff])")
_HAN_SIGNS = re.compile("[零〇一二三四五六七八九]{2}|[路街道巷目]|教练|教練|老师|老師|先生|女士|小姐|同学|同學|叫|名|人")
_SIGN_WORDS = _PATRONYM_WORDS | _TITLE_WORDS | _CUE_FIRST | frozenset(DIGIT_WORDS) | frozenset(("at", "arroba", "dot", "punto", "titik"))


def _nothing(text: str, parts: frozenset[str]) -> bool:
    """Whether a look at the text as it is shows that no detector can find anything: then it needs no transducer."""
    if "@" in text and _AT_SIGN.search(text):
        return False
    if not text.isascii() and (_ODD.search(text) or _HAN_SIGNS.search(text) or any(c in text for c in _CUE_INSIDE)):
        return False
    low = text.lower()
    words = frozenset(_SPLIT.split(low))
    if not words.isdisjoint(_SIGN_WORDS) or not parts.isdisjoint(_WORDS.findall(low)):
        return False
    hidden = _MASK.sub(" ", text)
    digits = len(_DIGIT.findall(hidden))
    return digits < 7 and not (digits and _street(words, text))


#: An at-sign that does not begin a handle.
_AT_SIGN = re.compile(r"[\w.+-]@|@\s|[(\[{<]\s*@")


def find(text: str, parts: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Personal information as (start, end, type) in source characters, in order, not overlapping."""
    if _nothing(text, parts):
        return []
    s, at = normalise(text)
    # addresses of pages, tags and handles are never personal information here
    hidden = _MASK.sub(lambda m: "\x00" * len(m.group()), s)
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if not any(x < b and a < y for x, y, _ in found):
            found.append((a, b, kind))

    if "@" in s:
        for m in _EMAIL.finditer(s):
            add(m.start(), m.end(), "email")
    digits = len(_DIGIT.findall(hidden))
    if digits and _street(frozenset(_SPLIT.split(hidden.lower())), hidden):
        for m in _ADDRESS.finditer(hidden):
            end = m.end()
            if more := _POST.match(hidden, end):
                end = more.end()
            add(m.start(), end, "address")
        for rx in (_UNIT_STREET, _ADDRESS_AFTER, _ADDRESS_HAN):
            for m in rx.finditer(hidden):
                add(m.start(), m.end(), "address")
    if digits >= 7:
        for m in _ID.finditer(hidden):
            if not re.match(r"(?:km|rm|kl)\b", m.group(), re.I):
                add(m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(hidden):
            n = sum(c.isdigit() for c in m.group())
            if (m.group()[0] == "+" and 8 <= n <= 15) or (m.group()[0] != "+" and 9 <= n <= 14):
                add(m.start(), m.end(), "phone")
        for m in _LOCAL.finditer(hidden):
            add(m.start(1), m.end(1), "phone")
    for a, b in _names(hidden, parts):
        add(a, b, "name")
    # the end of a span is the end of its last character's source
    out = []
    for a, b, kind in found:
        start, end = at[a], at[b - 1] + _width(at, b - 1)
        while end - 1 > at[b - 1] and (text[end - 1] in IGNORABLE or text[end - 1].isspace()):
            end -= 1  # what the transducers left out after the last character stays in the text
        out.append((start, end, kind))
    return sorted(out)


def _width(at: list[int], last: int) -> int:
    """Source characters that the normalised character at ``last`` stands for."""
    step = last + 1
    while step < len(at) - 1 and at[step] == at[last]:
        step += 1
    return max(1, at[step] - at[last])


def redact(text: str, parts: frozenset[str] = frozenset()) -> str:
    """The text with typed placeholders; all other characters as they were."""
    out, last = [], 0
    for a, b, kind in find(text, parts):
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*out, text[last:]])


class Parts(list):
    """The most frequent name parts, and in ``tail`` a table of all others (column ``part``) where there are more."""

    tail: DataFrame | None = None


def candidates(text: str, known: frozenset[str]) -> list[str]:
    """Words of a text that can be name parts outside of ``known``, lower-cased as they are looked up."""
    s, _ = normalise(text)
    s = _MASK.sub(lambda m: "\x00" * len(m.group()), s)
    return sorted({w for w in (*_WORDS.findall(s.lower()), *(x.lower() for x in _WORDS.findall(s))) if len(w) > 1} - known)


def learn_parts(frames: list[DataFrame], max_parts: int = MAX_PARTS, min_rows: int = MIN_PART_ROWS) -> Parts:
    """Name parts over every row of the given one-column frames of texts: the most frequent first, at most ``max_parts``, and the others as a table.

    Only the rows that hold a title, a patronymic or a set phrase go to Python.
    """

    @F.pandas_udf("array<string>")
    def seeds(texts: pd.Series) -> pd.Series:
        return texts.map(seed_parts)

    # every pattern has a capital after its title, patronymic or phrase
    plain_cues, other_cues = [c for c in CUES.split("|") if c[0] < "\u2000"], [c for c in CUES.split("|") if c[0] >= "\u2000"]
    gate = rf"(?<!\p{{L}})(?:\p{{Lu}}\p{{L}}+\s(?:{PATRONYM})\s\p{{Lu}}|(?iu:{TITLE})\.?\s\p{{Lu}}|(?iu:{'|'.join(plain_cues)})\s?\p{{Lu}})|(?:{'|'.join(other_cues)})\s?\p{{Lu}}"
    both = None
    for df in frames:
        t = F.col(df.columns[0])
        part = df.filter(t.rlike(gate)).select(F.explode(seeds(t)).alias("part"))
        both = part if both is None else both.unionAll(part)
    counted = both.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    top = [r["part"] for r in counted.orderBy(F.desc("n"), "part").limit(max_parts + 1).collect()]
    parts = Parts(top[:max_parts])
    if len(top) > max_parts:
        listed = counted.sparkSession.createDataFrame([(p,) for p in parts], "part string")
        parts.tail = counted.join(F.broadcast(listed), "part", "left_anti").select("part")
    return parts


def _own_parts(df: DataFrame, text: str, shared, tail: DataFrame) -> DataFrame:
    """Add ``__own``: the parts of the table that a text holds. Equal texts are joined once, by hash."""

    @F.pandas_udf("array<string>")
    def udf(texts: pd.Series) -> pd.Series:
        known = frozenset(shared.value)
        return texts.map(lambda t: candidates(t, known))

    df = df.withColumn("__k", F.sha2(F.col(text), 256))
    words = df.filter(F.col(text).isNotNull()).select("__k", text).dropDuplicates(["__k"]).select("__k", F.explode(udf.asNondeterministic()(F.col(text))).alias("part"))
    own = words.join(tail, "part").groupBy("__k").agg(F.collect_set("part").alias("__own"))
    return df.join(own, "__k", "left").drop("__k")


def detect(df: DataFrame, text: str, parts: list[str]) -> DataFrame:
    """Add ``pii`` (array of start, end, type in code points) and ``redacted_text``.

    NULL gives NULL in both; an empty text has no findings. Texts are read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(parts))
    tail = getattr(parts, "tail", None)

    @F.pandas_udf("pii array<struct<start:int,end:int,pii_type:string>>, redacted_text string")
    def udf(texts: pd.Series, more: pd.Series) -> pd.DataFrame:
        listed = frozenset(shared.value)
        rows = []
        for t, own in zip(texts, more, strict=True):
            known = listed if own is None or not len(own) else listed.union(own)
            if t is None:
                rows.append((None, None))
                continue
            found = find(t, known)
            out, last = [], 0
            for a, b, kind in found:
                out += [t[last:a], PLACEHOLDER[kind]]
                last = b
            rows.append(([{"start": a, "end": b, "pii_type": k} for a, b, k in found], "".join([*out, t[last:]])))
        return pd.DataFrame(rows, columns=["pii", "redacted_text"])

    kept = [c for c in df.columns if c not in ("pii", "redacted_text")]
    df = df.withColumn("__own", F.lit(None).cast("array<string>")) if tail is None else _own_parts(df, text, shared, tail)
    return df.withColumn("__p", udf.asNondeterministic()(F.col(text), F.col("__own"))).select(*kept, F.col("__p.pii").alias("pii"), F.col("__p.redacted_text").alias("redacted_text"))
