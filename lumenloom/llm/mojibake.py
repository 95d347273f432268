"""Problem 6: text decoded with the wrong character encoding.

Round-trip repair. A stretch of text is encoded again under a candidate legacy
encoding and strictly decoded as the encoding that was meant. The result is
kept when the garbling cost of the stretch drops, and the search is repeated
on the result for text that was garbled several times over. What still costs
after the last round (replacement characters, control characters, torn
sequences) is reported as not restorable.

Everything is per record, so the operator is a narrow, shuffle-free stage.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.chars import LIKE, is_emoji

#: Encodings that texts are read with by mistake although their bytes are UTF-8.
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-15", "cp866", "koi8-r", "cp874", "cp1258", "cp1254", "cp1253")
#: Multi-byte encodings that UTF-8 bytes are read with by mistake.
MULTI = ("gb18030", "big5hkscs", "cp949", "cp932", "euc_jp")
#: Encodings whose bytes are read as Latin by mistake.
MEANT = ("gb18030", "cp932", "cp949", "big5hkscs", "cp874", "cp1251", "koi8-r", "euc_jp")
MAX_LAYERS = 4


@lru_cache(maxsize=None)
def _bytes(codec: str) -> dict[str, int]:
    """Character to byte for one single-byte encoding; bytes it leaves undefined map as Latin-1 controls."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _utf8_runs(codec: str) -> re.Pattern:
    """Runs of complete UTF-8 sequences as they look in ``codec``."""
    back = {b: re.escape(c) for c, b in _bytes(codec).items()}
    cls = lambda lo, hi: "[" + "".join(back[b] for b in range(lo, hi + 1) if b in back) + "]"
    tail = cls(0x80, 0xBF)
    # a no-break space was often turned into a plain one afterwards
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")


@lru_cache(maxsize=65536)
def char_cost(ch: str) -> float:
    """How odd a character is in well-decoded text."""
    o = ord(ch)
    if o < 0x80:
        return 0.0
    if ch == "�" or 0x80 <= o <= 0x9F or 0xE000 <= o <= 0xF8FF:
        return 4.0
    if is_emoji(ch) and o > 0x2BFF:
        return 0.0
    cat = unicodedata.category(ch)
    name = unicodedata.name(ch, "")
    if cat in ("Cn", "Cc"):
        return 4.0
    if name.startswith(("BOX DRAWINGS", "LIGHT SHADE", "MEDIUM SHADE", "DARK SHADE", "BOPOMOFO")) or ch in "⌐¬∩≡⌠⌡▀▄█▌▐■₧ƒˆ˜¨¯´¸¦¤":
        return 2.0
    if cat in ("So", "Sm", "Sc", "Sk", "No", "Po", "Pi", "Pf", "Pd", "Ps", "Pe", "Pc"):
        return 0.3 if o < 0x2000 or 0x2030 <= o else 0.1
    if cat == "Cf" or cat == "Zs":
        return 0.3
    if 0x4E00 <= o <= 0x9FFF:
        return cjk_cost(ch)
    if 0x3400 <= o <= 0x4DBF or o >= 0x20000:
        return 2.0
    if 0xAC00 <= o <= 0xD7A3:
        try:
            ch.encode("euc_kr")
            return 0.15
        except UnicodeEncodeError:
            return 1.5
    if cat[0] in "LM":
        if o < 0x250:
            return 0.5 if o < 0x100 else 0.6
        if "MATHEMATICAL" in name or 0xFF00 <= o <= 0xFF5E:
            return 0.4
        if 0x400 <= o <= 0x4FF:
            return 0.15 if 0x410 <= o <= 0x44F or o in (0x401, 0x451) else 1.0
        if 0x3040 <= o <= 0x30FF or 0x0B80 <= o <= 0x0BFF or 0x0E00 <= o <= 0x0E7F or 0x1E00 <= o <= 0x1EFF or 0x300 <= o <= 0x36F:
            return 0.15 if o > 0x36F or o < 0x300 else 0.7
        if 0xFF61 <= o <= 0xFF9F:
            return 1.2
        if 0x370 <= o <= 0x3FF:
            return 0.5
        return 1.5
    return 1.0


@lru_cache(maxsize=65536)
def cjk_cost(ch: str) -> float:
    """Han characters: cheap where an everyday character set has them."""
    try:
        b = ch.encode("gb2312")
        if 0xB0 <= b[0] <= 0xD7:
            return 0.15
    except UnicodeEncodeError:
        b = b""
    for codec, low, high in (("big5", 0xA4, 0xC6), ("shift_jis", 0x88, 0x97)):
        try:
            x = ch.encode(codec)
            if low <= x[0] <= high:
                return 0.25
        except UnicodeEncodeError:
            pass
    return 0.9 if b else 2.0


def _latin_high(c: str) -> bool:
    return "\xa0" <= c <= "\xff"


#: Signs of a torn UTF-8 sequence read as Western text: leads followed by what only a continuation byte gives.
TORN = re.compile("ðŸ|â€|Ã[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]|Â[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]|ï¸|ã[€‚ƒ][\x80-\xffŠ‹Œ‘’“”•–—˜™š›œžŸ€‚ƒ„…†‡ˆ‰]|à[¸¹®¯][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]|Ð[\x80-\xbf]|Ñ[\x80-\xbf‚ƒŒ€]|≡ƒ|ΓÇ|├[⌐á¿óúñÑª║íƒ]|√[©±°£ß¥®•†≥∂∫]|‚Ä|Ô∏|рџ|вЂ|в„|вќ|Г©|谩|茅|馃|鈥|锟|ï¿½|ðŸ|ð\x9f|â\x80")
#: Runs of Latin letters above ASCII as they come from other single- or double-byte encodings; words rarely have two of them in a row.
HIGH_RUN = re.compile("[\xa1-\xffŠšŽžŒœŸ€‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›]{4,}")


NATURAL = ("cp1251", "cp866", "koi8-r", "cp874")
ORDINARY = frozenset(map(chr, [*range(0x410, 0x450), 0x401, 0x451, *range(0xE01, 0xE3B), *range(0xE40, 0xE4F)]))
#: Encodings in which a lone pair can't be everyday spelling.
PLAIN_PAIRS = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman")
_THAI = frozenset(map(chr, range(0xE01, 0xE5C)))


def _lone_pairs() -> re.Pattern:
    """One accented letter or sign as a pair of another script or of rare letters, against a Latin letter; neither everyday spelling nor look-alikes."""
    tails: dict[str, set[str]] = {}
    west = _bytes("cp1252")
    for codec in SINGLE:
        if codec in PLAIN_PAIRS:
            continue
        back = {b: c for c, b in _bytes(codec).items()}
        for lead in range(0xC2, 0xC6):
            for tail in range(0x80, 0xC0):
                a, z = back.get(lead), back.get(tail)
                if a and z and not (a in ORDINARY and z in ORDINARY) and not (a in LIKE and z in LIKE) and not (a in west and z in west) and (z != "\xa0" or lead != 0xC2):
                    tails.setdefault(a, set()).add(z)
    pair = "|".join(f"{re.escape(a)}[{''.join(map(re.escape, sorted(z)))}]" for a, z in sorted(tails.items()))
    return re.compile(f"(?<=[A-Za-z])(?:{pair})|(?:{pair})(?<!\xa0)(?=[A-Za-z])")


LONE = _lone_pairs()


#: Stretches above ASCII; texts repeat them (emoji, words, punctuation), so what is known of short ones is kept.
_HIGH = re.compile("[^\x00-\x7f]+")
KEPT = 64


def _stretches(text: str) -> list[tuple[str, bool, bool]]:
    """Stretches above ASCII, each with whether a Latin letter stands before and after it."""
    out = []
    for m in _HIGH.finditer(text):
        a, b = m.span()
        out.append((m.group(), a > 0 and text[a - 1].isalpha(), text[b : b + 1].isalpha()))
    return out


def _in_place(stretch: str, left: bool, right: bool) -> str:
    return ("a" if left else " ") + stretch + ("a" if right else " ")


def _odds(stretch: str, left: bool, right: bool) -> tuple[tuple[float, ...], int]:
    """Costs of the characters of a stretch, and its torn sequences and lone pairs."""
    costs, before = [], ""
    for ch in stretch:
        c = char_cost(ch)
        if before and c >= 0.3 and char_cost(before) >= 0.3:
            costs.append(c + 0.4)
        else:
            costs.append(c)
        before = ch
    return tuple(costs), len(TORN.findall(stretch)) + len(LONE.findall(_in_place(stretch, left, right)))


_odds_kept = lru_cache(maxsize=32768)(_odds)


def cost(text: str) -> float:
    """Garbling cost: odd characters, more where they stand against each other or inside words."""
    total, signs = 0.0, 0
    for s in _stretches(text):
        costs, n = _odds_kept(*s) if len(s[0]) <= KEPT else _odds(*s)
        # one after the other, as the sum of floats depends on the order
        total = reduce(add, costs, total)
        signs += n
    return total + 2.0 * signs


@lru_cache(maxsize=65536)
def _sensible(c: str) -> bool:
    """A character that a decoded stretch may hold: no symbol or rare letter that bytes only hit by chance; controls may be a layer in between."""
    o = ord(c)
    return o < 0xA0 or (char_cost(c) < 0.95 and not 0x2190 <= o <= 0x25FF and not 0x27C0 <= o <= 0x2BFF and not 0x2E80 <= o <= 0x2FFF) or o in (0x2B50, 0x2B55) or 0x2010 <= o <= 0x205F


def _plausible(text: str) -> bool:
    return all(char_cost(c) < 4.0 for c in text) and all(ch >= " " or ch in "\n\t\r" for ch in text)


def _single(run: str, codec: str, deep: bool) -> tuple[str | None, bool, bool]:
    """What a run is as UTF-8 that was read under ``codec``, if it is; whether a text may hold that, and whether it costs less."""
    table = _bytes(codec)
    try:
        meant = bytes(table[c] for c in run).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None, False, False
    layer = deep or any(_utf8_runs(x).search(meant) for x in ("cp1252", "latin-1"))
    return meant, all(_sensible(c) or (layer and c in _bytes("cp1252")) for c in meant), cost(meant) < cost(run)


_single_kept = lru_cache(maxsize=32768)(_single)


def _try_utf8(text: str, codec: str, deep: bool = False) -> tuple[str, bool]:
    """Replace each run that is UTF-8 under ``codec`` by its meaning where that lowers the cost (deep: even where it doesn't, for a layer in between)."""
    table, changed = _bytes(codec), False
    signs: tuple[bool, bool] | None = None

    def alone(m: re.Match, meant: str) -> bool:
        """A lone pair is no everyday spelling: it stands against a Latin letter, or nothing else in the text is in its script."""
        nonlocal signs
        run, before, after = m.group(), text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        left, right = before.isascii() and before.isalpha(), after.isascii() and after.isalpha()
        if LONE.match(text, m.start()) and "\xa0" <= meant <= "ſ" and not (_THAI & {*run}):
            return True
        if signs is None:
            # (letters of the script outside of all runs, a run that can only be garbled)
            rest, own = _utf8_runs(codec).sub("", text), {c for c in table if c.isalpha() and c > "\xff" and not "Ā" <= c <= "ɏ"}
            sure = any((len(x.group()) > 2 and not ORDINARY.issuperset(x.group())) or LONE.match(text, x.start()) for x in _utf8_runs(codec).finditer(text))
            signs = any(c in own for c in rest), sure
        if all(c in ORDINARY for c in run):
            return (left and right and not _THAI & {*run}) or (not signs[0] and (left or right or signs[1]))
        return not signs[0] and (signs[1] or codec in NATURAL or codec == "cp1253") and not all(c in LIKE for c in run)

    def swap(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        meant, sensible, cheaper = _single_kept(run, codec, deep) if len(run) <= KEPT else _single(run, codec, deep)
        if meant is None or not sensible:
            return run
        lone = len(run) == 2 and codec not in PLAIN_PAIRS
        if lone and not alone(m, meant):
            return run
        if len(run) > 2 and codec not in PLAIN_PAIRS and all("\xa0" <= c <= "ſ" for c in meant):
            touch = LONE.search(text, m.start())
            lone = bool(touch and touch.start() < m.end())
        if not deep and not lone and not cheaper:
            return run
        if not lone and codec in NATURAL and all(c in ORDINARY for c in run):
            return run  # ordinary Russian or Thai letters
        changed = True
        return meant

    return _utf8_runs(codec).sub(swap, text), changed


#: One Han character inside a Latin word, where an accented letter belongs.
_INSIDE = re.compile("(?<=[A-Za-z])[\u4e00-\u9fff](?![\u4e00-\u9fff])|(?<![\u4e00-\u9fff])[\u4e00-\u9fff](?=[A-Za-z])")


_PAIRS = re.compile("[¡-￮]{2,}")


def _multi(run: str, codec: str) -> str:
    """A run as UTF-8 that was read in an East Asian encoding, where that lowers the cost; else as it is."""
    try:
        meant = run.encode(codec).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return run
    return meant if _plausible(meant) and cost(meant) + 0.3 < cost(run) else run


_multi_kept = lru_cache(maxsize=32768)(_multi)


def _multi_codecs(run: str) -> tuple[str, ...]:
    return tuple(c for c in MULTI if _multi(run, c) != run)


_multi_codecs_kept = lru_cache(maxsize=32768)(_multi_codecs)


def _try_multi(text: str, codec: str) -> tuple[str, bool]:
    changed = False

    def lone(m: re.Match) -> str:
        nonlocal changed
        try:
            meant = m.group().encode(codec).decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m.group()
        if not "\xa0" <= meant <= "\xff":
            return m.group()
        changed = True
        return meant

    def swap(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        meant = _multi_kept(run, codec) if len(run) <= KEPT else _multi(run, codec)
        changed |= meant != run
        return meant

    return _PAIRS.sub(swap, _INSIDE.sub(lone, text) if codec == "gb18030" else text), changed


_LEGACY = re.compile("[\x21-\x7e\xa0-\xff\x80-\x9fŠšŽžŒœŸ€‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›]*(?:[\xa1-\xff\x80-\x9fŠšŽžŒœŸ€‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›]{2,}[\x20-\x7e]?)+[\xa0-\xff\x80-\x9f\x21-\x7eŠšŽžŒœŸ€‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›]*")


def _high(c: str) -> bool:
    return c >= "\x80"


def _try_legacy(text: str) -> tuple[str, bool]:
    """Runs of Western letters that are the bytes of an Asian or Cyrillic encoding."""
    changed = False

    def swap(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        high = sum(map(_high, run))
        if high < 4 or high < 0.5 * len(run) or not HIGH_RUN.search(run):
            return run
        best, best_cost = run, cost(run)
        for read in ("cp1252", "latin-1"):
            table = _bytes(read)
            try:
                raw = bytes(table[c] for c in run)
            except KeyError:
                continue
            for codec in MEANT:
                try:
                    meant = raw.decode(codec)
                except UnicodeDecodeError:
                    continue
                if _plausible(meant) and (c := cost(meant)) < 0.6 * best_cost:
                    best, best_cost = meant, c
        changed |= best != run
        return best

    return _LEGACY.sub(swap, text), changed


_SAFE = "\U0001f000-\U0001faff☀-➿️‍“”‘’…–—•"
#: What any garbling leaves: two characters above ASCII side by side, a Han character against a Latin one, or a sign of loss.
_GATE = re.compile(f"[^\x00-\x7f{_SAFE}][^\x00-\x7f]|[^\x00-\x7f][^\x00-\x7f{_SAFE}]|[A-Za-z][一-鿿]|[一-鿿][A-Za-z0-9]|[�\x80-\x9f]")


@lru_cache(maxsize=None)
def _ends(codec: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters of one encoding that can begin a UTF-8 sequence, and those that can go on with one."""
    table = _bytes(codec)
    return frozenset(c for c, b in table.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in table.items() if 0x80 <= b <= 0xBF)


def _can_hold(codec: str, high: set[str]) -> bool:
    """Whether a text with these characters above ASCII can hold a UTF-8 run of an encoding at all."""
    first, then = _ends(codec)
    return not first.isdisjoint(high) and not then.isdisjoint(high)


@lru_cache(maxsize=None)
def _any_utf8() -> re.Pattern:
    """The first two characters of a UTF-8 sequence in any single-byte encoding: without them there is none in a text."""
    tails: dict[str, set[str]] = {}
    for codec in SINGLE:
        first, then = _ends(codec)
        for c in first:
            tails.setdefault(c, set()).update(then)
    # leads with the same tails together
    leads: dict[frozenset[str], list[str]] = {}
    for c, t in tails.items():
        leads.setdefault(frozenset(t), []).append(c)
    cls = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
    return re.compile("|".join(cls(v) + cls(k) for k, v in leads.items()))


_PAIR = re.compile("[¡-￮]{2}")
#: Characters of which some stand wherever UTF-8 was read as an East Asian encoding.
_EASTERN = re.compile("[\u4e00-\u9fff\uac00-\ud7af\uff61-\uff9f\ue000-\uf8ff]")


def repair(text: str, max_layers: int = MAX_LAYERS) -> tuple[str, bool, bool]:
    """(restored text, whether a garbled stretch was found, whether nothing garbled is left)."""
    if text.isascii() or not _GATE.search(text):
        return text, False, True
    now, found = text, False
    for _ in range(max_layers):
        best, best_cost, how = now, cost(now), None
        if best_cost < 0.25:
            break
        options = []
        single = SINGLE if _any_utf8().search(now) else ()
        high = {c for c in now if c >= "\x80"} if single else set()
        for codec in single:
            if not _can_hold(codec, high):
                continue
            got, ok = _try_utf8(now, codec)
            if ok:
                # Thai letters cost little, so lone pairs of them inside Latin text count here
                options.append((got, 1.0 if codec == "cp874" and _THAI & {*now} and not _THAI & {*got} else 0.0))
        inside = bool(_INSIDE.search(now))
        if inside or (_PAIR.search(now) and _EASTERN.search(now)):
            # a codec that changes no run changes nothing
            some = MULTI if inside else {c for run in set(_PAIRS.findall(now)) for c in (_multi_codecs_kept(run) if len(run) <= KEPT else _multi_codecs(run))}
            for codec in (c for c in MULTI if c in some):
                got, ok = _try_multi(now, codec)
                if ok:
                    options.append((got, 0.0))
        got, ok = _try_legacy(now) if HIGH_RUN.search(now) else (now, False)
        if ok:
            options.append((got, 0.0))
        # several encodings often give the same text
        for got, gain in dict.fromkeys(options):
            c = cost(got) - gain
            if TORN.search(got) or any("\x80" <= x <= "\x9f" for x in got):
                # a layer in between is judged by what the next one makes of it
                c = min([c, *(cost(x) + 0.1 for x, ok in (_try_utf8(got, codec) for codec in SINGLE[:6]) if ok)])
            if c < best_cost - 0.2:
                best, best_cost, how = got, c, True
        if how is None:
            for first in single[:6]:
                between, ok = _try_utf8(now, first, deep=True) if _can_hold(first, high) else (now, False)
                for second in SINGLE[:6] if ok else ():
                    got, ok = _try_utf8(between, second)
                    if ok and (c := cost(got)) < best_cost - 0.2:
                        best, best_cost, how = got, c, True
        if how is None:
            break
        now, found = best, True
    left = bool(residue(now))
    return now, found or left, not left


_ODD = re.compile("[�\x80-\x84\x86-\x9f]|[┌-╬▀-▟⌐≡∩]|[ㄅ-ㄩ]")


def _remains(stretch: str, left: bool, right: bool) -> bool:
    if _ODD.search(stretch) or TORN.search(stretch) or LONE.search(_in_place(stretch, left, right)):
        return True
    for m in HIGH_RUN.finditer(stretch):
        run = m.group()
        letters = sum(c.isalpha() for c in run)
        odd = sum(c in "¤¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿×ƒˆ˜†‡‰" for c in run)
        if letters >= 3 and (odd or letters >= 4):
            return True
    return False


_remains_kept = lru_cache(maxsize=32768)(_remains)


def residue(text: str) -> bool:
    """Signs of garbling that no round trip removes."""
    return any(_remains_kept(*s) if len(s[0]) <= KEPT else _remains(*s) for s in _stretches(text))


def restore(df: DataFrame, text: str = "original_text") -> DataFrame:
    """Add ``restored_text``, ``was_garbled`` and ``fully_restored`` to every row.

    NULL stays NULL and is not garbled; an empty text is not garbled; texts of
    any length are processed whole. Columns of the same names are replaced.
    """

    @F.pandas_udf("restored_text string, was_garbled boolean, fully_restored boolean")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, False, True) if t is None else repair(t) for t in texts]
        return pd.DataFrame(rows, columns=["restored_text", "was_garbled", "fully_restored"])

    t = F.col(text)
    # plain ASCII is never garbled: such rows do not go to Python
    ascii_only = t.isNull() | ~t.rlike("[^\\x00-\\x7F]")
    # not deterministic: else a later filter would run it twice
    df = df.withColumn("__r", udf.asNondeterministic()(F.when(~ascii_only, t)))
    kept = [c for c in df.columns if c not in ("__r", "restored_text", "was_garbled", "fully_restored")]
    return df.select(*kept, F.coalesce(F.col("__r.restored_text"), t).alias("restored_text"), F.col("__r.was_garbled").alias("was_garbled"), F.col("__r.fully_restored").alias("fully_restored"))
