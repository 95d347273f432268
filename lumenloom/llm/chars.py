"""Character classes shared by the text operators of this subpackage."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin one (lower case and capitals).
CYRILLIC_LIKE = dict(zip("асеорхуіјѕԁһӏԛԝкмтвпАВЕКМНОРСТХІЈЅУԚԜҮӀ", "aceopxyijsdhlqwkmtbnABEKMHOPCTXIJSYQWYI", strict=True))
GREEK_LIKE = dict(zip("αορνικυτηχεσωγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopvikutnxeowyABEZHIKMNOPTYX", strict=True))
OTHER_LIKE = dict(zip("ɑɡıȷɩʟᴀᴄᴅᴇᴊᴋᴍɴᴏᴘʀꜱᴛᴜᴠᴡᴢʏօսոհցѵꞲꓐꓚꓟ", "agijiLACDEJKMNOPRSTUVWZYouunhgvIBCM"[:35], strict=False))
IGNORABLE = frozenset("­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁥⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ﻿ﾠ")
SPACES = frozenset("               　")
LIKE = CYRILLIC_LIKE | GREEK_LIKE | OTHER_LIKE


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """Script of a letter by its Unicode name's first word; '' for anything but a letter."""
    if ch < "\x80":
        return "LATIN" if ch.isalpha() else ""
    if unicodedata.category(ch)[0] != "L" and not is_mark(ch):
        return ""
    name = unicodedata.name(ch, "")
    first = name.split(" ")[0].split("-")[0]
    if first in ("FULLWIDTH", "MATHEMATICAL", "MODIFIER"):
        return "LATIN" if unicodedata.normalize("NFKC", ch).isascii() else first
    return {"HIRAGANA": "KANA", "KATAKANA": "KANA", "HALFWIDTH": "KANA", "FEMININE": "", "MASCULINE": "", "MICRO": "", "IDEOGRAPHIC": "CJK"}.get(first, first)


@lru_cache(maxsize=65536)
def is_mark(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M"


@lru_cache(maxsize=65536)
def is_emoji(ch: str) -> bool:
    """Pictographs, their modifiers, flags and keycap signs."""
    o = ord(ch)
    return 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or 0x2190 <= o <= 0x21FF or 0x2300 <= o <= 0x23FF or 0x2B00 <= o <= 0x2BFF or o in (0xFE0F, 0x20E3, 0x00A9, 0x00AE, 0x2122, 0x3030, 0x303D, 0x3297, 0x3299) or 0xE0020 <= o <= 0xE007F


@lru_cache(maxsize=65536)
def plain(ch: str) -> str:
    """The plain spelling of one styled letter or digit (full width, mathematical, letterlike, enclosed); other characters unchanged."""
    if ch < "\x80":
        return ch
    o = ord(ch)
    if 0xFF01 <= o <= 0xFF5E:
        c = chr(o - 0xFEE0)
        return c if c.isalnum() else ch
    if 0xFF66 <= o <= 0xFF9D:
        return unicodedata.normalize("NFKC", ch)
    if 0x1D400 <= o <= 0x1D7FF or (0x2100 <= o <= 0x214F and unicodedata.category(ch)[0] == "L") or 0x24B6 <= o <= 0x24E9 or 0x2160 <= o <= 0x217F or 0xFB00 <= o <= 0xFB06:
        k = unicodedata.normalize("NFKC", ch)
        return k if k and all(x.isalnum() for x in k) else ch
    if 0x1F130 <= o <= 0x1F149:
        return chr(o - 0x1F130 + 65)
    return ch


@lru_cache(maxsize=65536)
def skeleton(ch: str) -> str:
    """What a letter looks like: its plain form, folded to Latin and lower case where it is drawn like a Latin letter."""
    p = plain(ch)
    return "".join(LIKE.get(c, c) for c in p).lower()


def has_own_script(text: str) -> bool:
    """Whether a text holds Cyrillic or Greek letters that are drawn like no Latin one: then it is written in that script."""
    return any("\u0370" <= c <= "\u052f" and c not in LIKE and c.isalpha() for c in text)
