"""Problem 1: the language of each document and of each stretch of a mixed one.

A bidirectional gated recurrent network reads bytes and labels every
position; it is trained here, by backpropagation through time, on a bounded
sample of labelled rows whose labels are cleaned by the network's own first
round. Pooled position probabilities give the document's language; a Viterbi
pass over words with a price for each change gives the stretches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions.text import SHORT_FORMS
from lumenloom.llm import mojibake, pii
from lumenloom.llm.chars import IGNORABLE, LIKE, has_own_script, plain
from lumenloom.llm.gru import F32, Adam, BiGRU, Reader, pad, softmax

LANGUAGES = ("English", "Malay", "Indonesian", "Chinese", "Tamil", "Japanese", "Spanish", "French", "German", "Portuguese", "Korean", "Thai", "Vietnamese", "Tagalog", "Russian")
# Other names of the same languages, ISO codes among them.
ALIASES = {
    "english": "English", "en": "English", "eng": "English", "inggeris": "English", "inggris": "English",
    "malay": "Malay", "ms": "Malay", "msa": "Malay", "zsm": "Malay", "bahasa melayu": "Malay", "melayu": "Malay", "bahasa malaysia": "Malay",
    "indonesian": "Indonesian", "id": "Indonesian", "ind": "Indonesian", "bahasa indonesia": "Indonesian",
    "chinese": "Chinese", "zh": "Chinese", "zho": "Chinese", "cmn": "Chinese", "mandarin": "Chinese", "mandarin chinese": "Chinese", "中文": "Chinese",
    "tamil": "Tamil", "ta": "Tamil", "tam": "Tamil", "japanese": "Japanese", "ja": "Japanese", "jpn": "Japanese", "spanish": "Spanish", "es": "Spanish", "spa": "Spanish", "español": "Spanish", "castilian": "Spanish",
    "french": "French", "fr": "French", "fra": "French", "français": "French", "german": "German", "de": "German", "deu": "German", "deutsch": "German",
    "portuguese": "Portuguese", "pt": "Portuguese", "por": "Portuguese", "português": "Portuguese", "korean": "Korean", "ko": "Korean", "kor": "Korean", "thai": "Thai", "th": "Thai", "tha": "Thai",
    "vietnamese": "Vietnamese", "vi": "Vietnamese", "vie": "Vietnamese", "tagalog": "Tagalog", "tl": "Tagalog", "fil": "Tagalog", "filipino": "Tagalog", "russian": "Russian", "ru": "Russian", "rus": "Russian",
}

#: Labelled rows per language that the network is fitted on, at most.
SAMPLE_PER_LANGUAGE = 600
HIDDEN = 32
STEPS = (300, 500, 800)  # batches before the labels are cleaned, and after each time
BATCH, CROP = 128, 72
#: Languages that are harder to tell from others in their script, drawn more often; all others once.
WEIGHT = {"Malay": 4, "Indonesian": 4, "English": 4, "Tagalog": 2, "Spanish": 2, "Portuguese": 2, "French": 2, "German": 2}
#: Lead in nats from which the first round overrules the label of a sentence.
REJECT = 8.0
#: Bytes that the network reads in one piece, and that neighbouring pieces share.
PIECE, OVERLAP = 320, 40
#: Texts that are labelled together, and pieces of them that are read side by side.
TEXTS, READ = 2048, 256
#: Price of a change of language between two words, in nats.
CHANGE = 9.0
#: The same between two languages that share most of their words.
CHANGE_NEAR = 60.0
NEAR = ("Malay", "Indonesian")
#: A language is a part of a text from this share of its letters.
PART = 0.2
MIN_LETTERS = 6
#: Cells of the table of words that the search for the best path holds at once.
CELLS = 200_000


def known(label: Column) -> Column:
    """The listed name that a label means; NULL for anything else."""
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(F.regexp_replace(label, "[\\s_-]+", " "))))


_DROP = re.compile(r"(?i:https?://|www\.)\S+|\S+@\S+|[#＃@＠][\w.]*\w|(?<![A-Za-z])[Bb][Ii][Bb]\s+[A-Za-z\d]+|(?<![A-Za-z\d])(?=[A-Za-z]*\d)[A-Za-z\d]+(?![A-Za-z\d])|\b[A-Z]{2,}[-_][\w-]+|\[[A-Z_]+\]")
#: Emoji, invisible characters and signs beyond ASCII: blanks, or nothing inside a word.
_SIGNS = re.compile("[¡-©«-´¶-¹»-¿‐-‧‰-⁞₠-⯿　-〄〈-〰！-／：-＠［-｀｛-･️\U0001f000-\U0001faff]+")
_HIDDEN = re.compile("[" + "".join(map(re.escape, sorted(IGNORABLE))) + "]+")
_STYLED = re.compile("[０-ｚｦ-ﾝ℀-⅏Ⅰ-ⅿⒶ-ⓩﬀ-ﬆ\U0001d400-\U0001d7ff\U0001f130-\U0001f149]")
_FOLD = str.maketrans(LIKE)
_FOREIGN = re.compile("[" + "".join(map(re.escape, sorted(LIKE))) + "]")
#: Two or more words with capitals inside a sentence: a name, whatever language it is in.
_PROPER = re.compile(r"(?<=[a-zß-ÿ,] )[A-ZÀ-Þ][\w'’]+(?: [A-ZÀ-Þ][\w'’]+)+")
_CAPITAL = re.compile(r"(?<![^\W_])[A-ZÀ-Þ]")
#: A title with the name after it.
_TITLED = re.compile(rf"(?<!\w)(?i:{pii.TITLE})\.?\s[A-ZÀ-Þ][\w'’]+(?:\s[A-ZÀ-Þ][\w'’]+)*")
#: What could not be restored says nothing about the language.
_LOST = re.compile("\\S*�\\S*")
#: Malay short forms that no other listed language has; two of them make a text one that is written in short forms.
_SURE_FORMS = frozenset(SHORT_FORMS) - {"ni", "tu", "je", "org", "lg", "kat", "tak", "sy"}
_WORDS = re.compile(r"[^\W\d_]+")


_DIGIT = re.compile(r"\d")


#: What ``_DROP`` can't do without, in a stretch without blanks.
_TOKEN = re.compile(r"\S*[#＃@＠:.\d\[_-]\S*")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def _dropped(m: re.Match) -> str:
    token = m.group()
    return _dropped_kept(token) if len(token) <= 32 else _DROP.sub(_blank, token)


@lru_cache(maxsize=32768)
def _dropped_kept(token: str) -> str:
    return _DROP.sub(_blank, token)


def clean(text: str) -> str:
    """The text that can be in a language: repaired, plain letters; tags, handles, names, addresses, codes, signs and emoji become blanks."""
    if not text.isascii():
        text = mojibake.repair(text)[0]
        if "�" in text:
            text = _LOST.sub(_blank, text)
        text = _HIDDEN.sub("", text)
        # ends of sentences stay, emoji and other signs go
        text = _SIGNS.sub(lambda m: ". " if m.group()[0] in "。！？" else " ", text)
        if not text.isascii():
            if _STYLED.search(text):
                text = "".join(map(plain, text))
            text = unicodedata.normalize("NFC", text)
            if _FOREIGN.search(text) and not has_own_script(text):
                text = text.translate(_FOLD)
    words = {*_WORDS.findall(text.lower())}
    if not pii._STREETS.isdisjoint(words) and _DIGIT.search(text):
        # street addresses are names, whatever language they are in
        for rx in (pii._ADDRESS, pii._UNIT_STREET):
            text = rx.sub(_blank, text)
    if not pii._TITLE_WORDS.isdisjoint(words) or "ſ" in text:
        text = _TITLED.sub(_blank, text)
    for rx in pii._patterns(text):
        text = rx.sub(lambda m: m.group()[: m.start("a") - m.start()] + " " * (m.end() - m.start("a")), text)
    # only a bib number reaches over a blank
    text = _DROP.sub(_blank, text) if "bib" in words else _TOKEN.sub(_dropped, text)
    if _PROPER.search(text) and 2 * len(_CAPITAL.findall(text)) < len(text.split()):
        text = _PROPER.sub(_blank, text)
    return text


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


class Network:
    """Byte-level labeller; ``params`` are numpy arrays and travel as such."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 1, classes: int = len(LANGUAGES)) -> None:
        rng = np.random.default_rng(seed)
        self.layer = BiGRU(257, hidden, rng, "b", straight=True)
        self.params = self.layer.params | {"v": rng.normal(0, 0.1, (2 * hidden, classes)).astype(F32), "o": np.zeros(classes, F32)}

    def load(self, params: dict[str, np.ndarray]) -> Network:
        for k, v in params.items():
            self.params[k] = v
            if k in self.layer.params:
                self.layer.params[k] = v
        return self

    def log_probs(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h, _ = self.layer.forward(ids, lengths)
        return _log_softmax(h @ self.params["v"] + self.params["o"])

    def reader(self) -> Reader:
        """The network as it is now, for reading only: logits without ``o``."""
        return Reader(self.layer, self.params["v"])

    def gradients(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of positions (label -1: none) and of the pooled document probability, with gradients."""
        h, kept = self.layer.forward(ids, lengths, keep=True)
        logits = h @ self.params["v"] + self.params["o"]
        p = softmax(logits)
        mask = (labels >= 0).astype(F32) * weight[:, None]
        n = mask.sum() + 1e-6
        at = np.maximum(labels, 0)[:, :, None]
        took = np.take_along_axis(p, at, 2)[:, :, 0]
        loss = float(-(np.log(took + 1e-9) * mask).sum() / n)
        d = p.copy()
        np.put_along_axis(d, at, took[:, :, None] - 1, 2)
        d *= (mask / n)[:, :, None]
        # pooled probabilities of documents in one language
        one = (labels >= 0).any(1) & (labels.max(1) == np.where(labels >= 0, labels, labels.max(1)[:, None]).min(1))
        if one.any():
            inside = (labels >= 0).astype(F32) * one[:, None]
            count = inside.sum(1) + 1e-6
            pooled = (p * inside[:, :, None]).sum(1) / count[:, None]
            y = labels.max(1)
            mine = pooled[np.arange(len(y)), np.maximum(y, 0)]
            coef = one / (mine + 1e-6) / one.sum() / count
            grad = np.take_along_axis(p, np.maximum(y, 0)[:, None, None] + np.zeros((1, p.shape[1], 1), int), 2)
            extra = p * grad
            np.put_along_axis(extra, np.maximum(y, 0)[:, None, None] + np.zeros((1, p.shape[1], 1), int), np.take_along_axis(extra, np.maximum(y, 0)[:, None, None] + np.zeros((1, p.shape[1], 1), int), 2) - grad, 2)
            d += 0.5 * extra * (coef[:, None] * inside)[:, :, None].astype(F32)
        d = d.astype(F32)
        flat_h, flat_d = h.reshape(-1, h.shape[2]), d.reshape(-1, d.shape[2])
        grads = self.layer.backward(d @ self.params["v"].T, kept)
        return loss, grads | {"v": flat_h.T @ flat_d, "o": flat_d.sum(0)}


def _encode(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.int64) + 1


_LETTER_BYTE = np.zeros(257, bool)
_LETTER_BYTE[[b + 1 for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = True


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+", text) if sum(c.isalpha() for c in s) >= 4]


#: Scripts without blanks: their runs are cut every eight characters.
_UNSPACED = re.compile("([⺀-鿿ぁ-ヿ฀-๿]{8})(?=[⺀-鿿ぁ-ヿ฀-๿])")
_EDGE = re.compile("(?<=[⺀-鿿ぁ-ヿ฀-๿])(?=[A-Za-z])|(?<=[A-Za-z])(?=[⺀-鿿ぁ-ヿ฀-๿])")


def squeeze(text: str) -> str:
    """Words with one blank between them in small letters, as the network reads them; short forms are written out, runs without blanks are cut."""
    words = text.lower().split()
    if sum(w in _SURE_FORMS for w in words) >= 2:
        words = [SHORT_FORMS.get(w, w) for w in words]
    text = " ".join(words)
    return text if text.isascii() else _EDGE.sub(" ", _UNSPACED.sub(r"\1 ", text))


def train(rows: list[tuple[str, str]], seed: int = 7, steps: tuple[int, ...] = STEPS) -> dict[str, np.ndarray]:
    """Fit on (text, language name) rows; sentences whose label a round rejects are left out of the next."""
    rng = np.random.default_rng(seed)
    net = Network(seed=seed)
    adam = Adam(net.params, 4e-3)
    texts = [(LANGUAGES.index(lang), [s for s in map(squeeze, _sentences(clean(text))) if s]) for text, lang in rows]
    items = [(k, s) for k, sentences in texts for s in sentences]
    of = np.array([d for d, (_, sentences) in enumerate(texts) for _ in sentences], np.int64)
    if not items:
        return net.params

    def run(by: list[list[np.ndarray]], n: int, high: float) -> None:
        there = [k for k, v in enumerate(by) for _ in range(WEIGHT.get(LANGUAGES[k], 1)) if v]
        for step in range(n):
            ids, labels = [], []
            for _ in range(BATCH):
                k = there[rng.integers(len(there))]
                x = by[k][rng.integers(len(by[k]))]
                s = rng.integers(max(1, len(x) - CROP + 1))
                x = x[s : s + CROP]
                y = np.where(_LETTER_BYTE[x], k, -1)
                if rng.random() < 0.25:  # two languages side by side
                    k2 = there[rng.integers(len(there))]
                    x2 = by[k2][rng.integers(len(by[k2]))]
                    cut = int(rng.integers(16, CROP - 16))
                    x, y = np.concatenate([x[:cut], [33], x2[: CROP - cut]]), np.concatenate([y[:cut], [-1], np.where(_LETTER_BYTE[x2[: CROP - cut]], k2, -1)])
                ids.append(x)
                labels.append(y)
            a, lengths = pad(ids)
            b = np.full(a.shape, -1)
            for i, y in enumerate(labels):
                b[i, : len(y)] = y
            _, g = net.gradients(a, lengths, b, np.ones(len(a), F32))
            adam.step(g, high * (0.1 + 0.9 * (1 - step / n)))

    def grouped(which: list[tuple[int, str]]) -> list[list[np.ndarray]]:
        by: list[list[np.ndarray]] = [[] for _ in LANGUAGES]
        for k, s in which:
            by[k].append(_encode(s.strip() + " "))
        return by

    near = np.isin(np.arange(len(LANGUAGES)), [LANGUAGES.index(x) for x in NEAR])

    def trusted(apart: bool) -> list[tuple[int, str]]:
        """Sentences with the label of their text, where neither text nor sentence contradicts it; those of a text that surely is in another language with that one.

        Languages that share their words are not told apart before ``apart``, and never take sentences over from each other.
        """
        rows = np.zeros((len(items), len(LANGUAGES)), F32)
        reader = net.reader()
        for i in range(0, len(items), 512):
            # a sentence is judged by its first piece; only rows that fit the network pass here
            some = [_encode(s)[:PIECE] for _, s in items[i : i + 512]]
            for j, (x, logits) in enumerate(zip(some, reader(some), strict=True)):
                rows[i + j] = _log_softmax(logits[_LETTER_BYTE[x]] + net.params["o"]).sum(0)
        whole = np.zeros((len(texts), len(LANGUAGES)), F32)
        np.add.at(whole, of, rows)
        kept = []
        for (k, s), d, row in zip(items, of, rows, strict=True):
            if near[k] and not apart:
                row, total = row.copy(), whole[d].copy()
                row[near], total[near] = row[near].max(), total[near].max()
            else:
                total = whole[d]
            best = k if total[k] == total.max() else int(total.argmax())
            lead = total[best] - total[k]
            mine = k if lead < REJECT else best
            sure = lead > 3 * REJECT and not (near[k] and near[best])
            if (lead < REJECT or sure) and row.max() - row[mine] < REJECT:
                kept.append((mine, s))
        return kept

    run(grouped(items), steps[0], 6e-3)
    for k, n in enumerate(steps[1:]):
        run(grouped(trusted(k > 0)), n, 4e-3)
    return net.params


def sample_rows(df: DataFrame, text: str, label: Column, id_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled rows of each language, by the hash of their id; two narrow passes, no group in one task."""
    named = df.select(F.col(text).alias("t"), label.alias("l"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)).alias("u")).filter(F.col("l").isNotNull() & (F.length("t") > 12))
    counts = {r["l"]: r["n"] for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row per listed language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, int(1.3e6 * per_language / n) + 1))])
    rows = named.filter(F.col("u") < F.element_at(share, F.col("l"))).orderBy("u", "t").limit(2 * per_language * len(LANGUAGES)).collect()
    out, have = [], {}
    for r in rows:
        have[r["l"]] = have.get(r["l"], 0) + 1
        if have[r["l"]] <= per_language:
            out.append((r["t"], r["l"]))
    return out


_LEAD = np.zeros(256, bool)
_LEAD[[b for b in range(256) if b >= 0xC0 or (b < 0x80 and chr(b).isalpha())]] = True


def label_texts(texts: list[str | None], net: Network, change: float = CHANGE, reader: Reader | None = None) -> list[list[tuple[str, int, int, float]]]:
    """For each text its stretches (text, language number, letters, confidence) in order; none where it has no words.

    All bytes of all texts are read, in pieces of bounded length that overlap. ``reader`` saves building that of ``net`` for every call.
    """
    reader = reader or net.reader()
    cleaned = [squeeze(clean(t)) if t else "" for t in texts]
    coded = [t.encode("utf-8") for t in cleaned]
    blob = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    lengths = np.array([len(x) for x in coded], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    pieces: list[tuple[int, int, int]] = []  # begin, end, bytes that the piece before has read better
    for a, n in zip(begin, lengths, strict=False):
        for s in range(0, max(1, n - OVERLAP) if n else 0, PIECE - OVERLAP):
            pieces.append((int(a) + s, int(a + min(n, s + PIECE)), OVERLAP // 2 if s else 0))
    ids_of = blob.astype(np.int64) + 1
    scores = np.zeros((len(blob), len(LANGUAGES)), F32)
    pieces.sort(key=lambda p: p[1] - p[0])
    for k in range(0, len(pieces), READ):
        group = pieces[k : k + READ]
        for (a, b, skip), row in zip(group, reader([ids_of[a:b] for a, b, _ in group]), strict=True):
            scores[a + skip : b] = row[skip:]
    said = np.nonzero(_LETTER_BYTE[ids_of])[0]
    logs = _log_softmax(scores[said] + net.params["o"])
    scores.fill(0)
    scores[said] = logs
    # words of all texts at once
    gap = (blob == 32) | (blob == 10)
    first = np.nonzero(~gap & np.concatenate([[True], gap[:-1]]))[0]
    if not len(first):
        return [[] for _ in texts]
    last = np.nonzero(gap & np.concatenate([[False], ~gap[:-1]]))[0]
    per = np.add.reduceat(scores, first, axis=0)
    letters = np.add.reduceat(_LEAD[blob].astype(np.int64), first)
    # bytes of one character count once
    chars = np.add.reduceat(((blob & 0xC0) != 0x80).astype(np.int64) * ~gap, first)
    per *= (chars / (last - first))[:, None].astype(F32)
    cuts = np.searchsorted(first, begin)
    spans = [slice(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    order = sorted((i for i, x in enumerate(spans) if x.stop > x.start), key=lambda i: spans[i].stop - spans[i].start)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    k = 0
    while k < len(order):
        # texts of like length together, so that a long one does not widen the table of many
        end = k + 1
        while end < len(order) and (end + 1 - k) * (spans[order[end]].stop - spans[order[end]].start) <= CELLS:
            end += 1
        for i, path in zip(order[k:end], _viterbi([per[spans[i]] for i in order[k:end]], change), strict=True):
            x = spans[i]
            starts = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1])
            rows, counts = np.add.reduceat(per[x], starts, axis=0), np.add.reduceat(letters[x], starts)
            ends = np.concatenate([starts[1:], [len(path)]])
            for s, e, row, n in zip(starts, ends, rows, counts, strict=True):
                if n:
                    z, w = row / n, int(path[s])
                    z = np.exp(z - z.max())
                    # bytes, as the words were found there
                    piece = blob[first[x.start + s] : last[x.start + e - 1]].tobytes().decode("utf-8", "replace")
                    out[i].append((piece, w, int(n), float(z[w] / z.sum())))
        k = end
    return out


def _viterbi(rows: list[np.ndarray], change: float) -> list[np.ndarray]:
    """Best path of languages for each (words, languages) table, all tables at once."""
    if not rows:
        return []
    n, w, c = len(rows), max(len(r) for r in rows), rows[0].shape[1]
    table = np.zeros((n, w, c), F32)
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    best = table[:, 0].copy()
    near, rows_ = [LANGUAGES.index(x) for x in NEAR], np.arange(n)
    came = np.zeros((n, w, c), np.int8)
    for k in range(1, w):
        top = best.argmax(1)
        # a path that comes from the near language pays more, so it may come from the best other one
        other = np.where(np.isin(np.arange(c), near)[None], -np.inf, best)
        second = other.argmax(1)
        jump = np.broadcast_to(best[rows_, top][:, None] - change, (n, c)).copy()
        source = np.broadcast_to(top[:, None], (n, c)).copy()
        for a, b in (near, near[::-1]):
            from_near = best[:, b] - CHANGE_NEAR
            from_other = other[rows_, second] - change
            jump[:, a] = np.maximum(from_near, from_other)
            source[:, a] = np.where(from_near > from_other, b, second)
        stay = best >= jump
        came[:, k] = np.where(stay, np.arange(c)[None], source)
        best = np.where(stay, best, jump) + table[:, k]
    # padding adds nothing, so the best end is that of the real last word
    out = []
    last = best.argmax(1)
    for i, r in enumerate(rows):
        k = int(last[i])
        path = np.empty(w, np.int64)
        for t in range(w - 1, -1, -1):
            path[t] = k
            k = int(came[i, t, k])
        out.append(path[: len(r)])
    return out


def summary(stretches: list[tuple[str, int, int, float]], part: float = PART, min_letters: int = MIN_LETTERS) -> list[tuple[str, float, float]]:
    """(language, share of letters, confidence) of each language of a text that is a substantial part, largest first."""
    letters: dict[int, float] = {}
    conf: dict[int, float] = {}
    for _, k, n, c in stretches:
        letters[k] = letters.get(k, 0) + n
        conf[k] = conf.get(k, 0) + n * c
    total = sum(letters.values())
    wide = {LANGUAGES.index(x) for x in ("Chinese", "Japanese", "Korean")}
    # a Han character or syllable block weighs as two letters where a text is short
    if sum(n * (2 if k in wide else 1) for k, n in letters.items()) < min_letters:
        return []
    return [(LANGUAGES[k], n / total, conf[k] / n) for k, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])) if n / total >= part]


def detector(spark: SparkSession, params: dict[str, np.ndarray], stretches: bool = True):
    """Arrow function text -> struct(parts: language, share, confidence; with ``stretches`` these too). NULL and texts without words give empty arrays."""
    shared = spark.sparkContext.broadcast(params)
    parts = "parts array<struct<language:string,share:double,confidence:double>>"

    @F.pandas_udf(parts + ", stretches array<struct<stretch_text:string,language:string,letters:int,confidence:double>>" * stretches)
    def udf(texts: pd.Series) -> pd.DataFrame:
        net = Network().load(shared.value)
        reader = net.reader()
        rows = []
        values = list(texts)
        for i in range(0, len(values), TEXTS):
            for st in label_texts(values[i : i + TEXTS], net, reader=reader):
                row = ([{"language": a, "share": b, "confidence": c} for a, b, c in summary(st)],)
                rows.append((*row, [{"stretch_text": s, "language": LANGUAGES[k], "letters": n, "confidence": c} for s, k, n, c in st]) if stretches else row)
        return pd.DataFrame(rows, columns=["parts", "stretches"][: 1 + stretches])

    return udf.asNondeterministic()
