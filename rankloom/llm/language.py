"""Language identification of mixed-language text.

Each word is scored under every language by the hashed trigram around each of its letters (its
ends count as a letter), smoothed relative frequencies learned by Spark from a bounded sample of labelled documents. The scripts of a word's
letters narrow the candidates to the languages that use that script. Viterbi over the words, with a
penalty for switching, labels spans; the language of most letters is the prediction.

Null text, and text without a letter, is `und` with score 0 and no spans. Documents without a
language (null) don't train. With nothing to learn from, every text is `und`. Where no learned
language uses a script, all are candidates. Ties go to the language that sorts first. Repeated
rows train as often as they occur and are predicted alike. Every language that has a row to learn from is learned; the table
of log-probabilities takes a quarter of a megabyte for each. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import field, hash_bound, map_texts, slices

BITS = 16
MAX_TRAIN = 20_000
SWITCH = 8.0
SMOOTHING = 0.5
#: Bytes of text that are scored together.
PART_BYTES = 2 << 20
#: Share of a language's letters that a script must have to count as its own.
LEAST_SHARE = 0.002
#: First code points of Unicode blocks and the script of their letters; a fixed public table.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Asian"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
]
_FIRST = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])
#: Code points beyond this one count as Han letters.
PLANES = 0x30000
EDGE = 1


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, whether it is part of words, its small form, its script."""
    kinds = [unicodedata.category(chr(c))[0] if not 0xD800 <= c < 0xE000 else "C" for c in range(PLANES)]
    letter = np.array([k == "L" for k in kinds])
    small = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(PLANES)], np.uint32)
    script = _SCRIPT[np.searchsorted(_FIRST, np.arange(PLANES), side="right") - 1].astype(np.int8)
    return letter, letter | np.array([k == "M" for k in kinds]), small, script


class Words:
    """The words of some texts, as array work over their code points: runs of letters and marks that begin with a letter."""

    def __init__(self, texts: list[bytes]):
        letter, inside, small, script = characters()
        codes = [np.frombuffer(t.decode(errors="replace").encode("utf-32-le"), np.uint32) for t in texts]
        gap = np.array([0x20], np.uint32)
        c = np.minimum(np.concatenate([gap, *(x for y in codes for x in (y, gap))]), PLANES - 1)
        part = inside[c]
        first = part & ~np.concatenate(([False], part[:-1]))
        lone = first & ~letter[c]  # a mark that follows no letter
        while lone.any():
            part = part & ~lone
            first = part & ~np.concatenate(([False], part[:-1]))
            lone = first & ~letter[c]
        place = np.flatnonzero(part)  # of the words' letters and marks
        self.first = np.flatnonzero(first[place])  # of each word among those
        self.letters = np.diff(np.append(self.first, len(place)))
        edge = np.cumsum([len(x) + 1 for x in codes]) + 1
        self.size = np.diff(np.concatenate(([0], np.searchsorted(place[self.first], edge))))
        self.begin = np.cumsum(self.size) - self.size
        own = script[c[place]]
        self.script = own[self.first]
        if len(self.first) and (own != own[0]).any():  # the script of most of a word's letters
            differs = np.logical_or.reduceat(own != np.repeat(self.script, self.letters), self.first)
            for w in np.flatnonzero(differs).tolist():
                self.script[w] = np.bincount(own[self.first[w] : self.first[w] + self.letters[w]]).argmax()
        c = np.where(part, small[c], EDGE).astype(np.uint32)
        h = c[place - 1] * np.uint32(0x9E3779B1) + c[place] * np.uint32(0x85EBCA6B) + c[place + 1] * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.grams = (h >> np.uint32(32 - BITS)).astype(np.int32)


def learn(df: DataFrame, use: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log-probabilities of every hashed n-gram, and which scripts each uses.

    `use` is an expression over `_id`. About `most` documents at the most are taken, by a hash of the id.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").cast("string").alias("_text")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull()).where(use)
    # Every language keeps its own share of the sample.
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return [], np.empty((0, 1 << BITS), np.float32), np.empty((0, len(NAMES)), bool)
    each = max(1, most // len(names))
    kept = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(hash_bound(each, sizes[n])).cast("long"))])
    sample = rows.where(F.xxhash64("_id") <= kept[F.col("_lang")]).select("_lang", "_text")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in slices(batch):
                by: dict[str, list[bytes]] = {}
                for name, t in zip(part.column(0).to_pylist(), texts, strict=True):
                    by.setdefault(name, []).append(t)
                for name, group in by.items():
                    own = counts.setdefault(name, np.zeros((1 << BITS) + len(NAMES), np.int64))
                    words = Words(group)
                    own[: 1 << BITS] += np.bincount(words.grams, minlength=1 << BITS)
                    own[1 << BITS :] += np.bincount(words.script, minlength=len(NAMES))
        for name, own in counts.items():
            i = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(own[i], pa.int64())], names=["lang", "i", "n"])

    table = sample.mapInArrow(run, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toArrow()
    place = {n: k for k, n in enumerate(names)}
    counts = np.zeros((len(names), (1 << BITS) + len(NAMES)))
    counts[[place[x] for x in table.column("lang").to_pylist()], table.column("i").to_numpy()] = table.column("n").to_numpy()
    gram, script = counts[:, : 1 << BITS] + SMOOTHING, counts[:, 1 << BITS :]
    uses = script >= LEAST_SHARE * np.maximum(script.sum(1, keepdims=True), 1)
    uses |= ~uses.any(0)
    return names, np.log(gram / gram.sum(1, keepdims=True)).astype(np.float32), uses


class Steps:
    """Viterbi over stretches of words that step together, for each of the languages a stretch may begin with, or for all at once."""

    def __init__(self, scores: np.ndarray, at: np.ndarray, words: np.ndarray, switch: float, free: bool):
        k = scores.shape[1]
        self.order = np.argsort(-words, kind="stable")
        self.at = at[self.order]
        self.alive = np.searchsorted(-words[self.order], -np.arange(words.max()), side="left")  # stretches longer than each step
        best = np.full((len(at), 1 if free else k, k), -np.inf, np.float32)
        if free:
            best[:, 0] = scores[self.at]
        else:
            best[:, np.arange(k), np.arange(k)] = scores[self.at]
        kind = np.uint8 if k <= 256 else np.uint16 if k <= 65_536 else np.uint32
        self.back = [np.empty((0, 0, 0), kind)]
        own = np.arange(k, dtype=kind)
        for step in range(1, len(self.alive)):
            m = self.alive[step]
            now = best[:m]
            top, which = now[:, :, 0].copy(), np.zeros(now.shape[:2], kind)
            for j in range(1, k):
                which[now[:, :, j] > top] = j
                np.maximum(top, now[:, :, j], out=top)
            top -= switch
            self.back.append(np.where(now >= top[:, :, None], own, which[:, :, None]))
            np.maximum(now, top[:, :, None], out=now)
            now += scores[self.at[:m] + step][:, None, :]
            if step % 64 == 0:  # keep sums small; only differences matter within a stretch
                self.shift(best, m)
        best += self.shifted(best)
        self.best = np.empty_like(best)
        self.best[self.order] = best

    def shift(self, best: np.ndarray, m: int) -> None:
        if not hasattr(self, "moved"):
            self.moved = np.zeros(len(best))
        by = best[:m].max((1, 2))
        best[:m] -= by[:, None, None]
        self.moved[:m] += by

    def shifted(self, best: np.ndarray) -> np.ndarray:
        return getattr(self, "moved", np.zeros(len(best)))[:, None, None].astype(np.float32)

    def trace(self, first: np.ndarray, last: np.ndarray, label: np.ndarray) -> None:
        """Fill in the labels of all stretches, given the languages they begin (0 if all at once) and end with."""
        now, begun = last[self.order].astype(np.int64), first[self.order].astype(np.int64)
        for step in range(len(self.alive) - 1, -1, -1):
            m = self.alive[step]
            label[self.at[:m] + step] = now[:m]
            if step:
                now[:m] = self.back[step][np.arange(m), begun[:m], now[:m]]


def viterbi(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, switch: float, stretch: int = 1024) -> np.ndarray:
    """The best label of every word. scores: words x languages; texts begin at `begin` and have `size` words.

    Texts step together. Those of more than `stretch` words are cut into stretches, followed for every
    language they may begin with and then chained. The result is the exact best path.
    """
    n, k = scores.shape
    label = np.zeros(n, np.int64)
    if not n or k < 2:
        return label
    short = np.flatnonzero((size > 0) & (size <= stretch))
    if len(short):
        steps = Steps(scores, begin[short], size[short], switch, True)
        steps.trace(np.zeros(len(short), np.int64), steps.best[:, 0].argmax(1), label)
    long = np.flatnonzero(size > stretch)
    if not len(long):
        return label
    begin, size = begin[long], size[long]
    count = -(-size // stretch)
    first_of = np.cumsum(count) - count
    text = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(text)) - first_of[text]  # of the stretch in its text
    steps = Steps(scores, begin[text] + place * stretch, np.minimum(size[text] - place * stretch, stretch), switch, False)
    whole = steps.best.astype(np.float64)
    chain = np.argsort(-count, kind="stable")
    longest = int(count.max())
    left = np.searchsorted(-count[chain], -np.arange(longest), side="left")
    enter = np.zeros((len(text), k), np.int64)  # the first language that leads to each last one
    came = np.zeros((len(text), k), np.int64)  # the last language before each first one
    value = np.zeros((len(size), k))
    for step in range(longest):
        t = chain[: left[step]]
        s = first_of[t] + step
        start = np.zeros((len(t), k))
        if step:
            top = value[t].argmax(1)
            jump = value[t, top][:, None] - switch
            came[s] = np.where(value[t] >= jump, np.arange(k), top[:, None])
            start = np.maximum(value[t], jump)
        total = start[:, :, None] + whole[s]
        enter[s] = total.argmax(1)
        value[t] = total.max(1)
    first, last = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    state = value.argmax(1)
    for step in range(longest - 1, -1, -1):
        t = chain[: left[step]]
        s = first_of[t] + step
        last[s] = state[t]
        first[s] = enter[s, state[t]]
        state[t] = came[s, first[s]]
    steps.trace(first, last, label)
    return label


def labelled(df: DataFrame, model: tuple, *, keep: list[str], text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The columns `keep`, `_lang`, `_score` (its share of the letters) and `_spans` (language:first word:words, words from 0)."""
    names, table, uses = model
    by_gram = np.ascontiguousarray(table.T)

    def found(texts):
        words = Words(texts)
        n, k = len(words.first), len(names)
        if not n or not k:
            return [("und", 0.0, [])] * len(texts)
        scores = np.add.reduceat(by_gram[words.grams], words.first, axis=0)
        if not uses.all():
            scores = np.where(uses.T[words.script], scores, scores.min(1, keepdims=True) - 50)
        label = viterbi(scores, words.begin, words.size, switch)
        out = []
        for b, m in zip(words.begin.tolist(), words.size.tolist(), strict=True):
            if not m:
                out.append(("und", 0.0, []))
                continue
            own = label[b : b + m]
            share = np.bincount(own, weights=words.letters[b : b + m], minlength=k)
            edge = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [m])).tolist()
            out.append((names[int(share.argmax())], float(share.max() / share.sum()), [f"{names[own[a]]}:{a}:{c - a}" for a, c in zip(edge[:-1], edge[1:], strict=True)]))
        return out

    def work(texts):
        rows, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= PART_BYTES:
                rows += found(held)
                held, size = [], 0
        rows += found(held) if held else []
        lang, score, spans = zip(*rows, strict=True) if rows else ([], [], [])
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.string()))]

    return map_texts(df, keep, text, [field("_lang", "string"), field("_score", "double"), field("_spans", "strings")], work)
