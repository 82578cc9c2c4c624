"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a linear score.

Words with leetspeak (`1d10t`), separators (`i.d.i.o.t`, `i d i o t`) or long repetitions (`idiiiot`) are stretches. Each
has a lattice: a disguising character may be itself or a letter it stands for, a separator may be nothing or a space, a
run of a letter may be one, two or all of them. Viterbi finds the most likely reading under a character model of order
`ORDER`, whose counts Spark gathers from all documents. Neither the counts nor the readings pass through the driver:
each distinct stretch is joined with the counts that its lattice needs and read once, and the readings are joined to
the documents that hold the stretch. Small tables are broadcast, after a count; larger ones are joined by shuffles.

The score is a logistic regression over the distinct hashed words and word beginnings of the restored text, each
present or not, trained by follow-the-regularised-leader with a strong L1 on a bounded sample of labelled rows
(`MAX_TRAIN`, a documented parameter).

Null and empty texts have no words and score by the bias alone; with no labelled rows every score is 0.5. Rows without a
label don't train; a document with two labels trains with both. Repeated rows count, train and score alike. A long text
is read whole; its distinct words are what its task holds. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, written
from rankloom.llm.common import field, map_texts, mixed, modest_batches, slices
from rankloom.llm.language import characters
from rankloom.llm.quality_model import Leader, sampled, sigmoid

#: Characters that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
#: What may stand between single letters, and marks at a word's ends that belong to no word.
SEPARATORS = "._-*"
MARKS = ".,;:?\"'()[]{}<>%&#…«»“”`~^=/\\"
ORDER = 4
#: Weights of the model's orders from the highest to the uniform one, and the number of symbols of that.
MIX, SYMBOLS = (0.5, 0.3, 0.15, 0.04, 0.01), 200
#: Log-probabilities of the channel: a disguise for a letter (shared by its letters), a character for itself, one or two letters for a run, a separator for nothing or a space.
DISGUISED, ITSELF, ONE, TWO, NOTHING, SPACE = math.log(0.3), math.log(0.7), math.log(0.3), math.log(0.2), math.log(0.6), math.log(0.4)
BITS = 18
PREFIXES = range(3, 8)
#: Longer words are hashed one by one.
LONG_WORD = 32
MAX_TRAIN = 12_000
EPOCHS, ALPHA = 8, 0.6
#: Words that a worker remembers; rows of a table that is sent to all executors at the most.
CACHE, SENT = 150_000, 1_000_000
OTHER = "#"

_LEET = re.escape("".join(LEET))
_RUN = re.compile(r"([^\W\d_])\1\1")
_DISGUISE = re.compile(rf"[^\W\d_][{_LEET}]|[{_LEET}][^\W\d_]")
_SPACED = re.compile(rf"(?:[^\W_]|[{_LEET}])(?:[{re.escape(SEPARATORS)}](?:[^\W_]|[{_LEET}])){{2,}}")
_SINGLE = re.compile(rf"[^\W\d_]|[{_LEET}]")
_ENDS = re.compile(r"^([^\w\s])\1\1+|([^\w\s])\2\2+$")


def core(word: str) -> str:
    """A word in lower case and without marks at its ends, also without long runs of symbols there."""
    return _ENDS.sub("", word).strip(MARKS).rstrip("!|")


def disguised(word: str) -> bool:
    """Whether a word's core is a stretch: to be read by its lattice."""
    return bool(_RUN.search(word) or not word.isalpha() and (_DISGUISE.search(word) or _SPACED.fullmatch(word)))


def spaced(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of three or more words of one character that may be a letter; at least one is."""
    start = None
    for i, w in enumerate([*words, ""]):
        if len(w) == 1 and _SINGLE.fullmatch(w):
            start = i if start is None else start
        elif start is not None:
            if i - start >= 3 and any(c.isalpha() for c in words[start:i]):
                yield start, i
            start = None


def run_from(stretch: str, i: int) -> int:
    """How often the character at i stands there in a row, if the run begins at i; else 1."""
    n = 1
    while not (i and stretch[i - 1] == stretch[i]) and i + n < len(stretch) and stretch[i + n] == stretch[i]:
        n += 1
    return n


def lattice(stretch: str) -> list[list[tuple[str, int, float]]]:
    """For each place of the stretch the choices (text, characters read, log-probability)."""
    apart = " " in stretch or _SPACED.fullmatch(stretch)
    out = []
    for i, c in enumerate(stretch):
        if c == " " or apart and i % 2 and c in SEPARATORS:
            out.append([("", 1, NOTHING), (" ", 1, SPACE)])
        elif c in LEET:
            n = run_from(stretch, i)
            letters = [(x, DISGUISED - math.log(len(LEET[c]))) for x in LEET[c]]
            out.append([(c, 1, ITSELF), *((x, 1, p) for x, p in letters), *((x, n, p + ONE) for x, p in letters if n >= 3)])
        else:
            n = run_from(stretch, i)
            out.append([(c, 1, 0.0), *([(c, n, ONE), (c + c, n, TWO)] if n >= 3 and c.isalpha() else [])])
    return out


def symbol(c: str) -> str:
    return c if c == " " or c.isalpha() and c <= "\uffff" else OTHER


def number(gram: str) -> int:
    """Up to four symbols as one signed 64-bit integer."""
    value = 0
    for c in gram:
        value = value << 16 | ord(c)
    return value - (1 << 64) if value >> 63 else value


def steps(history: str, text: str) -> tuple[str, list[str]]:
    """The history after `text`, and the grams whose last symbol is each of its own."""
    grams = []
    for c in map(symbol, text):
        history += c
        grams.append(history[-ORDER:])
        history = history[1 - ORDER :]
    return history, grams


def grams_of(stretch: str) -> set[int]:
    """All grams, contexts and lower orders that reading the stretch can ask for."""
    choices, found = lattice(stretch), set()
    states: list[set[str]] = [set() for _ in range(len(stretch) + 1)]
    states[0].add(" ")
    for i, now in enumerate(states):
        for history in now:
            for text, n, _ in choices[i] if i < len(stretch) else [(" ", 0, 0.0)]:
                after, grams = steps(history, text)
                found.update(grams)
                if n:
                    states[i + n].add(after)
    return {number(g[k:j]) for g in found for k in range(len(g)) for j in (len(g) - 1, len(g)) if j > k}


def read(stretch: str, counts: dict[int, int], total: int) -> str:
    """The most likely reading; of equally likely ones the first found."""
    known: dict[str, float] = {}

    def cost(gram: str) -> float:
        if gram not in known:
            p = MIX[ORDER] / SYMBOLS + MIX[ORDER - 1] * counts.get(number(gram[-1]), 0) / max(1, total)
            for k in range(2, len(gram) + 1):
                seen = counts.get(number(gram[-k:-1]), 0)
                p += MIX[ORDER - k] * counts.get(number(gram[-k:]), 0) / seen if seen else 0.0
            known[gram] = math.log(p)
        return known[gram]

    choices = lattice(stretch)
    best: list[dict[str, tuple[float, int, str, str]]] = [{} for _ in range(len(stretch) + 1)]
    best[0][" "] = (0.0, -1, "", "")
    end = (-math.inf, "")
    for i, now in enumerate(best):
        for history, (score, *_) in now.items():
            if i == len(stretch):
                end = max(end, (score + cost((history + " ")[-ORDER:]), history), key=lambda x: x[0])
                continue
            for text, n, channel in choices[i]:
                after, grams = steps(history, text)
                value = score + channel + sum(map(cost, grams))
                if after not in best[i + n] or value > best[i + n][after][0]:
                    best[i + n][after] = (value, i, history, text)
    out, at, history = [], len(stretch), end[1]
    while at:
        _, at, history, text = best[at][history]
        out.append(text)
    return "".join(reversed(out))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of each word, one after another, and how many each has: the word and its beginnings. An empty word has none."""
    n, shift = len(words), np.uint64(64 - BITS)
    codes, length, begin = spelled(words)
    found, has = np.empty((n, 1 + len(PREFIXES)), np.uint64), np.zeros((n, 1 + len(PREFIXES)), bool)
    has[:, 0] = length > 0
    value, whole = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    longer = np.arange(n)
    for k in range(LONG_WORD):
        longer = longer[length[longer] > k]
        if not len(longer):
            break
        value[longer] = value[longer] * np.uint64(0x9E3779B97F4A7C15) + codes[begin[longer] + k] + np.uint64(1)
        if k + 1 in PREFIXES:
            found[:, 1 + PREFIXES.index(k + 1)] = value + np.uint64(k)
            has[:, 1 + PREFIXES.index(k + 1)] = length > k + 1
    whole[:] = value * np.uint64(3)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        whole[i] = xxhash.xxh3_64_intdigest(words[i].encode())
    found[:, 0] = whole
    return (mixed(found[has]) >> shift).astype(np.int64), has.sum(1)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, and the length and the beginning of each."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64), length, np.cumsum(length) - length


def cores(words: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The cores of words and which are stretches. Words of letters between marks, nearly all, are handled together."""
    try:
        low = pc.utf8_trim(pc.utf8_lower(pa.array(words, pa.binary()).cast(pa.string())), characters=MARKS)
    except pa.ArrowInvalid:
        low = pc.utf8_trim(pc.utf8_lower(pa.array([w.decode("utf-8", "replace") for w in words], pa.string())), characters=MARKS)
    found, plain = low.to_pylist(), pc.utf8_is_alpha(low).to_numpy(zero_copy_only=False)
    codes, length, begin = spelled(found)
    stretch = np.zeros(len(words), bool)
    three = np.flatnonzero((codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:]))
    word = np.searchsorted(begin + length, three, side="right")
    stretch[word[three + 2 < (begin + length)[word]]] = True
    stretch &= plain
    for i in np.flatnonzero(~plain).tolist():
        found[i] = core(found[i])
        stretch[i] = disguised(found[i])
    return found, stretch


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; of a few hundred, sorting finds them faster than hashing."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Words:
    """What a worker remembers of words: their cores, features, and whether they are stretches or of one character."""

    def __init__(self, features: bool = True):
        self.wanted = features
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.cores: list[str] = []
        self.stretch, self.single, self.size, self.begin = (np.empty(0, np.int64) for _ in range(4))
        self.features = np.empty(0, np.int64)

    def of(self, found: list[bytes]) -> np.ndarray:
        got = list(map(self.place.get, found))
        missed = [k for k, i in enumerate(got) if i is None]
        if missed:
            new = list(dict.fromkeys(found[k] for k in missed))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            found_cores, stretch = cores(new)
            if self.wanted:
                features, size = word_features(["" if s else c for c, s in zip(found_cores, stretch.tolist(), strict=True)])
                self.begin = np.concatenate((self.begin, len(self.features) + np.cumsum(size) - size))
                self.size = np.concatenate((self.size, size))
                self.features = np.concatenate((self.features, features))
            self.stretch = np.concatenate((self.stretch, stretch.astype(np.int64)))
            self.single = np.concatenate((self.single, np.array([len(c) == 1 and bool(_SINGLE.fullmatch(c)) for c in found_cores], np.int64)))
            self.cores += found_cores
            for k in missed:
                got[k] = self.place[found[k]]
        return np.array(got, np.int64)

    def parted(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
        """Of each text its words, its stretches, and which words belong to none."""
        if len(self.place) > CACHE:
            self.clear()
        found = [t.split() for t in texts]
        every = self.of([w for words in found for w in words])
        ends = np.cumsum([len(words) for words in found])
        for i in np.split(every, ends[:-1]):
            plain = self.stretch[i] == 0
            stretches = [self.cores[k] for k in i[~plain].tolist()]
            single = self.single[i]
            if len(i) > 2 and (single[:-2] & single[1:-1] & single[2:]).any():
                alone = [self.cores[k] if s else "" for k, s in zip(i.tolist(), single.tolist(), strict=True)]
                for start, end in spaced(alone):
                    stretches.append(" ".join(alone[start:end]))
                    plain[start:end] = False
            yield i, stretches, plain

    def features_of(self, i: np.ndarray) -> np.ndarray:
        """Sorted distinct features of words."""
        i = distinct(i)
        size = self.size[i]
        return distinct(self.features[np.repeat(self.begin[i] - np.cumsum(size) + size, size) + np.arange(size.sum())])


def counted_grams(words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all orders within the words, each as often as its word. A gram may begin with the space before its word and end with the one after it."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = " " + " ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    small = codes < 65536
    codes[~small | ~characters()[0][np.where(small, codes, 0)] & (codes != 32)] = ord(OTHER)
    codes = codes.astype(np.uint64)
    word = np.cumsum(codes == 32) - 1  # of a word's symbols and the space before it
    # The longest gram from each place on, its first symbol in the highest bits; shorter ones are its beginnings.
    n, inside = len(codes), word < len(words)
    grams = np.where(inside, codes << np.uint64(48), 0)
    for k in range(1, min(ORDER, n)):
        inside = inside[: n - k] & (word[k - 1 : n - 1] == word[: n - k])
        grams[: n - k] |= np.where(inside, codes[k:] << np.uint64(16 * (ORDER - 1 - k)), 0)
    order = np.argsort(grams)
    keys, counts = summed(grams[order], np.append(times, 0)[word[order]])
    found = []
    for size in range(1, ORDER + 1):
        own = keys >> np.uint64(16 * (ORDER - size))
        there = own & np.uint64(0xFFFF) != 0
        found.append(summed(own[there], counts[there]))
    return np.concatenate([k for k, _ in found]).view(np.int64), np.concatenate([c for _, c in found])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ones, and the sum of the counts of each."""
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gathered(df: DataFrame, text: str) -> DataFrame:
    """(gram, n, stretch), written: partial counts of grams and distinct stretches of each task."""
    modest_batches(df.sparkSession)

    def run(batches):
        words, times, stretches = Words(features=False), np.zeros(0, np.int64), set()

        def out():
            keys, n = counted_grams(words.cores, times)
            found = sorted(stretches)
            empty = [None] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(empty, pa.string())], names=["gram", "n", "stretch"])
            empty = [None] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(empty, pa.int64()), pa.array(empty, pa.int64()), pa.array(found, pa.string())], names=["gram", "n", "stretch"])

        for batch in batches:
            for _, texts in slices(batch):
                if len(words.place) > CACHE or len(stretches) > CACHE:
                    yield from out()
                    words.clear()
                    stretches.clear()
                    times = np.zeros(0, np.int64)
                for i, more, _ in words.parted(texts):
                    stretches.update(more)
                    if len(times) < len(words.cores):
                        times = np.concatenate((times, np.zeros(len(words.cores) - len(times), np.int64)))
                    np.add.at(times, i, 1)
        if words.cores:
            yield from out()

    return written(df.select(F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, "gram long, n long, stretch string"))


def readings(df: DataFrame, text: str = "text", sent: int = SENT) -> DataFrame:
    """(stretch, reading) of every distinct stretch that reads otherwise than it stands, written."""
    rows = gathered(df, text)
    counts = written(rows.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.where((F.col("gram") >= 0) & (F.col("gram") < 65536)).agg(F.sum("n")).first()[0] or 0

    def need(batches):
        for batch in batches:
            for stretch in batch.column(0).to_pylist():
                grams = sorted(grams_of(stretch))
                yield pa.RecordBatch.from_arrays([pa.array([stretch] * len(grams), pa.string()), pa.array(grams, pa.int64())], names=["stretch", "gram"])

    def best(batches):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                stretch, own = batch.column(0)[i].as_py(), batch.column(1)[i].values
                made.append(read(stretch, dict(zip(own.field(0).to_pylist(), own.field(1).to_pylist(), strict=True)), total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["stretch", "reading"])

    distinct = rows.where("stretch IS NOT NULL").select("stretch").distinct()
    wanted = distinct.mapInArrow(need, "stretch string, gram long").join(checked_broadcast(counts, sent), "gram")
    with_counts = wanted.groupBy("stretch").agg(F.collect_list(F.struct("gram", "n")).alias("counts"))
    return written(with_counts.mapInArrow(best, "stretch string, reading string").where("stretch <> reading"))


def featured(df: DataFrame, keep: list[str], text: str, weights: np.ndarray | None = None) -> DataFrame:
    """The columns `keep` and of each text the score `_score`, or, with stretches or without weights, its features `_x` and stretches `_s`; nothing is shuffled."""
    words = Words()

    def work(texts):
        scores, features, stretches = [], [], []
        for i, found, plain in words.parted(texts):
            x = words.features_of(i[plain])
            done = weights is not None and not found
            scores.append(scored(x, weights) if done else None)
            features.append(None if done else x.astype(np.int32))
            stretches.append(None if done else sorted(set(found)))
        return [pa.array(scores, pa.float64()), pa.array(features, pa.list_(pa.int32())), pa.array(stretches, pa.list_(pa.string()))]

    return map_texts(df, keep, text, [field("_score", "double"), field("_x", "ints"), field("_s", "strings")], work)


def scored(x: np.ndarray, weights: np.ndarray) -> float:
    return sigmoid(float(weights[x].sum(dtype=np.float64) + weights[-1]))


def restored(rows: DataFrame, read_as: DataFrame, sent: int = SENT) -> DataFrame:
    """`rows` (a written table with the unique `_row`, `_x` and `_s`) with `_s` as the readings of its stretches."""
    each = rows.select("_row", F.explode("_s").alias("stretch")).join(checked_broadcast(read_as, sent), "stretch", "left")
    found = each.groupBy("_row").agg(F.collect_list(F.coalesce("reading", "stretch")).alias("_r"))
    return rows.join(found, "_row", "left").withColumn("_s", F.col("_r")).drop("_r")


def whole_features(x: np.ndarray, readings: list[str] | None) -> np.ndarray:
    return np.unique(np.concatenate((np.asarray(x, np.int64), word_features(" ".join([] if readings is None else readings).split())[0])))


def trained(rows: DataFrame) -> np.ndarray:
    """Weights and bias from the bounded sample (_id, _y, _x, _s), in one task."""

    def run(frame):
        # Chance makes a weight grow as the root of the number of rows, and so does the bar that it must pass.
        leader, bias = Leader(np.zeros((1 << BITS) + 1), ALPHA, max(2.0, 0.15 * len(frame) ** 0.5)), 1 << BITS
        data = [(np.append(whole_features(x, s), bias), float(y)) for y, x, s in frame.sort_values(["_turn", "_y"])[["_y", "_x", "_s"]].itertuples(index=False)]
        for _ in range(EPOCHS):
            for i, y in data:
                leader.learn(i, y, np.ones(len(i)))
        return pd.DataFrame({"w": [leader.weights(np.arange(bias + 1)).astype("<f4").tobytes()]})

    made = rows.select(F.lit(0).alias("_one"), F.xxhash64("_id", F.lit(2)).alias("_turn"), "_y", "_x", "_s").groupBy("_one").applyInPandas(run, "w binary").collect()  # one row
    return np.frombuffer(made[0]["w"], "<f4") if made else np.zeros((1 << BITS) + 1, np.float32)


def numbered_rows(df: DataFrame) -> DataFrame:
    return written(df.withColumn("_row", F.monotonically_increasing_id()))


def fit(df: DataFrame, labels: DataFrame, use: Column, read_as: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN) -> np.ndarray:
    """Train on the documents that have a label and for which `use` (an expression over `_id`) holds; at most about `most` of them."""
    sample = sampled(df, labels, use, doc_id=doc_id, text=text, label=label, most=most)
    return trained(restored(numbered_rows(featured(sample, ["_id", "_y"], "_text").drop("_score")), read_as))


def scores(df: DataFrame, weights: np.ndarray, read_as: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `_score`, 0 to 1. Only the features of texts with stretches are shuffled."""
    modest_batches(df.sparkSession)
    keep = [c for c in keep if c != "_score"]
    own = [f"k{i}" for i in range(len(keep))]
    named = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], F.col(f"`{text}`").alias("_text"))
    rows = numbered_rows(featured(named, own, "_text", weights))
    open_ = restored(rows.where("_score IS NULL"), read_as)

    def run(batches):
        for batch in batches:
            found = [scored(whole_features(x, s), weights) for x, s in zip(batch.column("_x").to_pylist(), batch.column("_s").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.float64())], names=[*own, "_score"])

    schema = rows.select(*own, "_score").schema
    made = open_.select(*own, "_x", "_s").mapInArrow(run, schema)
    return rows.where("_score IS NOT NULL").select(*own, "_score").unionByName(made).toDF(*keep, "_score")
