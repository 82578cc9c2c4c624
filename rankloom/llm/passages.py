"""Removal of repeated passages by suffix arrays over shares of the corpus.

Every window of `length` bytes goes to the share named by its least hashed gram (see `gram_of`); equal windows
have the same least gram, so they meet. Neighbouring windows mostly agree on it and travel as one
slice. Only shares named from two places or more are looked at. Within them a suffix array by two-stage sorting
(see suffix_array) brings equal windows together, adjacent common prefixes of `length` bytes mark
them, and marks that the same text got from several shares are merged.

Hot passages: copies of a whole text are one text from the start; equal slices are sent once by
each task and sorted once; a share that is still large is dealt again by the least gram
of ever shorter beginnings of its windows, in the task that holds it, so the arrays stay small.

A second threshold can be in words (`words`). Each word is coded by WORD_BYTES hashed characters then, so that a window
of words is a window of a fixed length of the coded text, and only windows that begin with a word count. What
stands between words is not compared. Different words share a code with a probability of 2^-49. Both thresholds
go through the same shuffles; their shares never meet.

Null text: empty. Texts shorter than `length` lose nothing. Of copies of a whole text all bytes are
removed, as every window of one is in the other. Repeated rows are copies. Removal is
judged on the input: no first occurrence stays. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import written
from rankloom.llm.common import WordHashes, list_array, mixed, modest_batches, plain_names, slices, squeezed, word_hashes
from rankloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
#: The longest gram, in bytes or words. Longer ones make fewer shares of texts that have nothing else in common.
GRAM = 64
#: Bytes that are sorted together.
BATCH_BYTES = 1 << 20
#: A share of more bytes is dealt again.
SHARE_BYTES = 4 << 20
#: Characters of 7 bits that stand for a word.
WORD_BYTES = 7
#: Bytes of the number that stands for a word in a suffix array.
RANK_BYTES = 3


class Way(NamedTuple):
    """Windows of `length` bytes of the text, or of its code, that begin at multiples of `step`."""

    length: int
    step: int = 1

    def coded(self, texts: list[bytes], cache: WordHashes) -> list[bytes]:
        return texts if self.step == 1 else [coded(t, cache) for t in texts]


def gram_of(span: int) -> int:
    """The size of the grams in windows of `span` bytes or words: the greatest power of 2 in a quarter of it, at most GRAM."""
    return min(GRAM, 1 << max(0, (span // 4).bit_length() - 1))


def symbols(texts: list[bytes], step: int) -> np.ndarray:
    """A number for each byte or coded word."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if step == 1:
        return data
    out = np.zeros(len(data) // step, np.uint64)
    for i in range(step):
        out = (out << np.uint64(7)) | data[i::step]
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h = np.concatenate((data, np.zeros(gram, data.dtype))).astype(np.uint64)
    with np.errstate(over="ignore"):
        size, m = 1, np.uint64(0x9E3779B97F4A7C15)
        while size < gram:
            h = h[:-size] * m + h[size:]
            size, m = size * 2, m * m + np.uint64(2)
        return mixed(h)


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive entries."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    blocks = np.append(h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1]).ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int, span: int, step: int = 1, twice: bool = False) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one least gram in their first `span` bytes: hash, text, first window, last + 1.

    With `twice` also whether the gram of each run is the least one of windows at two places or more of its text.
    """
    size, width = length // step, span // step
    gram = gram_of(width)
    sizes = np.array([len(t) // step for t in texts], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    grams = gram_hashes(symbols(texts, step), gram)
    v = least_in(grams, width - gram + 1)
    usable = np.flatnonzero(sizes >= size)
    if not len(v) or not len(usable):
        none = np.empty(0, np.int64)
        return (np.empty(0, np.uint64), none, none, none, *[np.empty(0, bool)] * twice)
    start = np.union1d(np.flatnonzero(v[1:] != v[:-1]) + 1, begin[usable])
    owner = np.searchsorted(begin[usable], start, side="right") - 1
    stop = np.minimum(np.append(start[1:], len(v)), end[usable][np.maximum(owner, 0)] - size + 1)
    good = (owner >= 0) & (stop > start)
    start, stop, owner = start[good], stop[good], usable[owner[good]]
    h = v[start]
    found = h, owner, (start - begin[owner]) * step, (stop - begin[owner] - 1) * step + 1
    if not twice:
        return found
    # A gram is the least of some window if the greatest of the least ones around it is no less.
    pad = np.zeros(width - gram, np.uint64)
    most = ~least_in(~np.concatenate((pad, v, pad)), width - gram + 1)
    at = np.flatnonzero(most[: len(grams)] == grams[: len(most)])
    text = np.searchsorted(end, at, side="right").astype(np.uint64)
    key = np.sort(mixed(grams[at] ^ mixed(text + np.uint64(1))))
    again = np.unique(key[1:][key[1:] == key[:-1]])
    own = mixed(h ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    return (*found, again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own if len(again) else np.zeros(len(own), bool))


def of_way(h: np.ndarray, way: int) -> np.ndarray:
    """Share names that differ between ways, as signed numbers."""
    return (h ^ np.uint64(way * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)


def parts_of(texts: list[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def first_copies(docs: list, seen: set) -> list[int]:
    """The places of those that this task hasn't met before."""
    out = []
    for i, doc in enumerate(docs):
        if doc not in seen:
            seen.add(doc)
            out.append(i)
    return out


def shares(texts: DataFrame, ways: list[Way]) -> DataFrame:
    """(doc, n_words, hashes, marks) of the texts of (digest, doc, text), each at most once a task: the runs' shares, and (start * ways + way) * 2 + twice.

    twice: their gram leads windows at two places of the text. n_words: 0 without a way in words.
    """
    cache = WordHashes()

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part, data in slices(batch):
                new = first_copies(part.column(1).to_pylist(), seen)
                data, n_words = [data[i] for i in new], np.zeros(len(new), np.int64)
                parts: list[list] = []
                for k, way in enumerate(ways):
                    code = way.coded(data, cache)
                    if way.step > 1:
                        n_words = np.array([len(c) // way.step for c in code], np.int64)
                    h, owner, start, _, twice = runs(code, way.length, way.length, way.step, True)
                    edges = np.searchsorted(owner, np.arange(1, len(new)))
                    parts.append([np.split(of_way(h, k), edges), np.split((start * len(ways) + k) * 2 + twice, edges)])
                if new:
                    both = [[np.concatenate(x) for x in zip(*(p[j] for p in parts), strict=True)] for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(new)), pa.array(n_words), *(list_array(x, pa.int64()) for x in both)], names=["doc", "n_words", "hashes", "marks"])

    modest_batches(texts.sparkSession)
    return texts.mapInArrow(run, "doc long, n_words long, hashes array<long>, marks array<long>")


def packed_texts(texts: DataFrame) -> DataFrame:
    """(doc, digest, packed) of (digest, doc, text), each text at most once a task."""

    def run(batches):
        squeeze, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            for part, data in slices(batch):
                new = first_copies(part.column(0).to_pylist(), seen)
                if new:
                    at = pa.array(new)
                    yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(0).take(at), pa.array([squeeze.compress(data[i]) for i in new], pa.binary())], names=["doc", "digest", "packed"])

    modest_batches(texts.sparkSession)
    return texts.mapInArrow(run, "doc long, digest binary, packed binary")


def cut_out(texts: DataFrame, ways: list[Way]) -> DataFrame:
    """(hash, way, slice, digest, start, bytes) of the runs that begin at `starts` (start * ways + way) in (digest, starts, packed).

    `slice` tells slices apart; each task gives the bytes of a slice with its first mention only.
    """
    cache = WordHashes()

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        sent: set[bytes] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                whole = [unpack.decompress(x) for x in part.column(2).to_pylist()]
                rows = []
                for a, b in parts_of(whole):
                    wanted = [set(x) for x in part.column(1).slice(a, b - a).to_pylist()]
                    for k, way in enumerate(ways):
                        data = way.coded(whole[a:b], cache)
                        h, *places = runs(data, way.length, way.length, way.step)
                        for h, o, s, e in zip(of_way(h, k).tolist(), *(x.tolist() for x in places), strict=True):
                            if s * len(ways) + k in wanted[o]:
                                piece = data[o][s : e + way.length - 1]
                                key = xxhash.xxh3_128_digest(piece)
                                rows.append((h, k, key, a + o, s, None if key in sent else piece))
                                if len(sent) >= 500_000:
                                    sent.clear()
                                sent.add(key)
                if rows:
                    h, k, key, owner, start, piece = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int32()), pa.array(key, pa.binary()), part.column(0).take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(piece, pa.binary())], names=["hash", "way", "slice", "digest", "start", "bytes"])

    return texts.select("digest", "starts", "packed").mapInArrow(run, "hash long, way int, slice binary, digest binary, start int, bytes binary")


def repeated_windows(groups: list[list[bytes]], way: Way) -> list[list[np.ndarray]]:
    """For each slice of each group: which of its windows, one at every step, are found again in its own group."""
    length, step = way
    out: list[list[np.ndarray]] = [[np.zeros((len(s) - length) // step + 1, bool) for s in g] for g in groups]
    flat = [(i, j) for i, g in enumerate(groups) for j in range(len(g))]
    if not flat:
        return out
    pieces = [groups[i][j] for i, j in flat]
    sizes = np.array([len(p) for p in pieces])
    t = np.frombuffer(b"".join(pieces), np.uint8)
    if step > 1:  # a short number for each word
        _, rank = np.unique(symbols(pieces, step), return_inverse=True)
        t = np.column_stack([rank >> 8 * i & 255 for i in range(RANK_BYTES - 1, -1, -1)]).astype(np.uint8).ravel()
        sizes, length, step = sizes // step * RANK_BYTES, length // step * RANK_BYTES, RANK_BYTES
    end = np.cumsum(sizes)
    group = np.repeat(np.array([i for i, _ in flat]), sizes)
    valid = np.zeros(len(t), bool)
    valid[::step] = True
    for e in end.tolist():
        valid[max(0, e - length + 1) : e] = False
    order = suffix_array(t, length)
    order = order[valid[order]]
    same = common_prefixes(t, order, length) >= length
    # Equal windows of one group stand in one run; those of other groups there can't be equal, as their hash is.
    run = np.concatenate(([0], np.cumsum(~same)))
    key = run * (len(groups) + 1) + group[order]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    marked = np.zeros(len(t), bool)
    marked[order[count[inverse] > 1]] = True
    for (i, j), e, n in zip(flat, end.tolist(), sizes.tolist(), strict=True):
        out[i][j] = marked[e - n : e - length + 1 : step]
    return out


def large_share(pieces: list[bytes], way: Way, level: int) -> list[np.ndarray]:
    """`repeated_windows` of one large group, dealt by the least gram of shorter beginnings of the windows."""
    length, step = way
    span = (length // step >> level) * step
    if sum(map(len, pieces)) <= SHARE_BYTES or span < 8 * step:
        return repeated_windows([pieces], way)[0]
    out = [np.zeros((len(p) - length) // step + 1, bool) for p in pieces]
    dealt: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    for a, b in parts_of(pieces):
        for h, o, s, e in zip(*(x.tolist() for x in runs(pieces[a:b], length, span, step)), strict=True):
            dealt.setdefault(h, {}).setdefault(pieces[a + o][s : e + length - 1], []).append((a + o, s // step, (e - 1) // step + 1))
    for own in dealt.values():
        for found, places in zip(large_share(list(own), way, level + 1), own.values(), strict=True):
            for o, s, e in places:
                out[o][s:e] |= found if len(places) == 1 else True
    return out


def marked(pieces: DataFrame, ways: list[Way]) -> DataFrame:
    """(digest, way, spans): byte ranges a * 2^32 + b that lie in repeated windows, from `cut_out` rows in order of their hash and way."""

    def spans(start: int, windows: np.ndarray, way: Way) -> list[int]:
        edge = np.diff(np.concatenate(([0], windows.astype(np.int8), [0])))
        return [((start + a * way.step) << 32) + start + (b - 1) * way.step + way.length for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]

    def solved(held, k):
        """held: for each share, slice -> [bytes, places]."""
        way, rows = ways[k], []
        single = [g for g in held if sum(len(x[0]) for x in g.values()) <= SHARE_BYTES]
        found = repeated_windows([[x[0] for x in g.values()] if len(g) > 1 or _again(g, way) else [] for g in single], way)
        answers = [(g, f) for g, f in zip(single, found, strict=True)] + [(g, large_share([x[0] for x in g.values()], way, 1)) for g in held if sum(len(x[0]) for x in g.values()) > SHARE_BYTES]
        for g, f in answers:
            for i, (piece, places) in enumerate(g.values()):
                windows = np.ones((len(piece) - way.length) // way.step + 1, bool) if len(places) > 1 else f[i] if f else None
                if windows is not None and windows.any():
                    rows += [(digest, spans(start, windows, way)) for digest, start in places]
        for i in range(0, len(rows), 5000):
            digest, found = zip(*rows[i : i + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([k] * len(digest), pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["digest", "way", "spans"])

    def _again(g, way) -> bool:
        """A slice alone in its share can still hold a window twice, if it is longer than a window."""
        (piece, places), *_ = g.values()
        return len(places) == 1 and len(piece) > way.length

    def run(batches):
        held: list[list[dict]] = [[] for _ in ways]
        size = [0] * len(ways)
        now, last = {}, None
        for batch in batches:
            for h, k, key, digest, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, k) != last:
                    if now:
                        held[last[1]].append(now)
                        if size[last[1]] >= BATCH_BYTES:
                            yield from solved(held[last[1]], last[1])
                            held[last[1]], size[last[1]] = [], 0
                    now, last = {}, (h, k)
                own = now.setdefault(key, [None, []])
                if piece is not None and own[0] is None:
                    own[0] = piece
                    size[k] += len(piece)
                own[1].append((digest, start))
        if now:
            held[last[1]].append(now)
        for k in range(len(ways)):
            yield from solved(held[k], k)

    return pieces.mapInArrow(run, "digest binary, way int, spans array<long>")


def ways_of(length: int, words: int | None) -> list[Way]:
    if length < 8 or words is not None and words < 8:
        raise ValueError("windows must have at least 8 bytes, and 8 words")
    return [Way(length), *([Way(words * WORD_BYTES, WORD_BYTES)] if words else [])]


def removed(df: DataFrame, ways: list[Way], *, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digest, n_copies, n_words) of whole texts that are copies, (digest, spans0, ...) of what repeated windows of other texts cover, by way,
    and (doc, digest, packed) of all texts that can have any.

    digest is `digest_of` the text. spans: maximal disjoint byte ranges a * 2^32 + b of the text or its code, in order.
    n_words: null in texts that are shorter than a window.
    """
    texts = keyed(df, text)
    least = min(w.length if w.step == 1 else 2 * (w.length // w.step) - 1 for w in ways)  # words of one letter
    long = texts.where(F.octet_length("text") >= least)
    found = written(shares(long, ways))
    copies = texts.groupBy("digest", "doc").agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    copies = copies.join(found.groupBy("doc").agg(F.max("n_words").alias("n_words")), "doc", "left").drop("doc")

    rows = found.select("doc", F.inline(F.arrays_zip("hashes", "marks"))).select("doc", F.col("hashes").alias("hash"), F.shiftright("marks", 1).alias("place"), (F.col("marks") % 2).alias("twice"))
    where = F.xxhash64("doc", "place")
    again = rows.groupBy("hash").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.max("twice").alias("twice")).where("a <> b OR twice > 0").select("hash")
    wanted = rows.select("hash", "doc", "place").join(again, "hash", "left_semi").groupBy("doc").agg(F.collect_set("place").alias("starts"))

    # Copies of a text would only repeat its slices; which of them is taken makes no difference.
    one = packed_texts(long).join(wanted, "doc").dropDuplicates(["doc", "digest"])
    dealt = cut_out(one, ways).repartition("hash").sortWithinPartitions("hash", "way", F.col("bytes").isNull())
    by_way = [F.flatten(F.collect_list(F.when(F.col("way") == k, F.col("spans")))).alias(f"spans{k}") for k in range(len(ways))]
    return copies, merged(marked(dealt, ways).groupBy("digest").agg(*by_way), ways), one.select("doc", "digest", "packed")


def merged(spans: DataFrame, ways: list[Way]) -> DataFrame:
    def run(batches):
        for batch in batches:
            # What stands between two words isn't in a window of either.
            rows = [[joint(x, int(w.step > 1)) for x in batch.column(k + 1).to_pylist()] for k, w in enumerate(ways)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in rows)], names=batch.schema.names)

    return spans.mapInArrow(run, spans.schema)


def keyed(df: DataFrame, text: str) -> DataFrame:
    """(digest, doc, text): doc is a short name of the digest, which other texts may share."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return df.select(digest_of(whole).alias("digest"), F.xxhash64(digest_of(whole)).alias("doc"), whole.alias("text"))


def digest_of(whole):
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def without(data: bytes, spans: list[int]) -> bytes:
    out, at = [], 0
    for v in spans:
        out.append(data[at : v >> 32])
        at = v & 0xFFFFFFFF
    return b"".join([*out, data[at:]])


def stripped(texts: DataFrame, spans: DataFrame, ways: list[Way]) -> DataFrame:
    """(digest, n_removed, n_spans, kept bytes, n_covered) of those of the texts (doc, digest, packed) that have spans; n_covered: bytes or words covered in the last way.

    Joined by doc alone, as the texts are dealt by it already; of texts that share one, each finds its own digest.
    """
    names = [f"spans{k}" for k in range(len(ways))]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        size = lambda x: sum((v & 0xFFFFFFFF) - (v >> 32) for v in x)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                first, last = part.column(1).to_pylist(), part.column(len(ways)).to_pylist()
                kept = [without(unpack.decompress(z), x) for z, x in zip(part.column(len(ways) + 1).to_pylist(), first, strict=True)]
                counts = [[size(x) for x in first], [len(x) for x in first], [size(x) // ways[-1].step for x in last]]
                n, m, covered = (pa.array(c, pa.int64()) for c in counts)
                yield pa.RecordBatch.from_arrays([part.column(0), n, m, pa.array(kept, pa.binary()), covered], names=["digest", "n_removed", "n_spans", "kept", "n_covered"])

    by_doc = spans.groupBy(F.xxhash64("digest").alias("doc")).agg(F.collect_list(F.struct(F.col("digest").alias("of"), *names)).alias("all"))
    own = texts.join(by_doc, "doc").withColumn("own", F.filter("all", lambda x: x["of"] == F.col("digest"))).where(F.size("own") > 0)
    return own.select("digest", *[F.col("own")[0][n].alias(n) for n in names], "packed").mapInArrow(run, "digest binary, n_removed long, n_spans long, kept binary, n_covered long")


def digests(df: DataFrame, *, keep: list[str], text: str = "text", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The columns `keep`, n_bytes, n_removed, n_spans and kept_sha256 of every text.

    With `words` also n_repeated_words: how many words lie in windows of so many words that stand anywhere else.
    """
    keep = [c for c in keep if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_repeated_words"] * bool(words))]
    df, new = plain_names(df)
    text = new[text]
    ways = ways_of(length, words)
    copies, spans, texts = removed(df, ways, text=text)
    partly = stripped(texts, spans, ways).select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"), "n_covered")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    heads = df.select(*[F.col(new[c]) for c in keep], digest_of(whole).alias("digest"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("own"))
    rows = heads.join(copies, "digest", "left").join(partly, "digest", "left")
    is_copy = F.col("n_copies").isNotNull()
    all_gone = is_copy & (F.col("n_bytes") >= length)
    out = [
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"),
    ]
    if words:
        covered = F.when(is_copy & (F.col("n_words") >= words), F.col("n_words")).otherwise(F.coalesce("n_covered", F.lit(0)))
        out.append(covered.cast("long").alias("n_repeated_words"))
    return rows.select(*[F.col(new[c]).alias(c) for c in keep], *out)


def coded(text: bytes, cache: WordHashes) -> bytes:
    """WORD_BYTES ASCII characters for each word of the text."""
    h = word_hashes(text.split(), cache)
    return (h[:, None] >> (7 * np.arange(WORD_BYTES, dtype=np.uint64)) & np.uint64(127)).astype(np.uint8).tobytes()


def word_ranges(data: bytes, spans: list[int]) -> list[int]:
    """The byte ranges of `data` that ranges of its coded text stand for, each from its first word to its last."""
    there = ~np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], there.astype(np.int8), [0])))).tolist()
    return [(edge[2 * ((v >> 32) // WORD_BYTES)] << 32) + edge[2 * ((v & 0xFFFFFFFF) // WORD_BYTES) - 1] for v in spans]


def joint(spans: list[int], least: int = 0) -> list[int]:
    """Disjoint ranges, in order, that cover the same bytes; those that share at least so many bytes become one."""
    out: list[list[int]] = []
    for v in sorted(spans):
        a, b = v >> 32, v & 0xFFFFFFFF
        if out and a <= out[-1][1] - least:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a << 32) + b for a, b in out]


def deduplicated(df: DataFrame, *, text: str = "text", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """`df` with the repeated bytes taken out of its texts; a character that loses a byte goes as a whole.

    With `words`, repeated windows of so many words go as well, however short they are in bytes. Null texts stay null.
    """
    columns = df.columns
    df, new = plain_names(df)
    text = new[text]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [c for c in df.columns if c != text]
    ways = ways_of(length, words)
    copies, spans, _ = removed(df, ways, text=text)
    marked_rows = df.withColumn("_digest", digest_of(whole)).withColumn("_size", F.octet_length(whole).cast("long"))
    rows = squeezed(marked_rows, [*rest, "_digest", "_size"], text)
    rows = rows.join(copies.withColumnRenamed("digest", "_digest"), "_digest", "left").join(spans.withColumnRenamed("digest", "_digest"), "_digest", "left")
    none = F.array().cast("array<long>")
    size = [F.col("_size"), F.col("n_words") * WORD_BYTES]
    cuts = [F.when(F.col("n_copies").isNotNull() & (n >= w.length), F.array(n)).otherwise(F.coalesce(f"spans{k}", none)).alias(f"_cuts{k}") for k, (w, n) in enumerate(zip(ways, size))]
    kept = rows.select(*rest, *cuts, "_z")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = []
                ranges, *of_words = (c.to_pylist() for c in part.columns[len(rest) : -1])
                for k, (z, x) in enumerate(zip(part.column(part.num_columns - 1).to_pylist(), ranges, strict=True)):
                    data = None if z is None else unpack.decompress(z)
                    if data and of_words and of_words[0][k]:
                        x = joint(x + word_ranges(data, of_words[0][k]))
                    texts.append(without(data, x).decode(errors="ignore") if x and data else None if data is None else data.decode())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, text])

    out = kept.select(*rest).schema.add(text, "string")
    return kept.mapInArrow(run, out).select(*df.columns).toDF(*columns)
