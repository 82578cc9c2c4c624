"""Quality rules with an n-gram perplexity band for each language.

A modified Kneser-Ney model of the code points of all documents, order `ORDER`, for each language. Tasks
count the n-grams of their own documents, Spark adds them up; continuation counts, context sums, discounts and
probabilities are tables that grow with the corpus, made by grouping, windows over contexts and endings, and joins; they hold numbers only, all orders in one. An
n-gram is known by a 63-bit hash of its language and its code points; two n-grams of a billion share one with a
probability of about 5 %, and would then add their counts.

Documents fall into two folds by a hash of their text, and each is scored by the model of the other
fold, so that odd text is not excused by its own counts. The log-probabilities are looked up in sorted arrays
of hashes. A model of at most `MODEL_GRAMS` n-grams goes to all executors as one such array. A larger one is never
gathered anywhere: documents are dealt into groups of about `GROUP_BYTES` of text, each group asks for the n-grams
that it has by a join, and is scored with an array of those. Both ways give the same losses.

A document's loss is its mean negative log-probability per code point in nats. A language's band is the median of all its
documents plus or minus `BAND` scaled median deviations, at least `LEAST_WIDTH`, and documents outside are
rejected; below the median the width is at least `LOW_SHARE` of it too, as near copies in the other fold make good text likelier.

Null text has no words and fails the base rules. A null language is a language of its own. In an
empty table there is nothing to count. A document without characters has no perplexity and fails
the base rules; one whose language has no document in the other fold has none either, and the base
rules alone decide. Repeated rows count as often as they occur. Kept columns named like a measure or a verdict
give way to it. U+0000 counts as U+FFFF, and U+FFFE stands for the start of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import cut, written
from rankloom.functions.ranking import quantiles
from rankloom.llm.common import field, map_texts, mixed, modest_batches, plain_names, slices, squeezed, unsqueezed, windows

ORDER = 5
EDGE = "\ufffe"
NONE = "\x00none"
#: n-grams that are sent to every executor at the most, 16 bytes each.
MODEL_GRAMS = 4_000_000
#: Text that is scored with one array of n-grams where the model is larger.
GROUP_BYTES = 16 << 20
#: Half the width of a band in scaled median deviations.
BAND = 6.0
#: No band is narrower than this on either side, in nats.
LEAST_WIDTH = 1.0
#: Nor is it narrower below its median than this share of it.
LOW_SHARE = 0.5
#: n-grams that a task holds before it adds them up, and how many times as many different ones before it hands them on.
BUFFER, HELD = 1_000_000, 2
#: Bits of a code point.
CODE_BITS = 21
FOLDS = (0, 1)
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUATION = bytes(range(0x80, 0xC0))


def fold_of(text: Column) -> Column:
    """0 or 1, the same for copies of a text."""
    return F.pmod(F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))), F.lit(2)).cast("int")


def document_of(text: str, lang: str) -> Column:
    """The hash that tells texts of a language apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE)), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def hashed(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points; the hash of the ORDER of them from each place on; where each text's n-grams begin and end among those.

    The n-th n-gram of a text ends with its n-th code point.
    """
    pad = EDGE * (ORDER - 1)
    whole = [t.decode(errors="replace") for t in texts]
    c = np.frombuffer((pad.join(["", *whole]) + pad).encode("utf-32-le"), np.uint32)
    c = np.where(c == 0, np.uint32(0xFFFF), c)
    length = np.array([len(t) for t in whole], np.int64)
    end = np.cumsum(length + ORDER - 1) - (ORDER - 1)
    begin = end - length
    h = np.zeros(len(c) - ORDER + 1, np.uint64)
    wide = c.astype(np.uint64)
    for i in range(ORDER):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[i : i + len(h)]
    h += np.repeat(np.array([seed(x) for x in langs], np.uint64), np.diff(np.concatenate((begin, [len(h)]))))
    return c, mixed(h) >> np.uint64(1), begin, end


def inside(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each place lies in one of the disjoint ranges."""
    edge = np.zeros(size + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge, dtype=np.int8)[:-1] > 0


def marked(df: DataFrame, text: str, lang: str) -> list[Column]:
    """_lang, _fold, _doc."""
    return [F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE)).alias("_lang"), fold_of(F.col(f"`{text}`")).alias("_fold"), document_of(text, lang).alias("_doc")]


def added_up(held: list[tuple]) -> list[tuple]:
    """One table of the distinct keys for those in `held` (key, n and what goes with the key), which is emptied: columns go one by one, so that no more than one is there twice."""
    key, n, *others = (list(x) for x in zip(*held, strict=True))
    held.clear()

    def whole(parts: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(parts)
        parts.clear()
        return out

    keys = whole(key)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys = keys[new]
    sums = np.add.reduceat(whole(n)[order], new)
    first = order[new]
    del order, new
    return [(keys, sums, *(whole(x)[first] for x in others))]


def count_ngrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(key, lang, far, near, c0, c1): how often each n-gram of a language occurs in each fold. Every task adds up its own documents first.

    `lang` is the seed of the language. The code points w1 to w5 stand in `far` (w3, w2, w1) and `near` (w4, w5), CODE_BITS to each; those of a shorter n-gram's missing beginning are 0.
    """

    def rows_of(held: list[tuple]):
        key, n, name, far, near = held[0]
        fold = (key & np.uint64(1)).astype(np.int64)
        columns = [(key >> np.uint64(1)).astype(np.int64), name, far, near, n * (1 - fold), n * fold]
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in columns], names=["key", "lang", "far", "near", "c0", "c1"])

    def run(batches):
        held: list[tuple] = []
        fresh = 0
        for batch in batches:
            for part, texts in slices(batch):
                langs, folds = part.column(0).to_pylist(), part.column(1).to_numpy()
                c, h, begin, end = hashed(texts, langs)
                owner = np.repeat(np.arange(len(texts)), end - begin)
                if not len(owner):
                    continue
                at = np.arange(len(owner)) + np.repeat(begin - np.concatenate(([0], np.cumsum(end - begin)[:-1])), end - begin)
                key = (h[at] << np.uint64(1)) | folds.astype(np.uint64)[owner]
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                first, n = order[new], np.diff(np.append(new, len(key)))
                w = [c[at[first] + i].astype(np.int64) for i in range(ORDER)]
                seeds = np.array([seed(x) for x in langs], np.uint64).view(np.int64)
                far = (w[2] << 2 * CODE_BITS) | (w[1] << CODE_BITS) | w[0]
                held.append((key[new], n, seeds[owner[first]], far, (w[3] << CODE_BITS) | w[4]))
                fresh += len(new)
                if fresh >= BUFFER:
                    held, fresh = added_up(held), 0
                    if len(held[0][0]) >= HELD * BUFFER:
                        yield from rows_of(held)
                        held = []
        if held:
            yield from rows_of(added_up(held))

    modest_batches(df.sparkSession)
    rows = df.select(*marked(df, text, lang)[:2], F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.mapInArrow(run, "key long, lang long, far long, near long, c0 long, c1 long")
    return found.groupBy("key", "lang", "far", "near").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in FOLDS])


def ending(order: Column) -> tuple[Column, Column]:
    """`far` and `near` of the last `order` (1 to 5) code points of an n-gram."""
    mask = lambda n: F.lit(((1 << 3 * CODE_BITS) - 1) >> n * CODE_BITS << n * CODE_BITS)
    far = F.when(order == 5, F.col("far")).when(order == 4, F.col("far").bitwiseAND(mask(1))).when(order == 3, F.col("far").bitwiseAND(mask(2))).otherwise(F.lit(0).cast("long"))
    return far.alias("far"), F.when(order == 1, F.col("near").bitwiseAND(F.lit((1 << CODE_BITS) - 1))).otherwise(F.col("near")).alias("near")


def shorter(grams: DataFrame) -> DataFrame:
    """(lang, order, far, near, c0, c1) of all orders but the highest: of how many different code points each n-gram is the continuation, by either fold."""
    there = [(F.col(f"c{i}") > 0).cast("long").alias(f"c{i}") for i in FOLDS]
    each = grams.select("lang", "far", "near", *there, F.explode(F.array(*[F.lit(n) for n in range(ORDER, 1, -1)])).alias("order"))
    once = each.groupBy("lang", "order", *ending(F.col("order"))).agg(*[F.max(f"c{i}").alias(f"c{i}") for i in FOLDS])
    return once.groupBy("lang", (F.col("order") - 1).alias("order"), *ending(F.col("order") - 1)).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in FOLDS])


def discounts(counts: DataFrame) -> DataFrame:
    """A row for each language and order: by either fold the discounts d1 to d3 of modified Kneser-Ney, the n-grams counted once, twice and more often, those counted at all, and the sum."""
    is_ = lambda i, k: (F.col(f"c{i}") == k).cast("long")
    sums = {f"of{k}_{i}": F.sum(is_(i, k)) for i in FOLDS for k in (1, 2, 3, 4)}
    sums |= {f"types_{i}": F.sum((F.col(f"c{i}") > 0).cast("long")) for i in FOLDS} | {f"all_{i}": F.sum(f"c{i}") for i in FOLDS}
    sizes = counts.groupBy("lang", "order").agg(*[v.alias(k) for k, v in sums.items()])
    out = []
    for i in FOLDS:
        of = {k: F.col(f"of{k}_{i}").cast("double") for k in (1, 2, 3, 4)}
        y = F.when(of[1] > 0, of[1] / (of[1] + 2 * of[2])).otherwise(0.5)
        out += [F.when(of[k] > 0, F.least(F.lit(float(k)), F.greatest(F.lit(0.0), k - (k + 1) * y * of[k + 1] / of[k]))).otherwise(0.5).alias(f"d{k}_{i}") for k in (1, 2, 3)]
        out += [F.col(f"of1_{i}"), F.col(f"of2_{i}"), (F.col(f"types_{i}") - F.col(f"of1_{i}") - F.col(f"of2_{i}")).alias(f"more_{i}"), F.col(f"types_{i}"), F.col(f"all_{i}")]
    return sizes.select("lang", "order", *out)


def terms(i: int, total: Column, n1: Column, n2: Column, n3: Column) -> tuple[Column, Column, Column]:
    """u, v and t of interpolated Kneser-Ney in fold i: the probability is (u + v * p) / t, where p is that of the next lower order."""
    c, (d1, d2, d3) = F.col(f"c{i}"), (F.col(f"d{k}_{i}") for k in (1, 2, 3))
    less = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
    none = total == 0
    return F.when(none, 0.0).otherwise(F.greatest(c - less, F.lit(0.0))), F.when(none, 1.0).otherwise(d1 * n1 + d2 * n2 + d3 * n3), F.when(none, 1.0).otherwise(total.cast("double"))


def probabilities(grams: DataFrame) -> DataFrame:
    """(key, p0, p1) of `count_ngrams`' rows: modified Kneser-Ney of the last code point after the others, by either fold (null: it has no text of the language).

    A window over each context gives the terms of every order. n-grams that end with the same two code points are then sorted as a walk
    through the tree of their endings: the last row of each lower order before an n-gram is its own ending.
    """
    lower = written(shorter(grams))
    columns = ["key", "lang", "order", "far", "near", *[f"c{i}" for i in FOLDS]]
    counts = grams.withColumn("order", F.lit(ORDER)).select(columns).unionByName(lower.withColumn("key", F.lit(None).cast("long")).select(columns))
    sizes = written(discounts(counts))
    single = lower.where("order = 1").join(sizes.where("order = 1").drop("order"), "lang")
    first = []
    for i in FOLDS:
        u, v, t = terms(i, *[F.col(f"{n}_{i}") for n in ("all", "of1", "of2", "more")])
        first.append(((u + v * F.when(F.col(f"types_{i}") > 0, 1 / (F.col(f"types_{i}") + 1.0))) / t).alias(f"p1_{i}"))
    single = written(single.select("lang", F.col("near").alias("last"), *first))

    # A context has at most as many rows as there are code points.
    context = Window.partitionBy("lang", "order", "far", F.shiftright("near", CODE_BITS))
    rows = counts.where("order > 1")
    for i in FOLDS:
        is_ = lambda k, i=i: F.sum((F.col(f"c{i}") == k).cast("long")).over(context)
        rows = rows.withColumns({f"total_{i}": F.sum(f"c{i}").over(context), f"n1_{i}": is_(1), f"n2_{i}": is_(2), f"n3_{i}": F.sum((F.col(f"c{i}") > 2).cast("long")).over(context)})
    own = [x.alias(f"{n}_{i}") for i in FOLDS for n, x in zip("uvt", terms(i, *[F.col(f"{n}_{i}") for n in ("total", "n1", "n2", "n3")]), strict=True)]
    rows = rows.join(sizes, ["lang", "order"]).select("key", "lang", "order", "far", "near", F.struct(*own).alias("own"))
    before = Window.partitionBy("lang", "near").orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"of{n}": F.last(F.when(F.col("order") == n, F.col("own")), ignorenulls=True).over(before) for n in range(2, ORDER)})
    rows = rows.where(F.col("order") == ORDER).withColumn("last", F.col("near").bitwiseAND(F.lit((1 << CODE_BITS) - 1))).join(single, ["lang", "last"])
    out = []
    for i in FOLDS:
        p = F.col(f"p1_{i}")
        for s in (*[f"of{n}" for n in range(2, ORDER)], "own"):
            p = (F.col(f"{s}.u_{i}") + F.col(f"{s}.v_{i}") * p) / F.col(f"{s}.t_{i}")
        out.append(p.alias(f"p{i}"))
    return rows.select("key", *out)


def model(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(key, l0, l1): the log-probability of every n-gram of the documents by the model of each fold (null: it has no such language)."""
    logs = [F.ln(F.greatest(f"p{i}", F.lit(1e-12))).cast("float").alias(f"l{i}") for i in FOLDS]
    return written(probabilities(written(count_ngrams(df, text, lang))).select("key", *[F.when(F.col(f"p{i}").isNotNull(), x).alias(f"l{i}") for i, x in zip(FOLDS, logs, strict=True)]))


class SortedLogs:
    """Log-probabilities by both folds in the order of their hashes, with the first place for each beginning of a hash."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = np.append(keys[order], np.iinfo(np.int64).max), np.append(logs[order], np.zeros((1, 2), np.float32), axis=0)
        self.bits = max(1, len(keys).bit_length())
        self.start = np.searchsorted(self.keys, np.arange(1 << self.bits) << (63 - self.bits)).astype(np.int32)

    def places(self, key: np.ndarray) -> np.ndarray:
        """Where each key stands, or the next greater one."""
        at = self.start[key >> (63 - self.bits)].astype(np.int64)
        open_ = np.flatnonzero(self.keys[at] < key)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < key[open_]]
        return at

    def losses(self, texts: list[bytes], langs: list[str], folds: np.ndarray) -> list[float | None]:
        """Nats per code point by the other fold's model; None: no code point or no such model."""
        _, h, begin, end = hashed(texts, langs)
        at = self.places(h.astype(np.int64))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate((begin, [len(h)]))))
        log = self.logs[at, 1 - folds[owner]]
        log = np.where(inside(len(h), begin, end), log, np.float32(0))
        known = ~np.isnan(log)
        total = np.concatenate(([0.0], np.cumsum(np.where(known, log, 0), dtype=np.float64)))
        lost = np.concatenate(([0], np.cumsum(~known)))
        return [None if a == b or lost[b] > lost[a] else float(total[a] - total[b]) / (b - a) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def sorted_logs(table: pa.Table) -> SortedLogs:
    logs = np.empty((table.num_rows, len(FOLDS)), np.float32)
    for i in FOLDS:
        logs[:, i] = table.column(f"l{i}").to_numpy(zero_copy_only=False)
    return SortedLogs(table.column("key").to_numpy(zero_copy_only=False).astype(np.int64, copy=False), logs)


def group_losses(df: DataFrame, logs: DataFrame, text: str, lang: str, group_bytes: int) -> DataFrame:
    """(_doc, _loss) of every distinct text of each language, without the whole model in any one place."""
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    groups = 1 + size // group_bytes
    columns = marked(df, text, lang)
    rows = squeezed(df.select(*columns, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t")), ["_lang", "_fold", "_doc"], "_t")

    def first_copies(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, doc in enumerate(batch.column(2).to_pylist()):
                if doc not in seen:
                    seen.add(doc)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    once = rows.mapInArrow(first_copies, rows.schema).withColumn("_group", F.pmod("_doc", F.lit(groups)))
    dealt = cut(once.repartition("_group").sortWithinPartitions("_group"))

    def texts_of(batch):
        """Slices of (group, lang, fold, doc) lists and texts; columns _lang, _fold, _doc, _z, _group."""
        unpack = zstandard.ZstdDecompressor()
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            yield (*(part.column(c).to_pylist() for c in ("_group", "_lang", "_fold", "_doc")), [unpack.decompress(z) for z in part.column("_z").to_pylist()])

    def asked(batches):
        now, held = None, np.empty(0, np.uint64)
        for batch in batches:
            for group, langs, _, _, texts in texts_of(batch):
                _, h, begin, end = hashed(texts, langs)
                ends = np.searchsorted(group, sorted(set(group)), side="right").tolist()
                for a, b in zip([0, *ends], ends):
                    if group[a] != now:
                        yield from wanted(now, held)
                        now, held = group[a], np.empty(0, np.uint64)
                    there = inside(len(h), begin[a:b], end[a:b])
                    held = np.union1d(held, h[there])
        yield from wanted(now, held)

    def wanted(group, held):
        for i in range(0, len(held), 100_000):
            k = held[i : i + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), group, np.int64)), pa.array(k)], names=["_group", "key"])

    need = dealt.mapInArrow(asked, "_group long, key long").join(logs, "key")
    none = lambda names: [F.lit(None).cast(k).alias(n) for n, k in names.items()]
    of_text, of_model = {"_lang": "string", "_fold": "int", "_doc": "long", "_z": "binary"}, {"key": "long", "l0": "float", "l1": "float"}
    both = need.select("_group", F.lit(0).alias("_kind"), *none(of_text), *of_model).unionByName(dealt.select("_group", F.lit(1).alias("_kind"), *of_text, *none(of_model)))

    def score(batches):
        now, parts, table = None, [], None
        for batch in batches:
            kinds, group = batch.column("_kind").to_numpy(), batch.column("_group").to_numpy()
            edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(group) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if group[a] != now:
                    now, parts, table = group[a], [], None
                if kinds[a] == 0:
                    parts.append(part.select(list(of_model)))
                    continue
                if table is None:
                    table, parts = sorted_logs(pa.Table.from_batches(parts) if parts else pa.table({"key": pa.array([], pa.int64()), "l0": pa.array([], pa.float32()), "l1": pa.array([], pa.float32())})), []
                for _, langs, folds, docs, texts in texts_of(part):
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(table.losses(texts, langs, np.array(folds)), pa.float64())], names=["_doc", "_loss"])

    found = both.repartition("_group").sortWithinPartitions("_group", "_kind").mapInArrow(score, "_doc long, _loss double")
    return found.dropDuplicates(["_doc"])


def measures(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Words of one text are compared by Python's own 64-bit hash of bytes, which is never stored."""
    out = np.zeros((5, len(texts)), np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        h = windows(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), REPEAT_WINDOW)
        ordered = np.sort(h)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        covered = 0
        if again.size:
            at = np.flatnonzero(np.isin(h, again))
            covered = int(np.minimum(np.diff(at, append=at[-1] + REPEAT_WINDOW), REPEAT_WINDOW).sum())
        out[:, i] = len(words), len(t.translate(None, SPACES + CONTINUATION)), len(t) - len(t.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), covered
    return list(out)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(df: DataFrame, *, keep: list[str], text: str, lang: str, most: int = MODEL_GRAMS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The columns `keep`, `_lang`, `_doc`, the measures with `_` before their names, and `_loss` (nats per code point; null: none), written."""
    logs = model(df, text, lang)
    small = logs.count() <= most
    sent = df.sparkSession.sparkContext.broadcast(sorted_logs(logs.toArrow())) if small else None
    pa.default_memory_pool().release_unused()

    def work(texts, part):
        found = [pa.array(x, pa.int64()) for x in measures(texts)]
        if small:
            langs, folds = (part.column(part.num_columns - i) for i in (4, 3))
            found.append(pa.array(sent.value.losses(texts, langs.to_pylist(), folds.to_numpy()), pa.float64()))
        return found

    rows = df.select(*[F.col(f"`{c}`") for c in keep], *marked(df, text, lang), F.col(f"`{text}`").cast("string").alias("_whole"))
    out = map_texts(rows, [*keep, "_lang", "_fold", "_doc"], "_whole", [*(field(f"_{n}", "long") for n in NAMES), *([field("_loss", "double")] if small else [])], work, rows=True)
    if not small:
        return written(out.join(group_losses(df, logs, text, lang, group_bytes), "_doc", "left"))
    done = written(out)
    sent.destroy()
    return done


def bands(losses: DataFrame, width: float = BAND) -> DataFrame:
    """(_lang, _low, _high) over all documents of each language, by exact medians, so that they don't depend on how the documents are dealt out.

    A language whose documents have no loss has no limits. Medians and limits, a row for each language, are written, so that no plan holds those before it."""
    own = losses.where("_loss IS NOT NULL").select("_lang", "_loss")
    middle = written(quantiles(own, ["_lang"], "_loss", {"m": 0.5}))
    off = own.join(middle, "_lang").select("_lang", F.abs(F.col("_loss") - F.col("m")).alias("_off"))
    spread = middle.join(quantiles(off, ["_lang"], "_off", {"d": 0.5}), "_lang")
    half = F.greatest(F.lit(width * 1.4826) * F.col("d"), F.lit(LEAST_WIDTH))
    return written(spread.select("_lang", (F.col("m") - F.greatest(half, LOW_SHARE * F.col("m"))).alias("_low"), (F.col("m") + half).alias("_high")))


def verdicts(losses: DataFrame) -> DataFrame:
    """`losses` with base_failed and kept; the limits have a row for each language (see `bands`)."""
    base = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > REPEAT_PERCENT * F.col("_n_words"))
    fits = F.coalesce(F.col("_loss").between(F.col("_low"), F.col("_high")), F.lit(True))
    return losses.join(bands(losses), "_lang", "left").select(*losses.columns, base.alias("base_failed"), (~base & fits).alias("kept"))


def judged(df: DataFrame, *, keep: list[str], text: str, lang: str) -> DataFrame:
    """`verdicts` on all documents; texts are read twice, and only measures are kept between."""
    return verdicts(scored(df, keep=keep, text=text, lang=lang))


def rules(df: DataFrame, *, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns `keep`, the five measures, base_failed and kept, for every document."""
    keep = [c for c in keep if c not in (*NAMES, "base_failed", "kept")]
    df, new = plain_names(df)
    out = judged(df, keep=[new[c] for c in keep], text=new[text], lang=new[lang])
    return out.select(*[F.col(new[c]).alias(c) for c in keep], *[F.col(f"_{n}").alias(n) for n in NAMES], "base_failed", "kept")


def accepted(df: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `df` that pass, with their columns. Only measures are kept between the two passes over the texts."""
    columns = df.columns
    df, new = plain_names(df)
    text, lang = new[text], new[lang]
    good = judged(df, keep=[], text=text, lang=lang).where("kept").select("_doc").distinct()
    rest = [c for c in df.columns if c != text]
    rows = squeezed(df.withColumn("_doc", document_of(text, lang)), [*rest, "_doc"], text).join(good, "_doc", "left_semi")
    return unsqueezed(rows, rest, text).select(*df.columns).toDF(*columns)
