"""MinHash near-duplicate groups.

Every document's set of word shingles gets `BANDS` x `ROWS` universal hash minima. Documents with
the same set are one node, so copies cost one row each. Nodes that agree on a whole band share a
bucket. In each bucket every node is compared with the one that shares buckets with most others,
which in a group of edited copies is the text they were made from: pairs whose signatures agree
too seldom are dropped, the rest are confirmed on their full shingle sets, and large-star and small-star
rounds turn links into components.

So that no link is lost for having been compared with a bucket's centre only, buckets that still
hold nodes of different components are gone through again. A node too many of whose
shingles occur in no other such node cannot be linked with anything, which is counted exactly and rules out
most of them; of the rest, pairs of different components that were not compared yet are
confirmed too, unless what either has alone already makes the union too large. Nodes already joined are never paired, so a group of thousands of near copies costs
a few pairs a member.

With J the similarity, a linked pair shares no bucket with probability (1 - J^ROWS)^BANDS: 2e-8 at 0.85, 7e-6 at 0.8.
Confirmation looks at signatures first, one bit of each of `CHECKS` minima; that of a pair at the threshold
lies more than `SLACK` below it with a probability of 8e-6 at 0.85 and 5e-5 at 0.8, the upper tail of a binomial distribution.

Null, empty and blank texts have no set and are linked with nothing. A text of fewer words than a
shingle is one shingle. Repeated rows are copies of one another. A null id is a row like any other;
a component's id is its smallest non-null one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import written
from rankloom.llm.common import WordHashes, field, list_array, map_texts, mixed, plain_names, squeezed, unsqueezed, windows, word_hashes
from rankloom.llm.components import components

SHINGLE, BANDS, ROWS = 5, 30, 5
CHECKS, SLACK = 512, 0.11
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingles(text: bytes, cache: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, cache)
    if len(h) < size:
        return windows(h, len(h)) ^ np.uint64(len(h))
    found = np.sort(windows(h, size))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of n multiply-shift hash functions."""
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One row of n 32-bit minima for each set that isn't empty, in order."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, n), np.uint32)
    joined = np.concatenate(full)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
    out = np.empty((len(full), n), np.uint32)
    work = np.empty_like(joined)
    for i, (a, b) in enumerate(zip(*universal(n), strict=True)):
        np.multiply(joined, a, out=work)
        np.add(work, b, out=work)
        out[:, i] = np.minimum.reduceat(work, begin) >> np.uint64(32)
    return out


def profiled(df: DataFrame, *, keep: list[str], text: str, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`keep`, `_n` (set size), `_key` (128-bit hash of the set; null: empty set) and `_bands` (a hash of each band's minima)."""
    cache = WordHashes()

    def work(texts):
        sets = [shingles(t, cache, size) for t in texts]
        sig = signatures(sets, bands * rows).astype(np.uint64).reshape(-1, bands, rows)
        h = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])
        for i in range(rows):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
        made = iter(h.astype(np.int64))
        found = [next(made) if len(s) else np.empty(0, np.int64) for s in sets]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), list_array(found, pa.int64())]

    return map_texts(df, keep, text, [field("_n", "long"), field("_key", "binary"), field("_bands", "longs")], work)


def bits(sets: list[np.ndarray], n: int) -> np.ndarray:
    """One bit of each of n minima, 64 to a number."""
    return np.packbits((signatures(sets, n) & 1).astype(bool), axis=1).view(">u8").astype(np.uint64).view(np.int64)


def agreement(a: Column, b: Column, n: int) -> Column:
    """The similarity that two bit signatures stand for: bits of unlike minima are equal half the time."""
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - 2 * unlike / F.lit(float(n))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose full sets (_key, _set) are similar enough."""
    one = pairs.join(sets.select(F.col("_key").alias("a"), F.col("_set").alias("sa")), "a")
    two = one.join(sets.select(F.col("_key").alias("b"), F.col("_set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return two.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def fitting(percent: int) -> Column:
    """Whether two nodes' set sizes and signatures leave a similarity of `percent` possible."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & (agreement(F.col("sga"), F.col("sgb"), CHECKS) >= percent / 100 - SLACK)


def starred(shared: DataFrame) -> DataFrame:
    """(a, b): the nodes of each bucket of (bucket, _key) with the bucket's centre, the node with most company in all buckets."""
    company = shared.join(shared.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").groupBy("_key").agg(F.sum("n").alias("n"))
    ranked = shared.join(company, "_key")
    centre = ranked.groupBy("bucket").agg(F.max(F.struct("n", "_key")).alias("top")).select("bucket", F.col("top._key").alias("b"))
    return shared.join(centre, "bucket").where("_key <> b").select(F.col("_key").alias("a"), "b").distinct()


def possible(nodes: DataFrame, percent: int) -> DataFrame:
    """(_key, alone) of those of the nodes (_key, _set) that share enough shingles with any other of them to have a link;
    alone: how many of its shingles no other of them has."""
    single = nodes.select("_key", F.explode("_set").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.first("_key").alias("_key")).where("n = 1")
    alone = single.groupBy("_key").agg(F.count("*").alias("alone"))
    counted = nodes.select("_key", F.size("_set").alias("n")).join(alone, "_key", "left").select("_key", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    return counted.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")).select("_key", "alone")


def room(percent: int) -> Column:
    """Whether two sets of na and nb shingles, la and lb of them in no other set, can be similar enough."""
    a, b = F.col("na") - F.col("la"), F.col("nb") - F.col("lb")
    return 100 * F.least(a, b) >= percent * (F.greatest(a, b) + F.col("la") + F.col("lb"))


def grouped(df: DataFrame, *, keep: list[str], text: str = "text", doc_id: str = "doc_id", percent: int = 85, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The columns `keep` and `doc_id`, `_n` (set size), `_key` (null: no set) and `_root`, the same for all documents of a component.

    Links: 100 * intersection >= percent * union of the shingle sets.
    """
    columns = list(dict.fromkeys([*keep, doc_id]))
    seen = written(profiled(df, keep=columns, text=text, size=size, bands=bands, rows=rows))
    spread = seen.where("_key IS NOT NULL").select("_key", F.explode("_bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    several = spread.join(crowded, "bucket", "left_semi").distinct()
    shared = written(several.join(several.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket", "left_semi"))
    nodes = written(sets_of(df, seen, shared.select("_key").distinct(), doc_id, text, size))
    a, b = (nodes.select(F.col("_key").alias(x), F.col("_n").alias(f"n{x}"), F.col("_sig").alias(f"sg{x}")) for x in "ab")

    stars = written(starred(shared).join(a, "a").join(b, "b").where(fitting(percent)).select("a", "b"))
    roots = components(confirmed(stars, nodes, percent))

    # Buckets that still hold several components.
    placed = shared.join(roots.withColumnRenamed("node", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    apart = lambda t: t.join(t.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "bucket", "left_semi")
    still = written(apart(placed).select("bucket", "_key", "root"))
    able = written(possible(nodes.join(still.select("_key").distinct(), "_key", "left_semi").select("_key", "_set"), percent))
    own = able.join(nodes.select("_key", "_n", "_sig"), "_key").join(shared.join(able, "_key", "left_semi").groupBy("_key").agg(F.array_sort(F.collect_set("bucket")).alias("_in")), "_key")
    rest = written(apart(still.join(able.select("_key"), "_key", "left_semi")).join(own, "_key"))
    x, y = (rest.select("bucket", F.col("_key").alias(k), F.col("root").alias(f"r{k}"), F.col("_n").alias(f"n{k}"), F.col("alone").alias(f"l{k}"), F.col("_sig").alias(f"sg{k}"), F.col("_in").alias(f"in{k}")) for k in "ab")
    # A pair is met in the first bucket that it shares only.
    once = F.element_at(F.array_intersect("ina", "inb"), 1) == F.col("bucket")
    across = x.join(y, "bucket").where((F.col("ra") < F.col("rb")) & room(percent) & fitting(percent) & once).select("a", "b", "ra", "rb")
    compared = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = written(across.join(compared, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        new = across.join(confirmed(across.select("a", "b"), nodes, percent), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        joined = components(new).select(F.col("node").alias("root"), F.col("root").alias("to"))
        tops = joined.select(F.col("root").alias("node"), F.col("to").alias("root"))
        roots = roots.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(tops)
    found = seen.drop("_bands").join(roots.select(F.col("node").alias("_key"), F.col("root").alias("_root")), "_key", "left")
    return found.select(*columns, "_n", "_key", F.coalesce("_root", "_key").alias("_root"))


def sets_of(df: DataFrame, seen: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(_key, _n, _sig, _set) of the wanted keys, made again from the text of one document each; texts travel compressed."""
    chosen = seen.join(wanted, "_key", "left_semi").groupBy("_key").agg(F.min(f"`{doc_id}`").alias("_doc"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\x00null"))
    ids = chosen.select(name(F.col("_doc")).alias("_id")).distinct()

    texts = squeezed(df.select(name(F.col(f"`{doc_id}`")).alias("_id"), F.col(f"`{text}`").alias("_t")).where("_t IS NOT NULL"), ["_id"], "_t")
    cache = WordHashes()

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [s for z in batch.column(0).slice(i, 256).to_pylist() if len(s := shingles(unpack.decompress(z), cache, size))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        list_array(list(bits(sets, CHECKS)), pa.int64()),
                        list_array([s.astype(np.int64) for s in sets], pa.int64()),
                    ],
                    names=["_key", "_n", "_sig", "_set"],
                )

    made = texts.join(ids, "_id", "left_semi").select("_z").mapInArrow(run, "_key binary, _n long, _sig array<bigint>, _set array<long>")
    # A repeated id brings texts of other keys along, and the same key more than once.
    return made.join(chosen.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])


def near_duplicates(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest id of the component."""
    found = grouped(df, keep=[doc_id], text=text, doc_id=doc_id, percent=percent)
    ids = found.where("_root IS NOT NULL").groupBy("_root").agg(F.min(f"`{doc_id}`").alias("component_id"))
    out = found.join(ids, "_root", "left").select(F.col(f"`{doc_id}`"), F.col("_n").alias("n_shingles"), F.coalesce("component_id", F.col(f"`{doc_id}`")).alias("component_id"))
    return out.withColumn("kept", F.col(f"`{doc_id}`").eqNullSafe(F.col("component_id")))


def one_of_each(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """The rows of `df` without near duplicates: of each component the row with the smallest id stays, of rows that agree on everything one."""
    columns = df.columns
    df, new = plain_names(df)
    text, doc_id = new[text], new[doc_id]
    row = F.xxhash64(*df.columns)
    found = grouped(df.withColumn("_row", row), keep=["_row"], text=text, doc_id=doc_id, percent=percent).withColumnRenamed(doc_id, "_id")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_row"))
    with_words = found.where("_root IS NOT NULL").groupBy("_root").agg(F.min(place).alias("top"), F.count("*").alias("n")).where("n > 1")
    first = with_words.select("_root", "top.*")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._row") == F.col("b._row"))
    placed = found.alias("a").join(first.alias("b"), "_root").select(F.col("a._id").alias("_id"), F.col("a._row").alias("_row"), same.alias("_again"))
    # Equal rows have one root, and so one verdict.
    verdict = written(placed.groupBy("_id", "_row").agg(F.max("_again").alias("_again"), F.count("*").alias("n")).where("NOT _again OR n > 1").drop("n"))
    rest = [c for c in df.columns if c != text]
    rows = squeezed(df.withColumn("_row", row), [*rest, "_row"], text)
    hit = (F.col(f"r.`{doc_id}`").eqNullSafe(F.col("v._id"))) & (F.col("r._row") == F.col("v._row"))
    left = rows.alias("r").join(verdict.alias("v"), hit, "left").where("_again IS NULL OR _again").select(*[F.col(f"r.`{c}`") for c in rest], "_z", F.col("r._row").alias("_row"), "_again")
    single = left.where("_again IS NULL").unionByName(left.where("_again").dropDuplicates(["_row"]))
    return unsqueezed(single, rest, text).select(*df.columns).toDF(*columns)
