"""Merkle manifest of a dataset: a tree of its documents for each group, a tree of their roots above, and proofs.

A leaf is the SHA-256 (lower-case hex) of a document's fields, each as its UTF-8 byte count, a colon and the value, or
`-` if null. In a group leaves ascend by key; while several nodes remain, every `RUN` consecutive ones (the last run may
be shorter, even one) become the digest of their hex digests. The group roots, null group first, then bytewise, are
the leaves of the tree above.

Proofs are octopus multiproofs. Leaves are dealt in order to partitions of RUN ** HEIGHT, whose own tree is
complete. Each partition computes the least set of node coordinates outside itself that the proofs of all its leaves
need, fetches them in one join, derives the interiors that its proofs share, and expands the single proofs locally.
Groups of any size are dealt out by range and partition; the nodes above partitions are a 4096th of the leaves,
and one that very many partitions need is repeated for every so many of them, so that no key of the join grows.

Null fields are `-`; a null key sorts first, a null group is one of its own. Repeated rows are leaves of their own, side by
side. Equal keys are ordered by their leaves. An empty text is `0:`. An empty table has no leaves and no root. Texts of any
length are hashed in the scan and not shuffled. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import written
from rankloom.functions.ranking import numbered, running
from rankloom.llm.common import modest_batches

RUN = 16
#: Levels of a partition's own tree: it has up to RUN ** HEIGHT leaves (131 KB of digests).
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The leaf of a document as 32 bytes."""
    plain = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in plain]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with the leaves first..last of n, give all their proofs."""
    out, level = [], 0
    while n > 1:
        low, high = first // RUN, last // RUN
        out += [(level, at) for at in (*range(low * RUN, first), *range(last + 1, min(n, high * RUN + RUN)))]
        first, last, n, level = low, high, -(-n // RUN), level + 1
    return out


class Branch:
    """What a partition knows of its tree: its leaves from place `first` on, the fetched nodes, and what follows from them."""

    def __init__(self, first: int, leaves: list[str], n: int, fetched: list[tuple[int, int, str]] = (), height: int = HEIGHT):
        self.levels, self.sizes, self.above = [], [], {}
        known, level = dict(enumerate(leaves, first)), 0
        while True:
            own = list(known)
            known |= {at: x for k, at, x in fetched if k == level}
            self.levels.append(known)
            self.sizes.append(n)
            if n == 1 or level == height and not fetched:
                break
            known = {p: digest("".join(known[c] for c in range(p * RUN, min(n, p * RUN + RUN)))) for p in dict.fromkeys(at // RUN for at in own)}
            n, level = -(-n // RUN), level + 1

    def top(self) -> str:
        return next(iter(self.levels[-1].values()))

    def siblings(self, level: int, at: int) -> str:
        known, first = self.levels[level], at // RUN * RUN
        return "".join(known[c] for c in range(first, min(self.sizes[level], first + RUN)) if c != at)

    def proof(self, at: int, level: int = 0) -> str:
        """The siblings of a node and of the nodes above it, left to right, level by level."""
        if level == len(self.levels) - 1:
            return ""
        if level == 0:
            return self.siblings(0, at) + self.proof(at // RUN, 1)
        if (level, at) not in self.above:
            self.above[level, at] = self.siblings(level, at) + self.proof(at // RUN, level + 1)
        return self.above[level, at]

    def fold(self, at: int, value: str) -> str:
        """The root that follows if the leaf at `at` were `value`."""
        for known, n in zip(self.levels[:-1], self.sizes[:-1], strict=True):
            first = at // RUN * RUN
            value = digest("".join(value if c == at else known[c] for c in range(first, min(n, first + RUN))))
            at //= RUN
        return value


def parts_of(leaves: DataFrame, trees: DataFrame, more: list[str], height: int) -> DataFrame:
    """A row for each RUN ** height consecutive leaves of (_tree, _at, _leaf, *more), in order, with the columns of `trees` (_tree, _n, ...), written."""
    rows = leaves.groupBy("_tree", F.floor(F.col("_at") / RUN**height).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_at", "_leaf", *more))).alias("_leaves"))
    return written(beside(rows, trees, height))


def beside(parts: DataFrame, trees: DataFrame, height: int) -> DataFrame:
    """`parts` joined with a row for each tree, which is repeated for every RUN ** height of its partitions."""
    part = RUN**height
    blocks = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / (part * part)).cast("int"))
    return parts.withColumn("_block", F.floor(F.col("_part") / part).cast("int")).join(trees.withColumn("_block", F.explode(blocks)), ["_tree", "_block"]).drop("_block")


def each_row(batches):
    """One row at a time as a dictionary, since a row may hold thousands of leaves."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def leaves_in(row: dict) -> tuple[int, list[str]]:
    return row["_leaves"][0]["_at"], [x["_leaf"].hex() for x in row["_leaves"]]


def tops(parts: DataFrame, height: int) -> DataFrame:
    """(_tree, _n, _at, _node): the highest node that each partition has by itself."""

    def run(batches):
        for row in each_row(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row["_tree"]]), pa.array([row["_n"]], pa.int64()), pa.array([row["_part"]], pa.int64()), pa.array([Branch(*leaves_in(row), row["_n"], height=height).top()])], names=["_tree", "_n", "_at", "_node"])

    return parts.select("_tree", "_n", "_part", F.transform("_leaves", lambda x: F.struct(x["_at"].alias("_at"), x["_leaf"].alias("_leaf"))).alias("_leaves")).mapInArrow(run, "_tree string, _n long, _at long, _node string")


def nodes_above(parts: DataFrame, most: int, height: int) -> DataFrame:
    """(_tree, _n, _level, _at, _node) from the partitions' own tops to the roots; `most` is the greatest _n."""
    level = written(tops(parts, height)).withColumn("_level", F.when(F.col("_n") > RUN**height, F.lit(height)).otherwise(F.lit(-1)))
    found, at = level, height
    while RUN**at < most:
        run = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_node"))), lambda x: x["_node"])
        below = level.where((F.col("_level") == at) & (F.col("_n") > RUN**at))
        at += 1
        level = written(below.groupBy("_tree", "_n", F.floor(F.col("_at") / RUN).alias("_at")).agg(F.sha2(F.array_join(run, ""), 256).alias("_node")).withColumn("_level", F.lit(at)))
        found = found.unionByName(level)
    return written(found)


def roots(nodes: DataFrame) -> DataFrame:
    """(_tree, _root): of a tree of one partition its top, else the node of the highest level."""
    return nodes.groupBy("_tree").agg(F.max_by("_node", "_level").alias("_root"))


def fetched(parts: DataFrame, nodes: DataFrame, height: int) -> DataFrame:
    """(_tree, _part, _fetched): the nodes outside it that each partition needs, by one join."""
    part = RUN**height

    def run(batches):
        for row in each_row(batches):
            last = min(row["_n"], row["_part"] * part + part) - 1
            need = missing(row["_part"] * part, last, row["_n"])
            yield pa.RecordBatch.from_arrays([pa.array([row["_tree"]] * len(need), pa.string()), pa.array([row["_part"]] * len(need), pa.int64()), *(pa.array([x[i] for x in need], kind) for i, kind in ((0, pa.int32()), (1, pa.int64())))], names=["_tree", "_part", "_level", "_at"])

    need = parts.select("_tree", "_part", "_n").where(F.col("_n") > part).mapInArrow(run, "_tree string, _part long, _level int, _at long")
    # The partitions below a node's parent need it: from `low` to `high`, in blocks of `part`.
    wide = F.pow(F.lit(float(RUN)), F.col("_level") + 1 - height)
    low = F.floor(F.floor(F.col("_at") / RUN) * wide)
    high = F.least(low + wide - 1, F.floor((F.col("_n") - 1) / part))
    blocks = F.sequence(F.floor(low / part).cast("int"), F.floor(high / part).cast("int"))
    there = nodes.where(F.col("_n") > RUN ** F.col("_level")).where("_level >= 0").select("_tree", "_level", "_at", "_node", F.explode(blocks).alias("_block"))
    got = need.withColumn("_block", F.floor(F.col("_part") / part).cast("int")).join(there, ["_tree", "_level", "_at", "_block"])
    return got.groupBy("_tree", "_part").agg(F.collect_list(F.struct("_level", "_at", "_node")).alias("_fetched"))


def with_fetched(parts: DataFrame, nodes: DataFrame, height: int) -> DataFrame:
    return parts.join(fetched(parts, nodes, height), ["_tree", "_part"], "left")


def branch_of(row: dict) -> Branch:
    return Branch(*leaves_in(row), row["_n"], [(x["_level"], x["_at"], x["_node"]) for x in row["_fetched"] or []])


def root_branches(trees: DataFrame, subroots: DataFrame, height: int) -> DataFrame:
    """(_tree, _n, _place, _count, _runs, _root): for each tree the siblings of its root, level by level, in the tree of roots, and the root of all."""
    leaves = trees.join(subroots, "_tree").select(F.col("_tree").alias("_of"), F.col("_n").alias("_size"), F.lit("").alias("_tree"), F.col("_place").alias("_at"), F.unhex("_root").alias("_leaf"))
    n = trees.count()
    one = trees.sparkSession.range(1).select(F.lit("").alias("_tree"), F.lit(n).cast("long").alias("_n"))
    parts = parts_of(leaves, one, ["_of", "_size"], height)
    nodes = nodes_above(parts, n, height)

    def run(batches):
        for row in each_row(batches):
            branch, of = branch_of(row), row["_leaves"]
            runs = []
            for x in of:
                at, steps = x["_at"], []
                for level in range(len(branch.levels) - 1):
                    steps.append(branch.siblings(level, at))
                    at //= RUN
                runs.append(steps)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["_of"] for x in of]), pa.array([x["_size"] for x in of], pa.int64()), pa.array([x["_at"] for x in of], pa.int64()), pa.array(runs, pa.list_(pa.string())), pa.array([branch.top()] * len(of))],
                names=["_tree", "_n", "_place", "_runs", "_root"],
            )

    return written(with_fetched(parts, nodes, height).mapInArrow(run, "_tree string, _n long, _place long, _runs array<string>, _root string"))


def folded(value: str, place: int, runs: list[str]) -> str:
    """The root of all from a group's root and its siblings."""
    for text in runs:
        k = place % RUN * 64
        value = digest(text[:k] + value + text[k:])
        place //= RUN
    return value


def proofs(df: DataFrame, *, keep: list[str], fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", claims: dict[str, Column] | None = None, changed: Column | None = None, siblings: bool = False, height: int = HEIGHT) -> DataFrame:
    """The columns `keep` and leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    `claims` gives other values of some fields, as expressions, for the rows where `changed` holds: their fold begins with the leaf
    of the claimed values and uses the siblings of the real tree. With `siblings`, the proof itself comes as the column `proof`. Kept columns must be comparable (no maps).
    """
    modest_batches(df.sparkSession)
    new = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if siblings else [])]
    keep = [c for c in keep if c not in new]
    named = lambda c: F.col(f"`{c}`")
    claimed = F.when(changed, leaf([(claims or {}).get(c, named(c)) for c in fields])) if changed is not None else F.lit(None).cast("binary")
    kept = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.lit(None).cast("boolean")
    tree = F.coalesce(F.concat(F.lit("s"), named(group).cast("string")), F.lit(""))
    rows = df.select(tree.alias("_tree"), named(key).alias("_key"), leaf([named(c) for c in fields]).alias("_leaf"), claimed.alias("_claim"), kept.alias("_kept"), F.monotonically_increasing_id().alias("_row"), F.lit(1).alias("_one"))
    leaves = written(running(rows, ["_tree"], ["_key", "_leaf", "_row"], "_one", "_at").select("_tree", "_at", "_leaf", "_claim", "_kept"))
    trees = written(numbered(leaves.groupBy("_tree").agg(F.count("*").alias("_n")), ["_tree"], "_place"))
    parts = parts_of(leaves, trees.drop("_place"), ["_claim", "_kept"], height)
    nodes = nodes_above(parts, trees.agg(F.max("_n")).first()[0] or 0, height)
    whole = beside(with_fetched(parts, nodes, height).drop("_n"), root_branches(trees, roots(nodes), height), height)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_leaves")
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_leaves"}
                own = batch.column(at)[i].values
                first, real, claim = own.field("_at")[0].as_py(), [x.hex() for x in own.field("_leaf").to_pylist()], own.field("_claim").to_pylist()
                branch = Branch(first, real, row["_n"], [(x["_level"], x["_at"], x["_node"]) for x in row["_fetched"] or []])
                above = "".join(row["_runs"])
                made = [branch.proof(k) + above for k in range(first, first + len(real))]
                fold = [folded(branch.fold(k, c.hex() if c is not None else x), row["_place"], row["_runs"]) for k, (c, x) in enumerate(zip(claim, real, strict=True), first)]
                columns = [real, [branch.top()] * len(real), [row["_root"]] * len(real), [digest(p) for p in made], fold]
                out = [own.field("_kept"), *(pa.array(c, pa.string()) for c in columns), pa.array([x == row["_root"] for x in fold], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(made, pa.string())] if siblings else [])], names=["_kept", *new])

    schema = leaves.select("_kept").schema
    for c in new:
        schema = schema.add(c, "boolean" if c == "verified" else "string")
    made = whole.select("_n", "_leaves", "_fetched", "_place", "_runs", "_root").mapInArrow(run, schema)
    return made.select(*[F.col(f"_kept.c{i}").alias(c) for i, c in enumerate(keep)], *new)
