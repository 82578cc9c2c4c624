"""The one way this library ranks: a window within keys, ordered to the last tie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import cut

#: Scores are rounded before they are ranked, since the order of a sum's terms is not fixed.
SCORE_DIGITS = 6
#: The label order and the two gain tables.
LABELS = ["E", "S", "C", "I"]
GRADED = {"E": 3, "S": 2, "C": 1, "I": 0}
POOL_GAINS = {"E": 1.0, "S": 0.7, "C": 0.5, "I": 0.0}


def ranked(df: DataFrame, keys: list[str], *order: Column, top: int | None = None, name: str = "rank") -> DataFrame:
    """`df` with its row number within `keys`; with `top`, Spark cuts each partition before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if top is None else out.where(F.col(name) <= top)


def best_first(score: str = "score", tie: str = "item_id") -> list[Column]:
    return [F.col(score).desc(), F.col(tie).asc()]


def rounded(c: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(c, digits)


def mapped(c: Column, table: dict, default: Column) -> Column:
    """`c` looked up in a small fixed table."""
    out = F
    for key, value in table.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(default)


def sample_order(key: Column, seed: int = 42) -> Column:
    """Sorting by this draws a sample that is the same in every engine and on every cluster."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def running(df: DataFrame, keys: list[str], order: list[str], n: str, name: str = "before") -> DataFrame:
    """`df` with the sum of `n` over the rows of the same keys that come earlier in `order`, which must be unique within them.

    Rows are dealt out by range, so a group of any size is spread over tasks; only one sum for each task and group meets in one place.
    """
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(n).alias("_sum"))
    ahead = sums.select(*keys, "_part", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")).alias("_ahead"))
    own = F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy(*order)) - F.col(n)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_part")]
    return dealt.withColumn("_own", own).alias("a").join(ahead.alias("b"), same).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_own") + F.col("_ahead")).alias(name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with each row's place from 0 in `order`, which must be unique."""
    return running(df.withColumn("_one", F.lit(1)), [], order, "_one", name).drop("_one")


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of `value` with linear interpolation, one column for each of `at`, by counts of the distinct values; nulls are left out."""
    there = df.where(F.col(value).isNotNull())
    rows = running(there.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), keys, ["_v"], "_n")
    total = there.groupBy(*keys).agg(F.count("*").alias("_all"))
    both = rows.join(total, keys) if keys else rows.crossJoin(total)
    here = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_n")), F.col("_v")))
    out = []
    for name, p in at.items():
        place = (F.col("_all") - 1) * F.lit(float(p))
        low, high = here(F.floor(place)), here(F.ceil(place))
        out.append((low + (high - low) * (F.max(place) - F.floor(F.max(place)))).alias(name))
    return both.groupBy(*keys).agg(*out)


def sampled_within(df: DataFrame, keys: list[str], of: Column, most: int) -> DataFrame:
    """At most `most` rows of each group, those whose `of` (unique in the group) comes first by `sample_order`.

    Groups of any size: counts by the first three digits of the digest tell from which digit on no row can be taken, so that
    hardly more than the sample is shuffled and ranked."""
    rows = df.withColumn("_o", sample_order(of)).withColumn("_bin", F.substring("_o", 1, 3))
    bins = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_n")
    near = bins.withColumn("_before", before).where(F.col("_before") < most).select(*keys, "_bin")  # 4096 rows a group at the most
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_bin")]
    kept = rows.alias("a").join(near.alias("b"), same, "left_semi")
    return ranked(kept, keys, F.col("_o"), top=most, name="_r").drop("_o", "_bin", "_r")
