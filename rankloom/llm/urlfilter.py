"""URL rules by a sort-merge range join over reversed-host canonical keys.

A rule names a host and the start of a path; it fits the host itself and all its subdomains. The
key of (host, path) is the host's labels in reverse, a byte 1 and the path, so a rule fits exactly
the keys that begin with its own key: an interval [key, key + FF). A URL is looked up once for
each of its parent hosts. Intervals of prefixes are disjoint or nested. A sweep in key order opens a rule at
its start and closes it at its end, and keeps the stack of open rules: the depth is a running sum of +1 and -1, and
the slot of a depth holds the rule that was opened last at it, so a URL's innermost rule is in the slot of its own depth.

Everything is DataFrame work. URLs are reduced to distinct (host, path) first. The sweep is dealt
by top-level label and a hash of the path into shares of about `SHARE_KEYS` keys, by the counted keys of each label; a
label's rules are repeated for each of its shares.

The longest fitting rule (characters of host and path together, then the rule's text) wins.
Null URL, or one without "://": host and path are empty, no rule fits. Rules that are repeated
count once; of rules with the same host and path but other verdicts the smallest verdict counts.
Repeated rows give repeated results; an empty table or no rules are fine. Kept columns named like a new one give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.lineage import checked_broadcast, written

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Keys of a share, about, and labels whose numbers of shares are sent to every executor at the most.
SHARE_KEYS, SENT = 200_000, 1_000_000
NEW = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def key_of(labels: Column, path: Column) -> Column:
    """Binary sort key: reversed labels, byte 1, path."""
    return F.concat(F.array_join(F.reverse(labels), ".").cast("binary"), F.expr("X'01'"), path.cast("binary"))


def boundaries(rules: DataFrame) -> DataFrame:
    """(label, at, step, own): each rule's start (+1) and end (-1) in key order."""
    labels = F.split("host", "\\.")
    one = (
        rules.select(F.translate("host", UPPER, LOWERED).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(F.element_at(labels, -1).alias("label"), key_of(labels, F.col("path")).alias("key"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("own"))
    )
    ends = F.array(F.struct(F.col("key").alias("at"), F.lit(1).alias("step")), F.struct(F.concat("key", F.expr("X'FF'")).alias("at"), F.lit(-1).alias("step")))
    return one.select("label", F.inline(ends), "own")


def fitting(places: DataFrame, rules: DataFrame, share_keys: int = SHARE_KEYS) -> DataFrame:
    """(host, path, rule, verdict) of the longest rule for those of the distinct (host, path) that have one."""
    labels = F.split("host", "\\.")
    hosts = places.select("host", "path", labels.alias("labels"), F.element_at(labels, -1).alias("label"))
    sizes = written(hosts.groupBy("label").agg((1 + F.floor(F.sum(F.size("labels")) / share_keys)).alias("shares")))
    dealt = hosts.join(checked_broadcast(sizes, SENT), "label").withColumn("share", F.pmod(F.xxhash64("host", "path"), F.col("shares")))
    keys = dealt.select("label", "share", "host", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    probes = keys.select("label", "share", key_of(F.slice("labels", -F.col("n"), F.col("n")), F.col("path")).alias("at"), F.lit(0).alias("step"), none.alias("own"), "host", "path")
    steps = boundaries(rules).join(sizes, "label").select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), "at", "step", "own", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    # At the same key a rule is opened before URLs are looked up.
    order = [F.col("at"), F.abs("step").desc()]
    depth = F.sum("step").over(Window.partitionBy("label", "share").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slot = Window.partitionBy("label", "share", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("step") == 1, F.col("own"))
    swept = steps.unionByName(probes).withColumn("depth", depth).where("depth > 0").withColumn("top", F.last(opened, ignorenulls=True).over(slot))
    best = F.max_by("top", F.struct(F.length("top.rule"), F.col("top.rule")))
    return swept.where("step = 0 AND top IS NOT NULL").groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judged(df: DataFrame, rules: DataFrame, *, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """The columns `keep`, host, path, rule (null: none fits) and verdict (the rule's, else `default`). rules: host, path, verdict."""
    keep = [c for c in keep if c not in NEW]
    own = [f"c{i}" for i in range(len(keep))]
    places = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own, strict=True)], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    found = fitting(places.select("host", "path").where("host <> ''").distinct(), rules)
    return places.join(found, ["host", "path"], "left").select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).toDF(*keep, *NEW)
