"""Tokens and item texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]{2,})"
#: The English stop words of the lexical index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
#: Fixed value: how an item's fields make its text.
TEMPLATE = "{title}. {bullet_point}. Brand: {brand}"


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more, in order, stop words included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tokenize(df: DataFrame, key: str, text: str, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, term): one row for every token that is no stop word."""
    out = df.select(F.col(key), F.explode(tokens(F.col(text))).alias("term"))
    return out.where(~F.col("term").isin(stop_words)) if stop_words else out


def counted_tokens(df: DataFrame, key: str, text: str, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(key, size, term, tf): one row for each distinct token that is no stop word, and how many tokens the row has; nothing is shuffled.

    The tokens of a row are sorted, so that equal ones stand together and a term's count is the gap between two beginnings.
    """
    found = F.array_sort(F.filter(tokens(F.col(text)), lambda t: ~t.isin(stop_words)) if stop_words else tokens(F.col(text)))
    rows = df.select(F.col(key), found.alias("_t")).withColumn("_n", F.size("_t")).where("_n > 0")
    begins = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda i: (i == 1) | (F.element_at("_t", i) != F.element_at("_t", F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("_at", begins)
    each = F.transform("_at", lambda i, k: F.struct(F.element_at("_t", i).alias("term"), (F.coalesce(F.get("_at", k + 1), F.col("_n") + 1) - i).cast("long").alias("tf")))
    return rows.select(key, F.col("_n").cast("long").alias("size"), F.inline(each))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with {names} replaced by columns, null as empty."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))
