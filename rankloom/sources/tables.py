"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of a product's text columns.
TEXT_COLUMNS = ["product_title", "product_bullet_point", "product_description", "product_brand", "product_color"]

JUDGMENTS = "query_id bigint, query string, item_id bigint, label string, locale string, split string"
INTERACTIONS = "user_id bigint, item_id int, ts timestamp, event_id bigint"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A scan with its filter and projection pushed to the files; missing columns fail at once."""
    df = spark.read.parquet(path)
    if missing := set(columns or ()) - set(df.columns):
        raise ValueError(f"{path} has no {sorted(missing)}")
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def judgments(examples: DataFrame, locale: str, split: str) -> DataFrame:
    return examples.where((F.col("locale") == locale) & (F.col("split") == split)).select("query_id", "query", "item_id", "label")


def catalog(products: DataFrame, locale: str) -> DataFrame:
    """One locale's products; null texts are empty."""
    return products.where(F.col("product_locale") == locale).fillna("", subset=TEXT_COLUMNS).drop("product_locale")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Write `df` with a directory for each value of `by`, so that a filter on these columns decides which files are read; values of any size are spread over files."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def judgments_at(spark: SparkSession, path: str, locale: str, split: str) -> DataFrame:
    """`judgments` of a table written by locale and split: the files of the others are not opened."""
    return judgments(spark.read.schema(JUDGMENTS).parquet(path), locale, split)


def catalog_at(spark: SparkSession, path: str, locale: str) -> DataFrame:
    """`catalog` of a table written by product_locale."""
    return catalog(spark.read.option("basePath", path).parquet(path), locale)


def interactions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, ts, event_id) of interactions kept as a JSON object a line; lines that are none are left out."""
    return spark.read.schema(f"{INTERACTIONS}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt IS NULL").drop("_corrupt")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_vectors(df: DataFrame, path: str) -> None:
    """Write (item_id, vector) so that each item stands in one file, in order."""
    df.repartition("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Saved vectors; missing columns fail at once."""
    return parquet(spark, path, ["item_id", "vector"])
