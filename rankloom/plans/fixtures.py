"""Inputs of the reference queries, derived from the given tables by SQL that Spark and DuckDB both run.

`{name}` stands for a base table. The oracles inline the same texts as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "fx_products": """SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS product_title,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_type, '  ', p_name) END AS product_bullet_point,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat(p_name, ' ', p_type) END AS product_description,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS product_brand,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS product_color,
       CASE WHEN p_partkey % 10 < 8 THEN 'us' ELSE 'es' END AS product_locale FROM {part}""",
    "fx_catalog": "SELECT doc_id AS item_id, text FROM {documents}",
    "fx_queries": "SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 4 = 0 THEN 'train' ELSE 'test' END AS split FROM {benchmark}",
    "fx_qrels": """SELECT b.item_id AS query_id, d.doc_id AS item_id,
       CASE WHEN (d.doc_id * 7 + b.item_id * 3) % 10 = 0 THEN 'C' WHEN (d.doc_id * 7 + b.item_id * 3) % 10 IN (1, 2) THEN 'I'
            WHEN (d.doc_id * 7 + b.item_id * 3) % 10 IN (3, 4, 5) THEN 'S' ELSE 'E' END AS label,
       CASE WHEN b.item_id % 4 = 0 THEN 'train' ELSE 'test' END AS split
       FROM {documents} d JOIN {benchmark} b ON (d.doc_id * 31) % 23 = (23 - (b.item_id * 17) % 23) % 23""",
    "fx_logits": """SELECT event_id % 200 AS item_id, event_id % 17 AS position, CAST(floor(value) AS BIGINT) % 50 AS term_id,
       (value - 50.0e0) / 10.0e0 AS logit, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS mask FROM {events}""",
    "fx_items": "SELECT vec_id AS item_id, embedding AS vector FROM {embeddings}",
    "fx_vectors": "SELECT b.item_id AS query_id, e.embedding AS vector FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id",
    "fx_interactions": "SELECT user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS item_id, ts, event_id FROM {events}",
    "fx_purchases": """SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, o.o_orderdate AS ts, l.l_orderkey AS ok, l.l_linenumber AS ln
       FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def inlined(name: str) -> str:
    """The fixture's SQL over the plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", SQL[name])
