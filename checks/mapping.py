"""The model's tables derived from a star schema of orders and documents.

Each column is an expression that means the same in Spark SQL and in ANSI SQL
engines, so that checks can state the same inputs to both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeboard.sources.schema import REPO, USER, evolve

# From customer. Unknown values, hidden rows and odd places are put in on purpose.
USER_EXPRESSIONS = {
    "login": "c_name",
    "email": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('c', cast(c_custkey AS STRING), '@example.org') END",
    "location": (
        "CASE WHEN c_custkey % 8 = 0 THEN 'St. Louis, MO' WHEN c_custkey % 8 = 1 THEN 'stl'"
        " WHEN c_custkey % 8 = 2 THEN 'SAINT LOUIS' WHEN c_custkey % 8 = 3 THEN 'near St Louis'"
        " WHEN c_custkey % 8 = 4 THEN NULL WHEN c_custkey % 8 = 5 THEN '' ELSE 'Chicago' END"
    ),
    "hireable": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 4 = 1 END",
    "blog": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('https://example.org/', c_name) END",
    "bio": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('Works in ', lower(c_mktsegment)) END",
    "followers": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(floor(abs(c_acctbal)) AS INT) END",
    "following": "cast(c_custkey % 29 AS INT)",
    "public_repos": "CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE cast(c_custkey % 40 AS INT) END",
    "public_gists": "cast(c_custkey % 9 AS INT)",
    "avatar_url": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('https://img.example.org/', cast(c_custkey AS STRING)) END",
    "disk_usage": "cast(c_custkey * 3 % 1000 AS INT)",
    "created_at": "cast(DATE '2011-06-01' + cast(c_custkey * 37 % 5300 AS INT) AS TIMESTAMP)",
    "updated_at": "CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE TIMESTAMP '2024-02-03 04:05:06' END",
    "type": "CASE WHEN c_nationkey % 5 = 0 THEN 'Organization' ELSE 'User' END",
    "name": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('Name ', cast(c_custkey AS STRING)) END",
    "hide": "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN true ELSE false END",
    "is_admin": "c_custkey % 50 = 7",
    "refreshed_at": "TIMESTAMP '1998-01-01 00:00:00'",
    "company": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END",
}
USER_SQL = "customer"

# From orders joined to customer.
REPO_EXPRESSIONS = {
    "owner": "c_name",
    "name": "concat('repo-', cast(o_orderkey AS STRING))",
    "description": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE concat(c_mktsegment, ' order_', o_orderpriority, ' 100%') END",
    "language": "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END",
    "homepage": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('https://example.org/r/', cast(o_orderkey AS STRING)) END",
    "forks_count": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE cast(o_orderkey % 97 AS INT) END",
    "network_count": "cast(o_orderkey % 31 AS INT)",
    "open_issues_count": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderkey % 17 AS INT) END",
    "stargazers_count": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE cast(floor(o_totalprice / 1000) AS INT) END",
    "subscribers_count": "cast(o_orderkey % 11 AS INT)",
    "watchers_count": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 53 AS INT) END",
    "size": "cast(floor(o_totalprice) AS INT)",
    "fork": "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_orderstatus = 'F' END",
    "default_branch": "CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'master' END",
    "master_branch": "CASE WHEN o_orderkey % 6 = 0 THEN 'master' ELSE NULL END",
    "created_at": "cast(o_orderdate AS TIMESTAMP)",
    "pushed_at": "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE cast(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END",
    "updated_at": "cast(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY",
    "refreshed_at": "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE cast(o_orderdate AS TIMESTAMP) END",
}
REPO_SQL = "orders JOIN customer ON c_custkey = o_custkey"

# Texts as repositories, to search whole descriptions.
DOCUMENT_EXPRESSIONS = {
    "owner": "source",
    "name": "concat('doc-', cast(doc_id AS STRING))",
    "description": "text",
    "language": "lang",
    "stargazers_count": "cast(n_chars AS INT)",
}
PAGE_EXPRESSIONS = {
    "owner": "'pages'",
    "name": "concat(url, '#', cast(page_id AS STRING))",
    "description": "html",
    "stargazers_count": "cast(page_id % 1000 AS INT)",
}

# From lineitem joined to supplier: few owners with very many repositories each.
PACKAGE_EXPRESSIONS = {
    "owner": "s_name",
    "name": "concat(cast(l_orderkey AS STRING), '.', cast(l_linenumber AS STRING), '.', cast(l_partkey AS STRING))",
    "language": "concat(l_returnflag, l_linestatus)",
    "forks_count": "cast(floor(l_quantity) AS INT)",
    "stargazers_count": "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE cast(floor(l_extendedprice / 100) AS INT) END",
    "fork": "l_linenumber = 7",
    "created_at": "cast(l_shipdate AS TIMESTAMP)",
}
PACKAGE_SQL = "lineitem JOIN supplier ON s_suppkey = l_suppkey"
SUPPLIER_SQL = "supplier"
SUPPLIER_EXPRESSIONS = {
    "login": "s_name",
    "name": "concat('Name of ', s_name)",
    "company": "''",
    "type": "CASE WHEN s_nationkey % 2 = 0 THEN 'Organization' ELSE 'User' END",
    "followers": "cast(floor(abs(s_acctbal)) AS INT)",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the files once, not for every query."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _select(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in expressions.items()])


def users(spark: SparkSession, folder: str) -> DataFrame:
    return evolve(_select(table(spark, folder, "customer"), USER_EXPRESSIONS), USER)


def repos(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")
    )
    return evolve(_select(joined, REPO_EXPRESSIONS), REPO)


def document_repos(spark: SparkSession, folder: str) -> DataFrame:
    return evolve(_select(table(spark, folder, "documents"), DOCUMENT_EXPRESSIONS), REPO)


def page_repos(spark: SparkSession, folder: str) -> DataFrame:
    return evolve(_select(table(spark, folder, "pages"), PAGE_EXPRESSIONS), REPO)


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return evolve(_select(table(spark, folder, "supplier"), SUPPLIER_EXPRESSIONS), USER)


def packages(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")
    )
    return evolve(_select(joined, PACKAGE_EXPRESSIONS), REPO)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("created_at"))
