"""Labelled views of the test tables: key columns, a 0/1 ``label`` and ``features``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.sources.tables import read_table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
EVENT, ORDER, VEC, DOC, CUSTOMER = ["event_id"], ["o_orderkey"], ["vec_id"], ["doc_id"], ["c_custkey"]


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(
        spark,
        f"{sf}/lineitem.parquet",
        LINE,
        (F.col("l_quantity") >= 48).cast("int"),
        {c: F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_linenumber")},
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(
        spark,
        f"{sf}/events.parquet",
        EVENT,
        (F.col("event_type") == "error").cast("int"),
        {"value": F.col("value"), "user": F.col("user_id"), "hour": F.hour("ts"), "day": F.dayofmonth("ts")},
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(
        spark,
        f"{sf}/orders.parquet",
        ORDER,
        (F.col("o_totalprice") >= 450000).cast("int"),
        {
            "customer": F.col("o_custkey"),
            "month": F.month("o_orderdate"),
            "priority": F.substring("o_orderpriority", 1, 1).cast("int"),
        },
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by balance, nation and number, 1 for a debt."""
    return read_table(
        spark,
        f"{sf}/customer.parquet",
        CUSTOMER,
        (F.col("c_acctbal") < 0).cast("int"),
        {"balance": F.col("c_acctbal"), "nation": F.col("c_nationkey"), "number": F.col("c_custkey")},
    )


def embeddings(spark: SparkSession, sf: str, rare: str = "label = 5") -> DataFrame:
    """One class of the vectors against the rest."""
    raw = spark.read.parquet(f"{sf}/embeddings.parquet")
    return raw.select(
        "vec_id", F.expr(rare).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("features")
    )


def labelled_documents(spark: SparkSession, sf: str, label: str = "toxic") -> DataFrame:
    """Shape statistics of the whole text of every labelled document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = F.greatest(F.length("text"), F.lit(1))

    def share(pattern: str):  # noqa: ANN202
        return F.regexp_count("text", F.lit(pattern)) / size

    stats = docs.select(
        "doc_id",
        F.array(
            F.col("n_chars").cast("double"),
            F.size(F.split("text", r"\s+")).cast("double"),
            share("[0-9]"),
            share("[A-Z]"),
            share("[.,;:!?]"),
        ).alias("features"),
    )
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    return labels.join(stats, "doc_id")
