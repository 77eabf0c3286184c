"""Tables of a data folder, and the shapes that the operators expect, derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Articles from documents and labels: one an hour, so that no two share a time."""
    d = table(spark, folder, "documents")
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return d.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.col("lang").alias("category_slug"),
        F.col("source").alias("series_slug"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("draft"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("featured"),
        at.alias("published_at"),
        F.when(F.col("doc_id") % 3 == 0, at + F.make_dt_interval(days=F.col("doc_id").cast("int") % 5 + 1)).alias("updated_at"),
        F.array(F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("t"), (F.col("doc_id") % 11).cast("string"))).alias("tags"),
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """The categories in use and one that has no article."""
    return table(spark, folder, "documents").select(F.col("lang").alias("slug")).where("slug is not null").distinct().union(spark.createDataFrame([("unused",)], "slug string"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Speech segments from conversations. Turns may repeat: the text decides between equal turns."""
    c = table(spark, folder, "conversations")
    return c.select(F.col("conv_id").alias("article_id"), F.col("turn").alias("ordinal"), F.col("role").alias("type"), F.coalesce("text", F.lit("")).alias("text"))


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of recordings from order lines: the quantity is the duration in seconds."""
    li = table(spark, folder, "lineitem")
    return li.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").cast("timestamp").alias("t"), F.col("l_quantity").cast("long").alias("seconds"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Blind scores from order lines: the case is the line number, 0 is no valid score."""
    li = table(spark, folder, "lineitem")
    return li.select(F.col("l_linenumber").alias("case_id"), F.col("l_suppkey").alias("candidate"), (F.col("l_quantity").cast("int") % 6).alias("score"), (F.col("l_orderkey") % 5).cast("int").alias("criterion"))


def reader_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
