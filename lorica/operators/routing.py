"""Requests to rules: redirects and response headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import bounded


def redirected(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (path) with the target and status of the first rule (ord, from, to, status) that fits: the same path, or
    a rule that ends in * and begins the path. Rules are a short list kept by hand and are broadcast."""
    r = bounded(rules)
    exact = requests.join(r.where(~F.col("from").endswith("*")), requests["path"] == r["from"]).select("path", "ord", "to", "status")
    wild = r.where(F.col("from").endswith("*")).withColumn("start", F.expr("left(from, length(from) - 1)"))
    begun = requests.join(wild, requests["path"].startswith(wild["start"])).select("path", "ord", "to", "status")
    best = exact.unionByName(begun).groupBy("path").agg(F.min(F.struct("ord", "to", "status")).alias("r"))
    return requests.distinct().join(best, "path", "left").select("path", F.col("r.to").alias("target"), F.col("r.status").alias("status"))


def response_headers(host: Column, content_type: Column, headers: Column, preview: str) -> Column:
    """The headers map: pages of preview hosts are not indexed, others lose that header; HTML loses the origin header."""
    html = F.lower(content_type).contains("text/html")
    base = F.map_filter(headers, lambda k, v: ~((F.lower(k) == "x-robots-tag") | ((F.lower(k) == "access-control-allow-origin") & html)))
    marked = F.map_concat(base, F.create_map(F.lit("x-robots-tag"), F.lit("noindex, nofollow")))
    return F.when(host.endswith(preview), marked).otherwise(base)
