"""Substring search over normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.python_udfs import search_form


def index(posts: DataFrame) -> DataFrame:
    """id, url and the normalised text that a search looks at."""
    whole = F.concat_ws(" ", "title", text.excerpt(F.col("body")), "category_slug", F.array_join("tags", " "))
    return posts.select("id", "published_at", F.concat(F.lit("/posts/"), F.col("id").cast("string"), F.lit("/")).alias("url"), search_form(whole).alias("form"))


def search(index_: DataFrame, query: str) -> DataFrame:
    """Rows that contain the query; none for a blank one. Unranked: the order is that of the feed."""
    from ..functions.python_udfs import search_form_of

    form = search_form_of(query.strip())
    return index_.where(F.lit(bool(form)) & F.contains("form", F.lit(form))).select("id", "url")
