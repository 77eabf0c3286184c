"""What stands in manifests and plans, against the files that are there. Failures are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers

#: Widths of derived pictures. Fixed values.
WIDTHS = (320, 640, 960, 1280)
#: Bytes of a recording at least, and seconds by which it may differ. Fixed values.
LEAST_BYTES, TOLERANCE = 100, 0.1


def _broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that are broken; an unknown state breaks none."""
    return F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))))


def is_wide(width: Column, height: Column) -> Column:
    """Whether a picture is 16 to 9."""
    return width * 9 == height * 16


def picture_failures(pictures: DataFrame, posts: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(file, rule, expected, found) of derived pictures (file, kind, width, height): a name that does not end in one of
    the widths, a size that is not the one of the name (16 to 9, halves upwards; null where the file is no picture), and,
    with file null, a number of files that is not that of the posts times the widths."""
    wanted = F.regexp_extract("file", rf"-({'|'.join(map(str, widths))})\.webp$", 1)
    size = lambda w, h: F.concat_ws("x", w.cast("string"), h.cast("string"))
    named = pictures.withColumn("want", F.when(wanted != "", wanted.cast("int")))
    named = named.withColumn("high", numbers.half_up(F.col("want") * 9 / 16).cast("int"))
    right = (F.col("kind").eqNullSafe("webp")) & F.col("width").eqNullSafe(F.col("want")) & F.col("height").eqNullSafe(F.col("high"))
    rules = {"name": F.col("want").isNull(), "size": F.col("want").isNotNull() & ~right}
    single = named.select("file", _broken(rules).alias("rule"), size(F.col("want"), F.col("high")).alias("expected"), size(F.col("width"), F.col("height")).alias("found"))
    counted = pictures.select(F.lit(1).alias("file"), F.lit(0).alias("post")).unionAll(posts.select(F.lit(0), F.lit(len(widths)))).agg(F.coalesce(F.sum("file"), F.lit(0)).alias("f"), F.coalesce(F.sum("post"), F.lit(0)).alias("p"))
    total = counted.where("f <> p").select(F.lit(None).cast("string").alias("file"), F.lit("count").alias("rule"), F.col("p").cast("string").alias("expected"), F.col("f").cast("string").alias("found"))
    return single.unionByName(total)


def folder_key(article_id: Column) -> Column:
    """The name of an article's folder: the beginning of a digest of its id."""
    return F.left(F.sha2(article_id.cast("string"), 256), F.lit(16))


def asset_failures(assets: DataFrame, files: DataFrame, root: str = "/audio/articles") -> DataFrame:
    """(article_id, src, rule) of a manifest's assets (article_id, part, voice, src, bytes, sha256, seconds) against files
    (path, bytes, sha256, seconds) whose path is as src says. A path must lie in the article's folder, end in .mp3, hold no
    '..' and be there once in its article; the file must be there, of LEAST_BYTES or more, of the size, digest (if one is
    said) and seconds that the manifest says. Each article needs one asset for each of its parts and voices (src null).
    One join of the manifest with the scan of the files, whose digests and seconds come from the task that read them."""
    prefix = F.concat(F.lit(f"{root}/"), folder_key(F.col("article_id")), F.lit("/"))
    safe = F.coalesce(F.col("src").startswith(prefix) & F.col("src").endswith(".mp3") & ~F.contains("src", F.lit("..")), F.lit(False))
    f = files.select(F.col("path").alias("src"), F.struct(F.col("bytes").alias("bytes"), F.col("sha256").alias("sha256"), F.col("seconds").alias("seconds")).alias("file"))
    there, said = F.col("file").isNotNull(), F.col("sha256").isNotNull() & (F.col("sha256") != "")
    form = F.col("sha256").rlike("^[0-9a-f]{64}$")
    off = F.col("seconds").isNull() | (F.col("seconds") <= 0) | F.col("file.seconds").isNull() | (F.abs(F.col("file.seconds") - F.col("seconds")) > TOLERANCE)
    rules = {
        "unsafe_path": ~safe,
        "missing": safe & ~there,
        "too_small": there & (F.col("file.bytes") < LEAST_BYTES),
        "size": there & ~F.col("file.bytes").eqNullSafe(F.col("bytes")),
        "hash_form": said & ~form,
        "hash": there & said & form & (F.col("file.sha256") != F.col("sha256")),
        "seconds": there & off,
    }
    single = assets.join(f, "src", "left").select("article_id", "src", _broken(rules).alias("rule"))
    paths = assets.groupBy("article_id", "src").agg(F.count("*").alias("n"))
    twice = paths.where("n > 1 and src is not null").select("article_id", "src", F.lit("duplicate").alias("rule"))
    lists = assets.groupBy("article_id").agg(F.countDistinct("part").alias("p"), F.countDistinct("voice").alias("v"), F.countDistinct(F.struct("part", "voice")).alias("n"))
    gaps = lists.where("n <> p * v").select("article_id", F.lit(None).cast("string").alias("src"), F.lit("incomplete").alias("rule"))
    return single.unionByName(twice).unionByName(gaps)
