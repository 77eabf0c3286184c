"""Texts to speech segments, parts and timings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text
from ..functions.python_udfs import audio_parts_of, chunks, inline_of, match_form_of, parts_of

BLOCKS = ArrayType(StructType([StructField(c, StringType()) for c in ("type", "visible", "match")]))
IN_ORDER = ("ordinal", "type", "text")

_RULES = [  # formats of lines, fixed: what a line begins, first match wins; None ends the block before it and says nothing
    (re.compile(r"\|.*\|$|[-:| ]{3,}$|!\[[^\]]*\]\([^)]*\)\s*$"), None),
    (re.compile(r"(#{2,4})\s+(.+)$"), "h"),
    (re.compile(r"(?:[-*+]\s+|\d+[.)]\s+)(.+)$"), "list-item"),
    (re.compile(r">\s?(.*)$"), "quote"),
]


def blocks_of(body: str) -> list[tuple[str, str]]:
    """(type, raw text) of the blocks of a Markdown text: lines are classed, runs of one class are joined."""
    body = re.sub(r"(?s)```.*?```|<!--.*?-->", "\n", body)
    out: list[tuple[str, str]] = []
    run: tuple[str, list[str]] | None = None
    for line in [*re.split("\r?\n", body), ""]:
        line = line.strip()
        kind, said = ("paragraph", line) if line else (None, "")
        for rule, name in _RULES if line else ():
            if m := rule.match(line):
                kind = f"h{len(m[1])}" if name == "h" else name
                said = m[m.lastindex] if m.lastindex else ""
                break
        if run and run[0] != kind:
            out.append((run[0], " ".join(run[1])))
            run = None
        if kind in ("paragraph", "quote"):
            run = (kind, [*(run[1] if run else []), said])
        elif kind:
            out.append((kind, said))
    return out


def said_blocks_of(body: str) -> list[dict[str, str]]:
    """The blocks that say something: two characters or more, letters or digits among them."""
    out = []
    for kind, raw in blocks_of(body):
        visible = inline_of(raw)
        match = match_form_of(visible) if len(visible) >= 2 else ""
        if match:
            out.append({"type": kind, "visible": visible, "match": match[:120]})
    return out


@F.pandas_udf(BLOCKS)
def said_blocks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: said_blocks_of(t or ""))


def speech_segments(posts: DataFrame) -> DataFrame:
    """(id, segment_id, type, visible, match, spoken) of each block that says something; segment ids count per article. A
    text goes through Python once, from which its blocks come cleaned and in order."""
    b = posts.select("id", F.posexplode(said_blocks(text.without_references(F.col("body")))).alias("pos", "b")).select("id", "pos", "b.*")
    return b.select("id", F.format_string("b%04d", F.col("pos") + 1).alias("segment_id"), "type", "visible", "match", text.speech_text(F.col("visible")).alias("spoken"))


def chunked(segments: DataFrame, most: int) -> DataFrame:
    """(article_id, ordinal, type, piece, text): every segment in pieces of at most ``most`` bytes."""
    return segments.select("article_id", "ordinal", "type", F.posexplode(chunks(most)(F.col("text"))).alias("piece", "text"))


def packed(pieces: DataFrame, most: int) -> DataFrame:
    """pieces with the number of the part that each is in. Sequential within an article, one task per article."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ordinal", "piece", "type", "text"])
        return pdf.assign(part=parts_of(pdf["text"].tolist(), most))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.groupBy("article_id").applyInPandas(pack, f"{fields}, part int")


PART = "article_id long, part int, text string, sync array<struct<id:string,type:string,match:string,start:double,end:double>>"


def audio_parts(titles: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """(article_id, part, text, sync) of whole articles: titles (article_id, title) are read first, then pieces
    (article_id, pos, id, type, match, text) in order. Sequential within an article, one task per article."""

    def pack(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = right.sort_values("pos")[["id", "type", "match", "text"]].itertuples(index=False, name=None)
        made = audio_parts_of(left["title"].iloc[0], list(rows), most) if len(left) else []
        return pd.DataFrame([(key[0], i, p["text"], p["sync"]) for i, p in enumerate(made)], columns=["article_id", "part", "text", "sync"])

    return titles.groupBy("article_id").cogroup(pieces.groupBy("article_id")).applyInPandas(pack, PART)


def packed_sizes(segments: DataFrame, most: int) -> DataFrame:
    """Greedy packing where sizes only add up: a fold over each article's segments in order."""
    rows = F.array_sort(F.collect_list(F.struct(*IN_ORDER, F.octet_length("text").alias("bytes"))))

    def add(s, x):
        full = (s["used"] > 0) & (s["used"] + x["bytes"] > most)
        part = F.when(full, s["part"] + 1).otherwise(s["part"])
        used = F.when(full, x["bytes"]).otherwise(s["used"] + x["bytes"])
        return F.struct(part.alias("part"), used.alias("used"))

    start = F.struct(F.lit(1).alias("part"), F.lit(0).alias("used"))
    return segments.groupBy("article_id").agg(F.aggregate(rows, start, add)["part"].alias("parts"), F.sum(F.octet_length("text")).alias("bytes"))


def sync_intervals(segments: DataFrame, micro: int = 1_000_000) -> DataFrame:
    """Each segment's share of its article's time, by the length of its text, in millionths: [start, end)."""
    w = Window.partitionBy("article_id").orderBy(*IN_ORDER)
    weight = F.greatest(F.lit(1), F.char_length("text")).cast("long")
    upto = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("weight").over(Window.partitionBy("article_id"))
    out = segments.withColumn("weight", weight).withColumns({"upto": upto, "every": every})
    share = lambda c: F.floor(c * micro / F.col("every")).cast("long")
    return out.select("article_id", "ordinal", "type", "text", share(F.col("upto") - F.col("weight")).alias("start"), share(F.col("upto")).alias("end"))


def merged_runs(intervals: DataFrame) -> DataFrame:
    """Neighbours of equal type become one interval: gaps and islands."""
    w = Window.partitionBy("article_id").orderBy(*IN_ORDER)
    new = F.when(F.lag("type").over(w).eqNullSafe(F.col("type")), 0).otherwise(1)
    runs = intervals.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("article_id", "run", "type").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("article_id", F.col("run").cast("long").alias("run"), "type", "start", "end")


#: Weights of speech in 220ths of a word: a word, a letter (1/22), a strong pause (1.1), a medium one (0.45). Fixed values.
WORD, LETTER, STRONG, MEDIUM = 220, 10, 242, 99


def whole_weight(said: Column) -> Column:
    """speech_weight in whole 220ths, so that sums are exact."""
    words = F.size(F.filter(F.split(said, f"{text.WHITE}+"), lambda w: w != ""))
    letters = F.char_length(F.regexp_replace(said, text.WHITE, ""))
    pauses = F.regexp_count(said, F.lit("[.!؟]")) * STRONG + F.regexp_count(said, F.lit("[،؛:]")) * MEDIUM
    return F.greatest(F.lit(WORD), words * WORD + letters * LETTER + pauses).cast("long")


def weighted_intervals(pieces: DataFrame, micro: int = 1_000_000) -> DataFrame:
    """pieces (article_id, part, pos, id, text): the share of its part's time that each run of pieces of one segment takes,
    by speech weight, in millionths: (article_id, part, run, id, start, end)."""
    w = Window.partitionBy("article_id", "part").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = pieces.withColumn("weight", whole_weight(F.col("text")))
    p = p.withColumns({"upto": F.sum("weight").over(upto), "every": F.sum("weight").over(Window.partitionBy("article_id", "part")), "new": F.when(F.lag("id").over(w).eqNullSafe(F.col("id")), 0).otherwise(1)})
    p = p.withColumn("run", F.sum("new").over(upto))
    share = lambda c: F.floor(c * micro / F.col("every")).cast("long")
    spans = p.select("article_id", "part", "run", "id", share(F.col("upto") - F.col("weight")).alias("start"), share(F.col("upto")).alias("end"))
    return spans.groupBy("article_id", "part", "run", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"))


#: Bytes that a request for speech must stay under. Fixed value.
REQUEST_BYTES = 64_000


def ssml(pieces: DataFrame, voice: str, language: str = "ar-SA", rate: str = "0%") -> DataFrame:
    """(article_id, part, ssml, fits) of pieces (article_id, part, pos, type, text): one request for each part, its pieces in
    order, with pauses behind a title and around a heading. fits: whether it is below REQUEST_BYTES. A part is what one
    request holds, so its pieces are few."""
    body = F.concat(F.lit(f'<prosody rate="{rate}">'), text.escape_xml(F.col("text")), F.lit("</prosody>"))
    pause = lambda ms: F.lit(f'<break time="{ms}ms"/>')
    said = F.when(F.col("type") == "title", F.concat(body, pause(260))).when(F.col("type").rlike(r"^h\d$"), F.concat(pause(160), body, pause(180))).otherwise(body)
    rows = pieces.groupBy("article_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("<p>"), said, F.lit("</p>")).alias("said")))).alias("l"))
    head = f'<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis" xml:lang="{language}"><voice name="{voice}">'
    whole = rows.select("article_id", "part", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["said"]), ""), F.lit("</voice></speak>")).alias("ssml"))
    return whole.withColumn("fits", F.octet_length("ssml") < REQUEST_BYTES)


def prompts(parts: DataFrame, style: str) -> DataFrame:
    """(article_id, part, prompt) of parts (article_id, title, part, text; part from 0): style, context, then the transcript.
    Where an article has several parts, each says which one it is."""
    count = F.count("*").over(Window.partitionBy("article_id"))
    topic = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\r\n]+", " "))
    place = F.format_string("This is part %d of %d; voice and distance stay the same.", F.col("part") + 1, count)
    blank = F.lit("\n\n")
    return parts.select("article_id", "part", F.concat(F.lit(style), blank, F.lit("### CONTEXT (not read aloud)\nTopic: "), topic, F.lit("\n"), F.when(count > 1, place).otherwise(""), blank, F.lit("### TRANSCRIPT\n"), F.col("text")).alias("prompt"))


def zipped(blocks: DataFrame, segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Three lists of an article side by side by place (article_id, pos; from 0): blocks (block, start, end), segments (id,
    type) and parts (block, seconds). A row for each place that one of them has, with what is missing null."""
    key = ["article_id", "pos"]
    b = blocks.select(*key, F.col("block").alias("timed"), "start", "end")
    p = parts.select(*key, F.col("block").alias("recorded"), "seconds")
    return b.join(segments.select(*key, "id", "type"), key, "full_outer").join(p, key, "full_outer")


def zip_failures(rows: DataFrame, totals: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(article_id, pos, rule) of zipped() rows: a list that is too short, a block that is not the one of its place, times
    that do not fit the article (totals: article_id, seconds), and, with pos null, parts whose seconds do not add up."""
    block = F.format_string("block-%03d", F.col("pos") + 1)
    both = rows.join(totals.withColumnRenamed("seconds", "total"), "article_id")
    rules = {
        "missing": F.col("timed").isNull() | F.col("id").isNull() | F.col("recorded").isNull(),
        "order": (F.col("timed") != block) | (F.col("recorded") != block),
        "time": ~((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("total") + tolerance)),
    }
    single = both.select("article_id", "pos", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))
    sums = both.groupBy("article_id").agg(F.sum("seconds").alias("s"), F.max("total").alias("t")).where(~F.coalesce(F.abs(F.col("s") - F.col("t")) <= tolerance, F.lit(False)))
    return single.unionByName(sums.select("article_id", F.lit(None).cast(rows.schema["pos"].dataType).alias("pos"), F.lit("sum").alias("rule")))


def synced(rows: DataFrame, totals: DataFrame, digits: int = 9) -> DataFrame:
    """(article_id, pos, id, type, start, end) of zipped() rows: shares of the article's time; the last one ends at 1."""
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("article_id"))
    share = lambda c: F.round(F.col(c) / F.col("total"), digits)
    both = rows.join(totals.withColumnRenamed("seconds", "total"), "article_id")
    return both.select("article_id", "pos", "id", "type", share("start").alias("start"), F.when(last, 1.0).otherwise(share("end")).alias("end"))
