"""Stated values and traps of the column functions."""

import pytest
from pyspark.sql import functions as F

from lorica.functions import numbers, python_udfs, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_seek_and_clock(spark):
    from lorica.operators.timeline import seek

    parts = spark.createDataFrame([(1, 0, 0, 0, None, 10), (1, 1, 0, 0, None, 20), (1, 2, 0, 0, None, 30)], "article_id long, line int, p long, s long, t timestamp, seconds long")
    got = lambda t: tuple(seek(parts, spark.createDataFrame([(1, t)], "article_id long, target long")).first())[1:]
    assert got(45) == (2, 15, 60) and got(0) == (0, 0, 60) and got(30) == (1, 20, 60) and got(99) == (2, 30, 60) and got(-3) == (0, 0, 60)
    assert one(spark, numbers.clock(F.lit(281.088))) == "4:41" and one(spark, numbers.clock(F.lit(0))) == "0:00" and one(spark, numbers.clock(F.lit(-1))) == ""


def test_progress_window(spark):
    now = 1_700_000_000_000
    ok = lambda age, part=0, time=1.0: one(spark, numbers.valid_progress(F.lit(part), F.lit(2), F.lit(time), F.lit(now - age), F.lit(now)))
    assert ok(numbers.RETENTION_MS - 1) and ok(numbers.RETENTION_MS) and not ok(numbers.RETENTION_MS + 1) and not ok(-1)
    assert not ok(0, part=2) and not ok(0, time=-1.0)


def test_references_keep_the_arabic_list(spark):
    assert one(spark, text.without_references(F.lit("a\n## المصادر\n- x"))).endswith("- x")
    assert one(spark, text.without_references(F.lit("a\n## المصادر\n- x"), arabic=True)) == "a"
    assert one(spark, text.without_references(F.lit("a\n## References\n- x"))) == "a"


def test_two_normal_forms():
    assert python_udfs.search_form_of("احمد") not in python_udfs.search_form_of("أحمد")
    assert python_udfs.search_form_of("مدرسه") in python_udfs.search_form_of("مدرسة")
    assert python_udfs.match_form_of("أحمد") == python_udfs.match_form_of("احمد")


def test_fixed_and_white_space(spark):
    assert python_udfs.fixed_of(0.1234565, 6) == 0.123456
    assert one(spark, text.word_count(F.lit("a b﻿c"))) == 3
    assert one(spark, text.word_count(F.lit("---\nx y\n---\none ![two](u) [three](u) https://four"))) == 3
    assert one(spark, text.word_count(F.lit("a\n---\nb\n---\nc\n---\nd\n---"))) == 3  # only the first block goes
    assert one(spark, text.encode_component(F.lit("ا ا!'()*~"))) == "%D8%A7%20%D8%A7!'()*~"


def test_labels_costs_colours(spark):
    assert one(spark, text.article_count_label(F.lit(1234))) == "١٬٢٣٤ مقالًا" and one(spark, text.minutes_label(F.lit(3))) == "٣ دقائق قراءة"
    assert one(spark, numbers.cost_usd(F.lit("character"), F.lit(1000))) == pytest.approx(0.1) and one(spark, numbers.cost_usd(F.lit("rated"), F.lit(1000))) is None
    assert one(spark, numbers.contrast(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21)
    assert one(spark, numbers.mixed_colour(F.lit("#000000"), F.lit("#ffffff"))) == "#e0e0e0"
    assert one(spark, text.compact_title(F.lit("one two three"), 8)) == "one two" and one(spark, text.compact_title(F.lit("abcdefghij"), 4)) == "abcd"
    assert one(spark, text.image_set(F.lit("/images/posts/a.b.png")))["src"] == "/images/generated/a.b-640.webp"
    rules = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in (("ab", "x"), ("abc", "y"), ("x", "z"))))
    assert one(spark, text.replaced_in_order(F.lit("ab abc"), rules)) == "z y"


def test_chunks_and_parts():
    t = "One two. Three four five! " + "x" * 50
    got = python_udfs.chunks_of(t, 12)
    assert all(len(c.encode()) <= 12 for c in got) and "".join("".join(got).split()) == "".join(t.split())
    parts = python_udfs.parts_of(["a" * 30, "b" * 30, "c" * 30], 65)
    assert parts == [0, 0, 1] and python_udfs.joined_of(["a", "b!", "c"]) == "a. b! c"


def test_mp3():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    assert python_udfs.mp3_seconds_of(b"ID3\x03\0\0\0\0\0\0" + frame * 10) == python_udfs.fixed_of(10 * 1152 / 44100, 3)
    assert python_udfs.mp3_seconds_of(frame) is None and python_udfs.mp3_seconds_of(None) is None


def test_blocks_and_headers(spark):
    from lorica.operators.audit import tokens_in_order
    from lorica.operators.routing import response_headers
    from lorica.operators.speech import blocks_of

    assert blocks_of("# a\n## T\np1\np2\n> q\n- i\n|x|\n![a](b)\n```\ncode\n```") == [("paragraph", "# a"), ("h2", "T"), ("paragraph", "p1 p2"), ("quote", "q"), ("list-item", "i")]
    h = F.create_map(F.lit("Access-Control-Allow-Origin"), F.lit("*"), F.lit("X-Robots-Tag"), F.lit("noindex"))
    assert one(spark, response_headers(F.lit("a.pages.test"), F.lit("text/html"), h, ".pages.test")) == {"x-robots-tag": "noindex, nofollow"}
    assert one(spark, response_headers(F.lit("a.org"), F.lit("image/png"), h, ".pages.test")) == {"Access-Control-Allow-Origin": "*"}
    assert one(spark, tokens_in_order(F.lit("one two three"), ["one", "three"])) and not one(spark, tokens_in_order(F.lit("one two three"), ["three", "one"]))


def test_inline_text_on_both_sides(spark):
    """The column expression and the function of one value apply the same rules."""
    import random

    from lorica.functions.python_udfs import inline_of

    r = random.Random(2)
    bits = ["word", " ", "\t", "　", "\n", "*", "_", "`", "~", "![a](b)", "[c](d)", "(", ")", "[", "]", "<b>", "<", ">", "http://x.y/z", "(see https://a.b)", "،", " ؟", ".", "!", " ", "é", "\x0b"]
    texts = ["".join(r.choices(bits, k=r.randrange(30))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["v"] for x in df.select("i", text.inline_text(F.col("t")).alias("v")).collect()}
    assert got == {i: inline_of(t) for i, t in enumerate(texts)}


def test_excerpts_of_long_texts(spark):
    """The short way gives what the whole text gives."""
    import random

    r = random.Random(8)
    bits = ["word", "a-b", "  ", "\n", "*x*", "https://a.b/c", "(d)", "ünï", "~"]
    texts = [" ".join(r.choices(bits, k=r.randrange(1, 400))) for _ in range(200)] + ["x" * 79 + " <!-- " + "y " * 900 + "--> z", "[" + "a " * 900 + "](b) c", "-" * 1000 + " z " * 600, " " * 90 + "h" * 25]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    whole = text.excerpt(F.col("t"), 10_000)
    for n in (20, 420):
        assert df.select("i", text.excerpt(F.col("t"), n).alias("a"), F.left(whole, F.lit(n)).alias("b")).where("a <> b").isEmpty()


def test_seek_in_a_long_recording(spark):
    import time

    from lorica.operators.timeline import seek

    n = 100_000
    parts = spark.range(n).select(F.lit(1).cast("long").alias("article_id"), F.col("id").alias("line"), F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(None).cast("timestamp").alias("t"), (F.col("id") % 7).alias("seconds"))
    targets = spark.createDataFrame([(1, k) for k in (-5, 0, 1, 99_999, 150_000, 10**9)], "article_id long, target long")
    began = time.time()
    got = {(r["part"], r["inside"]) for r in seek(parts, targets).collect()}
    ends = [0]
    for k in range(n):
        ends.append(ends[-1] + k % 7)
    want = set()
    for at in (0, 0, 1, 99_999, 150_000, ends[-1]):
        k = next(i for i in range(n) if ends[i + 1] >= at)
        want.add((k, at - ends[k]))
    assert got == want and time.time() - began < 60


def test_numbers_within_groups(spark):
    import random

    from lorica.operators.ranking import numbered, numbered_within

    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "b", "c", None, ""]), r.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {x["i"]: x["rank"] for x in numbered_within(df, "g", "v", "i").collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:]), 1):
            want[x[2]] = k
    assert got == want
    every = {x["i"]: x["rank"] for x in numbered(df, "v", "i").collect()}
    assert every == {x[2]: k for k, x in enumerate(sorted(rows, key=lambda x: x[1:]), 1)}
    assert numbered_within(df.limit(0), "g", "v").count() == numbered(df.limit(0), "v").count() == 0


def test_lists_by_place(spark):
    from lorica.operators import speech

    blocks = spark.createDataFrame([("a", 0, "block-001", 0.0, 4.0), ("a", 1, "block-003", 4.0, 6.0), ("a", 3, "block-004", 6.0, 11.0)], "article_id string, pos long, block string, start double, end double")
    segments = spark.createDataFrame([("a", 0, "s0", "p"), ("a", 1, "s1", "h2"), ("a", 2, "s2", "p")], "article_id string, pos long, id string, type string")
    parts = spark.createDataFrame([("a", 0, "block-001", 4.0), ("a", 1, "block-002", 2.0), ("a", 2, "block-003", 3.0)], "article_id string, pos long, block string, seconds double")
    totals = spark.createDataFrame([("a", 10.0)], "article_id string, seconds double")
    rows = speech.zipped(blocks, segments, parts)
    assert sorted((r["pos"] if r["pos"] is not None else -1, r["rule"]) for r in speech.zip_failures(rows, totals).collect()) == [(-1, "sum"), (1, "order"), (2, "missing"), (3, "missing"), (3, "time")]
    got = {r["pos"]: (r["start"], r["end"]) for r in speech.synced(rows.where("pos < 2"), totals).collect()}
    assert got == {0: (0.0, 0.4), 1: (0.4, 1.0)}


def test_requests_for_speech(spark):
    from lorica.operators import speech

    kinds = "article_id string, part int, pos int, type string, text string"
    rows = [("a", 0, 1, "p", "x & y"), ("a", 0, 0, "title", "T"), ("a", 0, 2, "h2", "<h>"), ("b", 1, 0, "p", "z" * 70_000)]
    got = {(r["article_id"], r["part"]): (r["ssml"], r["fits"]) for r in speech.ssml(spark.createDataFrame(rows, kinds), "v").collect()}
    said = lambda t: f'<prosody rate="0%">{t}</prosody>'
    body = f'<p>{said("T")}<break time="260ms"/></p><p>{said("x &amp; y")}</p><p><break time="160ms"/>{said("&lt;h&gt;")}<break time="180ms"/></p>'
    assert got["a", 0][0].endswith(body + "</voice></speak>") and got["a", 0][1] and not got["b", 1][1]
    parts = spark.createDataFrame([("a", "One\r\nTwo ", 0, "first"), ("a", "One\r\nTwo ", 1, "second"), ("b", None, 0, "alone")], "article_id string, title string, part int, text string")
    said = {(r["article_id"], r["part"]): r["prompt"] for r in speech.prompts(parts, "S").collect()}
    assert "Topic: One Two\nThis is part 2 of 2;" in said["a", 1] and said["b", 0] == "S\n\n### CONTEXT (not read aloud)\nTopic: \n\n\n### TRANSCRIPT\nalone"


def test_titles_and_pictures(spark):
    title = lambda t: one(spark, text.branded_title(F.lit(t), "Lorica", "all"))
    assert title("Lorica") == "Lorica — all" and title("x" * 56) == "x" * 56 + " | Lorica" and title("x" * 57) == "x" * 57
    assert title("𝄞" + "x" * 54) == "𝄞" + "x" * 54 + " | Lorica" and title("𝄞" + "x" * 55) == "𝄞" + "x" * 55
    picture = lambda p, use: one(spark, text.picture_of(F.lit(p), use))
    assert picture("/images/posts/a.b.jpg", "social") == "/images/social/a.b-social.jpg" and picture("/images/thumbnails/c.png", "thumbnail") == "/images/thumbnails/c-320.webp"
    assert picture("/images/posts/a.jpg", "thumbnail") == "/images/generated/a-320.webp" and picture("/x.png", "social") == "/x.png" and one(spark, text.picture_of(F.lit(None).cast("string"), "social")) is None


def test_work_in_the_order_of_the_language(spark):
    from lorica.operators import audit, work

    ids = ["ب", "ا", "أ", "z", "Z", "a"]
    jobs = spark.createDataFrame([(i, 1) for i in ids] + [("last", 2)], "article_id string, requests int")
    got = [r["article_id"] for r in work.next_work(jobs, 7).collect()]
    assert got[-1] == "last" and got.index("ا") < got.index("ب") and got.index("أ") < got.index("ب") and got.index("a") < got.index("Z") and [r["article_id"] for r in work.next_work(jobs, 2).collect()] == got[:2]
    pages = spark.createDataFrame([(1, "<a href='/x'></a><img src=\"/a.png\" srcset='/b.webp 320w, /c.webp  2x,' data-src='//cdn/d'>"), (2, None)], "page_id int, html string")
    assert sorted(r["target"] for r in audit.links(pages).collect()) == ["//cdn/d", "/a.png", "/b.webp", "/c.webp", "/x"]
