"""Pictures, recordings and evaluations against files and plans."""

import hashlib
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorica.functions.pictures import picture_size
from lorica.operators import assets, lab
from lorica.sources import files


def png(w, h):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IEND", b"")


def webp(form, w, h):
    body = {
        "VP8 ": lambda: b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", w | 0x4000, h | 0x8000),
        "VP8L": lambda: b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | 1 << 28) + bytes(5),
        "VP8X": lambda: bytes(4) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"),
    }[form]()
    chunk = form.encode() + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def test_heads(spark):
    made = {"png": (png(1280, 720), ("png", 1280, 720)), "large": (png(70_000, 3), ("png", 70_000, 3))}
    for form, size in (("VP8 ", (320, 180)), ("VP8L", (16_384, 9)), ("VP8L", (1, 16_384)), ("VP8X", (16_777_216, 100_000)), ("VP8 ", (16_383, 1))):
        made[f"{form}{size}"] = (webp(form, *size) + b"rest" * 100, ("webp", *size))
    made |= {"short": (png(1, 1)[:20], None), "cut": (webp("VP8L", 2, 2)[:29], None), "other": (b"GIF89a" + bytes(40), None), "empty": (b"", None), "null": (None, None), "sign": (webp("VP8L", 2, 2).replace(b"\x2f", b"\x2e"), None)}
    rows = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, (b, _) in made.items()], "k string, b binary")
    got = {r["k"]: r["s"] and tuple(r["s"]) for r in rows.select("k", picture_size(F.col("b")).alias("s")).collect()}
    assert got == {k: s for k, (_, s) in made.items()}


def test_pictures_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    made = {f"a-{w}.webp": webp("VP8 ", w, w * 9 // 16) for w in (320, 640, 960, 1280)}
    made |= {"b-320.webp": webp("VP8X", 320, 181), "b-640.webp": webp("VP8L", 640, 360), "sub/b-961.webp": webp("VP8 ", 961, 540), "b-1280.webp": b"no picture", "b-960.webp": png(960, 540)}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "x.txt").write_text("no")
    found = files.pictures(spark, str(tmp_path))
    assert found.count() == 9 and {r["file"]: r["bytes"] for r in found.collect()} == {k.split("/")[-1]: len(v) for k, v in made.items()}
    posts = spark.range(3)
    failed = {tuple(r) for r in assets.picture_failures(found, posts).collect()}
    assert failed == {("b-320.webp", "size", "320x180", "320x181"), ("b-961.webp", "name", "", "961x540"), ("b-1280.webp", "size", "1280x720", ""), ("b-960.webp", "size", "960x540", "960x540"), (None, "count", "12", "9")}
    assert assets.picture_failures(found.where("file like 'a-%'"), spark.range(1)).isEmpty()
    assert [tuple(r) for r in assets.picture_failures(found.limit(0), spark.range(1)).collect()] == [(None, "count", "4", "0")]
    assert [r[0] for r in spark.range(1).select(assets.is_wide(F.lit(1280), F.lit(720)) & ~assets.is_wide(F.lit(1280), F.lit(721))).collect()] == [True]


FRAME = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)


def test_recordings_against_a_manifest(spark, tmp_path):
    key = lambda a: hashlib.sha256(a.encode()).hexdigest()[:16]
    kinds = "article_id string, part int, voice string, src string, bytes long, sha256 string, seconds double"
    content = {p: FRAME * (10 + p) for p in range(7)}
    rows = []
    for p, c in content.items():
        path = tmp_path / "audio" / "articles" / key("a") / f"{p}.mp3"
        path.parent.mkdir(parents=True, exist_ok=True)
        if p != 1:
            path.write_bytes(c)
        rows.append(["a", p, "v", f"/audio/articles/{key('a')}/{p}.mp3", len(c), hashlib.sha256(c).hexdigest(), (10 + p) * 0.0261224])
    rows[2][4] += 1  # a byte too many
    rows[3][5] = hashlib.sha256(b"other").hexdigest()
    rows[4][6] += 0.3  # overlong
    rows[5][5] = "XYZ"
    rows[6][5] = None
    (tmp_path / "audio" / "articles" / key("b")).mkdir()
    (tmp_path / "audio" / "articles" / key("b") / "0.mp3").write_bytes(FRAME[:50])
    rows += [["b", 0, "v", f"/audio/articles/{key('b')}/0.mp3", 50, None, 1.0], ["b", 1, "v", f"/audio/articles/{key('a')}/0.mp3", 4170, None, 0.261], ["b", 2, "w", None, None, None, None], ["b", 3, "v", f"/audio/articles/{key('b')}/../{key('b')}/0.mp3", 50, None, 0.0]]
    rows += [["c", 0, "v", rows[0][3].replace(key("a"), key("c")), 1, None, 1.0]] * 2
    manifest = spark.createDataFrame([tuple(r) for r in rows], kinds)
    scanned = files.recordings(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", rf"^file:/*{str(tmp_path).lstrip('/')}", ""))
    assert scanned.count() == 7
    got = Counter((r["article_id"], (r["src"] or "").split("/")[-1], r["rule"]) for r in assets.asset_failures(manifest, scanned).collect())
    assert got == Counter([("a", "1.mp3", "missing"), ("a", "2.mp3", "size"), ("a", "3.mp3", "hash"), ("a", "4.mp3", "seconds"), ("a", "5.mp3", "hash_form"), ("b", "0.mp3", "too_small"), ("b", "0.mp3", "seconds"), ("b", "0.mp3", "unsafe_path"), ("b", "0.mp3", "unsafe_path"), ("b", "", "unsafe_path"), ("b", "", "incomplete"), ("c", "0.mp3", "missing"), ("c", "0.mp3", "missing"), ("c", "0.mp3", "duplicate")])


def test_integrity(spark):
    segments = spark.createDataFrame([("a", 1, "eins"), ("a", 2, "zwei"), ("b", 1, "drei"), ("b", 1, "vier")], "article_id string, segment_id int, text string")
    cases = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "c", 1)], "case_id int, article_id string, segment_id int")
    candidates = spark.createDataFrame([("x",), ("y",), ("z",)], "candidate string")
    sha = hashlib.sha256("zwei".encode()).hexdigest()
    items = [("x", 1, "eins", None, 5.0), ("x", 2, None, sha, 2.0), ("x", 3, "drei", None, 90.0), ("x", 4, "?", None, 9.0), ("y", 1, "eins!", None, 5.0), ("y", 1, "eins", None, 5.0), ("y", 9, "eins", None, 5.0), ("q", 1, "eins", None, 91.0), ("y", 2, "x", "0", None)]
    made = spark.createDataFrame(items, "candidate string, case_id int, text string, text_sha256 string, seconds double")
    got = Counter(tuple(r) for r in lab.integrity(candidates, cases, segments, made).collect())
    assert got == Counter([(None, 4, "no_segment", 1), (None, 3, "segment_not_unique", 2), ("y", 9, "unknown_case", 1), ("q", 1, "unknown_candidate", 1), ("y", 1, "doubled", 2), ("y", None, "incomplete", 2), ("z", None, "incomplete", 4), ("y", 1, "other_text", 1), ("y", 2, "other_text", 1), ("q", 1, "length", 1), ("y", 2, "length", 1)])
    sound = lab.integrity(candidates.limit(1), cases.where("case_id < 3"), segments, made.where("candidate = 'x' and case_id < 3"))
    assert sound.isEmpty()
    assert {(r["case_id"], r["segments"], r["text"]) for r in lab.canonical(cases, segments).collect()} == {(1, 1, "eins"), (2, 1, "zwei"), (3, 2, "drei"), (4, 0, None)}


@pytest.mark.parametrize("name", ["picture_sizes", "asset_failures", "lab_integrity"])
def test_queries_break_every_rule(spark, name):
    """The queries on made plans fail in all the ways that there are."""
    from lorica.plans import QUERIES

    rules = {"picture_sizes": {"name", "size", "count"}, "asset_failures": {"unsafe_path", "missing", "too_small", "size", "hash_form", "hash", "seconds", "duplicate"}, "lab_integrity": {"no_segment", "unknown_case", "unknown_candidate", "doubled", "incomplete", "other_text", "length"}}
    found = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select("rule").distinct().collect()}
    assert rules[name] <= found
