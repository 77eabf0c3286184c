"""File sources, upserts and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from lorica.operators import work
from lorica.sources import files, tables
from lorica.streaming import state

DATA = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "First"\ndraft: true\n---\nbody\n')
    assert [tuple(r) for r in files.markdown(spark, str(tmp_path)).collect()] == [("a", "First", True, "body\n")]
    (tmp_path / "m.json").write_text('{"n": 3}')
    (tmp_path / "current.json").write_text('{"to": "m.json"}')
    assert files.pointed(spark, str(tmp_path), "current.json", "to", "n int").first()["n"] == 3
    with pytest.raises(ValueError):
        files.inside("/a", "../b")
    lines = spark.createDataFrame([("A=one", 0), ('B="two words"', 1), ("# no", 2), ("export C=three # note", 3), ("A=uno", 4)], "value string, ord int")
    assert {r["name"]: r["value"] for r in files.settings(lines).collect()} == {"A": "uno", "B": "two words", "C": "three"}
    (tmp_path / "_redirects").write_text("/a /b 301\n\n# c\n/d/* /e\n")
    assert [tuple(r)[1:] for r in files.rules(spark, str(tmp_path / "_redirects")).orderBy("ord").collect()] == [("/a", "/b", 301), ("/d/*", "/e", 302)]


def test_work(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (1, None)], "id long, v string")
    assert sorted(r["id"] for r in work.changed_only(old, new, "id").collect()) == [1, 3]
    assert sorted(tuple(r) for r in work.symmetric_difference(old, new, "id").collect()) == [(3, "only_right")]
    left = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "article_id long, pos int, seconds double")
    right = spark.createDataFrame([(1, 0, 1.05), (1, 1, 2.2)], "article_id long, pos int, seconds double")
    assert [r["pos"] for r in work.positional_gaps(left, right, 0.1).collect()] == [1]


def _stream(spark, tmp_path, events):
    path = str(tmp_path / "events")
    events.repartition(1).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def _drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams_equal_batch(spark, tmp_path):
    e = tables.reader_events(spark, DATA).where("event_type = 'view'")
    s = _stream(spark, tmp_path, e)
    rows = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    assert rows(_drain(state.latest_stream(s, "user_id", "value"), "complete", "s1"), "user_id", "value") == rows(state.latest(e, ["user_id"], "value"), "user_id", "value")
    assert rows(_drain(state.throttled_stream(s, "user_id", 3600.0), "append", "s2"), "user_id", "event_id") == rows(state.throttled(e, "user_id", 3600.0), "user_id", "event_id")
    once = rows(_drain(state.crossing_stream(s, "user_id", 75.0, "3650 days"), "append", "s3"), "user_id")
    assert once == rows(state.first_crossing(e, "user_id", 75.0), "user_id")


def test_throttle_against_a_loop(spark):
    e = tables.reader_events(spark, DATA).where("event_type = 'view'")
    kept, last = set(), {}
    for r in sorted(e.collect(), key=lambda r: (r["ts"], r["event_id"])):
        if r["user_id"] not in last or (r["ts"] - last[r["user_id"]]).total_seconds() >= 3600:
            last[r["user_id"]] = r["ts"]
            kept.add(r["event_id"])
    assert {r["event_id"] for r in state.throttled(e, "user_id", 3600.0).collect()} == kept


def test_streams_of_ticks_toggles_and_consents(spark, tmp_path):
    e = tables.reader_events(spark, DATA)
    rows = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir(), (tmp_path / "c").mkdir()
    s = _stream(spark, tmp_path / "a", e)
    assert rows(_drain(state.engaged_stream(s, "user_id", 5, 60), "append", "s4"), "user_id", "event_id") == rows(state.engaged(e, "user_id", 5, 60), "user_id", "event_id")
    clicks = e.where("event_type = 'click'").withColumn("item", F.floor("value").cast("long") % 10)
    on = _drain(state.toggled_stream(_stream(spark, tmp_path / "b", clicks), ["user_id", "item"]), "complete", "s5").where("on")
    assert rows(on, "user_id", "item") == rows(state.toggled(clicks, ["user_id", "item"]), "user_id", "item")
    granted = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False)
    both = e.where("event_type in ('signup', 'error', 'view', 'click')").withColumn("granted", granted)
    batch = state.consented(e.where("event_type in ('view', 'click')"), both.where("granted is not null").select("user_id", "ts", "granted"), "user_id")
    got = _drain(state.consented_stream(_stream(spark, tmp_path / "c", both.select("user_id", "ts", "event_id", "granted")), "user_id"), "append", "s6")
    assert rows(got, "event_id") == rows(batch, "event_id") and got.count() > 0


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, head in (("sub/b", "title: B"), ("a", "title: A\ndraft: true"), ("c", "title: 'C'")):
        (tmp_path / f"{name}.md").write_text(f"---\n{head}\n---\nbody {name}")
    assert [(r["id"], r["title"]) for r in files.narrated(spark, str(tmp_path)).collect()] == [("b", "B"), ("c", "C")]
    (tmp_path / "none.md").write_text("no head")
    with pytest.raises(Exception, match="no title: none"):
        files.narrated(spark, str(tmp_path)).collect()
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    (tmp_path / "sub" / "x.mp3").write_bytes(frame * 5)
    r = files.recordings(spark, str(tmp_path)).first()
    assert r["bytes"] == 5 * 417 and r["seconds"] == 0.131 and len(r["sha256"]) == 64


def test_page_in_the_future(spark):
    from lorica.operators import audit

    page = lambda t: f"<h1>a</h1><meta property='article:modified_time' content='{t}'>"
    pages = spark.createDataFrame([(1, page("2024-01-01T00:04:00Z")), (2, page("2024-01-01T00:06:00Z")), (3, "<h1>a</h1>")], "page_id long, html string")
    found = audit.page_failures(pages, F.lit("2024-01-01 00:00:00").cast("timestamp")).where("rule = 'future'")
    assert [r["page_id"] for r in found.collect()] == [2]
