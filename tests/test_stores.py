"""Ledgers, rollouts, upserts and releases on disk."""

import threading

import pytest
from pyspark.sql import functions as F

from lorica.operators import stores


def values(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v string")


def listed(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_ledger(spark, tmp_path):
    root = f"{tmp_path}/l"
    for k in (1, 2, 3, 2, 4):
        stores.append_run(values(spark, f"v{k}"), root, f"{k:03}", 3)
    assert stores.runs(spark, root) == ["002", "003", "004"]
    assert sorted(r["v"] for r in spark.read.parquet(root).collect()) == ["v2", "v3", "v4"]
    with pytest.raises(Exception, match="no"):
        stores.append_run(values(spark, "x").select(F.raise_error(F.lit("no")).cast("string").alias("v")), root, "003", 3)
    assert sorted(r["v"] for r in spark.read.parquet(root).collect()) == ["v2", "v3", "v4"]


def test_rollout(spark, tmp_path):
    root = f"{tmp_path}/r"
    wanted = spark.createDataFrame([("c", 2), ("b", 2), ("a", 9), ("d", 1)], "id string, n int")
    step = lambda run, cap=1: [r["id"] for r in stores.complete_next(wanted, root, run, "id", ["n"], cap).collect()]
    assert step("1") == ["d"] and step("2") == ["b"] and step("2") == ["b"] and step("1") == ["d"] and step("3", 2) == ["c", "a"] and step("4") == []
    assert sorted(tuple(r) for r in spark.read.parquet(root).select("id", "run").collect()) == [("a", 3), ("b", 2), ("c", 3), ("d", 1)]


def test_rollout_by_batches(spark, tmp_path):
    """Each batch of a stream completes one missing item, also if it is delivered again."""
    wanted = spark.createDataFrame([(k, k % 3) for k in range(5)], "id int, n int")
    sink = lambda _, number: stores.complete_next(wanted, f"{tmp_path}/r", f"{number:05}", "id", ["n"])
    for k in (0, 1, 1, 2, 0, 3, 4, 5, 5):
        sink(None, k)
    done = spark.read.parquet(f"{tmp_path}/r").orderBy("run").collect()
    assert [r["id"] for r in done] == [0, 3, 1, 4, 2]


def test_upsert(spark, tmp_path):
    root = tmp_path / "t"
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int, l array<string>")
    read = lambda: {r["id"]: (r["v"], r["l"]) for r in spark.read.parquet(str(root)).collect()}
    first = [(f"k{i}", i, ["a"]) for i in range(100)] + [(None, -1, None)]
    assert stores.upsert(frame(first), str(root), "id", 16) == list(range(16))
    before = listed(root)
    assert stores.upsert(frame(first[:40]), str(root), "id", 16) == [] and listed(root) == before
    new = [("k3", 33, ["a"]), ("k4", 4, ["b", None]), ("new", None, []), ("k5", 5, ["a"]), (None, -2, None)]
    changed = stores.upsert(frame(new), str(root), "id", 16)
    after = listed(root)
    kept = {f: t for f, t in before.items() if int(f.split("/")[0].removeprefix("bucket=")) not in changed}
    assert 1 < len(changed) <= 4 and kept.items() <= after.items() and len(kept) == 16 - len(changed)
    assert not {f for f in after if f in before and f not in kept}
    want = {i: (v, l) for i, v, l in first} | {i: (v, l) for i, v, l in new}  # noqa: E741
    assert read() == want and spark.read.parquet(str(root)).count() == 102
    with pytest.raises(ValueError, match="twice"):
        stores.upsert(frame([("k1", 1, None), ("k1", 2, None)]), str(root), "id", 16)
    with pytest.raises(Exception, match="bad"):
        stores.upsert(frame(new).withColumn("v", F.raise_error(F.lit("bad")).cast("int")), str(root), "id", 16)
    assert read() == want and listed(root) == after and stores.upsert(frame([]), str(root), "id", 16) == []


def test_releases(spark, tmp_path):
    root = f"file://{tmp_path}/site"
    one, two = values(spark, "first"), values(spark, "second")
    stores.publish(one, root, "r1")
    stores.publish(two, root, "r2")
    assert stores.current(spark, root).first()["v"] == "second"
    with pytest.raises(ValueError, match="r2"):
        stores.publish(one, root, "r2")
    with pytest.raises(Exception, match="broken"):
        stores.publish(one.select(F.raise_error(F.lit("broken")).cast("string").alias("v")), root, "r3")
    assert stores.current(spark, root).first()["v"] == "second" and stores.current_name(spark, root) == "r2"
    stores.rollback(spark, root, "r1")
    assert stores.current(spark, root).first()["v"] == "first"
    with pytest.raises(ValueError, match="r9"):
        stores.rollback(spark, root, "r9")
    assert {(r["release"], r["v"]) for r in stores.retained(spark, root).collect()} == {("r1", "first"), ("r2", "second")}


def test_publishers_at_the_same_time(spark, tmp_path, monkeypatch):
    """Both take the same number; the second one's pointer moves on."""
    root = f"file://{tmp_path}/site"
    stores.publish(values(spark, "zero"), root, "r0")
    plain, asked = stores._next, []
    monkeypatch.setattr(stores, "_next", lambda folder: asked.append(1) or (2 if len(asked) <= 2 else plain(folder)))
    stores.publish(values(spark, "one"), root, "r1")
    stores.publish(values(spark, "two"), root, "r2")
    assert stores.Folder(spark, root).names("pointers") == [f"{k:012d}" for k in (1, 2, 3)] and stores.current_name(spark, root) == "r2" and len(asked) == 3
    monkeypatch.setattr(stores, "_next", plain)
    failed = []

    def run(k):
        try:
            stores.publish(values(spark, f"t{k}"), root, f"t{k}")
        except Exception as e:  # reported below
            failed.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and stores.retained(spark, root).select("release").distinct().count() == 7
    assert stores.current(spark, root).first()["v"] == stores.current_name(spark, root)


def test_one_name_twice_at_the_same_time(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/site"
    stores.publish(values(spark, "kept"), root, "r1")
    monkeypatch.setattr(stores.Folder, "exists", lambda self, name="": name == "pointers")
    with pytest.raises(ValueError, match="r1"):
        stores.publish(values(spark, "lost"), root, "r1")
    assert spark.read.parquet(f"{root}/releases/release=r1").first()["v"] == "kept"
