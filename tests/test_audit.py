"""Audits on made rows."""

from lorica.operators import audit


def test_leaks_of_whole_items_anywhere(spark, monkeypatch):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    items = [(1, long), (2, "short – key"), (3, "x"), (4, ""), (5, None), (6, long[:45] + " otherwise")]
    rows = [(1, f'"{long}"'), (2, long[:44]), (3, "(short – key)"), (4, "short - key"), (5, None), (6, ""), (7, "mix" + long[:45] + " otherwise"), (8, "short"), (9, " – key")]
    needles = spark.createDataFrame(items, "item_id long, text string")
    expected = {(d, i) for d, t in rows for i, x in items if x and t and x in t}
    assert len(expected) == 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (16 << 20, 20):
        monkeypatch.setattr(audit, "LEAK_BYTES", most)
        assert {tuple(r) for r in audit.leaks(docs, needles).collect()} == expected
    assert audit.leaks(docs, needles.limit(0)).count() == 0




def test_leaks_of_items_that_begin_alike(spark):
    """Thousands of items with one header: found by look-up, whichever is the beginning of which."""
    import random
    import time

    r = random.Random(6)
    header = "Permission is hereby granted, free of charge, to any person who obtains a copy "
    tails = {"", "a", "ab", "abc", "b", "b\U0001d11e"} | {"".join(r.choices("abc ", k=r.randrange(1, 12))) for _ in range(4000)}
    items = [(i, header + t) for i, t in enumerate(sorted(tails))] + [(9000, header + "ab"), (9001, header[:64]), (9002, header[:20])]
    texts = [(k, " ".join(header + "".join(r.choices("abc ", k=9)) for _ in range(200))) for k in range(12)] + [(90, header[:-1]), (91, "x" + header + "b\U0001d11e"), (92, None), (93, header * 3)]
    needles, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    began = time.time()
    got = {tuple(x) for x in audit.leaks(docs, needles).collect()}
    assert time.time() - began < 60 and got == {(d, i) for d, t in texts for i, x in items if t and x in t}
