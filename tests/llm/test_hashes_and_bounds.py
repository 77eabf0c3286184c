"""Word hashes that nobody can make collide, and memory bounded by bytes."""

import os
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorica.llm import decontaminate, ngram_join, substring_dedup, tokens, toxicity, words
from lorica.llm.queries import tokenizer_path
from lorica.llm.store import word_key

from .conftest import frame
from .test_corpus_operators import brute_substring, library, table

#: Two words of one unkeyed hash: the second block of 8 bytes undoes what the first one did.
TWINS = ("aaaaaaaadtxbWjhM", "zbdMbCPMKZ7Gg6ve")


def hashes(texts, key=None):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    return words.span_hashes(data, starts, ends) if key is None else words.keyed_hashes(data, starts, ends, key)


@pytest.mark.parametrize("size", [16, 24, 200])
def test_made_collisions(size):
    """Blocks that make the unkeyed chain meet again, whatever stands before and behind them."""
    before, r = b"same...." * ((size - 16) // 16), np.random.default_rng(size)
    behind = b"z" * (size - 16 - len(before))
    state = words.mix(np.array([size], np.uint64) * words._K2 + words._BASE)
    eight = lambda b: np.frombuffer(b, "<u8")
    for i in range(0, len(before), 8):
        state = words.mix(state ^ eight(before[i : i + 8]))
    pairs = []
    for _ in range(50):
        x, y, last = (r.bytes(8) for _ in range(3))
        other = words.mix(state ^ eight(x)) ^ eight(last) ^ words.mix(state ^ eight(y))
        pairs.append((before + x + last + behind, before + y + other.tobytes() + behind))
    one, two = zip(*pairs, strict=True)
    assert (hashes(one) == hashes(two)).all()
    for key in (1, 2, 1 << 62):
        assert not (hashes(one, key) == hashes(two, key)).any()
        assert len(set(hashes(one + two, key).tolist())) == 100 and (hashes(one, key) == hashes(list(one), key)).all()
    assert (hashes(one, 1) != hashes(one, 2)).all()


def test_keyed_hashes_of_all_lengths():
    texts = [b"a" * n for n in range(400)] + [b"a" * n + b"b" for n in range(400)] + [b"\0" * n for n in range(1, 20)]
    assert len(set(hashes(texts, 5).tolist())) == len(texts)
    w = words.Words(pa.array(["aa bb aa", "bb"]), words.NON_SPACE, key=9)
    assert w.hash[0] == w.hash[2] != w.hash[1] == w.hash[3]


def test_operators_tell_twins_apart(spark):
    many = " ".join(f"w{i}" for i in range(59))
    docs = frame(spark, [(1, f"{many} {TWINS[0]}"), (2, f"{many} {TWINS[1]}")])
    cut = table(substring_dedup.substring_dedup(docs), "doc_id")
    assert cut[2]["n_removed"] == 59 and cut[2]["kept"] == TWINS[1]
    few = frame(spark, [(1, f"a b c {TWINS[0]}"), (2, f"a b c {TWINS[1]}")])
    assert [r["component_id"] for r in ngram_join.ngram_join(few).orderBy("doc_id").collect()] == [1, 2]
    bench = spark.createDataFrame([(7, TWINS[0])], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(few, bench).where("contaminated").collect()} == {1}


def test_templates_with_a_running_number(spark):
    """Ten thousand documents that differ in one number share no window with it; none may go for another one's."""
    tail = " ".join(f"w{i}" for i in range(49))
    numbers = [*range(9_996), 80_462, 258_369, 57_301, 222_285]
    rows = [(i, f"{n} {tail}") for i, n in enumerate(numbers)]
    got = table(substring_dedup.substring_dedup(frame(spark, rows).repartition(8)), "doc_id")
    assert all(r["n_removed"] == 0 and r["n_words"] == 50 for r in got.values()) and len(got) == len(rows)
    more = [(i, f"{n} {tail} end") for i, n in enumerate(numbers[:300])]
    got = table(substring_dedup.substring_dedup(frame(spark, more)), "doc_id")
    assert {i: (r["n_removed"], r["kept"]) for i, r in got.items()} == {i: x[1:] for i, x in brute_substring(more).items()}


def test_many_rows_without_id(spark):
    """Rows that share a doc_id, or have none, are looked up each for itself."""
    base = [f"v{i}" for i in range(60)]
    rows = [(None, " ".join([*base[: k % 50], f"x{k}", *base[k % 50 + 1 :]])) for k in range(2500)]
    began = time.time()
    got = ngram_join.ngram_join(frame(spark, [*rows, (5, " ".join(base))]).repartition(4))
    assert {r["component_id"] for r in got.collect()} == {5} and time.time() - began < 120


def test_long_words_are_not_sent(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, "".join(chr(c) for c in r.integers(0x4E00, 0x9000, 3000))) for i in range(60)] + [(i + 100, "short words " * 5 + "y" * 40 + " " + "z" * 70) for i in range(60)]
    sent = []
    plain = tokens.Frequent.of
    monkeypatch.setattr(tokens.Frequent, "of", staticmethod(lambda t: (sent.append(t), plain(t))[1]))
    docs, tok = frame(spark, rows).repartition(3), library()
    for most in (32 << 20, 90):
        monkeypatch.setattr(tokens, "BROADCAST_BYTES", most)
        got = table(tokens.token_counts(docs, tokenizer_path()), "doc_id")
        assert {i: x["n_tokens"] for i, x in got.items()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
        assert sum(len(x) + tokens.ENTRY for x in sent[-1]["token"].to_pylist()) <= most and all(len(x) <= tokens.SHORT for x in sent[-1]["token"].to_pylist())
    assert sent[0].num_rows == 3


def test_pieces_remember_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40_000)
    monkeypatch.setattr(tokens, "KEPT", 10_000)
    known = tokens.Pieces(tokenizer_path(), True)
    tok = library()
    for k in range(20):
        texts = [" ".join(f"{c}{k}{i}" for i in range(60)) + " " + "q" * 5000 for c in "abc"]
        index, ids = known.of(tokens.Units(pa.array(texts), True))
        flat = [x for i in index for x in np.frombuffer(ids[i], np.uint32).tolist()]
        assert flat == [x for t in texts for x in tok.encode(t, add_special_tokens=False).ids]
        assert known.bytes == sum(tokens.HELD + len(t) + len(x) for t, x in known.seen.items()) < 40_000 + 200 * 250
    assert not any(len(t) > tokens.LONGEST for t in known.seen)


def test_the_key_is_the_application_s(spark):
    assert word_key(spark) == word_key(spark) > 0
    spark.conf.set("spark.lorica.wordKey", "17")
    try:
        assert word_key(spark) == 17
    finally:
        spark.conf.unset("spark.lorica.wordKey")
    assert word_key(spark) != 17 and Counter(os.environ)["lorica"] == 0


def test_parities_lose_no_pair(spark):
    """The filter never rules out a pair that reaches the threshold, and rules out most that share nothing."""
    r = np.random.default_rng(3)
    rows, sets = [], []
    for _ in range(400):
        n = int(r.integers(1, 300))
        common = r.integers(0, 1 << 63, n, dtype=np.uint64)
        rest = lambda: r.integers(0, 1 << 63, int(r.integers(0, n // 3 + 1)), dtype=np.uint64)  # noqa: B023, E731
        sets.append((np.unique(np.concatenate([common, rest()])), np.unique(np.concatenate([common, rest()]))))
    sets += [(r.integers(0, 1 << 63, 90, dtype=np.uint64), r.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(50)]
    for i, (x, y) in enumerate(sets):
        rows.append((i, [len(x), *ngram_join.parities(words.mix(x))], [len(y), *ngram_join.parities(words.mix(y))]))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    from pyspark.sql import functions as F

    side = lambda c: F.struct(F.col(c)[0].alias("n"), F.slice(c, 2, ngram_join.PARITIES).alias("parities"))
    passed = {x["i"] for x in df.select("i", side("a").alias("x"), side("b").alias("y")).where(ngram_join._alike("x", "y")).collect()}
    near = {i for i, (x, y) in enumerate(sets) if 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y))}
    assert near <= passed and len(near) > 100 and not passed & set(range(400, 450))


def labelled(n):
    """A batch of n documents of about 8 KB: doc_id, text, toxic."""
    r = np.random.default_rng(n)
    said = np.array([f"w{k:x}ord" for k in r.integers(0, 1 << 20, 20_000)] + ["l o s e r", "m0r0n", "stop."])
    texts = [" ".join(r.choice(said, 1000)) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array([k % 2 for k in range(n)], pa.int32())], ["doc_id", "text", "toxic"])


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_takes_little_memory_for_a_text():
    """Also one long text, which no piece can cut."""
    model, batch = np.zeros((toxicity.SYMBOLS,) * 3), labelled(256)
    text = pa.array([" ".join(batch["text"].to_pylist())])
    assert peak(lambda: toxicity.features(text, model, {})) < 40 * text.nbytes


def test_toxicity_counts_by_small_pieces(monkeypatch):
    """However large a batch is, and with the counts of a batch that is looked at whole."""
    model, batch = np.zeros((toxicity.SYMBOLS,) * 3), labelled(1024)
    assert batch["text"].nbytes > 6 << 20 and peak(lambda: list(toxicity.counted(iter([batch]), model))) < 80 << 20

    def sums():
        out = Counter()
        for b in toxicity.counted(iter([batch.slice(0, 300), batch.slice(300, 0), batch.slice(300)]), model):
            for h, t, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out[h, "t"] += t
                out[h, "c"] += c
        return out

    got = sums()
    for piece, counted in ((1 << 30, 1 << 30), (100_000, 1)):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "COUNTED", counted)
        assert sums() == got


def test_character_counts_by_document(spark):
    """A text's characters do not follow those of the text that happens to lie before it."""
    docs = frame(spark, [(k, t) for k, t in enumerate(["ab", "cd", None, "", "e", "ab"] * 5)])
    one, many = (toxicity.character_counts(docs.repartition(n)) for n in (1, 7))
    assert (one == many).all() and not one[0, 1, 2] and one[0, 1, toxicity.EDGE] == 10


def test_index_pages_hold_one_segment(spark):
    """Parquet looks at a page's size after 100 rows only; a row of the index has a MB."""
    index = decontaminate.build_index(frame(spark, [(k, "w x y z " * 150_000) for k in range(3)]).coalesce(1))
    parquet, path = spark._jvm.org.apache.parquet.hadoop, spark._jvm.org.apache.hadoop.fs.Path
    for f in index.inputFiles():
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path(f), spark._jsc.hadoopConfiguration()))
        block = reader.getFooter().getBlocks().get(0)
        assert [reader.readOffsetIndex(c).getPageCount() for c in block.getColumns()] == [block.getRowCount()] * 7
        reader.close()
    assert index.count() == 3
