"""Rows that repeat a doc_id or have none, words that defeat weak hashes, empty tables, for all operators."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorica.llm import decontaminate, exact_dedup, maxent_lm, ngram_join, packing, pii, secrets, substring_dedup, tokens, toxicity, words
from lorica.llm.queries import tokenizer_path

from .conftest import frame
from .test_corpus_operators import brute_hits, library, table
from .test_corpus_operators import words as split


def thue_morse(n):
    s = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return s, s.translate(str.maketrans("ab", "ba"))


TM = [w for n in (1024, 2048, 4096) for w in thue_morse(n)]
#: (doc_id, text): ids 7 and 8 repeat, two rows have none.
ROWS = [
    (7, "one two three " + " ".join(f"p{i}" for i in range(80))), (7, "other words " + " ".join(f"q{i}" for i in range(70))), (8, "same row"), (8, "same row"),
    (9, " ".join(f"p{i}" for i in range(80)) + " end"), (None, "no id " + " ".join(f"q{i}" for i in range(70))), (None, None), (10, " ".join(f"q{i}" for i in range(70)) + " tail"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS).repartition(3)


def listed(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_word_hashes():
    for h in (words.Words(pa.array([" ".join(TM)]), words.NON_SPACE).hash,):
        assert len(set(h.tolist())) == len(TM)
    texts = ["aa bb aa", "x" * 400, "x" * 399 + "y " + "x" * 400, "bb"]
    w = words.Words(pa.array(texts), words.NON_SPACE)
    own = [w.text(i) for i in range(len(w.start))]
    for h in (w.hash, np.zeros(len(own), np.uint64)):  # also if all hashes were equal
        at, content = words.distinct_spans(w.data, w.start, w.end, h)
        assert [own[at[c]] for c in content] == own and len({own[i] for i in at}) == len(at) == 4


def test_words_that_defeat_polynomials(spark):
    tok = library()
    pairs = list(zip(TM[::2], TM[1::2], strict=True))
    rows = [(i, f"{a} {b} {a}") for i, (a, b) in enumerate(pairs)] + [(i + 10, b) for i, (_, b) in enumerate(pairs)] + [(20, " ".join([*(["w"] * 60), TM[0]])), (21, " ".join([*(["w"] * 60), TM[1]]))]
    docs = frame(spark, rows)
    counted = table(tokens.token_counts(docs, tokenizer_path()), "doc_id")
    packed = {(r["doc_id"], r["start"]): r for r in packing.pack(docs, tokenizer_path()).collect()}
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert counted[i]["n_tokens"] == len(ids) - 1
        for at in range(0, len(ids), 2048):
            assert packed[i, at]["ids_crc32"] == zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())
    joined = table(ngram_join.ngram_join(docs), "doc_id")
    assert all(joined[i]["component_id"] == i for i, _ in rows)
    bench = spark.createDataFrame([(1, TM[0])], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).where("contaminated").collect()} == {0, 20}
    cut = table(substring_dedup.substring_dedup(docs), "doc_id")
    assert cut[21]["n_removed"] == 60 and cut[21]["kept"] == TM[1]
    model, counts = maxent_lm.train_model(docs.where("doc_id < 10").select("doc_id", "text"))
    known = table(maxent_lm.score(docs, model, counts), "doc_id")
    c = Counter(x for i, t in rows if i < 10 for x in [*split(t), None])
    for i, t in rows:
        assert known[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))) for x in [*split(t), None]))


def test_pii_secrets_tokens_packing(odd):
    assert listed(pii.pseudonymise(odd, "k"), "doc_id", "text") == Counter((i, t or "") for i, t in ROWS)
    assert listed(secrets.scan(odd), "doc_id") == Counter((i,) for i, _ in ROWS)
    n = lambda t: len(library().encode(t or "", add_special_tokens=False).ids)
    assert listed(tokens.token_counts(odd, tokenizer_path()), "doc_id", "n_tokens") == Counter((i, n(t)) for i, t in ROWS)
    assert listed(packing.pack(odd, tokenizer_path()), "doc_id", "doc_tokens") == Counter((i, n(t) + 1) for i, t in ROWS)


def test_substring_dedup(odd):
    got = listed(substring_dedup.substring_dedup(odd), "doc_id", "n_words", "n_removed")
    # p0..p79 first in 7, q0..q69 first in the other row 7; rows without id lose nothing and are no reference
    expected = Counter([(7, 83, 0), (7, 72, 0), (8, 2, 0), (8, 2, 0), (9, 81, 80), (None, 72, 0), (None, 0, 0), (10, 71, 70)])
    assert got == expected


def test_ngram_join(odd):
    got = listed(ngram_join.ngram_join(odd), "doc_id", "n_shingles", "component_id", "class_id")
    expected = Counter([(7, 79, 7, 7), (7, 68, 7, 7), (8, 1, 8, 8), (8, 1, 8, 8), (9, 77, 7, 9), (None, 68, 7, None), (None, 0, None, None), (10, 67, 7, 10)])
    assert got == expected


def test_verifies_each_pair_once(spark, docs, monkeypatch):
    asked = []
    plain = ngram_join._verified

    def spy(pairs, *rest):
        asked.extend(tuple(r) for r in pairs.collect())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", spy)
    base = [f"w{k}" for k in range(80)]
    family = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 60, 2)]
    more = frame(spark, [(1000 + i, t) for i, t in enumerate(family)])
    got = ngram_join.ngram_join(docs.union(more))
    assert {r["component_id"] for r in got.where("doc_id >= 1000").collect()} == {1000}
    assert len(asked) == len(set(asked)) == len({tuple(sorted(p)) for p in asked}) and 29 <= len(asked) < 300


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(12))), (None, " ".join(f"q{i}" for i in range(10))), (1, "same row"), (22, None)], "item_id long, text string")
    for limit in (200_000, 2):
        parts = decontaminate.blocks(decontaminate.phrase_table(bench), limit)
        found = decontaminate.search(decontaminate.build_index(odd), parts)
        assert found.select("row").distinct().count() == len(ROWS) and len(parts) == (1 if limit > 2 else len(parts))
    got = listed(decontaminate.decontaminate(odd, bench).withColumn("s", F.concat_ws(",", "items")).withColumn("n", F.size("items")), "doc_id", "n_hit", "n", "s", "contaminated")
    expected = Counter([(7, 12, 1, "1", True), (7, 10, 1, "", True), (8, 2, 1, "1", True), (8, 2, 1, "1", True), (9, 12, 1, "1", True), (None, 10, 1, "", True), (None, 0, 0, "", False), (10, 10, 1, "", True)])
    assert got == expected
    named = [(i, t) for i, t in ROWS if i in (9, 10)]
    assert {(r["doc_id"], r["n_hit"]) for r in decontaminate.decontaminate(frame(spark, named), bench.where("item_id = 1")).collect()} == {(i, h[1]) for i, h in brute_hits(named, [(1, bench.first()["text"])]).items()}


def test_exact_dedup(odd):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got = listed(exact_dedup.exact_dedup(odd), "doc_id", "group_size", "digest")
    n = Counter(norm(t) for _, t in ROWS)
    assert got == Counter((i, n[norm(t)], hashlib.sha256(norm(t).encode()).digest()) for i, t in ROWS)


def test_maxent_does_not_follow_partitions(spark, docs):
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    models = [maxent_lm.train_model(train.repartition(n))[0] for n in (1, 5)]
    assert np.array_equal(models[0].weights, models[1].weights)
    small = maxent_lm.TOKENS_PER_ROW
    try:
        maxent_lm.TOKENS_PER_ROW = 0.02  # several shards
        a, b = (maxent_lm.train_model(train.repartition(n))[0].weights for n in (2, 7))
    finally:
        maxent_lm.TOKENS_PER_ROW = small
    assert np.array_equal(a, b) and not np.array_equal(a, models[0].weights)


def test_maxent_and_toxicity_rows(spark, odd):
    model, counts = maxent_lm.train_model(odd.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert listed(maxent_lm.score(odd, model, counts), "doc_id", "n_tokens") == Counter((i, len(split(t)) + 1) for i, t in ROWS)
    bad = [(k, f"you idiot number {k}", 1) for k in range(300, 340)] + [(k, f"the river number {k}", 0) for k in range(340, 380)]
    labels = spark.createDataFrame([(i, x, "t") for i, _, x in bad] + [(7, 0, "t")], "doc_id long, toxic int, text string")
    rows = [(i, t) for i, t, _ in bad] + [(200, "1d" * 50_000 + " idiot"), (200, "1d" * 50_000 + " idiot"), (None, "idiot")] + ROWS
    every = frame(spark, rows).withColumns({"score": F.lit("s"), "h": F.lit(1), "toxic": F.lit("no")})
    got = toxicity.score(every, toxicity.train(every, labels))
    assert listed(got.where("doc_id = 200 or (doc_id is null and predicted = 1)"), "doc_id", "predicted") == Counter({(200, 1): 2, (None, 1): 1})
    assert got.count() == len(rows) and got.where("doc_id in (7, 8, 9, 10)").agg(F.max("predicted")).first()[0] == 0


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    rows = [(3, "A x"), (5, "A x"), (5, "B unique"), (7, "C"), (7, "C"), (None, "D alone"), (None, "A x")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and listed(kept, "doc_id", "text") == Counter([(3, "A x"), (5, "B unique"), (7, "C"), (None, "D alone")])
    near = listed(corpus_pipeline.drop_near_copies(spark, frame(spark, ROWS).select("doc_id", "text"), str(tmp_path)), "doc_id", "text")
    assert near == Counter([ROWS[0], ROWS[1], ROWS[2], ROWS[6]])
    empty = docs.limit(0)
    for name in ("documents", "labels", "benchmark"):
        {"documents": empty, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}[name].write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
