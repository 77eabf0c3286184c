"""Hard negatives, the filter audit and byte-level BPE against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorica.llm import byte_bpe, filter_audit, hard_negatives
from lorica.llm.queries import tokenizer_path

from .conftest import frame

VECTORS = "vec_id long, embedding array<float>, label int, row long, g string, m binary"


def made_vectors(n=230):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.51, 1.0]) for _ in range(5)], r.choice([0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(300, 330)]  # many equal vectors
    rows += [(500, None, 1), (501, [0.1, None, 0.3, 0.1, 0.1], 1), (502, [float("nan")] * 5, 1), (503, [float("inf")] * 5, 0), (504, [0.5] * 5, None), (None, [0.5] * 5, 0)]
    rows += [(40, [0.25] * 5, 0), (40, [0.25] * 5, 2), (600, [0.5, 0.5], 0), (601, [], 1), (602, [0.5] * 7, 1)]
    return rows


def brute_negatives(rows, step):
    v = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    out = Counter()
    for a, (i, label, x) in enumerate(v):
        if i % step:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, m == label) for b, (j, m, y) in enumerate(v) if b != a]  # noqa: B905
        for s, j, _ in sorted(t for t in scored if t[2])[:5]:
            within = sorted(t for t in scored if not t[2] and -30 * s <= -100 * t[0] <= -90 * s)[:10]
            out.update((i, j, rank, k, -s, -u) for rank, (u, k, _) in enumerate(within, 1))
    return out


@pytest.mark.parametrize("sizes", [(16, 4, 2), (1000, 1000, 100)])
def test_hard_negatives(spark, sizes):
    rows = made_vectors()
    frame_ = spark.createDataFrame([(*x, 1, "g", None) for x in rows], VECTORS).repartition(3)
    relabel = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    n_rows, n_anchors, n_dims = sizes
    got = hard_negatives.hard_negatives(frame_, lambda i: i % 20 == 0, relabel, n_rows=n_rows, n_anchors=n_anchors, n_dims=n_dims)
    want = brute_negatives(rows, 20)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want and len(want) > 100


def test_hard_negatives_without_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none, lambda i: i % 2 == 0).collect() == []
    one = spark.createDataFrame([(2, [1.0], 0, 1, "", None), (3, [1.0], 0, 1, "", None)], VECTORS)
    assert hard_negatives.hard_negatives(one, lambda i: i % 2 == 0).collect() == []
    large = spark.createDataFrame([(2, [1e30], 0, 1, "", None)], VECTORS)
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(large, lambda i: i % 2 == 0)


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t))]
        fails.append(i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        rows.append((i, lang or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}))
    out, blame = {}, Counter()
    for part in {p for _, p, _ in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in rows if p == part]
            every = list(left)
            for step, own in enumerate(order, 1):
                gone = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                blame[part, own] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(own in f for _, f in every) - len(gone), sum(f == {own} for _, f in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, blame[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, rows):
    many = "aa bb cc " * 80
    docs = [(i, t, ("en", "de", None)[i % 3]) for i, t in rows]
    docs += [(900, many, "en"), (901, many, "de"), (902, many, "en"), (902, many, "en"), (None, many, "en"), (None, None, None), (903, "ABC " + many + "#", "xx"), (904, "Ünï " * 300 + "𝄞", "xx"), (905, "\x0b \x1c", "xx")]
    labels = [(i, i % 2, 1 - i % 2) for i, _, _ in docs if i is not None and i % 5] + [(901, None, 1), (901, 1, None), (None, 1, 1), (5000, 1, 1), (903, None, None)]
    frame_ = spark.createDataFrame([(i, t, g, "s", 1, 2) for i, t, g in docs], "doc_id long, text string, lang string, part string, mask int, n long").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(frame_, said).collect()}
    want = brute_audit(docs, labels)
    assert len(got) == 600 * 4 and got == want


def test_filter_audit_without_rows(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).collect() == []
    one = frame(spark, [(1, "x")])
    assert filter_audit.audit(one, none).count() == 600


def codec_of():
    import public_tokenizers
    import tiktoken

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["I'll don't 'S <|endoftext|> naïve 日本語 \U0001d11e é", "a  b\n\n\n  c \t\r\n x", " " * 3000, "=" * 3000, "ab" * 20_000, "\x00\x85 ​﻿", "१२३ 12345 ½ Ⅷ", "x" * 300_000]


def test_byte_bpe_as_the_reference_library(spark, rows):
    path, pattern, known = codec_of()
    docs = rows + list(enumerate(ODD, 1000)) + [(1000, "again"), (None, "no id"), (None, None)]
    got = byte_bpe.decode(byte_bpe.encode(frame(spark, docs).repartition(3), path, pattern), path, pattern).collect()
    want = Counter()
    for i, t in docs:
        ids = known.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_byte_bpe_of_random_characters(spark):
    path, pattern, known = codec_of()
    r = random.Random(1)
    tokens = list(known._mergeable_ranks)
    docs = [(i, b"".join(r.choices(tokens, k=6)).decode("utf-8", "ignore")) for i in range(3000)]
    docs += [(i, "".join(chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0x10000, 0x1F000)])) for _ in range(20))) for i in range(3000, 4000)]
    got = {r_["doc_id"]: np.frombuffer(r_["ids"], "<u4").tolist() for r_ in byte_bpe.encode(frame(spark, docs), path, pattern).collect()}
    assert got == {i: known.encode_ordinary(t) for i, t in docs}


def test_split_characters(spark):
    path, pattern, known = codec_of()
    text = "a𝄞b 日本 é"
    ids = known.encode_ordinary(text)
    halves = [(0, ids[:2]), (1, ids[2:]), (2, []), (3, None)]
    frame_ = spark.createDataFrame([(i, None if x is None else bytearray(np.array(x, "<u4").tobytes())) for i, x in halves], "doc_id long, ids binary")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(frame_, path, pattern).collect()}
    assert (got[0] + got[1]).decode() == text and got[2] == got[3] == b""
    with pytest.raises(UnicodeDecodeError):
        got[0].decode()
    spans = byte_bpe.offsets(byte_bpe.encode(frame(spark, [(7, text), (8, "")]), path, pattern), path, pattern).collect()
    begin, end = next((r["begin"], r["end"]) for r in spans if r["doc_id"] == 7)
    for i, a, b in zip(ids, begin, end, strict=True):
        raw = known.decode_single_token_bytes(i)
        assert raw in text[a:b].encode() and len(text[a:b].encode()) - len(raw) < 6
    assert begin[0] == 0 and end[-1] == len(text) and any(b < a for a, b in zip(end, begin[1:], strict=False))  # the split ones overlap
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id long, ids binary"), path, pattern).collect()


def test_byte_bpe_digests(spark, empty):
    path, pattern, _ = codec_of()
    assert byte_bpe.decode(byte_bpe.encode(empty, path, pattern), path, pattern).collect() == []
    row = byte_bpe.encode(frame(spark, [(1, None)]), path, pattern).select(F.sha2("ids", 256).alias("s"), "n_tokens").first()
    assert row["s"] == hashlib.sha256(b"").hexdigest() and row["n_tokens"] == 0
