"""Every link of the n-gram join, against all pairs."""

import random

import pytest

from lorica.llm.ngram_join import ngram_join


def brute(docs, n=5):
    sets = {}
    for i, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    classes = sorted({s for s in sets.values() if s}, key=sorted)
    links = {s: {t for t in classes if s != t and 100 * len(s & t) >= 75 * len(s | t)} for s in classes}
    out = {}
    for i, s in sets.items():
        reach, todo = {s}, [s]
        while todo and s:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        out[i] = (len(s), min(k for k, t in sets.items() if t in reach) if s else i, len(links[s]) if s else 0)
    return out


@pytest.fixture(scope="module")
def docs():
    r, out = random.Random(4), []
    for g in range(4):
        base = [f"w{g}x{k}" for k in range(60)]
        for _ in range(12):  # near copies, of which many reach each other through others alone
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(60)] = f"u{r.randrange(40)}"
            a = r.randrange(8)
            out.append(" ".join(w[a : 60 - r.randrange(8)]))
        out += [out[-1].upper(), base[0], " ".join(base[:4]), ""]
    return list(enumerate([*out, None]))


@pytest.mark.parametrize("every", [True, False])
def test_links(spark, docs, every):
    got = {r["doc_id"]: r for r in ngram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), every_link=every).collect()}
    want = brute(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    if every:
        assert {i: r["links"] for i, r in got.items()} == {i: w[2] for i, w in want.items()}
    else:
        assert all(r["joining_links"] <= want[i][2] for i, r in got.items())
        assert sum(r["joining_links"] for r in got.values()) < sum(w[2] for w in want.values())
