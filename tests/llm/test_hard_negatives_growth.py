"""Hard negatives: what is shuffled follows the input, and panels, blocks and kinds of numbers change no result."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorica.llm import hard_negatives

from .test_new_operators import VECTORS, brute_negatives, made_vectors

RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
RELABEL = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_shuffle_follows_the_input(spark):
    """Four times the rows have 16 times the scores; these stay where they are made."""
    took = []
    for n in (2000, 8000):
        x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
        frame = spark.createDataFrame([(k, x[k].tolist(), k % 5) for k in range(n)], "vec_id long, embedding array<float>, label int")
        before = shuffled(spark)
        assert hard_negatives.hard_negatives(frame, lambda i: i % 10 == 0).count() > n
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        took.append(shuffled(spark) - before)
    assert 0 < took[1] < 6 * took[0]


@pytest.mark.parametrize("times", [1, 1e5, 3e5])  # scores as 32-bit and 64-bit floats and as whole numbers
@pytest.mark.parametrize("sizes", [((30, 30), (3, 3), 7), ((1000, 1000), (1, 1), 16)])
def test_panels(spark, sizes, times):
    rows = [(i, x and [c and c * times for c in x], label) for i, x, label in made_vectors()]
    frame = spark.createDataFrame([(*x, 1, "g", None) for x in rows], VECTORS).repartition(3)
    panel_rows, panel_anchors, n_rows = sizes
    got = hard_negatives.hard_negatives(frame, lambda i: i % 20 == 0, RELABEL, n_rows=n_rows, n_anchors=2, n_dims=3, panel_rows=panel_rows, panel_anchors=panel_anchors)
    want = brute_negatives(rows, 20)
    assert Counter(tuple(r) for r in got.select(RESULT).collect()) == want and len(want) > 100


@pytest.mark.parametrize("order", ["rising", "falling", "equal", "any"])
def test_best_rows_in_any_order(order):
    """Each row better than all before it, or none, or all the same."""
    r, n = np.random.default_rng(5), 3000
    s = {"rising": np.arange(n), "falling": np.arange(n)[::-1], "equal": np.full(n, 500), "any": r.integers(0, 900, n)}[order]
    labels = r.integers(0, 2, n)
    above, upto = np.array([[99, 1200], [hard_negatives.MOST, -1]]), np.array([[800, 2500], [-hard_negatives.MOST, 5]])
    block = hard_negatives.Block([np.ones((2, 1), np.float32)], np.array([-1, -2]), np.array([-1, -2]), np.array([0, 0]), None, above.copy(), upto, False, 10)
    for a, z in ((0, 32), (32, 100), (100, 2100), (2100, n)):
        block.meet([s[a:z, None].astype(np.float32)], np.arange(a, z), np.arange(a, z), labels[a:z])
    block.take()
    for k in range(2):
        for w in range(2):
            want = sorted((-s[i], i) for i in range(n) if labels[i] and above[k, w] < s[i] <= upto[k, w])[:10]
            got = block.found[:, k, w]
            assert [(-x, i) for x, i in zip(got[0], got[1], strict=True) if x > hard_negatives.NONE] == want
