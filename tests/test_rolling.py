import random
import time
from collections import Counter

import numpy as np
import pytest

from quillspark.operators import agreement


def plain(pairs, window):
    out = []
    for i in range(len(pairs)):
        seen = pairs[max(0, i - window + 1) : i + 1]
        in_a, in_b = Counter(a for a, _ in seen), Counter(b for _, b in seen)
        out.append((len(seen), sum(a == b for a, b in seen), sum(n * in_b[v] for v, n in in_a.items())))
    return out


@pytest.mark.parametrize("window", [1, 3, 50, 1000])
def test_running_counts_equal_whole_windows(window):
    rnd = random.Random(window)
    pairs = [(rnd.choice([0, 0, 0, 1, 2, 7]), rnd.choice([0, 1, 1, 2, 5])) for _ in range(400)]
    a, b = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    assert list(zip(*(c.tolist() for c in agreement.rolling_counts(a, b, window)), strict=True)) == plain(pairs, window)


def test_cost_does_not_grow_with_the_window():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, (2, 100_000))
    spent = []
    for window in (50, 5000):
        start = time.perf_counter()
        agreement.rolling_counts(a, b, window)
        spent.append(time.perf_counter() - start)
    assert spent[1] < 5 * spent[0] + 0.5


@pytest.mark.parametrize("drop", [True, False])
def test_blocks_and_missing_values(spark, drop):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("xyyy"), rnd.choice(["u", "v", None]), rnd.choice(["u", "v", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, field string, a string, b string")
    got = {r["doc_id"]: (r["n"], r["kappa"]) for r in agreement.rolling_kappa(df, 40, ("doc_id",), drop_missing=drop).collect()}
    want = {}
    for field in "xy":
        own = [r for r in rows if r[1] == field and not (drop and (r[2] is None or r[3] is None))]
        for r, (n, agree, marginal) in zip(own, plain([r[2:] for r in own], 40), strict=True):
            want[r[0]] = (n, None if n * n == marginal else pytest.approx((n * agree - marginal) / (n * n - marginal)))
    assert got == want
