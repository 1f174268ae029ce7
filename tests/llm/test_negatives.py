"""Hard negatives against a plain search, on awkward vectors and across blocks."""

import random

import numpy as np
import pytest

from inspectlake.llm import negatives

ITEMS = "vec_id long, label int, v array<long>, score string, Block int"


def plain(rows, percent=80, most=5):
    """(anchor, positive, rank, negative, scores) by sorting every anchor's rows."""
    fine = [(i, l, v) for i, l, v, *_ in rows if i is not None and l is not None and v is not None and None not in v]
    anchors = {}
    for i, l, v in fine:
        if i % 100 == 0 and (i not in anchors or (l, v) < anchors[i]):
            anchors[i] = (l, v)
    end = 2**63 - 1
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-max(-end, min(end, sum(x * y for x, y in zip(v, w)))), i, l) for i, l, w in fine if i != a]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:most]:
            hard = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:most]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def vectors(rng, n):
    near = [[rng.randint(-40, 90) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randint(0, 3), [x + rng.randint(-9, 9) for x in rng.choice(near)], "s", 0) for i in range(n)]
    rows += rows[100:103] + [(100, 1, near[0], "s", 0), (300, None, near[1], "s", 0), (301, 1, None, "s", 0), (400, 1, [1, None], "s", 0)]
    rows += [(None, 1, near[0], "s", 0), (7000, 2, [], "s", 0), (7100, 2, [5, 5], "s", 0), (7001, 9, [0] * 6, "s", 0)]
    return rows + [(8000 + i, i % 2, [3, 3, 3, 3, 3, 3], "s", 0) for i in range(40)]


@pytest.mark.parametrize("block", [8192, 37])
def test_negatives_equal_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "VECTOR_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3 if block == 37 else 2048)
    monkeypatch.setattr(negatives, "LANES", 4)
    rows = vectors(random.Random(block), 900)
    got = negatives.mine(spark.createDataFrame(rows, ITEMS).repartition(3), "vec_id % 100 = 0").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_empty_items(spark):
    assert negatives.mine(spark.createDataFrame([], ITEMS), "vec_id % 100 = 0").count() == 0


def test_one_vector_with_a_third_of_all_rows(spark):
    rows = [(0, 0, [9, 1], "", 0), *((200, 0, [9, 1], "", 0) for _ in range(30)), *((i, i % 3, [8, i % 5], "", 0) for i in range(1, 61))]
    got = negatives.mine(spark.createDataFrame(rows, ITEMS), "vec_id % 100 = 0").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


@pytest.mark.parametrize("size", [1, 2**25, 2**40, 2**62])
def test_products_are_exact_or_end_at_a_long(size):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-size, size, (3, 4), endpoint=True) for _ in range(2))
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    end = 2**63 - 1
    assert negatives.products(a, b).tolist() == [[max(-end, min(end, x)) for x in row] for row in exact]


def test_floor_of_a_window():
    for p in (-7, 0, 1, 9, 10, 2**60 + 1):
        low = negatives.least_hard(p, 80)
        assert 80 * p <= 100 * low and 80 * p > 100 * (low - 1)
