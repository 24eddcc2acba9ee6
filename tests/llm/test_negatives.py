import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.llm import negatives


def brute_force(rows):
    usable = []
    for number, (key, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((key, [math.floor(256 * x) for x in vector], label))
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))
    told = []
    for at, (key, vector, label) in enumerate(usable):
        if key is None or key % 5:
            continue
        scored = [(sum(x * y for x, y in zip(vector, other)), k, tag)
                  for n, (k, other, tag) in enumerate(usable) if n != at]
        for positive, positive_id, _ in order(s for s in scored if s[2] == label)[:5]:
            near = order(s for s in scored if s[2] != label and 50 * positive <= 100 * s[0] <= 95 * positive)[:3]
            told += [(key, positive_id, rank, k, positive, score) for rank, (score, k, _) in enumerate(near, 1)]
    return sorted(told, key=repr)


def mined(spark, rows, **blocks):
    vectors = spark.createDataFrame(
        [(*row, 1, "x") for row in rows], "vec_id long, embedding array<double>, label int, row int, anchor string")
    found = negatives.hard_negatives(vectors.repartition(3), F.col("vec_id") % 5 == 0, **blocks)
    return sorted(map(tuple, found.collect()), key=repr)


def clustered(rng, n, dim=8):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.randrange(4)) for k in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"anchor_block": 7, "candidate_block": 31}])
def test_matches_brute_force(spark, blocks):
    rng = random.Random(2)
    rows = clustered(rng, 200) + [
        (None, [1.0] * 8, 1), (1000, None, 1), (1005, [float("nan")] * 8, 2), (1010, [None] * 8, 2),
        (1015, [0.5] * 8, None), (1020, [float("inf")] + [0.0] * 7, 1), (1025, [], 1), (1030, [0.0] * 8, 3),
        (1035, [2.0, 1.0], 2), (1036, [1.0] * 12, 1)]
    assert mined(spark, rows, **blocks) == brute_force(rows)


def test_ties_and_repeated_rows(spark):
    rows = [(k % 15, [float(k % 3), 1.0], k % 2) for k in range(90)]
    # Rows of one id, label and vector cannot be told apart, so ids and scores are all there is to compare.
    assert mined(spark, rows, candidate_block=16) == brute_force(rows)


def test_scores_beyond_doubles_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) * 2.0 ** 20 for _ in range(6)], k % 3) for k in range(60)]
    assert mined(spark, rows, candidate_block=20) == brute_force(rows)
    huge = [(k, [rng.uniform(0.5, 1) * 1e30], k % 2) for k in range(20)]
    assert all(row[4] is None for row in mined(spark, huge))


def test_too_few_rows(spark):
    assert mined(spark, [(0, [1.0], 1)]) == mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.6], 2)]) == [(0, 1, 1, 2, 65536, 39168)]
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(vectors, F.col("vec_id") % 5 == 0).collect() == []


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30):
        vectors = rng.normal(size=(n, 4))
        order, parent, edges = negatives.spanning_tree(vectors)
        assert sorted(order.tolist()) == list(range(n))
        seen = set()
        for at in order.tolist():
            assert parent[at] == at or parent[at] in seen
            seen.add(at)
        # Kruskal's choice has the same length.
        pairs = sorted((float(np.linalg.norm(vectors[i] - vectors[j])), i, j) for i in range(n) for j in range(i))
        group, total = list(range(n)), 0.0
        for length, i, j in pairs:
            if group[i] != group[j]:
                total += length
                group = [group[j] if g == group[i] else g for g in group]
        assert edges.sum() == pytest.approx(total)


def test_bounds_leave_most_candidates_alone(monkeypatch):
    """In tight clusters an anchor is scored against few rows, and the result is that of scoring all."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    rows = np.floor(256 * (np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)) * 0.02)).astype(np.int64)
    table = pa.table({
        "row": pa.array(range(2000)), "id": pa.array(range(2000)),
        "label": pa.array([str(n // 100 % 5) for n in range(2000)]),
        "vector": pa.array(rows.tolist(), pa.list_(pa.int64()))})
    asked = []
    plain = negatives._scores
    monkeypatch.setattr(negatives, "_scores", lambda block, at, *rest: asked.append(len(at)) or plain(block, at, *rest))
    search = negatives._search(negatives._all_scores, 5, True)
    anchors = table.take(list(range(0, 2000, 20)))
    found = search(anchors, table)
    assert len(asked) > 70 and np.mean(asked) < 250
    scores = rows @ rows.T
    for anchor in range(0, 2000, 20):
        same = [n for n in range(2000) if n != anchor and n // 100 % 5 == anchor // 100 % 5]
        best = sorted(same, key=lambda n: (-scores[anchor, n], n))[:5]
        assert [r["id"] for r in found.to_pylist() if r["anchor"] == anchor] == best
