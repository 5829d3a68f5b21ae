"""Nearest neighbours against all exact cosines, and the quantiser's loss."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in row], 0) for i, row in enumerate(x)], SCHEMA)


def found(df, **more):
    rows = {}
    for r in nn.neighbours(df, **more).orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return rows


def brute(ids, x, k=5, divisor=50):
    x = np.asarray(x, np.float32).astype(float)
    out = {}
    for i, q in enumerate(ids):
        if q % divisor == 0:
            score = x @ x[i] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
            out[q] = sorted((-round(s, 10), c) for j, (c, s) in enumerate(zip(ids, score, strict=True)) if j != i)[:k]
    return out


def recall(got, expected):
    hits = sum(len({c for c, _, _ in got[q]} & {c for _, c in rows}) for q, rows in expected.items())
    return hits / sum(map(len, expected.values()))


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 33)) * 2
    return np.concatenate([rng.normal(size=(3000, 33)), centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 33))])


def test_recall(spark, points):
    expected = brute(range(len(points)), points)
    got = found(table(spark, points), block=1500, rerank=100)
    assert set(got) == set(expected) and all([r for _, _, r in v] == [1, 2, 3, 4, 5] for v in got.values())
    assert recall(got, expected) >= 0.95
    for q, rows in got.items():  # scores are those of the vectors themselves, and in order
        assert all(a[1] >= b[1] for a, b in zip(rows, rows[1:], strict=False))
        x, y = (points[i].astype(np.float32).astype(float) for i in (q, rows[0][0]))
        assert math.isclose(rows[0][1], x @ y / math.sqrt((x @ x) * (y @ y)), rel_tol=1e-12)


def test_all_reranked_is_exact(spark, points):
    some = points[2500:3500]
    expected = brute(range(1000), some)
    for block in (50, 400, 5000):
        got = found(table(spark, some), block=block, per_block=7, rerank=5000)
        assert {q: [(-round(s, 10), c) for c, s, _ in v] for q, v in got.items()} == expected


def test_ties_copies_and_bad_rows(spark):
    good = [(0, [1.0, 0.0, 0.0]), *[(i, [2.0, 2.0, 0.0]) for i in range(40, 1, -1)], (100, [2.0, 2.0, 0.0]), (100, [2.0, 2.0, 0.0]), (3, [2.0, 2.0, 0.0]), (-50, [0.0, 1.0, -0.0]), (7, [0.0, 1.0])]
    bad = [(150, None), (150, []), (150, [0.0, -0.0, 0.0]), (200, [1.0, float("nan"), 0.0]), (250, [float("inf"), 0.0, 0.0]), (300, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("v", "ids", "i", "j", "q", "score", "rank", "codes", "query_id", "times")])
    got = found(df.repartition(3), block=2)
    assert set(got) == {0, 100, -50}
    assert [c for c, _, _ in got[0]] == [2, 3, 3, 4, 5] and math.isclose(got[0][0][1], math.sqrt(0.5))
    # the row of each query itself is left out, its twin isn't; both rows of 100 are queries
    assert sorted(got[100]) == sorted([(2, 1.0, 1), (3, 1.0, 2), (3, 1.0, 3), (4, 1.0, 4), (5, 1.0, 5)] * 2)
    assert got[-50][0] == (7, 1.0, 1)
    few = found(spark.createDataFrame([(0, [1.0, 2.0], 1), (50, [1.0, 2.5], 1)], SCHEMA))
    assert {q: [c for c, _, _ in v] for q, v in few.items()} == {0: [50], 50: [0]}
    assert found(spark.createDataFrame([(100, [1.0, 2.0], 1), (100, [1.0, 2.0], 1)], SCHEMA)) == {100: [(100, 1.0, 1)] * 2}


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)) == {}
    assert found(spark.createDataFrame([(50, [1.0], 0)], SCHEMA)) == {}


def test_numbers_at_the_edge_of_the_range(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [0.0, 3e300])], "vec_id long, embedding array<double>")
    got = found(df)[0]
    assert [c for c, _, _ in got] == [1, 2] and math.isclose(got[0][1], math.sqrt(0.5)) and got[1][1] == 0.0


def test_residuals_along_vectors_cost_more(points):
    """The weighted codes have less residual along the vectors than plain ones, and more in all."""
    x = nn.unit(np.concatenate([points, np.zeros((len(points), 1))], axis=1))
    model = nn.Quantiser(x[::4])
    assert model.weight > 1

    def residuals(sweeps):
        left = x - model.words[np.arange(model.parts), model.codes(x, sweeps)].reshape(x.shape)
        return ((left * x).sum(axis=1) ** 2).mean(), (left**2).sum(axis=1).mean()

    (along, total), (plain_along, plain_total) = residuals(2), residuals(0)
    assert along < 0.8 * plain_along and total > plain_total
    assert (model.weight - 1) * along + total < (model.weight - 1) * plain_along + plain_total


def test_tables_sum_to_products(points):
    x = nn.unit(points[:200, :30])
    for size in (30, 28):  # an odd and an even number of subspaces
        y = x[:, :size]
        model = nn.Quantiser(y)
        near = model.words[np.arange(model.parts), model.codes(y)].reshape(y.shape)
        assert np.allclose(nn.scan(model.tables(y[:9]), model.packed(y)), y[:9] @ near.T, atol=1e-5)
