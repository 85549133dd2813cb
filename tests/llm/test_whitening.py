import math

import numpy as np
import pytest

from shopstat.llm import whitening
from shopstat.llm.queries import build_queries

from .helpers import SF, clashing

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, wanted=whitening.WANTED):
    """From the full covariance: whole numbers, deviations, projections."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(wanted, int((e > whitening.FLAT * e[0]).sum()))
    return n, deviation, y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def compare(rows, ids, vectors, tolerance=1e-8):
    n, deviation, white, explained = brute(vectors)
    k = white.shape[1]
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error <= 1e-4
    assert len(rows) == len(ids) * k
    at = {i: p for p, i in enumerate(ids)}
    for i in ids:
        assert sorted(got[i]) == list(range(1, k + 1))
        assert all(r.deviation == deviation[at[i]] for r in got[i].values())
        np.testing.assert_allclose([got[i][c].explained for c in range(1, k + 1)], explained, rtol=1e-9)
    found = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((found * white).sum(axis=0))         # one sign for all rows of a component
    np.testing.assert_allclose(found * sign, white, atol=tolerance)


def test_query_against_the_full_covariance(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = build_queries()["op11_whitening"](spark, SF).collect()
    compare(rows, [r.vec_id for r in table], [r.embedding for r in table])


def _random(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(3, 1, d)).astype(np.float32).astype(float).tolist()


def test_rows_that_dont_count(spark):
    good = _random(40, 6)
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] * 6, [1.0, 2.0, None, 3.0, 4.0, 5.0], [inf, 0.0, 0.0, 0.0, 0.0, 0.0], [1e30] * 6, [1.0] * 5]
    rows = [(i, v, 1) for i, v in enumerate(good + bad)] + [(7, good[7], 1)]           # a repeated row counts twice
    found = whitening.report(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    n, deviation, white, _ = brute(good + [good[7]])
    assert {r.n for r in found} == {41} and n == 41
    assert {r.vec_id for r in found} == set(range(40))
    assert len([r for r in found if r.vec_id == 7]) == 2 * 6
    assert [r.deviation for r in found if r.vec_id == 3][0] == deviation[3]


def test_null_ids_and_commonest_length(spark):
    rows = [(None, v, None) for v in _random(5, 3)] + [(i, v, None) for i, v in enumerate(_random(4, 2))]
    found = whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in found} == {None} and len(found) == 15


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_spread_gives_no_rows(spark, vectors):
    found = whitening.report(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA))
    assert found.count() == 0 and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_components_are_left_out(spark):
    base = np.array(_random(60, 4))
    vectors = np.hstack([base, base[:, :1], np.ones((60, 1))]).tolist()       # rank 4 of 6
    rows = whitening.report(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {r.component for r in rows} == {1, 2, 3, 4}
    compare(rows, list(range(60)), vectors)


def test_filter_finds_what_the_block_lacks(spark):
    """Fewer directions than dimensions: the wanted pairs come from the filter."""
    vectors = _random(400, 40)
    rows, d = whitening.whole_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], SCHEMA))
    x = whitening.Centred(rows, d)
    values, q = whitening.principal(x, wanted=5, guard=4, degree=8)
    y = np.floor(64 * np.array(vectors))
    y -= y.mean(axis=0)
    v = y.T @ y / len(y)
    e, u = np.linalg.eigh(v)
    np.testing.assert_allclose(values, e[::-1][:5], rtol=1e-12)
    np.testing.assert_allclose(np.abs(np.diag(q.T @ u[:, ::-1][:, :5])), 1, atol=1e-12)
    with pytest.raises(whitening.NotCertified):
        whitening.principal(x, wanted=5, guard=4, degree=2, most_rounds=2)


def test_filter_damps_the_unwanted():
    class Diagonal:
        d = 50

        def product(self, q):
            return np.linspace(1, 50, 50)[:, None] * q
    block = whitening.chebyshev(Diagonal(), np.eye(50), 1.0, 40.0, 50.0, 10)
    sizes = np.diag(block)
    assert np.abs(sizes[:40]).max() < 1e-3 * abs(sizes[-1]) and np.all(np.diff(np.abs(sizes[40:])) > 0)


def test_low_end_estimate():
    class Diagonal:
        d = 30

        def product(self, q):
            return np.linspace(2, 9, 30)[:, None] * q
    assert 0 <= whitening.lowest(Diagonal(), np.random.default_rng(0)) <= 2.3


def test_deviation_beyond_64_bits_is_null(spark):
    vectors = [[1e10, 0.0], [-1e10, 1.0], [3e9, 5.0]]
    rows = whitening.report(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")).collect()
    assert rows and all(r.deviation is None for r in rows)
