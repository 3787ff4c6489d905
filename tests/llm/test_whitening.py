"""Whitening: rank-one updates against whole decompositions, the query against plain numpy, odd rows."""

import numpy as np
import pytest

from lectern.llm import queries, whitening
from lectern.llm.spectrum import Spectrum, rank_one, secular_roots
from tests.conftest import SF


@pytest.mark.parametrize("dim", [1, 2, 5, 16, 40])
@pytest.mark.parametrize("kind", ["full", "low rank", "copies", "whole numbers", "graded", "equal"])
def test_updates_and_joins_equal_a_whole_decomposition(dim, kind):
    x = np.random.default_rng(dim).standard_normal((3 * dim + 5, dim))
    if kind == "low rank":
        x[:, : max(1, dim // 2)] = x[:, -1:]
    elif kind == "copies":
        x = np.repeat(x[: max(1, len(x) // 5)], 5, axis=0)
    elif kind == "whole numbers":
        x = np.round(x * 2)
    elif kind == "graded":
        x = x * np.logspace(0, -8, dim)
    elif kind == "equal":
        x[:] = x[0]
    a, b = Spectrum.empty(dim), Spectrum.empty(dim)
    for row in x[: len(x) // 2]:
        a.add(row)
    for row in x[len(x) // 2 :]:
        b.add(row, 2)
    a.join(b)
    x = np.vstack([x, x[len(x) // 2 :]])
    off = x - x.mean(0)
    want = off.T @ off
    top = max(np.abs(want).max(), 1e-12)
    assert a.n == len(x) and np.allclose(a.mean, x.mean(0))
    assert np.abs(a.vectors * a.values @ a.vectors.T - want).max() <= 1e-12 * top
    assert np.abs(a.vectors.T @ a.vectors - np.eye(dim)).max() <= 1e-12
    assert np.abs(a.values - np.linalg.eigvalsh(want)).max() <= 1e-12 * top
    assert (np.diff(a.values) >= 0).all()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(3)
    for k in (1, 2, 7, 50):
        d = np.sort(rng.uniform(0, 10, k)) + np.arange(k) * 1e-6
        z2 = rng.uniform(1e-8, 1, k) ** 4
        origin, t = secular_roots(d, z2, 2.0)
        root = origin + t
        assert (root >= d).all() and (root[:-1] <= d[1:]).all()
        assert np.allclose(root, np.linalg.eigvalsh(np.diag(d) + 2 * np.sqrt(np.outer(z2, z2))), atol=1e-11)


def test_update_of_nothing_and_deflation():
    values, vectors = np.asarray([1.0, 1.0, 3.0]), np.eye(3)
    assert rank_one(values, vectors, np.zeros(3), 1.0)[0] is values
    got, turned = rank_one(values, vectors, np.asarray([3.0, 4.0, 0.0]), 1.0)
    assert np.allclose(got, [1, 3, 26]) and np.allclose(turned.T @ turned, np.eye(3))


def plain(vectors, components=32):
    """Whitened values, shares and deviations by numpy alone."""
    x = np.asarray([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(0)
    off = ((x * n - total) / n).astype(float)
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    return off @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), ((x * n - total) ** 2).sum(1)


def check(rows, ids, vectors):
    white, share, deviation = plain(vectors)
    k = white.shape[1]
    assert len(rows) == len(ids) * k
    got = {(r.vec_id, r.component): r for r in rows}
    made = np.asarray([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    made *= np.sign((made * white).sum(0))
    assert np.abs(made - white).max() <= 1e-6
    assert np.allclose([got[ids[0], c].explained for c in range(1, k + 1)], share, rtol=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in rows} == {len(ids)} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error <= 1e-9


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id bigint, embedding array<float>, n bigint, whitened double").repartition(parts)


def test_query_equals_numpy(spark):
    table = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    check(queries.QUERIES["op13_whitening"](spark, SF).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_many_partitions_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(6) * [1, 2, 3, 4, 5, 0.5]]) for i in range(80)]
    good += [(100 + i, good[0][1]) for i in range(40)]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, [1.0, 2.0])]
    rows = whitening.whiten(frame(spark, good + odd, 40)).collect()
    check(rows, [i for i, _ in good], [v for _, v in good])
    twice = whitening.whiten(frame(spark, [(1, good[3][1]), (1, good[3][1]), (None, good[4][1]), (2, good[5][1])])).collect()
    assert len(twice) == 4 * 2 and sum(r.vec_id is None for r in twice) == 2


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []


def test_huge_entries(spark):
    rows = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r.deviation for r in rows if r.vec_id == 1} == {None} and all(np.isfinite(r.whitened) for r in rows)
