"""The clustered logistic fit against a dense solution with explicit correlation matrices."""

import numpy as np
import pytest

from uttermark.operators import gee


def dense(cluster, y, x, rho, beta):
    """Score and information with the full inverse of every cluster's correlation matrix."""
    u, h, meat = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1],) * 2)
    for k in np.unique(cluster):
        at = cluster == k
        mu = 1 / (1 + np.exp(-x[at] @ beta))
        a = np.sqrt(mu * (1 - mu))
        r = np.full((at.sum(),) * 2, rho) + (1 - rho) * np.eye(at.sum())
        v = a[:, None] * r * a[None, :]
        d = x[at] * (mu * (1 - mu))[:, None]
        one = d.T @ np.linalg.solve(v, y[at] - mu)
        u, h, meat = u + one, h + d.T @ np.linalg.solve(v, d), meat + np.outer(one, one)
    return u, h, meat


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    cluster = np.repeat(np.arange(120), rng.integers(2, 9, 120))
    x1, x2 = rng.normal(size=len(cluster)), rng.integers(0, 2, len(cluster))
    shared = rng.normal(size=120)[cluster]
    y = (rng.random(len(cluster)) < 1 / (1 + np.exp(-(-0.3 + 0.9 * x1 - 0.6 * x2 + shared)))).astype(float)
    df = spark.createDataFrame([(int(c), float(b), float(a), int(k), float(a) * 2) for c, b, a, k in zip(cluster, y, x1, x2, strict=True)], "slurp_id long, y double, x1 double, x2 int, x3 double")
    return df, cluster, y, np.stack([np.ones(len(y)), x1, x2], 1)


def test_fit_solves_the_estimating_equations(data):
    df, cluster, y, x = data
    got = gee.fit(df, "y", ["x1", "x2"])
    assert (got.n, got.clusters) == (len(y), 120) and 0 < got.rho < 0.5
    u, h, meat = dense(cluster, y, x, got.rho, got.beta)
    assert np.abs(u).max() < 1e-4
    assert np.allclose(got.cov, np.linalg.inv(h) @ meat @ np.linalg.inv(h), rtol=1e-4)
    d, se, p = got.contrast("x1", "x2")
    assert d == pytest.approx(got.beta[1] - got.beta[2]) and se > 0 and 0 <= p <= 1
    chi, df_, _ = got.joint(["x1"])
    assert df_ == 1 and chi == pytest.approx(got.beta[1] ** 2 / got.cov[1, 1])


def test_fit_is_the_same_in_any_batches(data, spark):
    """Clusters cut by the ends of batches, down to a row at a time."""
    size, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for batch in ("10000", "5", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found.append(gee.fit(data[0].repartition(3), "y", ["x1", "x2"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for f in found[1:]:
        assert np.allclose(f.beta, found[0].beta, atol=1e-9) and np.allclose(f.cov, found[0].cov, atol=1e-9)
        assert (f.n, f.clusters, f.steps) == (found[0].n, 120, found[0].steps) and f.rho == pytest.approx(found[0].rho)


def test_one_term(spark):
    """An intercept alone."""
    df = spark.createDataFrame([(i // 3, float(i % 2)) for i in range(60)], "slurp_id long, y double")
    got = gee.fit(df, "y", [])
    assert got.beta[0] == pytest.approx(0, abs=1e-9) and got.clusters == 20


def test_refusals(data, spark):
    df = data[0]
    with pytest.raises(gee.Refused, match="rank"):
        gee.fit(df, "y", ["x1", "x3"])
    split = spark.createDataFrame([(i, float(i >= 20), float(i)) for i in range(40)], "slurp_id long, y double, x1 double")
    with pytest.raises(gee.Refused):
        gee.fit(split, "y", ["x1"])


def test_tails():
    assert gee.normal_tail(1.959963985) == pytest.approx(0.05, rel=1e-6)
    assert gee.chi2_tail(3.841458821, 1) == pytest.approx(0.05, rel=1e-6)
    assert gee.chi2_tail(29.1127, 6) == pytest.approx(5.79e-05, rel=1e-2)
    assert gee.chi2_tail(1.0, 4) == pytest.approx(0.909796, rel=1e-5)
