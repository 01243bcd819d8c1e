"""Ridge from per-fold QR factors against a direct numpy solve."""
import numpy as np
import pytest

from abode.operators import model as M
from abode.plans.model_queries import _train_test
from abode.session import scratch_path
from tests.conftest import SF_SMALL


def test_poly_exponent_order(spark):
    assert M.poly_exponents(spark, 2, 2) == [(1, 0), (2, 0), (0, 1), (1, 1), (0, 2)]
    assert len(M.poly_exponents(spark, 5, 5)) == 251
    for n, d in [(2, 2), (3, 4), (5, 5)]:
        assert M.term_order(n, d) == M.poly_exponents(spark, n, d)


def direct_ridge(x, y, exps, alpha):
    z = np.prod(x[:, None, :] ** np.array(exps, float)[None, :, :], axis=2)
    mu, sd = z.mean(0), z.std(0)
    sd[sd == 0] = 1.0
    xs = (z - mu) / sd
    w = np.linalg.solve(xs.T @ xs + alpha * np.eye(xs.shape[1]), xs.T @ (y - y.mean()))
    return lambda xt: (np.prod(xt[:, None, :] ** np.array(exps, float)[None, :, :], axis=2) - mu) / sd @ w + y.mean()


def test_ridge_matches_direct_solve(spark):
    tr, te = _train_test(spark, SF_SMALL)
    m = M.fit(tr, M.INPUTS, 3, alpha=0.1)
    p = tr.toPandas()
    f = direct_ridge(p[M.INPUTS].to_numpy(float), p["price"].to_numpy(float) / 1e9, m.exponents, 0.1)
    q = te.toPandas()
    want = f(q[M.INPUTS].to_numpy(float))
    got = m.transform(te).toPandas()["prediction"].to_numpy() / 1e9
    assert np.allclose(got, want, rtol=1e-7, atol=1e-7)


def test_grid_search_picks_min_cv_error(spark):
    tr, _ = _train_test(spark, SF_SMALL)
    m = M.fit(tr, ["area"], 1)
    best = min(m.cv, key=lambda r: r["mean_mse"])
    assert m.alpha == best["alpha"] and sum(r["chosen"] for r in m.cv) == 1


def test_save_load_round_trip(spark):
    tr, te = _train_test(spark, SF_SMALL)
    m = M.fit(tr, M.INPUTS, 2, alpha=1.0)
    path = scratch_path(spark, "test_model")
    m.save(spark, path)
    again = M.RidgeModel.load(spark, path)
    a = m.transform(te).toPandas()["prediction"].to_numpy()
    b = again.transform(te).toPandas()["prediction"].to_numpy()
    assert np.array_equal(a, b)


def reference_fit(x, y, exps, alpha):
    """Coefficients by numpy's QR of the standardised terms with the penalty's rows below."""
    z = M.terms(x, np.array(exps))
    mu, sd = z.mean(0), z.std(0)
    sd[sd <= 1e-9 * np.abs(z).max(0)] = np.inf
    xs = (z - mu) / sd
    d = xs.shape[1]
    q, r = np.linalg.qr(np.vstack([xs, np.sqrt(alpha) * np.eye(d)]))
    w = np.linalg.solve(r, q.T @ np.concatenate([y - y.mean(), np.zeros(d)]))
    return mu, sd, w, y.mean()


def test_degree_five_equals_numpy_qr(spark):
    """Chosen penalty, cross-validation errors, coefficients and predictions at the full degree."""
    tr, te = _train_test(spark, SF_SMALL)
    tr = tr.repartition(11)
    m = M.fit(tr)
    p = tr.toPandas().dropna(subset=M.INPUTS + ["price"])
    x, y, fold = p[M.INPUTS].to_numpy(float), p["price"].to_numpy(float) / 1e9, p["fold"].to_numpy()
    assert len(m.exponents) == 251

    def predicted(fit, xt):
        mu, sd, w, y0 = fit
        return (M.terms(xt, np.array(m.exponents)) - mu) / sd @ w + y0
    for row in m.cv:
        want = [np.mean((predicted(reference_fit(x[fold != f], y[fold != f], m.exponents, row["alpha"]), x[fold == f]) - y[fold == f]) ** 2)
                for f in sorted(set(fold))]
        assert np.allclose(row["fold_mse"], want, rtol=1e-8)
    assert m.alpha == min(m.cv, key=lambda r: r["mean_mse"])["alpha"]
    fit = reference_fit(x, y, m.exponents, m.alpha)
    slopes = fit[2] / fit[1]
    weight = np.abs(slopes * np.where(np.isinf(fit[1]), 0, fit[1]))
    got = np.array(m.coefficients())
    assert np.abs((got - slopes) * np.where(np.isinf(fit[1]), 0, fit[1])).max() <= 1e-8 * weight.max()
    q = te.toPandas()
    pred = m.transform(te).toPandas()["prediction"].to_numpy() / 1e9
    assert np.allclose(pred, predicted(fit, q[M.INPUTS].to_numpy(float)), rtol=1e-8, atol=1e-8)


def test_factors_merge_over_several_levels(spark):
    """Thirty tasks take two levels of merging; R'R is the Gram matrix of all rows."""
    from abode.operators import tsqr
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 4))
    rows = spark.createDataFrame([(int(k % 2), *map(float, r)) for k, r in enumerate(a)], "fold int, a double, b double, c double, d double")
    factors = tsqr.merged_factors(tsqr.task_factors(rows.repartition(30), lambda p: p[["a", "b", "c", "d"]].to_numpy()), 4)
    for f in (0, 1):
        part = a[f::2]
        assert np.allclose(factors[f].T @ factors[f], part.T @ part)


def test_a_fit_cleans_the_listings_once(spark, monkeypatch):
    """The training rows are read from a written table, not derived again by each pass over them."""
    from abode.plans import model_queries as Q
    seen = []
    fit = Q.M.fit
    monkeypatch.setattr(Q.M, "fit", lambda train, *a, **k: seen.append(train) or fit(train, *a, **k))
    SF = "/root/testdata/sf0.001"
    Q.q_model_save_load(spark, SF).collect()
    files = seen[0].inputFiles()
    assert files and not any("orders" in f or "customer" in f for f in files)
    direct = Q.training(Q.T(spark, SF)).filter("not is_test")
    assert sorted(map(tuple, seen[0].collect())) == sorted(map(tuple, direct.collect())) and direct.count() > 0


def test_factors_are_computed_on_one_thread(spark):
    """A task's factors take the CPU time of one core: no library threads beside the tasks' own."""
    import time

    import numpy as np
    from abode.operators import tsqr
    if not tsqr.one_thread():
        pytest.skip("numpy without OpenBLAS")

    def design(pdf):
        a = np.random.default_rng(7).random((2048, 253))
        wall, cpu = time.perf_counter(), time.process_time()
        for _ in range(20):
            tsqr.stacked_factor([a])
        # one row, whose factor is that row up to its sign: the cores used
        return np.full((len(pdf), 1), (time.process_time() - cpu) / (time.perf_counter() - wall))
    rows = spark.range(1).selectExpr("cast(id as int) fold", "id")
    (found,) = tsqr.task_factors(rows, design).collect()
    assert abs(np.frombuffer(found["factor"], "<f8")[0]) < 1.5
