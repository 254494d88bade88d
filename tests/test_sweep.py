"""Many fits from one matrix, growing regressions and their residual sources against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.operators import regress
from paneloom.operators.sweep import Fit, RegressionTable, added, shifted_sums, solved, sweep


def made(n=300, at=0.0, seed=1, gaps=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.1] + at
    y = 2 + (x - at) @ [1.5, -0.3, 20] + r.normal(size=n)
    z = x[:, 0] - at + r.normal(size=n)
    w = r.choice([0.0, 0.5, 1.0, 3.0], size=n)
    g = r.choice(["a", "b", None], size=n)
    rows = [(g[i], *map(float, x[i]), float(y[i]), float(z[i]), float(w[i])) for i in range(n)]
    if gaps:
        rows = [tuple(None if isinstance(v, float) and k < 4 and (7 * i + k) % 11 == 0 else v for k, v in enumerate(row)) for i, row in enumerate(rows)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double, z double, w double").repartition(3)


def solution(rows, y, xs, constant=True):
    """Weighted least squares of complete rows."""
    a = np.array([[r[i] for i in xs] for r in rows], float)
    t, w = np.array([r[y] for r in rows], float), np.array([r[6] for r in rows], float)
    centre = a.mean(0) if constant else np.zeros(a.shape[1])
    a = a - centre
    full = np.c_[np.ones(len(a)), a] if constant else a
    beta = np.linalg.lstsq(full * np.sqrt(w)[:, None], t * np.sqrt(w), rcond=None)[0]
    rs = (w * (t - full @ beta) ** 2).sum() / w.sum()
    if constant:
        beta[0] -= beta[1:] @ centre
    return beta, rs


FITS = [Fit("y", "y", ("x1", "x2", "x3")), Fit("y2", "y", ("x1", "x2")), Fit("z", "z", ("x3", "x1")), Fit("x", "x1", ("z",))]
PLACES = {"x1": 1, "x2": 2, "x3": 3, "y": 4, "z": 5}


@pytest.mark.parametrize("constant", [True, False])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_sweep(spark, by, constant):
    rows = made()
    got = sweep(frame(spark, rows), FITS, "w", by=by, constant=constant).collect()
    groups = {None: rows} if not by else {k: [r for r in rows if r[0] == k] for k in ("a", "b", None)}
    assert len(got) == len(groups) * len(FITS)
    for r in got:
        own = groups[r["g"] if by else None]
        fit = next(f for f in FITS if f.label == r["label"])
        beta, rs = solution(own, PLACES[fit.response], [PLACES[p] for p in fit.predictors], constant)
        assert r["coefficients"] == pytest.approx(beta.tolist(), rel=1e-8)
        assert r["residual_squares"] == pytest.approx(rs, rel=1e-8)
        assert r["size"] == len(own) and r["names"] == [*(["constant"] if constant else []), *fit.predictors]


def test_sweep_equals_single_fits_with_gaps(spark):
    df = frame(spark, made(gaps=True))
    for constant in (True, False):
        got = {r["label"]: r for r in sweep(df, FITS[:2], "w", constant=constant).collect()}
        for f in FITS[:2]:
            one = regress.regress(df, f.response, f.predictors, "w", constant=constant).first()
            for i, name in enumerate(got[f.label]["names"]):
                assert got[f.label]["coefficients"][i] == pytest.approx(one[name], rel=1e-7)
                assert got[f.label]["t_stat"][i] == pytest.approx(one[f"{name}T"], rel=1e-6)
                assert got[f.label]["sigma"][i] == pytest.approx(one[f"{name}S"], rel=1e-6)
            assert got[f.label]["R2"] == pytest.approx(one["R2"], rel=1e-6)


def test_one_aggregate_for_any_number_of_fits(spark):
    """Two scans for the moments and their means, one for the residuals, for one fit as for four."""
    reads = []
    for fits in (FITS[:1], FITS):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            seen.add(1)
            yield from batches

        df = frame(spark, made(90)).coalesce(1)
        sweep(df.mapInArrow(counted, df.schema), fits, "w").collect()
        reads.append(seen.value)
    assert reads[0] == reads[1] <= 3


def test_far_from_zero(spark):
    rows = made(at=1e8)
    got = sweep(frame(spark, rows), FITS[:1], "w").first()
    beta, rs = solution(rows, 4, [1, 2, 3])
    assert got["coefficients"][1:] == pytest.approx(beta[1:].tolist(), rel=1e-5)
    assert got["residual_squares"] == pytest.approx(rs, rel=1e-5)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_batches_add_up(spark, by):
    rows = made(240, at=1e6, gaps=True)
    parts = [frame(spark, rows[a:b]) for a, b in ((0, 10), (10, 150), (150, 240))]
    names = ["x1", "x2", "x3", "y"]
    sums = shifted_sums(parts[0], names, "w", by)
    for p in parts[1:]:
        sums = added(sums.unionByName(shifted_sums(p, names, "w", by)), 4, by)
    whole = shifted_sums(frame(spark, rows), names, "w", by)
    fit = [Fit("y", "y", ("x1", "x2", "x3"))]
    key = lambda r: str(r["g"]) if by else ""
    for a, b in zip(sorted(solved(sums, fit, by).collect(), key=key), sorted(solved(whole, fit, by).collect(), key=key), strict=True):
        assert a["betas"][0][1:] == pytest.approx(b["betas"][0][1:], rel=1e-6)
        assert a["size"] == b["size"] and a["n"] == b["n"] and a["c0_3"] == b["c0_3"]


def growing(spark, **options):
    parts = [made(80, seed=s) for s in (1, 2)]
    table = RegressionTable(FITS[:1], "w", **options)
    for p in parts:
        table.update(frame(spark, p))
    return parts, table


def residual(rows, beta):
    a, t, w = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows]), np.array([r[6] for r in rows])
    return (w * (t - beta[0] - a @ beta[1:]) ** 2).sum() / w.sum()


def test_residuals_of_given_rows(spark):
    parts, table = growing(spark, store_all=True)
    other = made(50, seed=9)
    got = table.compute(frame(spark, other)).first()
    beta, _ = solution(parts[0] + parts[1], 4, [1, 2, 3])
    assert got["coefficients"] == pytest.approx(beta.tolist())
    assert got["residual_squares"] == pytest.approx(residual(other, beta))


def test_residuals_of_all_updates_come_before_the_last(spark):
    parts, table = growing(spark, store_all=True, store_last=True)
    beta, rs = solution(parts[0] + parts[1], 4, [1, 2, 3])
    assert table.compute().first()["residual_squares"] == pytest.approx(rs)
    assert table.compute(use_all=False).first()["residual_squares"] == pytest.approx(residual(parts[1], beta))
    assert table.compute(use_all=False, use_last=False).first()["residual_squares"] is None


def test_residuals_of_the_last_update(spark):
    parts, table = growing(spark, store_last=True)
    beta, _ = solution(parts[0] + parts[1], 4, [1, 2, 3])
    assert table.compute().first()["residual_squares"] == pytest.approx(residual(parts[1], beta))
    assert growing(spark)[1].compute().first()["R2"] is None
    with pytest.raises(ValueError):
        RegressionTable(FITS).compute()


def test_forecasts_and_errors_at_once(spark):
    rows = made(60)
    table = RegressionTable(FITS[:1], "w", store_all=True).update(frame(spark, rows))
    got = table.predict(frame(spark, rows)).collect()
    beta, rs = solution(rows, 4, [1, 2, 3])
    w = np.array([r[6] for r in rows])
    x = np.c_[np.ones(60), np.array([r[1:4] for r in rows])]
    c = np.linalg.inv((x * w[:, None]).T @ x / w.sum()) * rs
    for r in got:
        v = np.array([1, r["x1"], r["x2"], r["x3"]])
        assert r["forecast"] == pytest.approx(v @ beta)
        assert r["error"] == pytest.approx(np.sqrt(v @ c @ v))


def test_fits_without_a_solution(spark):
    rows = [("a", 1.0, 2.0, float(i), float(i), 1.0, 1.0) for i in range(9)]
    got = {r["label"]: r for r in sweep(frame(spark, rows), [Fit("flat", "y", ("x1",)), Fit("good", "y", ("x3",))]).collect()}
    assert got["flat"]["coefficients"] is None and got["good"]["coefficients"] == pytest.approx([0, 1])
    assert sweep(frame(spark, rows).where("false"), FITS, by=["g"]).count() == 0
    assert sweep(frame(spark, rows[:1]), FITS[:1]).first()["coefficients"] is None
    assert sweep(frame(spark, rows), FITS[:1]).agg(F.count(F.lit(1))).first()[0] == 1
