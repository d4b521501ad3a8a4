"""Outlier detectors, pruned neighbours and thresholds of many classes against plain solvers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.functions.stats import chi2_cdf, chi2_quantile
from phenogrid.operators import neighbours, outliers, threshold


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))


def test_chi_square():
    for x in (0.1, 1.0, 5.0, 40.0):
        assert chi2_cdf(x, 2) == pytest.approx(1 - math.exp(-x / 2), abs=1e-13)
        assert chi2_cdf(x, 4) == pytest.approx(1 - math.exp(-x / 2) * (1 + x / 2), abs=1e-13)
        assert chi2_cdf(x, 1) == pytest.approx(math.erf(math.sqrt(x / 2)), abs=1e-13)
    assert chi2_quantile(0.975, 2) == pytest.approx(-2 * math.log(0.025)) and chi2_cdf(chi2_quantile(0.5, 7), 7) == pytest.approx(0.5)


def reweighted(x, mean, cov):
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    within = x[d < np.median(d) / chi2_quantile(0.5, x.shape[1]) * chi2_quantile(0.975, x.shape[1])]
    return within.mean(0), np.cov(within.T, bias=True)


def test_covariance_equals_the_best_of_all_subsets(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        x = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 2))
        x[:3] += 9
        best = min((x[list(s)] for s in itertools.combinations(range(12), 7)), key=lambda s: np.linalg.det(np.cov(s.T, bias=True)))
        mean, cov = reweighted(x, best.mean(0), np.cov(best.T, bias=True))
        got = outliers.robust_covariance(frame(spark, x), ["f0", "f1"])
        assert np.allclose(got.mean, mean) and np.allclose(got.cov, cov)


def test_covariance_over_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3)) @ np.diag([1, 2, 3])
    x[:700] = rng.normal(size=(700, 3)) * 0.3 + 15
    df = frame(spark, x)
    got = outliers.robust_covariance(df, ["f0", "f1", "f2"], starts=60, start_rows=300)
    h = (3000 + 3 + 1) // 2
    best = outliers._starts(x, h, 60, 5, np.random.default_rng(3))[0]  # the same on all rows in one place
    mean, cov = reweighted(x, best.mean, best.cov)
    assert np.allclose(got.mean, mean, atol=0.02) and np.allclose(got.cov, cov, rtol=0.03, atol=0.05)
    scored = outliers.outlier_scores(df, ["f0", "f1", "f2"], "rc", contamination=0.25).toPandas().sort_values("row_id")
    assert not scored.inlier[:700].any() and abs(1 - scored.inlier.mean() - 0.25) < 0.01


def capped(v, total):
    """The nearest point with 0 <= x <= 1 that sums to total."""
    low, high = v.min() - 1, v.max()
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if np.clip(v - t, 0, 1).sum() > total else (low, t)
    return np.clip(v - low, 0, 1)


def test_one_class_dual_against_projected_gradient(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(50, 2)), rng.normal(size=(6, 2)) + 5]
    for nu in (0.1, 0.5):
        kernel = outliers.rbf(x, x, 0.3)
        alpha, rho = outliers.smo(kernel, nu)
        a, steepest = capped(np.ones(len(x)), nu * len(x)), np.linalg.eigvalsh(kernel)[-1]
        for _ in range(3000):
            a = capped(a - kernel @ a / steepest, nu * len(x))
        assert alpha @ kernel @ alpha == pytest.approx(a @ kernel @ a, rel=1e-5)
        assert alpha.sum() == pytest.approx(nu * len(x)) and (kernel @ alpha < rho - 1e-3).mean() <= nu + 1e-9
        got = outliers.outlier_scores(frame(spark, x), ["f0", "f1"], "oc-svm", nu=nu, gamma=0.3).toPandas().sort_values("row_id")
        assert np.allclose(got.outlier_score, rho - kernel @ alpha, atol=2e-3)


def test_gradient_steps_reach_the_optimum_on_landmarks(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(900, 2)), rng.normal(size=(60, 2)) * 0.3 + 4]
    df = frame(spark, x)
    map_ = outliers.Landmarks.of(x[:40], 0.1)
    z = map_.lift(x)
    assert np.allclose(map_.lift(x[:40]) @ map_.lift(x[:40]).T, outliers.rbf(x[:40], x[:40], 0.1), atol=1e-6)
    alpha, rho = outliers.smo(z @ z.T, 0.2)  # the dual of the same problem
    best = z.T @ alpha / (0.2 * len(x))
    w, edge = outliers.descend(df.repartition(3), ["f0", "f1"], map_, 0.2)

    def loss(w, rho):
        return 0.1 * w @ w - 0.2 * rho + np.maximum(0, rho - z @ w).mean()

    assert loss(w, edge) - loss(best, rho / (0.2 * len(x))) < 0.02 * abs(loss(best, rho / (0.2 * len(x))))
    assert (z @ w < edge).mean() == pytest.approx(0.2, abs=0.01)


def test_methods_differ_and_handle_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(200, 2)), [[9.0, -9.0]]]
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0)], "row_id long, f0 double, f1 double"))
    seen = {}
    for m in outliers.METHODS:
        got = {r.row_id: r for r in outliers.outlier_scores(df, ["f0", "f1"], m, nu=0.1, contamination=0.05).collect()}
        assert len(got) == 203 and got[900].outlier_score is None and not got[900].inlier and not got[901].inlier and not got[200].inlier
        scores = [got[i].outlier_score for i in range(201)]
        assert max(scores) == scores[200] or m.startswith("oc")
        seen[m] = np.round(scores, 6).tolist()
        assert outliers.outlier_scores(df.filter("row_id > 899"), ["f0", "f1"], m).filter("inlier").count() == 0
    assert len({tuple(v) for v in seen.values()}) == 5
    with pytest.raises(ValueError, match="method"):
        outliers.outlier_scores(df, ["f0"], "svm")
    rep = df.select("row_id", F.array("f0", "f1", F.lit(1.0)).alias("pca"))
    got = {r.row_id: r.outlier_score for r in outliers.outlier_scores(rep, [], "if", use_rep="pca", n_pcs=2).collect()}
    assert np.round([got[i] for i in range(201)], 6).tolist() == seen["if"]


def brute_near(x, ids, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        order = sorted((d[j], ids[j]) for j in range(len(x)) if ids[j] != ids[i])[:k]
        out |= {(ids[i], o, rank + 1, round(float(dist), 9)) for rank, (dist, o) in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["clusters", "copies", "line", "few"])
def test_neighbours_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    x = {
        "clusters": rng.normal(size=(12, 3))[rng.integers(0, 12, 260)] * 20 + rng.normal(size=(260, 3)),
        "copies": np.r_[np.zeros((120, 3)), rng.integers(0, 3, (80, 3)).astype(float)],
        "line": np.c_[np.arange(150.0), np.zeros(150), np.zeros(150)],
        "few": rng.normal(size=(3, 3)),
    }[kind]
    df = frame(spark, x).select("row_id", F.array("f0", "f1", "f2").alias("v")).unionByName(spark.createDataFrame([(900, None), (901, [1.0, None, 2.0])], "row_id long, v array<double>"))
    got = neighbours.nearest(df, "row_id", F.col("v"), 5, block_rows=32, part_rows=16).collect()
    assert {(r.id, r.other, r["rank"], round(r.distance, 9)) for r in got} == brute_near(x, list(range(len(x))), 5)


def test_clustered_rows_visit_few_parts(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 1200)] * 30 + rng.normal(size=(1200, 8))
    df = frame(spark, x).select("row_id", F.array(*[f"f{j}" for j in range(8)]).alias("v"))
    rows, pivots = neighbours.parted(df, "row_id", F.col("v"), part_rows=30)
    near = neighbours._best(neighbours._met(rows.select("id", "v", "part"), rows.select("id", "v", "part"), 5, 8192), 5)
    n = neighbours.visits(rows, pivots, near.groupBy("id").agg(F.max("distance").alias("within"))).count()
    assert len(pivots) > 30 and n < 0.15 * 1200 * (len(pivots) - 1)


def test_thresholds_of_many_classes_equal_all_splits():
    rng = np.random.default_rng(9)
    for classes in (2, 3, 4, 5):
        n, c = rng.integers(0, 30, 14), np.arange(14) * 0.5
        p = n / n.sum()

        def between(cuts, p=p, c=c):
            edges = [0, *cuts, 14]
            return sum((p[a:z] @ c[a:z]) ** 2 / p[a:z].sum() if p[a:z].sum() > 0 else 0.0 for a, z in zip(edges[:-1], edges[1:], strict=True))

        best = max(between(s) for s in itertools.combinations(range(1, 14), classes - 1))
        got = threshold.multi_otsu(n, c, classes)
        assert len(got) == classes - 1 and between([int(g / 0.5) + 1 for g in got]) == pytest.approx(best)
    with pytest.raises(ValueError, match="two classes"):
        threshold.multi_otsu(n, c, 1)


def test_visits_leave_in_small_batches(spark, monkeypatch):
    """A row that visits every part has its vector copied for few visits at a time, and no neighbour is lost."""
    monkeypatch.setattr(neighbours, "STEP_VISITS", 64)
    x = np.random.default_rng(12).normal(size=(300, 10))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, v array<double>")
    rows, pivots = neighbours.parted(df, "row_id", F.col("v"), 16)
    frames = []

    class Caught:
        """Takes the function that mapInArrow is given."""

        def join(self, *_):
            return self

        select = join

        def mapInArrow(self, look, _):  # noqa: N802
            frames.append(look)

    class Rows(Caught):
        schema = rows.schema

        def groupBy(self, key):  # noqa: N802
            return rows.groupBy(key)

    neighbours.visits(Rows(), pivots, None)
    batch = rows.withColumn("within", F.lit(None).cast("double")).toArrow().combine_chunks().to_batches()[0]
    sizes = [b.num_rows for b in frames[0](iter([batch]))]
    assert max(sizes) <= 64 and sum(sizes) == 300 * (len(pivots) - 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r["rank"]): r.other for r in neighbours.nearest(df, "row_id", F.col("v"), 4, part_rows=16).collect()}
    assert all(got[i, k + 1] == j for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4]))
