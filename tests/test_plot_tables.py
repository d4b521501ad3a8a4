"""Densities, layouts, dendrogram orders, mixed-model lines and pipeline stages against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from phenogrid.functions.stats import ADJUSTMENTS, adjust
from phenogrid.operators import batch, estimators, features, models, plot_tables, scale


def test_density_is_near_the_sum_over_all_points(spark):
    rng = np.random.default_rng(1)
    parts = {"a": rng.normal(size=(400, 2)) @ np.array([[2, 1], [0, 0.5]]), "b": np.r_[rng.normal(size=(150, 2)), rng.normal(size=(50, 2)) * 0.3 + 6]}
    rows = [(i, g, float(p[0]), float(p[1])) for g, x in parts.items() for i, p in enumerate(x)]
    odd = [(1, "line", 1.0, 1.0), (2, "line", 2.0, 2.0), (3, "line", 3.0, 3.0), (4, "few", 0.0, 1.0), (5, None, 1.0, 1.0), (6, "a", None, 1.0)]
    df = spark.createDataFrame(rows + odd, "i long, g string, x double, y double")
    got = plot_tables.kernel_density(df, "x", "y", "g", 96).toPandas()
    assert len(got) == len(rows) + len(odd)
    for g, x in parts.items():
        cov = np.cov(x.T) * len(x) ** (-1 / 3)
        d = x[:, None] - x[None]
        want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)).sum(1) / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * len(x))
        mine = got[(got.g == g) & got.x.notna()].sort_values("i")
        assert np.abs(mine.density.to_numpy() - want).max() < 0.05 * want.max()
        assert mine.density_scaled.min() == 0 and mine.density_scaled.max() == 1 and np.corrcoef(mine.density_scaled, want)[0, 1] > 0.999
    assert got[got.g.isin(["line", "few"]) | got.g.isna() | got.x.isna()].density.isna().all()


def test_lineages_and_cycles(spark):
    edges = [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 4), (20, None), (21, 99), (30, 31), (31, 32), (32, 30), (33, 30)]
    df = spark.createDataFrame([(t, p, f) for t, p in edges for f in (t, t + 2)], "track long, parent long, frame long")
    got = {r.track: r for r in plot_tables.lineage_layout(df, "track", "parent", "frame").collect()}
    assert {k: (got[k].depth, got[k].position, got[k].leaves, got[k].root) for k in (1, 2, 3, 4, 5, 6, 7, 20, 21)} == {
        1: (0, 0.5, 4, 1), 2: (1, 0.0, 3, 1), 3: (1, 1.0, 1, 1), 4: (2, -0.25, 1, 1), 5: (2, 0.0, 1, 1), 6: (2, 0.25, 1, 1), 7: (3, -0.25, 1, 1), 20: (0, 0.5, 1, 20), 21: (0, 0.5, 1, 21),
    }
    assert {k for k, r in got.items() if r.cyclic} == {30, 31, 32, 33} and got[33].depth is None and (got[1].start, got[1].end) == (1, 3)


def test_traces_lie_on_the_principal_axis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) @ np.array([[3, 1], [0, 0.4]])
    df = spark.createDataFrame([("f", float(a), float(b), i) for i, (a, b) in enumerate(x)] + [("g", 1.0, 1.0, 99), ("f", None, 1.0, 100)], "f string, x double, y double, i long")
    got = {r.i: r.trace for r in plot_tables.trace_layout(df, ["f"], "x", "y").collect()}
    axis = np.linalg.svd(x - x.mean(0))[2][0]
    want = (x - x.mean(0)) @ (axis * np.sign(axis[np.abs(axis).argmax()]))
    assert np.allclose([got[i] for i in range(60)], want) and got[99] == 0 and got[100] is None


def test_dendrogram_order_reproduces_the_tree(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(12, 5)), rng.normal(size=(10, 5)) + 8, rng.normal(size=(9, 5)) - 8]
    merges = models.linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)))
    order = plot_tables.leaf_order(merges, len(x))
    assert sorted(order) == list(range(len(x)))
    members = {i: [i] for i in range(len(x))}
    place = {k: i for i, k in enumerate(order)}
    for k, (a, b, *_) in enumerate(merges):  # each cluster stands together, the first one to the left
        members[len(x) + k] = members[int(a)] + members[int(b)]
        spots = sorted(place[i] for i in members[len(x) + k])
        assert spots == list(range(spots[0], spots[0] + len(spots))) and max(place[i] for i in members[int(a)]) < min(place[i] for i in members[int(b)])
    df = spark.createDataFrame([(f"r{i:02d}", *map(float, r)) for i, r in enumerate(x)] + [("gone", None, 1.0, 1.0, 1.0, 1.0)], "row_id string, a double, b double, c double, d double, e double")
    rows, feats = plot_tables.clustermap_order(df, list("abcde"))
    assert [int(r.row_id[1:]) for r in rows.orderBy("position").collect()] == order and {r.feature for r in feats.collect()} == set("abcde")
    few, one = plot_tables.clustermap_order(df, ["a"], sample_size=1)
    assert few.count() == 1 and one.collect()[0].position == 0


def test_offsets_are_best_linear_predictions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for treat in ("ctrl", "t1"):
        for g in range(6):
            shift = [3, -2, 1, 0, -1, -1][g]
            for dose in (0.0, 1.0, 5.0) if treat == "t1" else (0.0,):
                rows += [(treat, dose, f"g{g}", float(2 + 0.7 * dose + shift + rng.normal(0, 0.5))) for _ in range(3 + g % 2)]
    df = spark.createDataFrame(rows + [("t1", 1.0, None, 1.0), ("t1", 1.0, "g1", None)], "treat string, dose double, rand string, y double")
    got = {r.group: r for r in models.lmem_lines(df, "y", "treat", "dose", "rand").collect()}
    table = pd.DataFrame(rows, columns=["treat", "dose", "rand", "y"])
    rank = table.dose.map({0.0: 0, 1.0: 1, 5.0: 2}).to_numpy(float)
    x, y = np.stack([rank, np.ones(len(rank))], 1), table.y.to_numpy()
    z = (table["rand"].to_numpy()[:, None] == np.unique(table["rand"])).astype(float)
    ratio = models.reml_fit(y, x, table["rand"].to_numpy()).ratio

    def loglik(r):  # restricted, with the whole covariance matrix
        v = np.eye(len(y)) + r * z @ z.T
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        beta = np.linalg.solve(a, x.T @ w @ y)
        rss = (y - x @ beta) @ w @ (y - x @ beta)
        return -0.5 * ((len(y) - 2) * np.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, r * z.T @ w @ (y - x @ beta)

    best, beta, offset = loglik(ratio)
    assert all(best >= loglik(ratio * f)[0] for f in (0.9, 1.1)) and ratio > 1
    for k, name in enumerate(np.unique(table["rand"])):
        assert (got[name].slope, got[name].intercept, got[name].offset) == pytest.approx((beta[0], beta[1], offset[k])) and got[name].n == (table["rand"] == name).sum()


def stages_frame(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"b{i % 2}", "ctrl" if i % 3 else "x", *map(float, rng.normal(size=3) * [1, 4, 2] + i % 2)) for i in range(90)]
    return spark.createDataFrame(rows, "row_id long, batch string, treatment string, p double, q double, r double")


def test_stages_are_fitted_saved_and_loaded(spark, tmp_path):
    df, feats = stages_frame(spark), ["p", "q", "r"]
    pipe = Pipeline(stages=[estimators.CORALAligner(features=feats), estimators.RobustMADScaler(features=feats, epsilon=1e-6), estimators.TVNWhitener(features=feats)])
    pipe.write().overwrite().save(f"{tmp_path}/pipe")
    fitted = Pipeline.load(f"{tmp_path}/pipe").fit(df)
    fitted.write().overwrite().save(f"{tmp_path}/model")
    a, b = (m.transform(df).orderBy("row_id").select(*feats).toPandas().to_numpy() for m in (fitted, PipelineModel.load(f"{tmp_path}/model")))
    one = batch.CORAL(feats, "batch", "treatment").fit(df).transform(df)
    two = scale.RobustMAD(feats, 1e-6).fit(one).transform(one)
    three = batch.TVN(feats, "treatment").fit(two).transform(two).orderBy("row_id").select(*feats).toPandas().to_numpy()
    assert np.array_equal(a, b) and np.allclose(a, three)


def test_every_adjustment_of_ranked_features(spark):
    df = stages_frame(spark)
    for method in ADJUSTMENTS:
        got = features.rank_features(df, ["p", "q", "r"], "treatment", corr_method=method).collect()
        for g in {r.grp for r in got}:
            own = [r for r in got if r.grp == g]
            assert [r.p_adjusted for r in own] == pytest.approx(adjust(np.array([r.p for r in own]), method).tolist())
    with pytest.raises(ValueError, match="corr_method"):
        features.rank_features(df, ["p"], "treatment", corr_method="none")
