"""Golden values, independent numpy versions and properties."""

import math
import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions import stats
from phenogrid.operators import batch, clean, evaluate, group, hmm, models, motility, outliers, scale, simulate, threshold, timeseries, tracking
from phenogrid.profile import Profile
from phenogrid.sources import plates


def test_bleaching_golden(spark):
    df = spark.createDataFrame([(i, "ctrl", float(i), 20.0 / 2**i) for i in range(5)], "row_id long, treat string, t double, DNA double")
    out, curves = batch.correct_bleaching(df, ["DNA"], None, "treat", "t")
    assert [round(r.DNA, 5) for r in out.orderBy("t").collect()] == [20.0] * 5
    assert curves.agg(F.min("r2")).first()[0] > 0.999999


def test_select_by_group_golden(spark):
    df = spark.createDataFrame([(i, i // 3, i % 3) for i in range(9)], "row_id long, t long, dose long")
    assert [r.row_id for r in clean.select_by_group(df, "dose", "t", "max").orderBy("row_id").collect()] == [2, 5, 8]


def test_state_distribution_golden(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 1, 0, 1, 0, 0, 1, 1, 1], strict=True)), "time long, state long")
    got = {(r.time, r.state): r.share for r in timeseries.state_distribution(df, "time", "state").collect()}
    assert got[0, 1] == pytest.approx(1 / 3) and got[1, 0] == pytest.approx(2 / 3) and got[2, 0] == 0 and got[2, 1] == 1


def test_log_golden(spark):
    x = [0.7252543, 0.50132436, 0.95608366, 0.6439902, 0.42385504]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "row_id long, f double")
    got = [r.f for r in scale.transform(df, ["f"], "log").orderBy("row_id").collect()]
    assert got == pytest.approx([-0.321233, -0.690502, -0.044910, -0.440072, -0.858364], abs=1e-5)


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "row_id long, f double")
    assert [r.f for r in X.ingest(df, ["f"]).orderBy("row_id").collect()] == [None, None, 1.0]


def test_otsu_golden(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(2, 0.1, 5), rng.normal(0, 0.1, 5)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, f double")
    assert [r.c for r in threshold.assign_by_threshold(df, "f", new_var="c").orderBy("row_id").collect()] == [1] * 5 + [0] * 5


def test_quantile_transform_is_uniform(spark):
    df = spark.createDataFrame([(i, float(i) ** 2) for i in range(201)], "row_id long, f double")
    got = np.array([r.f for r in scale.transform_quantile(df, ["f"], 101).orderBy("row_id").collect()])
    assert np.abs(got - np.linspace(0, 1, 201)).max() < 0.01


def test_tvn_whitens_controls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + 5
    df = spark.createDataFrame([(i, "ctrl", *map(float, r)) for i, r in enumerate(x)], "row_id long, treat string, a double, b double, c double")
    y = np.array([list(r) for r in batch.TVN(["a", "b", "c"], "treat", epsilon=0).fit(df).transform(df).select("a", "b", "c").collect()])
    assert np.allclose(np.cov(y.T, bias=True), np.eye(3), atol=1e-6) and np.allclose(y.mean(0), 0, atol=1e-8)


def test_coral_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) * [1, 3]
    b = np.arange(60) % 2
    df = spark.createDataFrame([(i, int(b[i]), "ctrl", *map(float, r)) for i, r in enumerate(x)], "row_id long, batch long, treat string, a double, b double")
    got = np.array([list(r) for r in batch.CORAL(["a", "b"], "batch", "treat").fit(df).transform(df).orderBy("row_id").select("a", "b").collect()])

    def root(m, p):
        w, v = np.linalg.eigh(m)
        return (v * w**p) @ v.T

    want = np.empty_like(x)
    for k in (0, 1):
        want[b == k] = x[b == k] @ root(np.cov(x[b == k].T) + np.eye(2), -0.5) @ root(np.cov(x.T) + np.eye(2), 0.5)
    assert np.allclose(got, want)


def test_polish_residuals_have_zero_medians():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 12)) + np.arange(8)[:, None] * 2 + np.arange(12)[None]
    res = batch.median_polish(x, 50)[3]
    assert np.abs(np.median(res, axis=0)).max() < 1e-6 and np.abs(np.median(res, axis=1)).max() < 0.05


def test_normalised_controls_have_mean_zero_and_deviation_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, i % 2, "ctrl" if i % 3 else "t", float(v)) for i, v in enumerate(rng.normal(7, 3, 300))], "row_id long, p long, treat string, f double")
    r = scale.normalize(df, ["f"], ["p"], "standard", "treat", "ctrl").filter("treat = 'ctrl'").groupBy("p").agg(F.avg("f").alias("m"), F.stddev_pop("f").alias("s")).collect()
    assert all(abs(x.m) < 1e-9 and abs(x.s - 1) < 1e-9 for x in r)


def test_dedup_is_idempotent_and_sampling_is_a_share(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), "w%d" % (i % 5)) for i in range(500)], "row_id long, a double, b double, well string")
    once = clean.drop_duplicate_rows(df, ["a", "b"])
    assert once.count() == 21 == clean.drop_duplicate_rows(once, ["a", "b"]).count()
    assert group.subsample(df, ["well"], 0.15).count() == 75


def test_similarity_blocks_cover_every_pair(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i, "a", [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, g string, v array<double>")
    got = {(r.a, r.b): r.sim for r in evaluate.similarity(df, ["g"], F.col("v")).collect()}
    want = np.corrcoef(x)
    assert len(got) == 435 and all(abs(s - want[i, j]) < 1e-9 for (i, j), s in got.items())


def test_linkage_and_cut():
    x = np.array([0, 0.1, 5, 5.1, 20.0])
    d = np.abs(x[:, None] - x[None])
    m = models.linkage(d)
    assert list(models.cut(m, 5, 3)) == [0, 0, 1, 1, 2] and m[0, 2] == pytest.approx(0.1)
    assert models.estimate_k(d, (2, 5), 2) == 3


def test_dtw_by_definition():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(7, 2)), rng.normal(size=(9, 2))
    d = np.full((8, 10), np.inf)
    d[0, 0] = 0
    for i in range(7):
        for j in range(9):
            d[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(d[i, j], d[i, j + 1], d[i + 1, j])
    assert models.dtw(a, b) == pytest.approx(d[7, 9] ** 0.5) and models.dtw(a, a) == 0


def test_reml_finds_the_slope():
    rng = np.random.default_rng(7)
    g = np.repeat(np.arange(6), 10)
    x = np.tile(np.arange(5.0), 12)
    y = 0.8 * x + rng.normal(size=6)[g] + rng.normal(0, 0.3, 60)
    p, r2 = models.reml_random_intercept(y, np.stack([x, np.ones(60)], 1), g)
    assert p < 1e-6 and 0.2 < r2 < 1
    assert models.reml_random_intercept(np.ones(5), np.ones((5, 1)), np.zeros(5)) == (1.0, 0.0)


def test_transport_meets_demand_at_least_cost():
    cost = np.array([[0.0, 1, 2], [1, 0, 1], [2, 1, 0]])
    flow = models.transport(np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.3, 0.5]), cost)
    assert np.allclose(flow.sum(0), [0.2, 0.3, 0.5]) and (flow * cost).sum() == pytest.approx(0.6)
    with pytest.raises(ValueError):
        models.transport(np.array([0.1]), np.array([0.2]), np.ones((1, 1)))


def test_student_p_and_adjust():
    assert stats.t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803, abs=1e-7)
    assert np.allclose(stats.adjust(np.array([0.01, 0.02, 0.03, 0.5]), "fdr_bh"), [0.04, 0.04, 0.04, 0.5])


def test_erf_in_sql(spark):
    z = [-2.0, -0.5, 0.0, 1.3]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(X.phi(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(v / 2**0.5)) for v in z], abs=2e-7)


def test_motility_of_a_straight_line():
    m = motility.path_measures(np.stack([np.arange(40.0) ** 1.1, 2 * np.arange(40.0) ** 1.1], 1), 1, None, 3, 10, False)
    assert m["DirectionalityRatio"] == pytest.approx(1) and m["Linearity"] == pytest.approx(1) and m["AvgTurnAngle"] == pytest.approx(0, abs=1e-3) and m["MSDalpha"] > 1.9


def test_hidden_states_are_found(spark):
    sim = simulate.hidden_markov(spark, 12, 2, t=np.array([[0.95, 0.05], [0.05, 0.95]]), e=np.eye(2), length=60, seed=3)
    df = sim.select(F.concat_ws("-", "track", "time").alias("row_id"), "track", "time", "hidden", F.array(F.col("hidden") * 4.0 + F.sin(F.col("time") * 12.9 + F.col("track"))).alias("rep")).cache()
    states, model = hmm.fit_hmm(df, 2, "track", "time", "rep", n_init=1, rounds=6)
    same = states.join(df, "row_id").agg(F.avg((F.col("HMMState") == F.col("hidden")).cast("double"))).first()[0]
    assert same > 0.98 and model.stationary().sum() == pytest.approx(1)


def test_tracker_follows_simulated_motion(spark):
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for tr in range(5):
        p, v = np.array([tr * 150.0, 50.0]), rng.normal(0, 6, 2)
        for t in range(20):
            rows.append((k, "f", t, float(p[0]), float(p[1]), tr))
            p, k = p + v + rng.normal(0, 0.5, 2), k + 1
    df = spark.createDataFrame(rows, "row_id long, field string, t long, x double, y double, truth long")
    got = tracking.track(df, "t", ["field"], "x", "y", max_search_radius=40).join(df, "row_id")
    pairs = {(r.track, r.truth) for r in got.collect()}
    assert len(pairs) == 5


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(9)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.uniform(size=(n, m))
        best = min(sum(c[i, j] for i, j in zip(rows, cols, strict=True)) for rows in [range(min(n, m))] if n <= m for cols in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in enumerate(rows)) for rows in itertools.permutations(range(n), m))
        assert sum(c[i, j] for i, j in tracking.assign(c)) == pytest.approx(best)


def test_plates_are_read_from_text(spark, tmp_path):
    for batch_name, plate in (("b1", "p1"), ("b2", "p1")):
        d = tmp_path / "in" / batch_name / plate
        d.mkdir(parents=True)
        for name in ("Cells", "Cytoplasm"):
            pd.DataFrame({"ImageNumber": [1, 1], "ObjectNumber": [1, 2], "Metadata_Well": ["B02", "B03"], "AreaShape_Area": [1.5, 2.5]}).to_csv(d / f"{name}.csv", index=False)
    layout = tmp_path / "layout.csv"
    pd.DataFrame({"well": ["B2", "B3"], "Treatment": ["ctrl", "x"]}).to_csv(layout, index=False)
    p = plates.load_plates(spark, str(tmp_path / "in"), ["Cells", "Cytoplasm"], layout=str(layout))
    assert sorted(p.features) == ["Cells_AreaShape_Area", "Cytoplasm_AreaShape_Area"] and p.df.count() == 4
    assert {r.BatchNumber for r in p.df.collect()} == {1, 2} and {r.Metadata_Treatment for r in p.df.collect()} == {"ctrl", "x"}
    plates.write_profile(p, str(tmp_path / "store"), ["BatchNumber"])
    back = plates.read_profile(spark, str(tmp_path / "store"))
    assert back.features == p.features and back.df.count() == 4
    with pytest.raises(ValueError):
        plates.read_objects(spark, str(layout))


def test_parent_chain_and_profile():
    assert plates.parent_chain({"A": ["B"], "B": ["C", "A"], "C": []}) == ["A", "B", "C"]
    assert Profile.__dataclass_params__.frozen


def test_stream_counts_equal_batch(spark, tmp_path):
    from phenogrid.streaming.quality import running_counts

    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "w%d" % (m % 2), float(m)) for h in range(4) for m in range(0, 60, 10)]
    df = spark.createDataFrame(rows, "ts string, well string, f double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = running_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["well"], ["f"], "ts").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 24


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_modz_in_blocks_equals_all_pairs(spark, monkeypatch, method):
    monkeypatch.setattr(group, "PAIR_ROWS", 7)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 5)), 1)
    x[3] = 2.0  # without spread: correlates with none
    df = spark.createDataFrame([(i, i % 2 if i else 5, *map(float, x[i])) for i in range(60)], "row_id long, g long, " + ", ".join(f"f{i} double" for i in range(5)))
    got = {r.g: list(r)[1:] for r in group.aggregate_modz(df, ["g"], [f"f{i}" for i in range(5)], method).collect()}
    assert got.pop(5) == pytest.approx(x[0])  # a row alone
    b = pd.DataFrame(x).rank(axis=1).to_numpy() if method == "spearman" else x
    for g in (0, 1):
        rows = [i for i in range(1, 60) if i % 2 == g]
        r = np.nan_to_num([[0.0 if i == j or 3 in (i, j) else np.corrcoef(b[i], b[j])[0, 1] for j in rows] for i in rows])
        w = np.maximum(np.maximum(r, 0).sum(1) / (len(rows) - 1), 0.01)
        assert got[g] == pytest.approx(w @ x[rows] / w.sum())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_modz_query_weighs_every_customer(spark, method):
    from phenogrid import registry

    d = "/root/testdata/sf0.001"
    got = {r.g: list(r)[1:] for r in registry.QUERIES[f"aggregate_modz_{method}"](spark, d).select("g", "f0", "f1", "f2", "f3").collect()}
    region = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{d}/nation.parquet").collect()}
    rows = [(region[r.c_nationkey], [r.c_acctbal, r.c_nationkey * 100.0, float(len(r.c_name)), r.c_custkey % 97 * 20.0]) for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    for g in {k for k, _ in rows}:
        x = np.array([v for k, v in rows if k == g])
        r = np.corrcoef(pd.DataFrame(x).rank(axis=1).to_numpy() if method == "spearman" else x)
        np.fill_diagonal(r, 0)
        w = np.maximum(np.maximum(r, 0).sum(1) / (len(x) - 1), 0.01)
        assert got[g] == pytest.approx(w @ x / w.sum(), abs=1e-5)


@pytest.mark.parametrize("wide", [0, 1024])
def test_pair_sums_equal_the_pairs(spark, monkeypatch, wide):
    """By blocks of rows, and by sums of labels without pairs."""
    for name, value in (("PAIR_ROWS", 9), ("MOST_WIDE", wide), ("LABEL_ROWS", 3), ("HELD_NUMBERS", 80)):
        monkeypatch.setattr(evaluate, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, "ctrl" if i % 3 == 0 else f"t{i % 2}", i % 2, [1.0] * 6 if i == 4 else rng.normal(size=6).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, g long, treat string, conc long, v array<double>")
    for method in ("pearson", "spearman"):
        pairs, sums = (f(df, ["g", "treat", "conc"], F.col("v"), method) for f in (evaluate.similarity, evaluate.pair_sums))
        for of in (lambda p: evaluate.reproducibility(p, ["g"]), lambda p: evaluate.effect(p, "treat"), lambda p: evaluate.effect(p, "treat", ["conc"])):
            one, two = (of(p).toPandas() for p in (pairs, sums))
            keys = list(one.columns[:-3])
            pd.testing.assert_frame_equal(one.sort_values(keys).reset_index(drop=True), two.sort_values(keys).reset_index(drop=True))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_evaluation_takes_all_vectors_whole(spark):
    from phenogrid import registry

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    r = np.corrcoef(x)
    up = np.triu(np.ones(r.shape, bool), 1)
    same = label[:, None] == label[None]
    null = r[up & ~same]
    got = {g.label: (g.mean_sim, g.z) for g in registry.QUERIES["reproducibility_z"](spark, d).collect()}
    assert set(got) == set(label.tolist())
    for g, (mean, z) in got.items():
        want = r[up & same & (label == g)[:, None]].mean()
        assert mean == pytest.approx(want, abs=2e-6) and z == pytest.approx((want - null.mean()) / null.std(ddof=1), abs=2e-5)
    assert registry.QUERIES["dist_mahalanobis"](spark, d).count() == len(rows) * (len(rows) - 1) // 2
    assert {g.label for g in registry.QUERIES["eval_percentiles"](spark, d).collect()} == set(label.tolist())


def test_batch_tools_run_one_after_another(spark, tmp_path):
    from phenogrid import __main__ as tools
    from phenogrid.profile import Profile
    from phenogrid.sources import plates

    rng = np.random.default_rng(5)
    rows = [(f"r{i:03}", 1 + i % 2, 1, f"w{i % 6}", "ctrl" if i % 6 < 2 else "t", int(i % 4) + 1, *map(float, rng.normal(size=3)), float(rng.uniform(0, 100)), float(rng.uniform(0, 100)), i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id string, BatchNumber int, PlateNumber int, well string, treat string, Metadata_Field int, a double, b double, c double, Cells_Location_Center_X double, Cells_Location_Center_Y double, Metadata_Timepoint int")
    p = Profile(df.withColumn("twin", F.col("a")), ["a", "b", "c", "twin"])
    at = lambda n: str(tmp_path / n)
    plates.write_profile(p, at("start"))
    tools.main(["collect", at("start"), at("start"), at("twice")], spark)
    assert plates.read_profile(spark, at("twice")).df.count() == 240
    for argv in (
        ["clean", at("start"), at("clean"), "--freq-thresh", "0"],
        ["normalize", at("clean"), at("normal"), "--method", "mad_robust", "--pop-var", "treat", "--norm-pop", "ctrl"],
        ["subsample", at("normal"), at("half"), "--perc", "0.5"],
        ["aggregate", at("normal"), at("wells"), "--by", "BatchNumber", "PlateNumber", "well", "--min-cells", "5"],
        ["pseudostitch", at("normal"), at("stitched"), "--grid", "2", "2", "--image", "100", "100"],
        ["track", at("normal"), at("tracks")],
        ["split", at("normal"), at("train"), "--test-size", "0.25"],
    ):
        tools.main(argv, spark)
    got = {n: plates.read_profile(spark, at(n)) for n in ("clean", "half", "wells", "stitched", "tracks", "train", "train-test")}
    assert got["clean"].features == ["a", "b", "c"] and got["half"].df.count() == 60
    assert got["wells"].df.count() == 6 and 0 < got["stitched"].df.count() < 120 and "track" in got["tracks"].df.columns
    assert (got["train"].df.count(), got["train-test"].df.count()) == (90, 30)


def test_adjustments():
    from phenogrid.functions.stats import adjust

    p = np.array([0.01, 0.04, 0.03, 0.005])
    want = {"bonferroni": [0.04, 0.16, 0.12, 0.02], "sidak": 1 - (1 - p) ** 4, "holm": [0.03, 0.06, 0.06, 0.02], "simes-hochberg": [0.03, 0.04, 0.04, 0.02], "fdr_bh": [0.02, 0.04, 0.04, 0.02], "fdr_by": np.array([0.02, 0.04, 0.04, 0.02]) * (1 + 1 / 2 + 1 / 3 + 1 / 4)}
    for method, value in want.items():
        assert adjust(p, method) == pytest.approx(np.asarray(value)), method
    with pytest.raises(ValueError):
        adjust(p, "other")


def test_correlations_of_many_features_have_one_rule(spark):
    """A feature that misses a value has no correlation, with few features as with many."""
    from phenogrid.operators import features

    rng = np.random.default_rng(6)
    for d in (5, 130):
        x = rng.normal(size=(80, d))
        x[:, 2] = 1.5
        rows = [(i, *[None if (i, j) == (3, 0) else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
        df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"f{j} double" for j in range(d))).repartition(3)
        for method in ("pearson", "spearman") if d == 5 else ("pearson",):
            got = {(r.i, r.j): r.r for r in features.correlation_pairs(df, [f"f{j}" for j in range(d)], method).collect()}
            want = np.corrcoef((pd.DataFrame(x).rank().to_numpy() if method == "spearman" else x)[:, [1, 3, 4]].T)
            assert all(got[k] is None for k in got if 0 in k or 2 in k) and [got[1, 3], got[1, 4], got[3, 4]] == pytest.approx([want[0, 1], want[0, 2], want[1, 2]])


def test_local_outlier_factor_equals_brute_force(spark):
    from phenogrid.operators import models

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(3, 3)) + 9])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, None, 0.0, 0.0)], "row_id long, a double, b double, c double")
    got = {r.row_id: r for r in outliers.outlier_scores(df, ["a", "b", "c"], "lof", neighbours=5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    kth = np.take_along_axis(d, near, 1)[:, -1]
    dens = 1 / np.maximum(np.take_along_axis(d, near, 1), kth[near]).mean(1)
    assert [got[i].outlier_score for i in range(63)] == pytest.approx((dens[near].mean(1) / dens).tolist())
    assert got[99].outlier_score is None and not got[99].inlier and not got[62].inlier


def test_mixture_emissions_and_silhouette(spark):
    from phenogrid.operators import hmm

    rng = np.random.default_rng(8)
    rows, truth = [], []
    for t in range(12):
        s = 0
        for f in range(40):
            s = 1 - s if rng.random() < 0.1 else s
            centre = (-6 if rng.random() < 0.5 else -3) if s == 0 else (3 if rng.random() < 0.5 else 6)
            rows.append((t * 40 + f, t, f, [float(centre + rng.normal() * 0.3), float(rng.normal())]))
            truth.append(s)
    df = spark.createDataFrame(rows, "row_id long, track long, frame long, rep array<double>")
    states, model = hmm.fit_hmm(df, [2, 3], "track", "frame", "rep", select_by="silhouette", n_init=1, rounds=6, mixtures=2)
    got = {r.row_id: r.HMMState for r in states.collect()}
    assert model.k == 2 and model.mixtures == 2 and np.mean([got[i] == s for i, s in enumerate(truth)]) > 0.97
    with pytest.raises(ValueError):
        hmm.fit_hmm(df, 2, "track", "frame", "rep", select_by="other")


def test_one_call_scores_groups_of_tiles_and_representation(spark):
    from phenogrid.operators import batch, scale, summaries

    rng = np.random.default_rng(9)
    rows = [(i, i % 4, "ctrl" if i % 4 == 0 else f"t{i % 4}", [float(x) for x in rng.normal(size=5)]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, g long, treat string, v array<double>")
    repro, eff = evaluate.repro_effect(df, ["g"], "treat", F.col("v"))
    pairs = evaluate.similarity(df, ["g", "treat"], F.col("v"))
    assert {r.g: round(r.z, 9) for r in repro.collect()} == {r.g: round(r.z, 9) for r in evaluate.reproducibility(pairs, ["g"]).collect()}
    assert {r.treat: round(r.z, 9) for r in eff.collect()} == {r.treat: round(r.z, 9) for r in evaluate.effect(pairs, "treat").collect()}
    tiles = spark.createDataFrame([(1, "a", 1, 90.0, 5.0), (2, "a", 2, 5.0, 5.0), (3, "b", 2, 5.0, 5.0)], "row_id long, well string, tile int, x double, y double")
    assert {r.row_id for r in batch.pseudostitch(tiles, "tile", "x", "y", (2, 2), (100, 100)).collect()} == {1}
    kept = {r.row_id: r.x for r in batch.pseudostitch(tiles, "tile", "x", "y", (2, 2), (100, 100), by=["well"], update_loc=False).collect()}
    assert kept == {1: 90.0, 3: 5.0}
    wide = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(20)], "row_id long, a double, b double, c double")
    assert summaries.choose_representation(wide, ["a", "b", "c"], None, 0)[1] == "X"
    out, name = summaries.choose_representation(wide, ["a", "b", "c"], None, 2)
    assert name == "X_pca" and len(out.first()[name]) == 2
    fitted = scale.RobustMAD(["a", "b"]).fit(wide)
    x = wide.toPandas()["a"]
    assert fitted.transform(wide).toPandas()["a"].to_numpy() == pytest.approx(((x - x.median()) / (1.482602218505602 * (x - x.median()).abs().median())).to_numpy())


def test_flows_between_states_are_cheapest(spark):
    """Two and three states against enumeration of the vertices; unequal frames as shares; missing values take no part."""
    rng = np.random.default_rng(41)
    rows = [(i, t, str(rng.choice(list("abc"))), [float(x) for x in rng.normal(size=2)]) for t in (0, 1, 2, 5) for i in range(20 + t)] + [(99, 0, None, [0.0, 0.0]), (98, 1, "a", None), (97, None, "b", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, t long, state string, rep array<double>")
    got = models.state_flows(df, "state", "t", "rep").toPandas()
    good = [r for r in rows if r[1] is not None and r[2] is not None]
    mean = {s: np.mean([r[3] for r in good if r[2] == s and r[3] is not None], axis=0) for s in "abc"}
    assert sorted(set(zip(got.time, got.next, strict=True))) == [(0, 1), (1, 2), (2, 5)]
    for t, after in ((0, 1), (1, 2), (2, 5)):
        share = [{s: np.mean([r[2] == s for r in good if r[1] == u]) for s in "abc"} for u in (t, after)]
        part = got[got.time == t]
        for s in "abc":
            assert part[part.source == s].flow.sum() == pytest.approx(share[0][s]) and part[part.target == s].flow.sum() == pytest.approx(share[1][s])
        cost = {(a, b): np.linalg.norm(mean[a] - mean[b]) for a in "abc" for b in "abc"}
        best = np.inf
        for base in itertools.combinations([(a, b) for a in "abc" for b in "abc"], 5):  # a vertex of the polytope has five flows at most
            m = np.array([[float(c[0] == s) for c in base] for s in "abc"] + [[float(c[1] == s) for c in base] for s in "abc"])
            want = np.array([share[0][s] for s in "abc"] + [share[1][s] for s in "abc"])
            x = np.linalg.lstsq(m, want, rcond=None)[0]
            if (x > -1e-9).all() and np.allclose(m @ x, want):
                best = min(best, sum(cost[c] * v for c, v in zip(base, x, strict=True)))
        assert sum(cost[r.source, r.target] * r.flow for r in part.itertuples()) == pytest.approx(best)


def test_models_of_all_keys_equal_those_of_one_key_after_the_other(spark):
    sim = simulate.hidden_markov(spark, 14, 2, t=np.array([[0.9, 0.1], [0.1, 0.9]]), e=np.eye(2), length=30, seed=5)
    df = sim.select(F.concat_ws("-", "track", "time").alias("row_id"), "track", "time", F.array(F.col("hidden") * 3.0 + F.sin(F.col("time") * 12.9 + F.col("track"))).alias("rep"), F.when(F.col("track") == 13, None).otherwise(F.concat(F.lit("k"), F.col("track") % 2)).alias("key")).cache()
    states, fitted = hmm.fit_hmm_by_key(df, "key", 2, "track", "time", "rep", n_init=1, rounds=4, sample_size=5)
    _, shared = hmm.fit_hmm(df, 2, "track", "time", "rep", n_init=1, rounds=4, sample_size=5)
    got = {r.row_id: (r.key, r.HMMState) for r in states.collect()}
    assert set(fitted) == {"k0", "k1"} and len(got) == 13 * 30
    for k in fitted:
        part, one = hmm.fit_hmm(df.filter(F.col("key") == k), 2, "track", "time", "rep", n_init=1, rounds=4, sample_size=5, start=shared)
        assert np.allclose(fitted[k].trans, one.trans) and np.allclose(fitted[k].means, one.means) and np.allclose(fitted[k].start, one.start)
        assert {i: s for i, (key, s) in got.items() if key == k} == {r.row_id: r.HMMState for r in part.collect()}


def test_equal_means_tie(spark):
    """Rows of one group in two orders: sums of fractions differ in their last digits, equal means must not."""
    values = [(7 * i % 11) / 100 for i in range(40)]
    assert len({np.cumsum(np.random.default_rng(g).permutation(values))[-1] for g in range(40)}) > 1
    made = [(g, v) for g in range(40) for v in np.random.default_rng(g).permutation(values).tolist()] + [(40, 1 / 3), (40, 2 / 3), (41, None), (42, 1e300), (42, 1e300)]
    df = spark.createDataFrame(made, "g long, f double").repartition(7)
    got = {r.g: r.f for r in group.aggregate(df, ["g"], ["f"], "mean", row_id="g").collect()}
    assert {got[g] for g in range(40)} == {sum(7 * i % 11 for i in range(40)) / 4000}
    assert got[40] == pytest.approx(0.5) and got[41] is None and got[42] is not None


def test_similarity_copies_rows_once_a_block(spark, monkeypatch):
    """Rows are shuffled once and travel in their block's bytes: as many packed rows as blocks, whatever the rows, and every pair once."""
    monkeypatch.setattr(evaluate, "PACK_ROWS", 40)
    monkeypatch.setattr(evaluate, "SLICE_PAIRS", 300)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 12)).astype(np.float32).astype(float)
    x[7] = x[90]  # copies: no distance
    df = spark.createDataFrame([(i, f"g{i % 3}", r.tolist()) for i, r in enumerate(x)] + [(150, "g0", None)], "row_id long, g string, v array<double>")
    packed = evaluate._packed(df.select(F.col("row_id").alias("id"), F.col("v")), [], 5, None)
    assert packed.count() == 5
    for method in ("euclidean", "cityblock", "kendall", "spearman", "mahalanobis"):
        got = {(r.a, r.b): r for r in evaluate.similarity(df if method != "mahalanobis" else df.filter("v is not null"), ["g"], F.col("v"), method, block_rows=30).collect()}
        assert all(a < b and r.g_a == f"g{a % 3}" and r.g_b == f"g{b % 3}" for (a, b), r in got.items())
        n = 150 if method == "mahalanobis" else 151
        assert len(got) == n * (n - 1) // 2
        i, j = np.triu_indices(150, 1)
        if method == "kendall":
            s = evaluate._signs(x)
            want = (s @ s.T)[i, j] / np.sqrt((np.abs(s).sum(1)[:, None] * np.abs(s).sum(1))[i, j])
        elif method == "spearman":
            want = np.corrcoef(evaluate._ranked(x))[i, j]
        elif method == "mahalanobis":
            d = x[i] - x[j]
            want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T)), d))
        else:
            want = np.abs(x[i] - x[j]).sum(1) if method == "cityblock" else np.sqrt(((x[i] - x[j]) ** 2).sum(1))
        assert np.allclose([got[a, b].sim for a, b in zip(i.tolist(), j.tolist(), strict=True)], want, atol=1e-9)
        if method == "euclidean":
            assert got[7, 90].sim == 0 and got[0, 150].sim is None


def test_mad_holds_no_group_of_values(spark, capsys):
    """Exact medians and MADs of groups of any size, without an exact percentile, whose buffer holds every distinct value of a group."""
    rng = np.random.default_rng(8)
    made = pd.DataFrame({"row_id": np.arange(6007), "g": np.r_[np.zeros(6001, int), [1, 1, 2, 2, 2, 3]], "a": np.r_[rng.normal(size=6001), [1.0, 4.0, 5.0, 5.0, 9.0, np.nan]], "b": rng.integers(0, 3, 6007).astype(float)})
    df = spark.createDataFrame([(int(r.row_id), int(r.g), None if np.isnan(r.a) else float(r.a), float(r.b)) for r in made.itertuples()], "row_id long, g long, a double, b double").repartition(5)
    out = scale.normalize(df, ["a", "b"], ["g"], "mad_robust", eps=1.0)
    out.explain()
    assert "percentile(" not in capsys.readouterr().out
    got = out.toPandas().set_index("row_id").sort_index()
    for f in "ab":
        med = made.groupby("g")[f].transform("median")
        mad = (made[f] - med).abs().groupby(made["g"]).transform("median")
        assert np.allclose(got[f].astype(float), (made[f] - med) / (mad * X.MAD_SCALE + 1), equal_nan=True)
    whole = scale.normalize(df, ["b"], [], "mad_robust", eps=1.0).toPandas().set_index("row_id").sort_index()
    assert np.allclose(whole["b"], (made["b"] - made["b"].median()) / ((made["b"] - made["b"].median()).abs().median() * X.MAD_SCALE + 1))


def test_spearman_ranks_do_not_move_rows(spark, monkeypatch):
    """Ranks of few distinct values are held by tasks, those of many are joined by value; both are exact, and no row is taken apart into one for each feature."""
    from phenogrid.operators import features

    rng = np.random.default_rng(9)
    x = pd.DataFrame({"a": rng.integers(0, 5, 400).astype(float), "b": rng.normal(size=400), "c": rng.integers(0, 90, 400).astype(float)})
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x.to_numpy())], "row_id long, a double, b double, c double")
    want = x.rank().corr().to_numpy()
    for held in (10_000, 120, 0):
        monkeypatch.setattr(features, "HELD_VALUES", held)
        assert np.allclose(features.correlation_matrix(df, ["a", "b", "c"], "spearman"), want)
        if held == 10_000:
            plan = features.ranked(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Generate" not in plan


def test_no_features_left(spark):
    """A recipe whose selection keeps no feature goes on: no row misses a feature."""
    df = spark.createDataFrame([(1, None), (2, 1.0)], "row_id long, f double")
    assert clean.drop_missing_rows(df, []).count() == 2 and scale.normalize(df, ["f"]).count() == 2
