"""Fixture queries of models, tracking, simulation and pipelines, and the flagship."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phenogrid.operators import group, hmm, models, outliers, simulate, tracking
from phenogrid.plans import pipelines
from phenogrid.plans.fixtures import CELLS, DIRTY, FEATS, TRACKS, cells, dirty, r6, read, rounded, tracks
from phenogrid.profile import Profile

QUERIES, SQL = {}, {}
_BY = ["batch", "plate"]


def _flagship(s, d):
    out = pipelines.plate_profiles(Profile(dirty(s, d), FEATS), _BY, "well", "treatment", "ctrl", 80)
    return rounded(out.df, *FEATS)


QUERIES["flagship_plate_profile"] = _flagship
_MADQ = ", ".join(f"({f} - quantile_cont({f}, 0.5) FILTER (WHERE treatment = 'ctrl') OVER w) / nullif(1.482602218505602 * mad({f}) FILTER (WHERE treatment = 'ctrl') OVER w, 0) AS {f}" for f in FEATS)
SQL["flagship_plate_profile"] = f"""WITH {DIRTY}, c AS (SELECT * FROM dirty WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL), n AS (SELECT batch, plate, well, {_MADQ} FROM c WINDOW w AS (PARTITION BY batch, plate))
SELECT batch, plate, well, count(*) AS "Metadata_Cellnumber", {', '.join(r6(f'quantile_cont({f}, 0.5)') + f' AS {f}' for f in FEATS)} FROM n GROUP BY batch, plate, well HAVING count(*) >= 80"""


def _pipeline_clean(s, d):
    df = dirty(s, d).withColumns({"copy": F.col("l_extendedprice"), "constant": F.lit(1.0), "flag": (F.col("line") > 6).cast("double")})
    p = pipelines.clean_data(Profile(df, [*FEATS, "copy", "constant", "flag"]), 0.9, 0.3, 0.00001)
    return p.df.select("row_id", *p.features)


QUERIES["pipeline_clean"] = _pipeline_clean
SQL["pipeline_clean"] = f"""WITH {DIRTY}, c AS (SELECT *, (line > 6)::DOUBLE AS flag FROM dirty WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL)
SELECT min(row_id) AS row_id, l_quantity, l_extendedprice, l_discount, l_tax FROM (SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, flag FROM c) GROUP BY l_quantity, l_extendedprice, l_discount, l_tax, flag"""


def _wells(s, d):
    df = group.aggregate(cells(s, d), ["batch", "well"], FEATS, "mean", row_id="row_id")
    return df.withColumns({"row_id": F.concat_ws("-", "batch", F.lpad(F.col("well").cast("string"), 4, "0")), "treat": F.when(F.col("well") % 3 == 0, "ctrl").otherwise(F.concat(F.lit("t"), F.col("well") % 3)), "dose": (F.floor(F.col("well") / 3) % 5).cast("double"), "l_tax": F.col("l_tax") + F.when(F.col("well") % 3 == 1, (F.floor(F.col("well") / 3) % 5) * 0.01).otherwise(0.0)})


QUERIES["lmem"] = lambda s, d: rounded(models.feature_lmem(_wells(s, d), FEATS, "treat", "dose", "batch", intercept=True), "p_min", "r2_mean", "r2_std")
QUERIES["feature_agglo"] = lambda s, d: rounded(models.feature_agglo(_wells(s, d).withColumns({"a": F.col("l_quantity") * 1.01, "b": F.col("l_tax") + 0.001}), [*FEATS, "a", "b"], 3)[0].select("row_id", "agglo_0", "agglo_1", "agglo_2"), "agglo_0", "agglo_1", "agglo_2")
SQL["feature_agglo"] = f"""WITH {CELLS}, w AS (SELECT batch, well, avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS di, avg(l_tax) + CASE WHEN well % 3 = 1 THEN well // 3 % 5 * 0.01 ELSE 0 END AS t FROM cells GROUP BY batch, well)
SELECT batch || '-' || lpad(well::VARCHAR, 4, '0') AS row_id, {r6('(q + q * 1.01) / 2')} AS agglo_0, {r6('e')} AS agglo_1, {r6('(di + t + t + 0.001) / 3')} AS agglo_2 FROM w"""
QUERIES["estimate_k"] = lambda s, d: s.createDataFrame([(models.estimate_k(models.feature_distances(_wells(s, d).withColumns({f"{f}_{i}": F.col(f) * (1 + i / 100) for f in FEATS for i in range(3)}), [f"{f}_{i}" for f in FEATS for i in range(3)]), (2, 8)),)], "k int")
QUERIES["svm_rfe"] = lambda s, d: models.svm_rfe(_wells(s, d), FEATS, "treat", 2)
for _m in ("if", "rc", "lof", "oc-svm"):
    QUERIES[f"outliers_{_m.replace('-', '_')}"] = lambda s, d, m=_m: outliers.outlier_scores(_wells(s, d), FEATS, m).select("row_id", F.round("outlier_score", 6).alias("outlier_score"), "inlier")


# every well among all wells: 20 neighbours, reachability, densities
SQL["outliers_lof"] = f"""WITH {CELLS}, w AS (SELECT batch || '-' || lpad(well::VARCHAR, 4, '0') AS id, avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c, avg(l_tax) + CASE WHEN well % 3 = 1 THEN well // 3 % 5 * 0.01 ELSE 0 END AS e FROM cells GROUP BY batch, well),
nn AS (SELECT p.id, q.id AS other, sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2) + pow(p.e - q.e, 2)) AS d FROM w p JOIN w q ON p.id <> q.id QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, q.id) <= 20),
k AS (SELECT id AS other, max(d) AS kth FROM nn GROUP BY id), dn AS (SELECT id, 1 / greatest(avg(greatest(d, kth)), 1e-12) AS density FROM nn JOIN k USING (other) GROUP BY id),
s AS (SELECT nn.id, avg(o.density) / any_value(m.density) AS lof FROM nn JOIN dn o ON nn.other = o.id JOIN dn m ON nn.id = m.id GROUP BY nn.id) SELECT id AS row_id, {r6('lof')} AS outlier_score, lof <= 1.5 AS inlier FROM s"""


def _series(s, d):
    """Mean courses of 24 groups of tracks, over all frames."""
    return tracks(s, d).groupBy((F.col("track") % 24).alias("track"), "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


QUERIES["dtw_matrix"] = lambda s, d: rounded(models.dtw_pairs(_series(s, d), ["track"], "frame", ["x", "y"]), "distance")
QUERIES["dtw_matrix_independent"] = lambda s, d: rounded(models.dtw_pairs(_series(s, d), ["track"], "frame", ["x", "y"], "independent"), "distance")
QUERIES["linkage_tree"] = lambda s, d: models.linkage_tree(models.dtw_pairs(_series(s, d), ["track"], "frame", ["x", "y"]))
QUERIES["fate_walks"] = lambda s, d: models.fate_cluster(read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", row_id="vec_id")


def _hidden(s, d):
    return tracks(s, d).select("event_id", "track", "frame", F.array((F.col("x") + F.when(F.col("state") == "click", 300.0).otherwise(0.0)) / 100, F.col("y") / 50).alias("rep"))


QUERIES["hmm_states"] = lambda s, d: hmm.fit_hmm(_hidden(s, d), [2, 3], "track", "frame", "rep", "event_id")[0]
QUERIES["hmm_by_key"] = lambda s, d: hmm.fit_hmm_by_key(_hidden(s, d).withColumn("key", F.col("track") % 2), "key", 2, "track", "frame", "rep", "event_id", n_init=1)[0]
QUERIES["hmm_distance"] = lambda s, d: hmm.hmm_distance(_hidden(s, d), hmm.fit_hmm_by_key(_hidden(s, d).withColumn("key", F.col("track") % 2), "key", 2, "track", "frame", "rep", "event_id", n_init=1)[1])


def _flow(s, d):
    rows = tracks(s, d).filter("frame in (0, 1)").groupBy("frame", "state").count().collect()
    states = sorted({r.state for r in rows})
    n = {(r.frame, r.state): r["count"] for r in rows}
    a, b = (np.array([n.get((f, x), 0) for x in states], float) for f in (0, 1))
    cost = np.abs(np.arange(len(states))[:, None] - np.arange(len(states))[None]).astype(float)
    flow = models.transport(a / a.sum(), b / b.sum(), cost)
    return s.createDataFrame([(x, y, float(round(flow[i, j], 9))) for i, x in enumerate(states) for j, y in enumerate(states)], "source string, target string, flow double")


QUERIES["state_transport"] = _flow
QUERIES["state_flows"] = lambda s, d: rounded(models.state_flows(tracks(s, d).withColumn("rep", F.array("x", "y")), "state", "frame", "rep"), "flow", "cost")
QUERIES["bayes_track"] = lambda s, d: tracking.track(tracks(s, d).select("event_id", (F.col("track") % 10).alias("field"), (F.col("frame") % 40).alias("t"), "x", "y"), "t", ["field"], "x", "y", "event_id", division_radius=20.0)
for _m in ("rw", "brw", "levy", "fbm"):
    QUERIES[f"simulate_{_m}"] = lambda s, d, m=_m: simulate.motion(s, 50, m, alpha=2.5)
QUERIES["simulate_markov"] = lambda s, d: simulate.markov_chain(s, 50, 4)
QUERIES["simulate_ndarma"] = lambda s, d: simulate.ndarma(s, 50, 4, ma_order=1)
QUERIES["simulate_hmm"] = lambda s, d: simulate.hidden_markov(s, 50, 3)


def _recipe(s, d):
    df = cells(s, d).withColumns({"area": F.col("l_extendedprice") / 1000 + 5, "nucleus": F.col("l_quantity") + 20, "dna": F.col("l_tax") * 100 + F.col("line"), "dose": F.col("line").cast("double")})
    df = df.withColumn("treatment", F.when(F.col("well") % 4 == 0, "ctrl").otherwise(F.concat(F.lit("t"), F.col("well") % 4))).withColumn("dose", (F.floor(F.col("well") / 4) % 5).cast("double"))
    p = pipelines.profile_recipe(Profile(df, [*FEATS, "area", "nucleus", "dna"]), _BY, "well", "treatment", "dose", "area", "nucleus", "dna", "l_extendedprice", min_cells=20)
    return p.df.select("batch", "plate", "well", "Cycle", *p.features)


QUERIES["pipeline_recipe"] = _recipe
