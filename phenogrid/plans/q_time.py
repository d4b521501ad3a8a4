"""Fixture queries of time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.operators import motility, timeseries
from phenogrid.plans.fixtures import TRACKS, r6, read, rounded, tracks

QUERIES, SQL = {}, {}

for _m, _a in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min")):
    QUERIES[f"ts_aggregate_{_m}"] = lambda s, d, m=_m: rounded(timeseries.ts_aggregate(tracks(s, d), ["x", "y"], "track", "frame", m, fpu=2), "x", "y")
    SQL[f"ts_aggregate_{_m}"] = f"""WITH {TRACKS}, k AS (SELECT track, x - lag(x, 2) OVER w AS dx, y - lag(y, 2) OVER w AS dy FROM tracks WINDOW w AS (PARTITION BY track ORDER BY frame)) SELECT track, count(*) AS "Length", {r6(f'{_a}(dx)')} AS x, {r6(f'{_a}(dy)')} AS y FROM k GROUP BY track HAVING count(*) >= 30"""
QUERIES["ts_aggregate_diff"] = lambda s, d: rounded(timeseries.ts_aggregate(tracks(s, d), ["x", "y"], "track", "frame", "diff"), "x", "y")
SQL["ts_aggregate_diff"] = f"""WITH {TRACKS} SELECT track, count(*) AS "Length", {r6('arg_max(x, frame) - arg_min(x, frame)')} AS x, {r6('arg_max(y, frame) - arg_min(y, frame)')} AS y FROM tracks GROUP BY track HAVING count(*) >= 30"""
QUERIES["ts_aggregate_callable"] = lambda s, d: rounded(timeseries.ts_aggregate(tracks(s, d), ["x", "y"], "track", "frame", lambda v, fpu=1: v.max(0) - v.min(0)), "x", "y")
SQL["ts_aggregate_callable"] = f"""WITH {TRACKS} SELECT track, count(*) AS "Length", {r6('max(x) - min(x)')} AS x, {r6('max(y) - min(y)')} AS y FROM tracks GROUP BY track HAVING count(*) >= 30"""


def _families(s, d):
    return tracks(s, d).select("event_id", "track", "frame", (F.col("track") % 12).alias("root"), F.floor(F.col("track") / 12).alias("gen"), ((F.col("track") % 12) + F.floor(F.col("track") / 24) * 12).alias("parent"))


QUERIES["proliferation_rank"] = lambda s, d: timeseries.proliferation(_families(s, d), "root", "track")
SQL["proliferation_rank"] = "SELECT user_id % 12 AS root, count(DISTINCT user_id) AS n FROM events GROUP BY ALL"
QUERIES["proliferation_rank_gen"] = lambda s, d: timeseries.proliferation(_families(s, d), "root", "track", "gen", "gen", clip=0.5)
SQL["proliferation_rank_gen"] = "SELECT user_id % 12 AS root, max(user_id // 12) AS n FROM events GROUP BY ALL ORDER BY n DESC, root LIMIT 6"
QUERIES["state_distribution"] = lambda s, d: rounded(timeseries.state_distribution(tracks(s, d), "frame", "state"), "share")
SQL["state_distribution"] = f"WITH {TRACKS}, c AS (SELECT frame, state, count(*) AS n FROM tracks GROUP BY ALL), t AS (SELECT frame, sum(n) AS t FROM c GROUP BY frame), s AS (SELECT DISTINCT state FROM c) SELECT t.frame, s.state, {r6('coalesce(n, 0) / t')} AS share FROM t CROSS JOIN s LEFT JOIN c ON c.frame = t.frame AND c.state = s.state"
QUERIES["state_centroids"] = lambda s, d: rounded(timeseries.centroids(read(s, d, "embeddings"), ["label"], "embedding", "median"), "value")
SQL["state_centroids"] = f"SELECT label, CAST(i AS INTEGER) AS dim, {r6('quantile_cont(x, 0.5)')} AS value FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL"
QUERIES["state_distances"] = lambda s, d: rounded(timeseries.state_distances(read(s, d, "embeddings"), "label", "embedding"), "distance")
SQL["state_distances"] = f"WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS v FROM e GROUP BY ALL) SELECT a.label AS a, b.label AS b, {r6('sqrt(sum(pow(a.v - b.v, 2)))')} AS distance FROM c a JOIN c b USING (i) GROUP BY ALL"


def _field(s, d):
    return tracks(s, d).select("event_id", (F.col("track") % 10).alias("field"), (F.col("frame") % 40).alias("t"), "x", "y")


_FIELD = f"{TRACKS}, fld AS (SELECT event_id, track % 10 AS field, frame % 40 AS t, x, y FROM tracks), rk AS (SELECT *, dense_rank() OVER (PARTITION BY field ORDER BY t) AS f FROM fld)"
_PARENT = "par AS (SELECT event_id, parent FROM (SELECT a.event_id, b.event_id AS parent, row_number() OVER (PARTITION BY a.event_id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.event_id) AS rn FROM rk a LEFT JOIN rk b ON a.field = b.field AND b.f = a.f - 1) WHERE rn = 1)"
QUERIES["track_nn_parents"] = lambda s, d: timeseries.nearest_parents(_field(s, d), "t", ["field"], "x", "y", "event_id").fillna(-1, ["parent"])
SQL["track_nn_parents"] = f"WITH {_FIELD}, {_PARENT} SELECT event_id, coalesce(parent, -1) AS parent FROM par"
QUERIES["track_nn"] = lambda s, d: timeseries.track_nn(_field(s, d), "t", ["field"], "x", "y", "event_id").fillna(-1, ["parent"])
SQL["track_nn"] = f"WITH RECURSIVE {_FIELD}, {_PARENT}, up AS (SELECT event_id, parent, event_id AS tree FROM par WHERE parent IS NULL UNION ALL SELECT p.event_id, p.parent, u.tree FROM par p JOIN up u ON p.parent = u.event_id) SELECT event_id, coalesce(parent, -1) AS parent, tree FROM up"
QUERIES["lineage_edges"] = lambda s, d: timeseries.lineage_edges(_families(s, d), "track", "parent", "frame")
SQL["lineage_edges"] = f"WITH {TRACKS}, p AS (SELECT track, min(frame) AS st, max(frame) AS en, track % 12 + track // 24 * 12 AS par FROM tracks GROUP BY ALL) SELECT b.track AS parent, a.track AS child, b.en AS parent_end, a.st AS child_start FROM p a JOIN p b ON a.par = b.track WHERE a.par <> a.track"


def _trees(s, d):
    return read(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 40).alias("tree"), (F.floor(F.col("vec_id") / 40) + (F.col("vec_id") % 40 % 7 == 3).cast("long")).alias("t"), F.col("embedding").cast("array<double>").alias("rep"))  # some trees start later: gaps in the grid


_TREES = "tr AS (SELECT vec_id, vec_id % 40 AS tree, vec_id // 40 + CASE WHEN vec_id % 40 % 7 = 3 THEN 1 ELSE 0 END AS t, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS rep FROM embeddings), g AS (SELECT a.tree, b.t FROM (SELECT DISTINCT tree FROM tr) a CROSS JOIN (SELECT DISTINCT t FROM tr) b), f AS (SELECT g.tree, g.t, coalesce(rep, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS v FROM g LEFT JOIN tr USING (tree, t))"


def _flat(df, rep):
    """A whole vector as its first component, sum and sum of squares."""
    total = lambda f: F.aggregate(rep, F.lit(0.0), lambda acc, x: acc + f(x))
    return rounded(df.withColumns({"v0": F.get(rep, F.lit(0)), "v1": total(lambda x: x), "v2": total(lambda x: x * x)}).drop(rep), "v0", "v1", "v2")


_flat_sql = lambda v: f"{r6(f'{v}[1]')} AS v0, {r6(f'list_sum({v})')} AS v1, {r6(f'list_sum(list_transform({v}, lambda x: x * x))')} AS v2"
_V3 = _flat_sql("v")
_STEP = "list_transform(range(1, 65), lambda i: coalesce(b[i] - a[i], 0))"
QUERIES["to_grid"] = lambda s, d: _flat(timeseries.to_grid(_trees(s, d), "tree", "t", "rep"), "vec")
SQL["to_grid"] = f"WITH {_TREES} SELECT tree, t, {_V3} FROM f"
QUERIES["make_3d_round_trip"] = lambda s, d: _flat(timeseries.from_3d(timeseries.make_3d(_trees(s, d), "tree", "t", "rep"), "tree", [r[0] for r in _trees(s, d).select("t").distinct().orderBy("t").collect()], "t"), "vec")
SQL["make_3d_round_trip"] = SQL["to_grid"]
QUERIES["tree_labels"] = lambda s, d: timeseries.tree_labels(_trees(s, d).withColumn("y", F.col("vec_id") % 20), "tree", "y")
SQL["tree_labels"] = f"WITH {_TREES} SELECT tree, min(vec_id % 20) AS y, count(DISTINCT vec_id % 20) = 1 AS consistent FROM tr GROUP BY tree"
QUERIES["vectorize_embedding"] = lambda s, d: _flat(timeseries.vectorize(_trees(s, d), "tree", "t", "rep").select("vec_id", "X_vect"), "X_vect")
SQL["vectorize_embedding"] = f"WITH {_TREES}, m AS (SELECT tree, t, v AS a, lead(v) OVER (PARTITION BY tree ORDER BY t) AS b FROM f) SELECT vec_id, {_flat_sql('w')} FROM (SELECT vec_id, {_STEP} AS w FROM tr JOIN m USING (tree, t))"
QUERIES["js_distance"] = lambda s, d: rounded(timeseries.jensen_shannon(tracks(s, d).groupBy((F.col("track") % 30).alias("track"), "state").agg(F.count(F.lit(1)).alias("n")), "track", "state", "n"), "distance", digits=5)
SQL["js_distance"] = f"""WITH {TRACKS}, n AS (SELECT track % 30 AS track, state, count(*) AS n FROM tracks GROUP BY ALL), p AS (SELECT track, state, n / sum(n) OVER (PARTITION BY track) AS p FROM n),
f AS (SELECT k.track, s.state, coalesce(p, 0) AS p FROM (SELECT DISTINCT track FROM p) k CROSS JOIN (SELECT DISTINCT state FROM p) s LEFT JOIN p ON p.track = k.track AND p.state = s.state)
SELECT a.track AS a, b.track AS b, {r6('sqrt(greatest(0, sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p * 2 / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * ln(b.p * 2 / (a.p + b.p)) ELSE 0 END) / 2))', 5)} AS distance FROM f a JOIN f b ON a.state = b.state AND a.track < b.track GROUP BY ALL"""
_NODES = [[*n, *[0.0] * 61] for n in ([0.1, 0.0, 0.0], [-0.1, 0.0, 0.0], [0.0, 0.1, 0.1], [0.0, -0.1, -0.1])]
QUERIES["velocity_field"] = lambda s, d: rounded(timeseries.velocity_field(timeseries.vectorize(_trees(s, d), "tree", "t", "rep"), "rep", "X_vect", _NODES, 5), "value")
SQL["velocity_field"] = f"""WITH {_TREES}, m AS (SELECT tree, t, v AS a, lead(v) OVER (PARTITION BY tree ORDER BY t) AS b FROM f), w AS (SELECT vec_id, rep, {_STEP} AS u FROM tr JOIN m USING (tree, t)),
nd AS (SELECT node, list_concat(c3, list_transform(range(61), lambda x: 0.0::DOUBLE)) AS c FROM (VALUES (0, [0.1, 0.0, 0.0]::DOUBLE[]), (1, [-0.1, 0.0, 0.0]::DOUBLE[]), (2, [0.0, 0.1, 0.1]::DOUBLE[]), (3, [0.0, -0.1, -0.1]::DOUBLE[])) x(node, c3)),
q AS (SELECT vec_id, u, node FROM w CROSS JOIN nd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(rep, c), node) = 1), k AS (SELECT node, count(*) AS n FROM q GROUP BY node HAVING count(*) > 5)
SELECT node, n, CAST(i - 1 AS INTEGER) AS dim, {r6('avg(x)')} AS value FROM (SELECT node, unnest(range(1, 65)) AS i, unnest(u) AS x FROM q) JOIN k USING (node) GROUP BY ALL"""

# -- motility -------------------------------------------------------------------------------------------------------------

_P = f"""{TRACKS}, st AS (SELECT track, frame, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, count(*) OVER (PARTITION BY track) AS n FROM tracks WINDOW w AS (PARTITION BY track ORDER BY frame)),
dd AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM st WHERE n >= 30)"""
_MOT = {
    "basic": (["Length", "AccumDisplacement", "DisplacementFromOrigin", "DirectionalityRatio", "GyrationRadius", "AvgSpeed", "StdSpeed", "MedianSpeed", "MADSpeed", "MinSpeed", "MaxSpeed"],
              """SELECT track, any_value(n) AS "Length", sum(d) AS "AccumDisplacement", sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) AS "DisplacementFromOrigin", "DisplacementFromOrigin" / "AccumDisplacement" AS "DirectionalityRatio", sqrt(var_pop(x) + var_pop(y)) AS "GyrationRadius",
              avg(d) AS "AvgSpeed", stddev_pop(d) AS "StdSpeed", quantile_cont(d, 0.5) AS "MedianSpeed", mad(d) AS "MADSpeed", min(d) AS "MinSpeed", max(d) AS "MaxSpeed" FROM dd GROUP BY track"""),
    "shape": (["Linearity", "Monotonicity", "NonGaussAlpha2", "AvgDisplacement", "StdDisplacement", "SkewDisplacement", "DisplacementKurtosis_1"],
              """SELECT track, abs(corr(x, y)) AS "Linearity", abs(corr(rx, ry)) AS "Monotonicity", avg(pow(d, 4)) / (3 * pow(avg(d * d), 2)) - 1 AS "NonGaussAlpha2", avg(d) AS "AvgDisplacement", stddev_pop(d) AS "StdDisplacement", skewness(d) AS "SkewDisplacement", kurtosis_pop(d) AS "DisplacementKurtosis_1"
              FROM (SELECT *, rank() OVER (PARTITION BY track ORDER BY x) + (count(*) OVER (PARTITION BY track, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY track ORDER BY y) + (count(*) OVER (PARTITION BY track, y) - 1) / 2.0 AS ry FROM dd) GROUP BY track"""),
    "memory": (["MSDalpha", "DisplacementAC_1", "DisplacementAC_4", "VelocityAC_1", "AvgTurnAngle"],
               """SELECT a.track, "MSDalpha", "DisplacementAC_1", "DisplacementAC_4", "VelocityAC_1", "AvgTurnAngle" FROM
               (SELECT track, regr_slope(ln(m), ln(tau)) AS "MSDalpha" FROM (SELECT a.track, b.frame - a.frame AS tau, avg(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS m FROM dd a JOIN dd b ON a.track = b.track AND b.frame > a.frame GROUP BY ALL) GROUP BY track) a
               JOIN (SELECT track, sum((d - m) * (d1 - m)) / count(d1) / any_value(v) AS "DisplacementAC_1", sum((d - m) * (d4 - m)) / count(d4) / any_value(v) AS "DisplacementAC_4" FROM (SELECT track, d, lead(d) OVER w AS d1, lead(d, 4) OVER w AS d4, avg(d) OVER (PARTITION BY track) AS m, var_pop(d) OVER (PARTITION BY track) AS v FROM dd WINDOW w AS (PARTITION BY track ORDER BY frame)) GROUP BY track) b USING (track)
               JOIN (SELECT track, avg(dx * ex + dy * ey) / avg(dx * dx + dy * dy) AS "VelocityAC_1", avg(CASE WHEN d * e > 0 THEN acos(greatest(-1, least(1, (dx * ex + dy * ey) / (d * e)))) END) * 180 / pi() AS "AvgTurnAngle" FROM (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, lead(d) OVER w AS e FROM dd WINDOW w AS (PARTITION BY track ORDER BY frame)) GROUP BY track) c USING (track)"""),
}
for _k, (_cols, _sql) in _MOT.items():
    QUERIES[f"motility_{_k}"] = lambda s, d, c=_cols: rounded(motility.motility(tracks(s, d), "track", "frame", ["x", "y"]).select("track", *c), *c, digits=5)
    SQL[f"motility_{_k}"] = f"WITH {_P}, m AS ({_sql}) SELECT track, {', '.join(f'{r6(chr(34) + c + chr(34), 5)} AS {chr(34)}{c}{chr(34)}' for c in _cols)} FROM m"
_PH = ["ActiveRatio", "AvgActiveSpeed", "AvgIdlingSpeed", "StdActiveSpeed", "StdIdlingSpeed", "AvgActiveTurnAngle", "AvgIdlingTurnAngle", "Hurst"]
QUERIES["motility_phases"] = lambda s, d: rounded(motility.motility(tracks(s, d), "track", "frame", ["x", "y"]).select("track", *_PH), *_PH, digits=5)
QUERIES["motility_embedding"] = lambda s, d: rounded(motility.motility(tracks(s, d).withColumn("z", F.col("x") * F.col("y") % 7), "track", "frame", ["x", "y", "z"], fpu=2).select("track", "AvgSpeed", "Linearity", "Monotonicity", "AvgTurnAngle"), "AvgSpeed", "Linearity", "Monotonicity", "AvgTurnAngle", digits=5)

_ST = f"""{TRACKS}, sn AS (SELECT track, frame, state, count(*) OVER (PARTITION BY track) AS n FROM tracks), al AS (SELECT DISTINCT state FROM tracks), tk AS (SELECT DISTINCT track, n FROM sn WHERE n >= 30),
mg AS (SELECT tk.track, al.state, count(sn.frame) / any_value(tk.n) AS p FROM tk CROSS JOIN al LEFT JOIN sn ON sn.track = tk.track AND sn.state = al.state GROUP BY tk.track, al.state)"""
_SC = ["Entropy", "Gini", "Chebycheff", "DwellTime_click", "TransitionProb"]
QUERIES["state_motility"] = lambda s, d: rounded(motility.state_motility(tracks(s, d), "track", "frame", "state").select("track", "Length", "Entropy", "Gini", "Chebycheff", "TransitionProb"), "Entropy", "Gini", "Chebycheff", "TransitionProb")
SQL["state_motility"] = f"""WITH {_ST}, a AS (SELECT track, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*)) AS e, count(*) / (count(*) - 1.0) * (1 - sum(p * p)) AS g, count(*) / (count(*) - 1.0) * (1 - max(p)) AS c FROM mg GROUP BY track),
t AS (SELECT track, avg((state <> nx)::INT) AS t FROM (SELECT track, state, lead(state) OVER (PARTITION BY track ORDER BY frame) AS nx FROM sn) WHERE nx IS NOT NULL GROUP BY track)
SELECT tk.track, CAST(n AS INTEGER) AS "Length", {r6('e')} AS "Entropy", {r6('g')} AS "Gini", {r6('c')} AS "Chebycheff", {r6('t')} AS "TransitionProb" FROM tk JOIN a USING (track) JOIN t USING (track)"""
_DEP = ["CohenKappa_2", "CramerVi_2", "Sakoda_2", "GKTau_2", "GKLambda_2", "Uncertainty_2", "TotalCorr_2"]
QUERIES["state_dependence"] = lambda s, d: rounded(motility.state_motility(tracks(s, d), "track", "frame", "state").select("track", *_DEP), *_DEP)
SQL["state_dependence"] = f"""WITH {_ST}, pr AS (SELECT track, state AS i, nx AS j, count(*) AS c, sum(count(*)) OVER (PARTITION BY track) AS t FROM (SELECT track, state, lead(state, 2) OVER (PARTITION BY track ORDER BY frame) AS nx FROM sn) WHERE nx IS NOT NULL GROUP BY track, state, nx),
g AS (SELECT a.track, a.state AS i, b.state AS j, a.p AS pi, b.p AS pj, coalesce(c / t, 0) AS q FROM mg a JOIN mg b USING (track) LEFT JOIN pr ON pr.track = a.track AND pr.i = a.state AND pr.j = b.state),
s AS (SELECT track, sum(p * p) AS sq, max(p) AS tp, sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS en, count(*) AS m FROM mg GROUP BY track),
x AS (SELECT track, sum(CASE WHEN i = j THEN q - pi * pi ELSE 0 END) AS dg, sum(coalesce(pow(q - pi * pj, 2) / nullif(pi * pj, 0), 0)) AS ph, sum(coalesce(q * q / nullif(pj, 0), 0)) AS gk, sum(CASE WHEN q > 0 THEN q * ln(q / (pi * pj)) ELSE 0 END) AS inf, avg(pow(q - pi * pj, 2) / nullif(pi * (1 - pi) * pj * (1 - pj), 0)) AS tc FROM g GROUP BY track),
l AS (SELECT track, sum(mx) AS pk FROM (SELECT track, j, max(q) AS mx FROM g GROUP BY ALL) GROUP BY track)
SELECT track, {r6('dg / (1 - sq)')} AS "CohenKappa_2", {r6('sqrt(ph / (m - 1))')} AS "CramerVi_2", {r6('sqrt(m * ph / ((m - 1) * (1 + ph)))')} AS "Sakoda_2", {r6('(gk - sq) / (1 - sq)')} AS "GKTau_2", {r6('(pk - tp) / (1 - tp)')} AS "GKLambda_2", {r6('-inf / en')} AS "Uncertainty_2", {r6('tc')} AS "TotalCorr_2" FROM s JOIN x USING (track) JOIN l USING (track)"""
QUERIES["state_stationary"] = lambda s, d: motility.state_motility(tracks(s, d), "track", "frame", "state").drop("Length")
