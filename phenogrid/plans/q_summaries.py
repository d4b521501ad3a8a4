"""Fixture queries of plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.ml import Pipeline

from phenogrid.operators import estimators, models, plot_tables, summaries
from phenogrid.plans.q_eval import _AXES, _FIRST, _PAIR, _SECOND, _TWO, _two
from phenogrid.plans.fixtures import CELLS, FEATS, TRACKS, cells, r6, read, rounded, tracks
from phenogrid.plans.q_models import _wells

QUERIES, SQL = {}, {}


def _pca(s, d):
    df = cells(s, d).withColumn("l_extendedprice", F.col("l_extendedprice") / 10000)
    return summaries.pca(df, FEATS)[1].agg(F.round(F.sum("variance"), 5).alias("total"), F.round(F.max("cumulative"), 5).alias("cumulative"))


QUERIES["pca_variance"] = _pca
SQL["pca_variance"] = f"WITH {CELLS} SELECT round(var_samp(l_quantity) + var_samp(l_extendedprice / 10000) + var_samp(l_discount) + var_samp(l_tax), 5) AS total, 100.0::DOUBLE AS cumulative FROM cells"
QUERIES["pca_scores"] = lambda s, d: rounded(summaries.pca(cells(s, d), FEATS, 2)[0].select("row_id", F.get("X_pca", F.lit(0)).alias("pc1"), F.get("X_pca", F.lit(1)).alias("pc2")), "pc1", "pc2", digits=3)
QUERIES["pca_pair"] = lambda s, d: rounded(summaries.pca(_two(s, d), _TWO)[0].select("row_id", F.get("X_pca", F.lit(0)).alias("pc1"), F.get("X_pca", F.lit(1)).alias("pc2")), "pc1", "pc2", digits=5)
SQL["pca_pair"] = f"WITH {_PAIR}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM two), e AS (SELECT *, {_AXES} FROM m) SELECT row_id, {r6(_FIRST, 5)} AS pc1, {r6(_SECOND, 5)} AS pc2 FROM two, e"
QUERIES["pca_components_pair"] = lambda s, d: rounded(summaries.pca(_two(s, d), _TWO)[1], "variance", "percent", "cumulative")
SQL["pca_components_pair"] = f"WITH {_PAIR}, m AS (SELECT 0 AS mx, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM two), e AS (SELECT *, {_AXES} FROM m) SELECT CAST(1 AS INTEGER) AS component, {r6('l1')} AS variance, {r6('100 * l1 / (l1 + l2)')} AS percent, {r6('100 * l1 / (l1 + l2)')} AS cumulative FROM e UNION ALL SELECT 2, {r6('l2')}, {r6('100 * l2 / (l1 + l2)')}, 100.0 FROM e"
QUERIES["time_summary"] = lambda s, d: rounded(summaries.time_summary(tracks(s, d), "frame", ["x", "y"], ["state"]), "x", "x_std", "y", "y_std", digits=9)
SQL["time_summary"] = f"WITH {TRACKS} SELECT frame, state, {r6('avg(x)', 9)} AS x, {r6('stddev_samp(x)', 9)} AS x_std, {r6('avg(y)', 9)} AS y, {r6('stddev_samp(y)', 9)} AS y_std FROM tracks GROUP BY ALL"
QUERIES["time_heatmap"] = lambda s, d: rounded(summaries.time_heatmap(tracks(s, d), "frame", [0, 1, 2], ["x", "y"]), "0", "1", "2")
SQL["time_heatmap"] = f"""WITH {TRACKS}, l AS (SELECT frame, 'x' AS feature, x AS v FROM tracks UNION ALL SELECT frame, 'y', y FROM tracks) SELECT feature, {', '.join(f'{r6(f"avg(v) FILTER (WHERE frame = {t})")} AS "{t}"' for t in range(3))} FROM l GROUP BY feature"""
_B = ["low", "q1", "median", "q3", "high", "mean", "whisker_low", "whisker_high"]
QUERIES["box_summary"] = lambda s, d: rounded(summaries.box_summary(cells(s, d), ["plate"], ["l_quantity", "l_extendedprice"]), *_B)
SQL["box_summary"] = f"""WITH {CELLS}, l AS (SELECT plate, 'l_quantity' AS feature, l_quantity AS v FROM cells UNION ALL SELECT plate, 'l_extendedprice', l_extendedprice FROM cells), q AS (SELECT plate, feature, count(*) AS n, min(v) AS low, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS high, avg(v) AS mean FROM l GROUP BY ALL),
w AS (SELECT plate, feature, min(v) AS whisker_low, max(v) AS whisker_high FROM l JOIN q USING (plate, feature) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL) SELECT plate, feature, n, {', '.join(f'{r6(c)} AS {c}' for c in _B)} FROM q JOIN w USING (plate, feature)"""
QUERIES["volcano"] = lambda s, d: rounded(summaries.volcano(cells(s, d).select("row_id", (F.col("l_quantity") / 10 - 2.5).alias("logfc"), (F.col("l_tax") + 0.01).alias("p_adjusted"))), "logfc", "p_adjusted", "neg_log_p")
SQL["volcano"] = f"WITH {CELLS}, v AS (SELECT row_id, l_quantity / 10 - 2.5 AS logfc, l_tax + 0.01 AS p_adjusted FROM cells) SELECT row_id, {r6('logfc')} AS logfc, {r6('p_adjusted')} AS p_adjusted, {r6('-log10(p_adjusted)')} AS neg_log_p, CASE WHEN p_adjusted <= 0.05 AND logfc >= 1 THEN 'up' WHEN p_adjusted <= 0.05 AND logfc <= -1 THEN 'down' ELSE 'ns' END AS cls FROM v"
QUERIES["state_graph"] = lambda s, d: rounded(summaries.state_graph(tracks(s, d), "track", "frame", "state"), "p")
SQL["state_graph"] = f"WITH {TRACKS}, k AS (SELECT state, lead(state) OVER (PARTITION BY track ORDER BY frame) AS nx FROM tracks), n AS (SELECT state AS source, nx AS target, count(*) AS n FROM k WHERE nx IS NOT NULL AND nx <> state GROUP BY ALL) SELECT source, target, {r6('n / sum(n) OVER (PARTITION BY source)')} AS p FROM n"
QUERIES["density"] = lambda s, d: rounded(summaries.density(tracks(s, d), "x", "y", ["state"], 20), "share")
SQL["density"] = f"""WITH {TRACKS}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tracks), n AS (SELECT state, CAST(least(floor((x - x0) / (x1 - x0) * 20), 19) AS INTEGER) AS bin_x, CAST(least(floor((y - y0) / (y1 - y0) * 20), 19) AS INTEGER) AS bin_y, count(*) AS n FROM tracks, e GROUP BY ALL)
SELECT state, bin_x, bin_y, n, {r6('n / sum(n) OVER (PARTITION BY state)')} AS share FROM n"""

_BINS = 24
QUERIES["kernel_density"] = lambda s, d: rounded(plot_tables.kernel_density(tracks(s, d), "x", "y", "state", _BINS).select("event_id", (F.col("density") * 1000).alias("density"), "density_scaled"), "density", "density_scaled", digits=5)
SQL["kernel_density"] = f"""WITH {TRACKS}, k AS (SELECT * FROM tracks WHERE x IS NOT NULL AND y IS NOT NULL AND state IS NOT NULL),
m AS (SELECT state, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM k GROUP BY state),
w AS (SELECT event_id, state, n, sqrt(a) AS r, sqrt(c - b * b / a) AS s, (x - mx) / sqrt(a) AS u, (y - my - b / sqrt(a) * ((x - mx) / sqrt(a))) / sqrt(c - b * b / a) AS v FROM k JOIN m USING (state)),
e AS (SELECT state, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM w GROUP BY state),
p AS (SELECT event_id, state, n, r, s, (u1 - u0) / {_BINS} AS du, (v1 - v0) / {_BINS} AS dv, least(floor((u - u0) / (u1 - u0) * {_BINS}), {_BINS - 1}) AS i, least(floor((v - v0) / (v1 - v0) * {_BINS}), {_BINS - 1}) AS j FROM w JOIN e USING (state)),
q AS (SELECT state, i, j, any_value(n) AS n, any_value(r) AS r, any_value(s) AS s, any_value(du) AS du, any_value(dv) AS dv, count(*) AS q FROM p GROUP BY state, i, j),
g AS (SELECT a.state, a.i, a.j, sum(b.q * exp(-0.5 * (pow((a.i - b.i) * a.du, 2) + pow((a.j - b.j) * a.dv, 2)) / pow(pow(a.n, -1.0 / 6), 2))) / any_value(2 * pi() * pow(pow(a.n, -1.0 / 6), 2) * a.n * a.r * a.s) AS density FROM q a JOIN q b USING (state) GROUP BY a.state, a.i, a.j),
z AS (SELECT *, coalesce((density - min(density) OVER h) / nullif(max(density) OVER h - min(density) OVER h, 0), 0) AS scaled FROM g WINDOW h AS (PARTITION BY state))
SELECT t.event_id, {r6('density * 1000', 5)} AS density, {r6('scaled', 5)} AS density_scaled FROM tracks t LEFT JOIN p USING (event_id) LEFT JOIN z ON z.state = p.state AND z.i = p.i AND z.j = p.j"""


def _families(s, d):
    """vec_id as tracks: each has the third of its number for a mother; two of a hundred are each other's."""
    v = F.col("vec_id")
    mother = F.when(v % 100 == 40, v + 1).when(v % 100 == 41, v - 1).otherwise(F.floor(v / 3))
    return read(s, d, "embeddings").select(v.alias("track"), mother.cast("long").alias("mother"), v.alias("frame"))


QUERIES["lineage_layout"] = lambda s, d: rounded(plot_tables.lineage_layout(_families(s, d), "track", "mother", "frame").drop("start", "end"), "position", digits=9)
SQL["lineage_layout"] = f"""WITH RECURSIVE t AS (SELECT vec_id AS track, CASE WHEN vec_id % 100 = 40 THEN vec_id + 1 WHEN vec_id % 100 = 41 THEN vec_id - 1 ELSE vec_id // 3 END AS mother FROM embeddings),
k AS (SELECT track, CASE WHEN mother <> track AND mother IN (SELECT track FROM t) THEN mother END AS parent FROM t),
e AS (SELECT track, parent, row_number() OVER (PARTITION BY parent ORDER BY track) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM k WHERE parent IS NOT NULL),
d AS (SELECT track, track AS root, CAST(0 AS INTEGER) AS depth, 0.5::DOUBLE AS position, 1.0::DOUBLE AS w FROM k WHERE parent IS NULL
  UNION ALL SELECT e.track, d.root, d.depth + 1, d.position + CASE WHEN e.n = 1 THEN 0 ELSE -(d.w / 2) + 2 * (d.w / 2) * e.i / (e.n - 1) END, CASE WHEN e.n = 1 THEN d.w ELSE d.w / 2 END FROM e JOIN d ON e.parent = d.track),
up AS (SELECT track AS leaf, track AS node FROM d WHERE track NOT IN (SELECT parent FROM e) UNION ALL SELECT up.leaf, e.parent FROM up JOIN e ON e.track = up.node),
l AS (SELECT node AS track, count(*) AS leaves FROM up GROUP BY node)
SELECT k.track, k.parent, d.root, d.depth, {r6('d.position', 9)} AS position, l.leaves, d.root IS NULL AS cyclic FROM k LEFT JOIN d USING (track) LEFT JOIN l USING (track)"""
QUERIES["trace_layout"] = lambda s, d: rounded(plot_tables.trace_layout(tracks(s, d), ["state"], "x", "y").select("event_id", "frame", "trace"), "trace", digits=5)
SQL["trace_layout"] = f"""WITH {TRACKS}, m AS (SELECT state, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS g FROM tracks WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY state)
SELECT event_id, frame, {r6('CASE WHEN abs(cos(g)) >= abs(sin(g)) THEN sign(cos(g)) ELSE sign(sin(g)) END * ((x - mx) * cos(g) + (y - my) * sin(g))', 5)} AS trace FROM tracks LEFT JOIN m USING (state)"""
QUERIES["clustermap_rows"] = lambda s, d: plot_tables.clustermap_order(_wells(s, d), FEATS)[0]
QUERIES["clustermap_features"] = lambda s, d: plot_tables.clustermap_order(_wells(s, d), FEATS)[1]
QUERIES["lmem_lines"] = lambda s, d: rounded(models.lmem_lines(_wells(s, d), "l_quantity", "treat", "dose", "batch"), "slope", "intercept", "offset")


def _scaled(s, d):
    df = cells(s, d)
    return rounded(Pipeline(stages=[estimators.RobustMADScaler(features=FEATS[:2])]).fit(df).transform(df).select("row_id", *FEATS[:2]), *FEATS[:2])


QUERIES["ml_robust_mad"] = _scaled
SQL["ml_robust_mad"] = f"WITH {CELLS}, m AS (SELECT median(l_quantity) AS a, median(l_extendedprice) AS b FROM cells), s AS (SELECT median(abs(l_quantity - a)) AS c, median(abs(l_extendedprice - b)) AS d FROM cells, m) SELECT row_id, {r6('(l_quantity - a) / (c * 1.482602218505602)')} AS l_quantity, {r6('(l_extendedprice - b) / (d * 1.482602218505602)')} AS l_extendedprice FROM cells, m, s"
