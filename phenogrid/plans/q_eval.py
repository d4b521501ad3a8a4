"""Fixture queries of joins, similarity, evaluation, batch correction and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.operators import batch, evaluate, group
from phenogrid.plans.fixtures import CELLS, FEATS, cells, r6, read, rounded, rounded_native
from phenogrid.sources import plates

QUERIES, SQL = {}, {}

# -- sources and joins ----------------------------------------------------------------------------------------------------


def _merge_objects(s, d):
    li = read(s, d, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    one = li.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(*key)
    a = one.join(li, key).select(F.col("l_orderkey").alias("ImageNumber"), F.col("l_linenumber").alias("ObjectNumber"), F.lit("A1").alias("Metadata_Well"), F.col("l_quantity").alias("Area"), F.col("l_returnflag").alias("Metadata_Flag"))
    b = one.join(li, key).filter("l_linenumber < 4").select(F.col("l_orderkey").alias("ImageNumber"), F.col("l_linenumber").alias("ObjectNumber"), F.lit("A1").alias("Metadata_Well"), F.col("l_tax").alias("Area"), F.col("l_returnflag").alias("Metadata_Flag"))
    return plates.merge_objects({"Cells": a, "Nuclei": b})


QUERIES["merge_objects"] = _merge_objects
SQL["merge_objects"] = """WITH o AS (SELECT l_orderkey, l_linenumber, any_value(l_quantity) AS q, any_value(l_tax) AS t, any_value(l_returnflag) AS f FROM lineitem GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey AS "ImageNumber", l_linenumber AS "ObjectNumber", 'A1' AS "Metadata_Well", q AS "Cells_Area", f AS "Metadata_Flag", t AS "Nuclei_Area" FROM o WHERE l_linenumber < 4"""


def _merge_relation(s, d):
    li = cells(s, d).select("row_id", F.col("image").alias("Line_Parent_Order"), "l_quantity")
    od = read(s, d, "orders").select(F.col("o_orderkey").alias("ObjectNumber"), F.col("o_custkey").alias("Order_Parent_Customer"), "o_totalprice")
    cu = read(s, d, "customer").select(F.col("c_custkey").alias("ObjectNumber"), "c_nationkey")
    parents = {"Line": ["Order"], "Order": ["Customer"], "Customer": []}
    return plates.merge_relations({"Line": li, "Order": od, "Customer": cu}, parents, lambda c, p: f"{c}_Parent_{p}", keys=())


QUERIES["merge_relation"] = _merge_relation
SQL["merge_relation"] = f"""WITH {CELLS} SELECT row_id, image AS "Line_Parent_Order", l_quantity, o_custkey AS "Order_Parent_Customer", o_totalprice, c_nationkey FROM cells JOIN orders ON image = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def _layout(s, d):
    wells = read(s, d, "supplier").select("s_suppkey", F.concat(F.char(65 + F.floor(F.col("s_suppkey") / 10) % 10), F.lpad((F.col("s_suppkey") % 10).cast("string"), 2, "0")).alias("Metadata_Well"))
    layout = read(s, d, "nation").join(F.broadcast(read(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    layout = layout.select(F.concat(F.char(65 + F.floor(F.col("n_nationkey") / 5)), (F.col("n_nationkey") % 5).cast("string")).alias("well"), F.col("n_name").alias("Treatment"), F.col("r_name").alias("Class"))
    return plates.annotate_layout(wells, layout)


QUERIES["annotate_layout"] = _layout
SQL["annotate_layout"] = """WITH w AS (SELECT s_suppkey, chr(CAST(65 + s_suppkey // 10 % 10 AS INTEGER)) || (s_suppkey % 10)::INTEGER::VARCHAR AS well FROM supplier),
l AS (SELECT chr(CAST(65 + n_nationkey // 5 AS INTEGER)) || (n_nationkey % 5)::INTEGER::VARCHAR AS well, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT well AS "Metadata_Well", s_suppkey, n_name AS "Metadata_Treatment", r_name AS "Metadata_Class" FROM w JOIN l USING (well)"""


def _concat(s, d):
    df = cells(s, d)
    return plates.concat([df.filter("batch = 'O'").select("row_id", "l_tax", "l_quantity"), df.filter("batch = 'F'").select("row_id", "l_discount", "l_tax")])


QUERIES["concat_plates"] = _concat
SQL["concat_plates"] = f"WITH {CELLS} SELECT row_id, l_tax FROM cells WHERE batch IN ('O', 'F')"


def _catalogue(s, d):
    paths = read(s, d, "orders").select(F.concat(F.lit("/data/p1/r"), F.lpad((F.col("o_orderkey") % 20).cast("string"), 2, "0"), F.lit("c"), F.lpad((F.col("o_orderkey") % 7).cast("string"), 2, "0"), F.lit("f"), F.lpad((F.col("o_orderkey") % 3).cast("string"), 2, "0"), F.lit("-ch"), (F.col("o_orderkey") % 4).cast("string"), F.lit(".tif")).alias("path"))
    return plates.catalogue(paths, r"r(?P<Row>\d+)c(?P<Column>\d+)f(?P<Field>\d+)", {"DNA": "ch1", "Actin": "ch2"}).groupBy("channel", "Row", "Column", "Metadata_Field").agg(F.count(F.lit(1)).alias("n"))


QUERIES["image_catalogue"] = _catalogue
SQL["image_catalogue"] = """SELECT CASE o_orderkey % 4 WHEN 1 THEN 'DNA' ELSE 'Actin' END AS channel, lpad((o_orderkey % 20)::VARCHAR, 2, '0') AS "Row", lpad((o_orderkey % 7)::VARCHAR, 2, '0') AS "Column", CAST(o_orderkey % 3 AS INTEGER) AS "Metadata_Field", count(*) AS n FROM orders WHERE o_orderkey % 4 IN (1, 2) GROUP BY ALL"""


def _patches(s, d):
    df = cells(s, d).select("row_id", F.col("well").cast("string").alias("Metadata_Well"), F.col("line").alias("Metadata_Field"), "plate", "batch", (F.col("l_quantity") * 40).alias("x"), (F.col("l_tax") * 25000).alias("y"))
    files = df.filter("Metadata_Field < 3").select("Metadata_Well", "Metadata_Field")
    return plates.patches(df, files, "plate", "x", "y", {"batch": "O"}, most=50).select("row_id", "plate", "number", "x0", "x1", "y0", "y1")


QUERIES["patch_windows"] = _patches
SQL["patch_windows"] = f"""WITH {CELLS}, k AS (SELECT row_id, plate, row_number() OVER (PARTITION BY plate ORDER BY row_id) AS rn, trunc(l_quantity * 40) AS x, trunc(l_tax * 25000) AS y FROM cells WHERE batch = 'O' AND line < 3)
SELECT row_id, plate, CAST(rn - 1 AS INTEGER) AS number, CAST(greatest(0, least(x - 150, 1748)) AS INTEGER) AS x0, CAST(greatest(0, least(x - 150, 1748)) AS INTEGER) + 300 AS x1, CAST(greatest(0, least(y - 150, 1748)) AS INTEGER) AS y0, CAST(greatest(0, least(y - 150, 1748)) AS INTEGER) + 300 AS y1 FROM k WHERE rn <= 50"""


def _batches(s, d):
    names = read(s, d, "supplier").select("s_suppkey", F.concat(F.lit("/root/b"), F.col("s_nationkey") % 3, F.lit("/p"), F.col("s_nationkey") % 7, F.lit("/Cells.csv")).alias("file"))
    return plates.with_batch(names, F.col("file")).select("s_suppkey", "BatchNumber", "PlateNumber")


QUERIES["batch_numbers"] = _batches
SQL["batch_numbers"] = """WITH n AS (SELECT s_suppkey, s_nationkey % 3 AS b, s_nationkey % 7 AS p FROM supplier) SELECT s_suppkey, CAST(dense_rank() OVER (ORDER BY b) AS INTEGER) AS "BatchNumber", CAST(dense_rank() OVER (PARTITION BY b ORDER BY p) AS INTEGER) AS "PlateNumber" FROM n"""

# -- similarity and evaluation --------------------------------------------------------------------------------------------

_WF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _vectors(s, d):
    return read(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") < 3, "ctrl").otherwise(F.concat(F.lit("t"), F.col("label") % 3)).alias("treat"), (F.col("label") % 2).alias("conc"))


_V = "vec AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN label < 3 THEN 'ctrl' ELSE 't' || (label % 3) END AS treat, CAST(label % 2 AS INTEGER) AS conc FROM embeddings)"
_UNIT = "list_transform(list_transform({0}, lambda x: x - list_avg({0})), lambda y: y / sqrt(list_sum(list_transform({0}, lambda z: pow(z - list_avg({0}), 2)))))"
_RANK = "list_transform(v, lambda x: len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2.0)"


def _dist_sql(method: str) -> str:
    pre, sim = {
        "pearson": (f"u AS (SELECT *, {_UNIT.format('v')} AS u FROM vec)", "list_dot_product(a.u, b.u)"),
        "spearman": (f"k AS (SELECT *, {_RANK} AS k FROM vec), u AS (SELECT *, {_UNIT.format('k')} AS u FROM k)", "list_dot_product(a.u, b.u)"),
        "euclidean": ("u AS (SELECT *, v AS u FROM vec)", "list_distance(a.u, b.u)"),
        "cityblock": ("u AS (SELECT *, v AS u FROM vec)", "list_sum(list_transform(list_zip(a.u, b.u), lambda z: abs(z[1] - z[2])))"),
    }[method]
    return f"WITH {_V}, {pre}, pairs AS (SELECT a.id AS a, b.id AS b, a.label AS label_a, b.label AS label_b, a.treat AS treat_a, b.treat AS treat_b, a.conc AS conc_a, b.conc AS conc_b, {sim} AS sim FROM u a JOIN u b ON a.id < b.id)"


def _pairs(s, d, method="pearson"):
    return evaluate.similarity(_vectors(s, d), [], F.col("v"), method, "vec_id")


def _sums(s, d):
    return evaluate.pair_sums(_vectors(s, d), ["label", "treat", "conc"], F.col("v"), "pearson", "vec_id")


for _m in ("pearson", "spearman", "euclidean", "cityblock"):
    QUERIES[f"dist_{_m}"] = lambda s, d, m=_m: rounded_native(_pairs(s, d, m).select("a", "b", "sim"), "sim")
    SQL[f"dist_{_m}"] = _dist_sql(_m) + f" SELECT a, b, {r6('sim')} AS sim FROM pairs"
QUERIES["dist_kendall"] = lambda s, d: rounded_native(_pairs(s, d, "kendall").select("a", "b", "sim"), "sim")
SQL["dist_kendall"] = f"""WITH {_V}, g AS (SELECT id, flatten(list_transform(range(1, len(v)), lambda i: list_transform(range(i + 1, len(v) + 1), lambda j: CAST(sign(v[i] - v[j]) AS DOUBLE)))) AS s FROM vec)
SELECT a.id AS a, b.id AS b, {r6('list_dot_product(a.s, b.s) / sqrt(list_dot_product(a.s, a.s) * list_dot_product(b.s, b.s))')} AS sim FROM g a JOIN g b ON a.id < b.id"""
QUERIES["dist_mahalanobis"] = lambda s, d: rounded_native(_pairs(s, d, "mahalanobis").select("a", "b", "sim"), "sim")
QUERIES["reproducibility_z"] = lambda s, d: rounded(evaluate.reproducibility(_sums(s, d), ["label"]).select("label", "mean_sim", "z"), "mean_sim", "z")
SQL["reproducibility_z"] = _dist_sql("pearson") + f", n AS (SELECT avg(sim) AS m, stddev_samp(sim) AS s FROM pairs WHERE label_a <> label_b), g AS (SELECT label_a AS label, avg(sim) AS x FROM pairs WHERE label_a = label_b GROUP BY ALL) SELECT label, {r6('x')} AS mean_sim, {r6('(x - m) / s')} AS z FROM g, n"
QUERIES["effect_z"] = lambda s, d: rounded(evaluate.effect(_sums(s, d), "treat").select("treat", "effect", "z"), "effect", "z")
_EFF = "SELECT CASE WHEN treat_a = 'ctrl' THEN treat_b ELSE treat_a END AS treat, CASE WHEN treat_a = 'ctrl' THEN conc_b ELSE conc_a END AS conc, sim FROM pairs WHERE (treat_a = 'ctrl') <> (treat_b = 'ctrl')"
SQL["effect_z"] = _dist_sql("pearson") + f", e AS ({_EFF}), n AS (SELECT avg(sim) AS m, stddev_samp(sim) AS s FROM pairs WHERE treat_a = 'ctrl' AND treat_b = 'ctrl'), g AS (SELECT treat, avg(sim) AS x FROM e GROUP BY treat) SELECT treat, {r6('x')} AS effect, {r6('(x - m) / s')} AS z FROM g, n"
QUERIES["effect_by_level_z"] = lambda s, d: rounded(evaluate.effect(_sums(s, d), "treat", ["conc"]).select("treat", "conc", "effect", "z"), "effect", "z")
_LEVEL = f", e AS ({_EFF}), l AS (SELECT avg(sim) AS m, stddev_samp(sim) AS s FROM pairs WHERE treat_a = 'ctrl' AND treat_b = 'ctrl' AND conc_a = conc_b GROUP BY conc_a), n AS (SELECT avg(m) AS m, avg(s) AS s FROM l), g AS (SELECT treat, conc, avg(sim) AS x FROM e GROUP BY ALL)"
SQL["effect_by_level_z"] = _dist_sql("pearson") + _LEVEL + f" SELECT treat, conc, {r6('x')} AS effect, {r6('(x - m) / s')} AS z FROM g, n"
QUERIES["select_concentration"] = lambda s, d: evaluate.best_concentration(_vectors(s, d), _sums(s, d), "treat", "conc")[1].select("vec_id", "treat", "conc")
SQL["select_concentration"] = _dist_sql("pearson") + _LEVEL + ", b AS (SELECT treat, conc FROM g, n QUALIFY row_number() OVER (PARTITION BY treat ORDER BY round(abs((x - m) / s), 9) DESC, conc) = 1) SELECT id AS vec_id, treat, conc FROM vec WHERE treat = 'ctrl' OR (treat, conc) IN (SELECT (treat, conc) FROM b)"
QUERIES["eval_percentiles"] = lambda s, d: rounded(evaluate.reproducibility(_sums(s, d), ["label"]).select("label", "percentile"), "percentile")
_PHI = "0.5 * (1 + (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)))"
SQL["eval_percentiles"] = _dist_sql("pearson") + f", n AS (SELECT avg(sim) AS m, stddev_samp(sim) AS s FROM pairs WHERE label_a <> label_b), g AS (SELECT label_a AS label, avg(sim) AS x FROM pairs WHERE label_a = label_b GROUP BY ALL), zz AS (SELECT label, abs((x - m) / s) AS z FROM g, n), tt AS (SELECT *, 1 / (1 + 0.3275911 * z / sqrt(2)) AS t FROM zz) SELECT label, {r6(_PHI)} AS percentile FROM tt"
QUERIES["eval_quartiles"] = lambda s, d: rounded(evaluate.quartiles(evaluate.reproducibility(_sums(s, d), ["label"]), "mean_sim"), "q1", "q2", "q3")
SQL["eval_quartiles"] = _dist_sql("pearson") + f", g AS (SELECT label_a AS label, avg(sim) AS x FROM pairs WHERE label_a = label_b GROUP BY ALL) SELECT {r6('quantile_cont(x, 0.25)')} AS q1, {r6('quantile_cont(x, 0.5)')} AS q2, {r6('quantile_cont(x, 0.75)')} AS q3 FROM g"

# -- batch correction and geometry ----------------------------------------------------------------------------------------


def _scaled(s, d):
    return cells(s, d).withColumn("l_extendedprice", F.col("l_extendedprice") / 10000).withColumn("l_quantity", F.col("l_quantity") / 10)


def _cov(s, d):
    mean, cov, n = batch.covariance(_scaled(s, d).filter("treatment = 'ctrl'"), FEATS)
    rows = [(i, j, round(float(cov[i, j]), 6) + 0.0) for i in range(4) for j in range(4)]
    return s.createDataFrame(rows, "i int, j int, cov double")


QUERIES["control_covariance"] = _cov
_SC = f"{CELLS}, sc AS (SELECT * REPLACE (l_extendedprice / 10000 AS l_extendedprice, l_quantity / 10 AS l_quantity) FROM cells)"
SQL["control_covariance"] = f"WITH {_SC} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r6(f'covar_pop({FEATS[i]}, {FEATS[j]})')} AS cov FROM sc WHERE treatment = 'ctrl'" for i in range(4) for j in range(4))
QUERIES["tvn"] = lambda s, d: rounded(batch.TVN(FEATS, "treatment").fit(_scaled(s, d)).transform(_scaled(s, d)).select("row_id", *FEATS), *FEATS)
QUERIES["coral"] = lambda s, d: rounded(batch.CORAL(FEATS, "batch", "treatment").fit(_scaled(s, d)).transform(_scaled(s, d)).select("row_id", *FEATS), *FEATS)


def _plate(s, d, method, sweeps):
    wells = group.aggregate(cells(s, d), ["plate", "well"], ["l_quantity", "l_extendedprice"], "mean")
    at = F.col("well")  # plates of 10 x 10 wells
    wells = wells.withColumns({"part": F.floor(at / 100), "prow": F.floor(at / 10) % 10, "pcol": at % 10})
    return rounded(batch.correct_plates(wells, ["l_quantity", "l_extendedprice"], "prow", "pcol", ["plate", "part"], sweeps, method).select("plate", "well", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", digits=5)


QUERIES["plate_polish"] = lambda s, d: _plate(s, d, "median", 10)
QUERIES["plate_polish_mean"] = lambda s, d: _plate(s, d, "mean", 1)
_POLISH = f"""WITH {CELLS}, w AS (SELECT plate, well, well // 100 AS part, well // 10 % 10 AS prow, well % 10 AS pcol, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM cells GROUP BY ALL), r0 AS (UNPIVOT w ON q, e INTO NAME f VALUE x)"""


def _polish_sql(mid: str, sweeps: int) -> str:
    steps = "".join(
        f", c{k} AS (SELECT * REPLACE (x - {mid} OVER (PARTITION BY plate, part, f, prow) AS x) FROM r{k - 1}), r{k} AS (SELECT * REPLACE (x - {mid} OVER (PARTITION BY plate, part, f, pcol) AS x) FROM c{k})"
        for k in range(1, sweeps + 1)
    )
    return _POLISH + steps + f""", m AS (SELECT plate, part, f, mad(x) AS mad FROM r{sweeps} GROUP BY ALL), s AS (SELECT plate, well, f, x / nullif(mad, 0) AS v FROM r{sweeps} JOIN m USING (plate, part, f))
SELECT plate, well, {r6("max(v) FILTER (WHERE f = 'q')", 5)} AS l_quantity, {r6("max(v) FILTER (WHERE f = 'e')", 5)} AS l_extendedprice FROM s GROUP BY ALL"""


SQL["plate_polish"] = _polish_sql("quantile_cont(x, 0.5)", 10)
SQL["plate_polish_mean"] = _polish_sql("avg(x)", 1)


def _bleach(s, d):
    return cells(s, d).select("row_id", "treatment", F.col("line").cast("double").alias("t"), (F.col("l_quantity") * F.exp(-0.3 * F.col("line")) + 5).alias("DNA_mean"), F.col("l_tax").alias("other"))


QUERIES["bleach_control_curve"] = lambda s, d: rounded(batch.control_curve(_bleach(s, d).withColumn("treatment", F.lit("ctrl")), ["DNA_mean"], "treatment", "t"), "mean")
SQL["bleach_control_curve"] = f"WITH {CELLS} SELECT CAST(line AS DOUBLE) AS t, 'DNA_mean' AS feature, {r6('avg(l_quantity * exp(-0.3 * line) + 5)')} AS mean FROM cells GROUP BY ALL"
QUERIES["bleach_corrected"] = lambda s, d: rounded(batch.correct_bleaching(_bleach(s, d).withColumn("treatment", F.lit("ctrl")), ["DNA_mean", "other"], ["DNA"], "treatment", "t")[0].select("row_id", "DNA_mean"), "DNA_mean", digits=4)


def _tiles(s, d):
    e = read(s, d, "events")
    return e.select("event_id", (F.col("event_id") % 25 + 1).alias("tile"), (F.pmod(F.col("event_id") * 7919, F.lit(204800)) / 100).alias("x"), (F.pmod(F.col("event_id") * 104729, F.lit(204800)) / 100).alias("y"))


for _r, _rc in (("horizontal", ("(tile - 1) // 5", "(tile - 1) % 5")), ("vertical", ("(tile - 1) % 5", "(tile - 1) // 5")), ("horizontal_serp", ("(tile - 1) // 5", "CASE WHEN (tile - 1) // 5 % 2 = 0 THEN (tile - 1) % 5 ELSE 4 - (tile - 1) % 5 END")), ("vertical_serp", ("CASE WHEN (tile - 1) // 5 % 2 = 0 THEN (tile - 1) % 5 ELSE 4 - (tile - 1) % 5 END", "(tile - 1) // 5"))):
    QUERIES[f"pseudostitch_{_r}"] = lambda s, d, r=_r: rounded(batch.pseudostitch(_tiles(s, d), "tile", "x", "y", reading=r).select("event_id", "tile_row", "tile_col", "x", "y"), "x", "y")
    SQL[f"pseudostitch_{_r}"] = f"""WITH t AS (SELECT event_id, event_id % 25 + 1 AS tile, (event_id * 7919 % 204800) / 100.0::DOUBLE AS x, (event_id * 104729 % 204800) / 100.0::DOUBLE AS y FROM events),
p AS (SELECT event_id, tile, CAST({_rc[0]} AS INTEGER) AS tile_row, CAST({_rc[1]} AS INTEGER) AS tile_col, x, y FROM t), q AS (SELECT event_id, tile, tile_row, tile_col, x + tile_col * 1638.4::DOUBLE AS x, y + tile_row * 1638.4::DOUBLE AS y FROM p),
g AS (SELECT tile, trunc(({_rc[1]}) * 1638.4) AS x0, trunc(({_rc[1]}) * 1638.4 + 2048) AS x1, trunc(({_rc[0]}) * 1638.4) AS y0, trunc(({_rc[0]}) * 1638.4 + 2048) AS y1 FROM (SELECT unnest(range(1, 26)) AS tile))
SELECT event_id, tile_row, tile_col, {r6('x')} AS x, {r6('y')} AS y FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.tile < q.tile AND trunc(x) >= x0 AND trunc(x) < x1 AND trunc(y) >= y0 AND trunc(y) < y1)"""


def _plate_map(s, d):
    at = F.col("well") % 96
    wells = group.aggregate(cells(s, d).withColumn("name", F.concat(F.char(65 + F.floor(at / 12)), (at % 12 + 1).cast("string"))), ["name"], ["l_quantity"], "mean", count=True)
    return rounded(batch.plate_map(wells, "name", "l_quantity", size=group.COUNT, size_range=(10.0, 50.0)), "value", "size")


QUERIES["plate_map"] = _plate_map
SQL["plate_map"] = f"""WITH {CELLS}, w AS (SELECT well % 96 AS at, avg(l_quantity) AS v, count(*) AS n FROM cells GROUP BY ALL), g AS (SELECT CAST(unnest(range(96)) AS INTEGER) AS i), f AS (SELECT i // 12 + 1 AS "row", i % 12 + 1 AS col, v, n FROM g LEFT JOIN w ON i = w.at)
SELECT "row", col, {r6('v')} AS value, {r6('10 + (n - min(n) OVER ()) * 40.0 / (max(n) OVER () - min(n) OVER ())')} AS size FROM f"""

# -- two features: roots and axes of 2 x 2 matrices have closed forms, which SQL can write -----------------------------------

_TWO = ["l_quantity", "l_tax"]
_two = lambda s, d: cells(s, d).withColumns({"l_tax": F.col("l_tax") * 100 + F.col("l_quantity") / 10})
_PAIR = f"{CELLS}, two AS (SELECT row_id, batch, treatment, l_quantity AS x, l_tax * 100 + l_quantity / 10 AS y FROM cells)"
# the axes of a symmetric matrix (a b, b c), b > 0: values l1 >= l2, the first axis (u, v), the second (-v, u) or (v, -u)
_AXES = "(a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2, b / sqrt(b * b + pow((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) - a, 2)) AS u, ((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) - a) / sqrt(b * b + pow((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) - a, 2)) AS v"
_FIRST, _SECOND = "(x - mx) * u + (y - my) * v", "(CASE WHEN abs(u) >= abs(v) THEN (y - my) * u - (x - mx) * v ELSE (x - mx) * v - (y - my) * u END)"
QUERIES["tvn_pair"] = lambda s, d: rounded(batch.TVN(_TWO, "treatment").fit(_two(s, d)).transform(_two(s, d)).select("row_id", *_TWO), *_TWO, digits=5)
SQL["tvn_pair"] = f"WITH {_PAIR}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM two WHERE treatment = 'ctrl'), e AS (SELECT *, {_AXES} FROM m) SELECT row_id, {r6(f'({_FIRST}) / sqrt(l1 + 1e-5)', 5)} AS l_quantity, {r6(f'{_SECOND} / sqrt(l2 + 1e-5)', 5)} AS l_tax FROM two, e"
QUERIES["coral_pair"] = lambda s, d: rounded(batch.CORAL(_TWO, "batch", "treatment").fit(_two(s, d)).transform(_two(s, d)).select("row_id", *_TWO), *_TWO, digits=5)
# the root of (a b, b c): add the root of the determinant to the diagonal, divide by the root of trace plus twice that
SQL["coral_pair"] = f"""WITH {_PAIR}, k AS (SELECT * FROM two WHERE treatment = 'ctrl'), g AS (SELECT var_samp(x) + 1 AS a, covar_samp(x, y) AS b, var_samp(y) + 1 AS c FROM k), gr AS (SELECT *, sqrt(a * c - b * b) AS d FROM g), w AS (SELECT (a + d) / sqrt(a + c + 2 * d) AS wa, b / sqrt(a + c + 2 * d) AS wb, (c + d) / sqrt(a + c + 2 * d) AS wc FROM gr),
h AS (SELECT batch, var_samp(x) + 1 AS a, covar_samp(x, y) AS b, var_samp(y) + 1 AS c FROM k GROUP BY batch), hr AS (SELECT *, sqrt(a * c - b * b) AS d FROM h), i AS (SELECT batch, d * sqrt(a + c + 2 * d) AS q, (c + d) AS ia, -b AS ib, (a + d) AS ic FROM hr),
z AS (SELECT row_id, (x * ia + y * ib) / q AS p, (x * ib + y * ic) / q AS r FROM two JOIN i USING (batch)) SELECT row_id, {r6('p * wa + r * wb', 5)} AS l_quantity, {r6('p * wb + r * wc', 5)} AS l_tax FROM z, w"""


def _two_wells(s, d):
    return group.aggregate(_two(s, d), ["batch", "well"], _TWO, "mean").withColumns({"id": F.col("well") * 2 + (F.col("batch") == "O").cast("int"), "v": F.array(*_TWO)})


QUERIES["dist_mahalanobis_pair"] = lambda s, d: rounded_native(evaluate.similarity(_two_wells(s, d), [], F.col("v"), "mahalanobis", "id").select("a", "b", "sim"), "sim", digits=5)
SQL["dist_mahalanobis_pair"] = f"""WITH {_PAIR}, w AS (SELECT l_suppkey * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS id, avg(l_quantity) AS x, avg(l_tax * 100 + l_quantity / 10) AS y FROM lineitem GROUP BY ALL), m AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM w)
SELECT p.id AS a, q.id AS b, {r6('sqrt((pow(p.x - q.x, 2) * c - 2 * (p.x - q.x) * (p.y - q.y) * b + pow(p.y - q.y, 2) * a) / (a * c - b * b))', 5)} AS sim FROM w p JOIN w q ON p.id < q.id, m"""
