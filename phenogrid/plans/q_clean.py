"""Fixture queries of cleaning, joining, aggregation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.operators import clean, group
from phenogrid.plans.fixtures import CELLS, DIRTY, FEATS, cells, dirty, r6, read, rounded

QUERIES, SQL = {}, {}
_F = ", ".join(FEATS)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("drop_missing_rows", f"WITH {DIRTY} SELECT row_id, {_F} FROM dirty WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL")
def _(s, d):
    return clean.drop_missing_rows(dirty(s, d), FEATS).select("row_id", *FEATS)


@query("drop_missing_rows_share", f"WITH {DIRTY} SELECT row_id, {_F} FROM dirty WHERE ((l_quantity IS NULL)::INT + (l_tax IS NULL)::INT) / 4.0 < 0.5")
def _(s, d):
    return clean.drop_missing_rows(dirty(s, d), FEATS, 0.5).select("row_id", *FEATS)


@query("drop_missing_features", f"WITH {DIRTY} SELECT row_id, l_extendedprice, l_discount FROM dirty")
def _(s, d):
    df = dirty(s, d)
    return df.select("row_id", *[f for f in FEATS if f not in clean.missing_features(df, FEATS)])


@query("null_shares", f"""WITH {DIRTY} SELECT feature, count(*) AS n, count(*) - count(value) AS n_null, {r6("(count(*) - count(value)) / count(*)")} AS share
FROM (SELECT 'l_quantity' AS feature, l_quantity AS value FROM dirty UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM dirty UNION ALL SELECT 'l_discount', l_discount FROM dirty UNION ALL SELECT 'l_tax', l_tax FROM dirty) GROUP BY feature""")
def _(s, d):
    return rounded(clean.null_shares(dirty(s, d), FEATS), "share")


for _side, _cond in (("both", "x < m + 1.5 * sd AND x > m - 1.5 * sd"), ("left", "x > m - 1.5 * sd"), ("right", "x < m + 1.5 * sd")):
    QUERIES[f"filter_std_{_side}"] = lambda s, d, side=_side: clean.filter_std(cells(s, d), "l_extendedprice", 1.5, side).select("row_id", "l_extendedprice")
    SQL[f"filter_std_{_side}"] = f"WITH {CELLS}, st AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM cells) SELECT row_id, l_extendedprice FROM (SELECT row_id, l_extendedprice, l_extendedprice AS x, m, sd FROM cells, st) WHERE {_cond}"


@query("filter_threshold", f"WITH {CELLS} SELECT row_id FROM cells WHERE l_quantity < 25 AND l_tax > 0.03")
def _(s, d):
    return clean.filter_threshold(clean.filter_threshold(cells(s, d), "l_quantity", 25), "l_tax", 0.03, "left").select("row_id")


@query("drop_duplicate_rows", f"WITH {CELLS} SELECT min(row_id) AS row_id, l_quantity, l_discount, l_tax FROM cells GROUP BY ALL")
def _(s, d):
    return clean.drop_duplicate_rows(cells(s, d), ["l_quantity", "l_discount", "l_tax"]).select("row_id", "l_quantity", "l_discount", "l_tax")


@query("drop_duplicate_features", "SELECT 'copy_q' AS feature, 'l_quantity' AS first UNION ALL SELECT 'copy_t', 'l_tax'")
def _(s, d):
    df = cells(s, d).withColumns({"copy_q": F.col("l_quantity"), "copy_t": F.col("l_tax") + 0.0, "near_t": F.when(F.col("line") == 7, F.col("l_discount")).otherwise(F.col("l_tax"))})
    return clean.duplicate_features(df, [*FEATS, "copy_q", "copy_t", "near_t"])


@query("drop_invariant", f"WITH {CELLS} SELECT row_id, l_discount, l_tax FROM cells WHERE NOT (l_discount = l_tax)")
def _(s, d):
    df = cells(s, d).withColumn("constant", F.lit(3.0))
    feats = ["l_discount", "l_tax", "constant"]
    left = [f for f in feats if f not in clean.invariant_features(df, feats)]
    return clean.drop_invariant_rows(df, left).select("row_id", *left)


@query("outlier_threshold_features", f"""WITH {DIRTY} SELECT feature, {r6("max(abs(value))")} AS max_abs, count(*) = count(value) AND coalesce(max(abs(value)), 1e300) <= 50 AS keep
FROM (SELECT 'l_quantity' AS feature, l_quantity AS value FROM dirty UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM dirty UNION ALL SELECT 'l_discount', l_discount FROM dirty UNION ALL SELECT 'l_tax', l_tax FROM dirty) GROUP BY feature""")
def _(s, d):
    return rounded(clean.outlier_features(dirty(s, d), FEATS, 50), "max_abs")


@query("outlier_threshold_rows", f"WITH {DIRTY} SELECT row_id FROM dirty WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND greatest(abs(l_quantity), abs(l_tax)) <= 30")
def _(s, d):
    return clean.drop_outlier_rows(dirty(s, d), ["l_quantity", "l_tax"], 30).select("row_id")


_LEVEL = """WITH lv AS (SELECT DISTINCT p_type, p_size FROM part), md AS (SELECT p_type, quantile_cont(p_size, 0.5) AS m FROM lv GROUP BY p_type),
pick AS (SELECT p_type, {} AS lvl FROM lv JOIN md USING (p_type) GROUP BY p_type) SELECT p_partkey, p_type, p_size FROM part JOIN pick USING (p_type) WHERE p_size = lvl"""
for _m, _e in (("max", "max(p_size)"), ("min", "min(p_size)"), ("median", "arg_min(p_size, abs(p_size - m) * 1000 + p_size / 1000.0)")):
    QUERIES[f"select_by_group_{_m}"] = lambda s, d, m=_m: clean.select_by_group(read(s, d, "part"), "p_size", "p_type", m).select("p_partkey", "p_type", "p_size")
    SQL[f"select_by_group_{_m}"] = _LEVEL.format(_e)


@query("encode_labels", """SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS "p_brand_Enc" FROM part""")
def _(s, d):
    return clean.encode_labels(read(s, d, "part"), "p_brand").select("p_partkey", "p_brand", "p_brand_Enc")


@query("well_standardise", """SELECT s_suppkey, chr(CAST(65 + s_suppkey // 10 % 10 AS INTEGER)) || CAST(CAST(s_suppkey % 10 AS INTEGER) AS VARCHAR) AS well FROM supplier""")
def _(s, d):
    raw = F.concat(F.char(65 + F.floor(F.col("s_suppkey") / 10) % 10), F.lpad((F.col("s_suppkey") % 10).cast("string"), 2, "0"))
    return read(s, d, "supplier").select("s_suppkey", clean.standard_well(raw).alias("well"))


@query("ratio_projection", f"WITH {CELLS} SELECT row_id, {r6('l_extendedprice / nullif(l_discount, 0)')} AS ratio FROM cells")
def _(s, d):
    return rounded(clean.ratio(cells(s, d), "l_extendedprice", "l_discount", "ratio").select("row_id", "ratio"), "ratio")


@query("annotation_query", f"WITH {CELLS} SELECT row_id FROM cells WHERE batch = 'O' AND treatment = 'ctrl'")
def _(s, d):
    return clean.query(cells(s, d), batch="O", treatment="ctrl").select("row_id")


@query("keep_annotations", f"WITH {CELLS} SELECT row_id, plate, {_F} FROM cells")
def _(s, d):
    return clean.keep_annotations(cells(s, d), FEATS, ["plat"], ["row_id"])


@query("representation_slice", f"SELECT vec_id, {r6('list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)))')} AS s FROM embeddings")
def _(s, d):
    df = read(s, d, "embeddings").select("vec_id", clean.representation(None, "embedding", 8).alias("e"))
    return rounded(df.select("vec_id", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("s")), "s")


@query("qc_anti_join", f"WITH {CELLS} SELECT row_id, batch, plate, well FROM (SELECT *, count(*) OVER (PARTITION BY batch, plate, well) AS n FROM cells) WHERE n >= 100")
def _(s, d):
    return clean.drop_low_count(cells(s, d), ["batch", "plate", "well"], 100).select("row_id", "batch", "plate", "well")


# -- groups ---------------------------------------------------------------------------------------------------------------

_KEYS = ["batch", "plate", "well"]
for _m, _a in (("mean", "avg({0})"), ("median", "quantile_cont({0}, 0.5)")):
    QUERIES[f"aggregate_{_m}"] = lambda s, d, m=_m: rounded(group.aggregate(dirty(s, d), _KEYS, FEATS, m, obs=["treatment"], count=True), *FEATS)
    SQL[f"aggregate_{_m}"] = f"""WITH {DIRTY} SELECT batch, plate, well, {", ".join(f"{r6(_a.format(f))} AS {f}" for f in FEATS)}, arg_min(treatment, row_id) AS treatment, count(*) AS "Metadata_Cellnumber" FROM dirty GROUP BY batch, plate, well"""


@query("aggregate_counts_summed", f"""WITH {CELLS} SELECT batch, plate, CAST(sum(line) AS BIGINT) AS "Metadata_Cellnumber", {r6("avg(l_tax)")} AS l_tax FROM cells GROUP BY batch, plate""")
def _(s, d):
    df = cells(s, d).withColumn(group.COUNT, F.col("line").cast("long"))
    return rounded(group.aggregate(df, ["batch", "plate"], ["l_tax"], "mean", count=True), "l_tax")


@query("aggregate_qc", f"""WITH {CELLS} SELECT batch, plate, well, {r6("quantile_cont(l_quantity, 0.5)")} AS l_quantity, count(*) AS "Metadata_Cellnumber" FROM cells GROUP BY ALL HAVING count(*) >= 100""".replace("GROUP BY ALL", "GROUP BY batch, plate, well"))
def _(s, d):
    return rounded(group.aggregate(cells(s, d), _KEYS, ["l_quantity"], min_cells=100), "l_quantity")


@query("qc_low_groups", f"""WITH {CELLS} SELECT batch, plate, well, count(*) AS "Metadata_Cellnumber" FROM cells GROUP BY batch, plate, well HAVING count(*) < 90""")
def _(s, d):
    return group.low_count_groups(cells(s, d), _KEYS, 90)


@query("aggregate_embedding", f"SELECT label, i, {r6('avg(x)')} AS x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i")
def _(s, d):
    df = group.aggregate(read(s, d, "embeddings"), ["label"], [], "mean", row_id="vec_id", reps=["embedding"])
    return rounded(df.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long")), "x")


_MODZ = f"""WITH v AS (SELECT n_regionkey AS g, c_custkey AS id, [c_acctbal, CAST(c_nationkey AS DOUBLE) * 100, CAST(length(c_name) AS DOUBLE), CAST(c_custkey % 97 AS DOUBLE) * 20] AS v FROM customer JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT g, id, v, BASIS AS b FROM v),
c AS (SELECT g, id, v, list_transform(b, lambda x: x - list_avg(b)) AS c FROM b),
u AS (SELECT g, id, v, list_transform(c, lambda x: x / nullif(sqrt(list_sum(list_transform(c, lambda y: y * y))), 0)) AS u FROM c),
p AS (SELECT a.g, a.id, any_value(a.v) AS v, avg(greatest(list_dot_product(a.u, o.u), 0)) AS w FROM u a JOIN u o ON a.g = o.g AND a.id <> o.id GROUP BY a.g, a.id),
q AS (SELECT g, id, v, greatest(coalesce(w, 0), 0.01) AS w FROM p)
SELECT g, {", ".join(r6(f"sum(w * v[{i + 1}]) / sum(w)") + f" AS f{i}" for i in range(4))} FROM q GROUP BY g"""
_SPEARMAN = "list_transform(v, lambda x: len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2.0)"


def _modz(s, d, method):
    df = read(s, d, "customer").join(F.broadcast(read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.select(F.col("n_regionkey").alias("g"), "c_custkey", F.col("c_acctbal").alias("f0"), (F.col("c_nationkey").cast("double") * 100).alias("f1"), F.length("c_name").cast("double").alias("f2"), ((F.col("c_custkey") % 97).cast("double") * 20).alias("f3"))
    return rounded(group.aggregate_modz(df, ["g"], ["f0", "f1", "f2", "f3"], method, row_id="c_custkey"), "f0", "f1", "f2", "f3")


QUERIES["aggregate_modz_pearson"] = lambda s, d: _modz(s, d, "pearson")
QUERIES["aggregate_modz_spearman"] = lambda s, d: _modz(s, d, "spearman")
SQL["aggregate_modz_pearson"] = _MODZ.replace("BASIS", "v")
SQL["aggregate_modz_spearman"] = _MODZ.replace("BASIS", _SPEARMAN)

_ORDER = "md5('0:' || row_id), row_id"
_CHUNK = f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, plate ORDER BY {_ORDER}) - 1 AS rn, count(*) OVER (PARTITION BY batch, plate) AS n FROM cells),
k AS (SELECT *, rn // 500 AS chunk FROM r WHERE rn // 500 < TAKE) SELECT batch, plate, chunk AS "Chunk", count(*) AS "Metadata_Cellnumber", {r6("quantile_cont(l_quantity, 0.5)")} AS l_quantity, {r6("quantile_cont(l_extendedprice, 0.5)")} AS l_extendedprice FROM k GROUP BY batch, plate, chunk"""
for _n, _take, _arg in (("aggregate_chunks", "n // 500", None), ("aggregate_chunks_equal", "(SELECT min(n // 500) FROM r)", "equal"), ("aggregate_chunks_fixed", "least(n // 500, 2)", 2)):
    QUERIES[_n] = lambda s, d, a=_arg: rounded(group.aggregate_chunks(cells(s, d), ["batch", "plate"], ["l_quantity", "l_extendedprice"], 500, a), "l_quantity", "l_extendedprice")
    SQL[_n] = _CHUNK.replace("TAKE", _take)


@query("subsample", f"WITH {CELLS} SELECT row_id, batch, plate FROM (SELECT *, row_number() OVER (PARTITION BY batch, plate ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY batch, plate) AS n FROM cells) WHERE rn <= round_even(n * 0.15, 0)")
def _(s, d):
    return group.subsample(cells(s, d), ["batch", "plate"], 0.15).select("row_id", "batch", "plate")


@query("subsample_grouped", f"""WITH {CELLS}, u AS (SELECT DISTINCT batch, plate, well FROM cells), k AS (SELECT *, row_number() OVER (PARTITION BY batch, plate ORDER BY md5('0:' || well), well) AS rn, count(*) OVER (PARTITION BY batch, plate) AS n FROM u)
SELECT row_id, batch, plate, well FROM cells SEMI JOIN (SELECT * FROM k WHERE rn <= round_even(n * 0.1, 0)) USING (batch, plate, well)""")
def _(s, d):
    return group.subsample(cells(s, d), ["batch", "plate"], 0.1, grouped="well").select("row_id", "batch", "plate", "well")


@query("subsample_replacement_counts", f"WITH {CELLS} SELECT batch, plate, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n FROM cells GROUP BY batch, plate")
def _(s, d):
    return group.subsample(cells(s, d), ["batch", "plate"], 0.2, with_replacement=True).groupBy("batch", "plate").agg(F.count(F.lit(1)).alias("n"))


@query("sample_rows", f"WITH {CELLS} SELECT row_id FROM cells ORDER BY md5('3:' || row_id), row_id LIMIT 1000")
def _(s, d):
    return group.sample_rows(cells(s, d), 1000, seed=3).select("row_id")


@query("train_test_split", f"WITH {CELLS} SELECT row_id, row_number() OVER (ORDER BY md5('0:' || row_id)) <= ceil(count(*) OVER () * 0.2 - 1e-9) AS is_test FROM cells")
def _(s, d):
    return group.train_test_split(cells(s, d)).select("row_id", "is_test")


@query("train_test_split_stratified", f"WITH {CELLS} SELECT row_id, row_number() OVER (PARTITION BY plate ORDER BY {_ORDER}) <= round_even(count(*) OVER (PARTITION BY plate) * 0.2, 0) AS is_test FROM cells")
def _(s, d):
    return group.train_test_split(cells(s, d), stratify="plate").select("row_id", "is_test")


@query("group_shuffle_split", """WITH k AS (SELECT source, min(lang) AS s FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (PARTITION BY s ORDER BY md5('0:' || source), source) <= round_even(count(*) OVER (PARTITION BY s) * 0.25, 0) AS is_test FROM k)
SELECT doc_id, source, is_test FROM documents JOIN r USING (source)""")
def _(s, d):
    return group.group_shuffle_split(read(s, d, "documents").select("doc_id", "source", "lang"), "source", 0.25, "lang").select("doc_id", "source", "is_test")


@query("sample_tracks", "SELECT event_id, user_id FROM events SEMI JOIN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('0:' || user_id), user_id LIMIT 20) USING (user_id)")
def _(s, d):
    return group.sample_tracks(read(s, d, "events"), "user_id", 20).select("event_id", "user_id")


@query("first_rows_per_group", f"WITH {CELLS} SELECT row_id, well, CAST(rn - 1 AS INTEGER) AS number FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY row_id) AS rn FROM cells) WHERE rn <= 5")
def _(s, d):
    return group.first_rows(cells(s, d), ["well"], 5).select("row_id", "well", "number")


@query("value_counts", f"WITH {CELLS} SELECT treatment, count(*) AS n FROM cells GROUP BY treatment")
def _(s, d):
    return group.value_counts(cells(s, d), "treatment")
