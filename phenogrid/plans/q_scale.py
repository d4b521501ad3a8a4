"""Fixture queries of normalisation, transforms, thresholds and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.operators import features, group, scale, threshold
from phenogrid.plans.fixtures import CELLS, DIRTY, FEATS, cells, dirty, r6, read, rounded

QUERIES, SQL = {}, {}
_BY = ["batch", "plate"]


def _norm_sql(method: str, pop: bool, by: bool = True) -> str:
    part = "PARTITION BY batch, plate" if by else ""
    flt = "FILTER (WHERE treatment = 'ctrl')" if pop else ""

    def one(f: str) -> str:
        w = f"OVER ({part})"
        if method == "standard":
            return f"({f} - avg({f}) {flt} {w}) / coalesce(nullif(stddev_pop({f}) {flt} {w}, 0), 1)"
        if method == "min_max":
            return f"({f} - min({f}) {flt} {w}) / coalesce(nullif(max({f}) {flt} {w} - min({f}) {flt} {w}, 0), 1)"
        if method == "robust":
            return f"({f} - quantile_cont({f}, 0.5) {flt} {w}) / coalesce(nullif(quantile_cont({f}, 0.75) {flt} {w} - quantile_cont({f}, 0.25) {flt} {w}, 0), 1)"
        return f"({f} - quantile_cont({f}, 0.5) {flt} {w}) / nullif(1.482602218505602 * mad({f}) {flt} {w}, 0)"

    return f"WITH {DIRTY} SELECT row_id, {', '.join(r6(one(f)) + f' AS {f}' for f in FEATS)} FROM dirty"


for _m, _n in (("standard", "standard"), ("robust", "robust"), ("mad_robust", "mad"), ("min_max", "minmax")):
    QUERIES[f"normalize_{_n}"] = lambda s, d, m=_m: rounded(scale.normalize(dirty(s, d), FEATS, _BY, m).select("row_id", *FEATS), *FEATS)
    SQL[f"normalize_{_n}"] = _norm_sql(_m, False)
    QUERIES[f"normalize_control_{_n}"] = lambda s, d, m=_m: rounded(scale.normalize(dirty(s, d), FEATS, _BY, m, "treatment", "ctrl").select("row_id", *FEATS), *FEATS)
    SQL[f"normalize_control_{_n}"] = _norm_sql(_m, True)
QUERIES["normalize_ungrouped_control"] = lambda s, d: rounded(scale.normalize(dirty(s, d), FEATS, (), "standard", "treatment", "ctrl").select("row_id", *FEATS), *FEATS)
SQL["normalize_ungrouped_control"] = _norm_sql("standard", True, False)
QUERIES["normalize_drop_missing"] = lambda s, d: rounded(scale.normalize(dirty(s, d), FEATS, _BY, "standard", drop_missing=True).select("row_id", *FEATS), *FEATS)
SQL["normalize_drop_missing"] = f"SELECT * FROM ({_norm_sql('standard', False)}) WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL"

for _m, _e in (("sqrt", "CASE WHEN {0} >= 0 THEN sqrt({0}) END"), ("log", "CASE WHEN {0} > 0 THEN ln({0}) END"), ("log1p", "CASE WHEN {0} > -1 THEN ln(1 + {0}) END")):
    QUERIES[f"transform_{_m}"] = lambda s, d, m=_m: rounded(scale.transform(dirty(s, d), FEATS, m).select("row_id", *FEATS), *FEATS)
    SQL[f"transform_{_m}"] = f"WITH {DIRTY} SELECT row_id, {', '.join(r6(_e.format(f)) + f' AS {f}' for f in FEATS)} FROM dirty"

QUERIES["transform_quantile"] = lambda s, d: rounded(scale.transform_quantile(cells(s, d), ["l_quantity", "l_extendedprice"], 101).select("row_id", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", digits=5)
_Q = """q_{0} AS (SELECT quantile_cont({0}, list_transform(range(101), lambda i: i / 100.0)) AS q FROM cells),
p_{0} AS (SELECT v AS x, len(list_filter(q, lambda y: y < v)) AS b, len(list_filter(q, lambda y: y <= v)) AS u, q FROM (SELECT DISTINCT {0} AS v FROM cells), q_{0}),
s_{0} AS (SELECT x, CASE WHEN b = 101 THEN 1.0 WHEN u = 0 THEN 0.0 WHEN u > b THEN (b + u - 1) / 2.0 / 100.0 ELSE (b - 1 + (x - q[b]) / nullif(q[b + 1] - q[b], 0)) / 100.0 END AS v FROM p_{0})"""
SQL["transform_quantile"] = f"WITH {CELLS}, {_Q.format('l_quantity')}, {_Q.format('l_extendedprice')} SELECT row_id, {r6('a.v', 5)} AS l_quantity, {r6('b.v', 5)} AS l_extendedprice FROM cells JOIN s_l_quantity a ON a.x = l_quantity JOIN s_l_extendedprice b ON b.x = l_extendedprice"
QUERIES["transform_power"] = lambda s, d: rounded(scale.transform_power(cells(s, d), ["l_quantity", "l_extendedprice"]).select("row_id", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")

_LIFT = "CASE WHEN abs(lam) < 1e-12 THEN ln(1 + v) ELSE (pow(v + 1, lam) - 1) / lam END"  # of values from 0 on


def _round(k: int, grid: str, source: str) -> str:
    """The best exponent of each feature among a grid's; the first of equals."""
    return f"g{k} AS (SELECT f, {grid} AS lam FROM {source}), s{k} AS (SELECT f, lam, -count(*) / 2 * ln(var_pop({_LIFT})) + (lam - 1) * sum(ln(1 + v)) AS score FROM l JOIN g{k} USING (f) GROUP BY f, lam), b{k} AS (SELECT f, arg_max(lam, score) AS best FROM s{k} GROUP BY f)"


SQL["transform_power"] = f"""WITH {CELLS}, l AS (SELECT row_id, 'q' AS f, l_quantity AS v FROM cells UNION ALL SELECT row_id, 'e', l_extendedprice FROM cells),
{_round(1, "-2.0::DOUBLE + unnest(range(21)) * 0.25", "(SELECT DISTINCT f FROM l)")}, {_round(2, "best - 0.25 + unnest(range(9)) * 0.0625", "b1")}, {_round(3, "best - 0.0625 + unnest(range(9)) * 0.015625", "b2")},
t AS (SELECT row_id, f, {_LIFT} AS v FROM l JOIN (SELECT f, best AS lam FROM b3) USING (f)) SELECT row_id, {r6("max(v) FILTER (WHERE f = 'q')")} AS l_quantity, {r6("max(v) FILTER (WHERE f = 'e')")} AS l_extendedprice FROM t GROUP BY row_id"""

# -- thresholds -----------------------------------------------------------------------------------------------------------

QUERIES["histogram"] = lambda s, d: rounded(threshold.histogram(cells(s, d), "l_extendedprice", ["batch"]), "lo", "hi")
_HIST = f"""{CELLS}, e AS (SELECT batch, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM cells GROUP BY batch),
h AS (SELECT batch, lo, hi, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM cells JOIN e USING (batch) GROUP BY ALL)"""
SQL["histogram"] = f"WITH {_HIST} SELECT batch, {r6('lo')} AS lo, {r6('hi')} AS hi, bin, n FROM h"
_FULL = """, g AS (SELECT batch, lo, hi, CAST(unnest(range(256)) AS INTEGER) AS bin FROM (SELECT DISTINCT batch, lo, hi FROM h)),
f AS (SELECT g.batch, g.bin, g.lo + (g.bin + 0.5) * (g.hi - g.lo) / 256 AS c, (g.hi - g.lo) / 256 AS bw, coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON g.batch = h.batch AND g.bin = h.bin),
m AS (SELECT *, sum(n) OVER u AS w1, sum(n * c) OVER u AS s1, sum(n) OVER t AS w, sum(n * c) OVER t AS s, sum(n) OVER t AS total FROM f WINDOW u AS (PARTITION BY batch ORDER BY bin), t AS (PARTITION BY batch))"""
QUERIES["threshold_otsu"] = lambda s, d: rounded(threshold.otsu_sql(threshold.histogram(cells(s, d), "l_extendedprice", ["batch"]), ["batch"]), "threshold", digits=4)
_OTSU = f"WITH {_HIST} {_FULL}, v AS (SELECT batch, bin, c, round(coalesce(w1 * (w - w1) * pow(s1 / nullif(w1, 0) - (s - s1) / nullif(w - w1, 0), 2), 0), 6) AS v FROM m WHERE bin < 255) SELECT batch, bin, {r6('c', 4)} AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY batch ORDER BY v DESC, bin) = 1"
SQL["threshold_otsu"] = _OTSU


def _found(method):
    return lambda s, d: rounded(threshold.find_thresholds(cells(s, d), "l_extendedprice", ["batch"], method).select("batch", F.get("thresholds", F.lit(0)).alias("threshold")), "threshold", digits=4)


QUERIES["threshold_otsu_bins"], SQL["threshold_otsu_bins"] = QUERIES["threshold_otsu"], SQL["threshold_otsu"]
SQL["threshold_otsu"] = f"SELECT batch, threshold FROM ({_OTSU})"
for _m in ("otsu", "mean", "isodata", "yen", "triangle", "li", "minimum", "multi_otsu"):
    QUERIES[f"threshold_{_m}"] = _found(_m)
SQL["threshold_mean"] = f"WITH {CELLS} SELECT batch, {r6('avg(l_extendedprice)', 4)} AS threshold FROM cells GROUP BY batch"
SQL["threshold_isodata"] = f"WITH {_HIST} {_FULL}, d AS (SELECT *, (s1 / nullif(w1, 0) + (s - s1) / nullif(w - w1, 0)) / 2 - c AS d FROM m) SELECT batch, {r6('min(c)', 4)} AS threshold FROM d WHERE d >= 0 AND d < bw GROUP BY batch"
SQL["threshold_yen"] = f"""WITH {_HIST} {_FULL}, p AS (SELECT *, sum(n / total) OVER u AS a, sum(pow(n / total, 2)) OVER u AS b, sum(pow(n / total, 2)) OVER (PARTITION BY batch) AS bb FROM m WINDOW u AS (PARTITION BY batch ORDER BY bin)),
k AS (SELECT batch, bin, c, ln(pow(a * (1 - a), 2) / (b * (bb - b))) AS v FROM p WHERE bin < 255 AND a > 0 AND a < 1 - 1e-12) SELECT batch, {r6('arg_max(c, v)', 4)} AS threshold FROM k GROUP BY batch"""
SQL["threshold_multi_otsu"] = f"""WITH {_HIST} {_FULL}, v AS (SELECT a.batch, a.c, a.bin AS i, b.bin AS j, coalesce(a.s1 * a.s1 / nullif(a.w1, 0), 0) + coalesce(pow(b.s1 - a.s1, 2) / nullif(b.w1 - a.w1, 0), 0) + coalesce(pow(b.s - b.s1, 2) / nullif(b.w - b.w1, 0), 0) AS v FROM m a JOIN m b ON a.batch = b.batch AND a.bin < b.bin AND b.bin < 255)
SELECT batch, {r6('c', 4)} AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY batch ORDER BY v DESC, i, j) = 1"""
QUERIES["threshold_multi_otsu_both"] = lambda s, d: threshold.find_thresholds(cells(s, d), "l_extendedprice", ["batch"], "multi_otsu").select("batch", F.posexplode("thresholds").alias("at", "threshold")).withColumn("threshold", F.round("threshold", 4))
SQL["threshold_multi_otsu_both"] = f"""WITH {_HIST} {_FULL}, v AS (SELECT a.batch, a.c AS c0, b.c AS c1, a.bin AS i, b.bin AS j, coalesce(a.s1 * a.s1 / nullif(a.w1, 0), 0) + coalesce(pow(b.s1 - a.s1, 2) / nullif(b.w1 - a.w1, 0), 0) + coalesce(pow(b.s - b.s1, 2) / nullif(b.w - b.w1, 0), 0) AS v FROM m a JOIN m b ON a.batch = b.batch AND a.bin < b.bin AND b.bin < 255),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY batch ORDER BY v DESC, i, j) = 1) SELECT batch, CAST(0 AS INTEGER) AS at, {r6('c0', 4)} AS threshold FROM best UNION ALL SELECT batch, 1, {r6('c1', 4)} FROM best"""
# the bin farthest from the line between the peak and the end of the longer tail
SQL["threshold_triangle"] = f"""WITH {_HIST} {_FULL}, ends AS (SELECT batch, min(bin) FILTER (WHERE n > 0) AS lo, max(bin) FILTER (WHERE n > 0) AS hi, max(n) AS height FROM m GROUP BY batch), p AS (SELECT ends.*, min(bin) AS peak FROM ends JOIN m ON m.batch = ends.batch AND m.n = ends.height GROUP BY ALL),
d AS (SELECT m.batch, c, CASE WHEN peak - lo < hi - peak THEN -bin ELSE bin END AS place, CASE WHEN peak - lo < hi - peak THEN height * (hi - bin) - (hi - peak) * n ELSE height * (bin - lo) - (peak - lo) * n END AS far FROM m JOIN p ON m.batch = p.batch AND CASE WHEN peak - lo < hi - peak THEN bin BETWEEN peak + 1 AND hi ELSE bin BETWEEN lo AND peak - 1 END)
SELECT batch, {r6('c', 4)} AS threshold FROM d QUALIFY row_number() OVER (PARTITION BY batch ORDER BY far DESC, place) = 1"""
SQL["threshold_li"] = f"""WITH RECURSIVE {_HIST} {_FULL}, x AS (SELECT batch, n, c - min(c) OVER (PARTITION BY batch) AS x, min(c) OVER (PARTITION BY batch) AS c0, bw FROM m),
r AS (SELECT batch, sum(n * x) / sum(n) AS t, -1.0::DOUBLE AS last, 0 AS k FROM x GROUP BY batch
UNION ALL SELECT batch, (mb - mf) / (ln(mb) - ln(mf)), t, k + 1 FROM (SELECT r.batch, r.t, r.k, sum(n * x) FILTER (WHERE x > t) / nullif(sum(n) FILTER (WHERE x > t), 0) AS mf, sum(n * x) FILTER (WHERE x <= t) / nullif(sum(n) FILTER (WHERE x <= t), 0) AS mb FROM r JOIN x USING (batch) WHERE abs(t - last) > bw / 2 GROUP BY r.batch, r.t, r.k) WHERE mf IS NOT NULL AND mb > 0)
SELECT r.batch, {r6('arg_max(t, k) + any_value(c0)', 4)} AS threshold FROM r JOIN (SELECT DISTINCT batch, c0 FROM x) USING (batch) GROUP BY r.batch"""
QUERIES["threshold_assign"] = lambda s, d: threshold.assign_by_threshold(cells(s, d), "l_extendedprice", ["batch"], "cls", "mean", labels={0: "low", 1: "high"}, max_val=50000.0).select("row_id", "cls")
SQL["threshold_assign"] = f"WITH {CELLS}, t AS (SELECT batch, avg(l_extendedprice) AS m FROM cells WHERE l_extendedprice < 50000 GROUP BY batch) SELECT row_id, CASE WHEN l_extendedprice > m THEN 'high' ELSE 'low' END AS cls FROM cells JOIN t USING (batch)"

# -- features -------------------------------------------------------------------------------------------------------------

_LONG = "long AS (SELECT batch, plate, row_id, feature, value FROM (SELECT batch, plate, row_id, l_quantity, l_extendedprice, l_discount, l_tax FROM {0}) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
QUERIES["near_zero_variance"] = lambda s, d: rounded(features.near_zero_variance(cells(s, d), FEATS, 0.9, 0.0005), "freq_ratio", "unique_ratio")
SQL["near_zero_variance"] = f"""WITH {CELLS}, {_LONG.format('cells')}, c AS (SELECT feature, value, count(*) AS n FROM long GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r FROM c),
a AS (SELECT feature, max(n) FILTER (WHERE r = 1) AS n1, coalesce(max(n) FILTER (WHERE r = 2), 0) AS n2, count(*) AS k, sum(n) AS t FROM r GROUP BY feature)
SELECT feature, {r6('n2 / n1')} AS freq_ratio, {r6('k / t')} AS unique_ratio, k > 1 AND n2 / n1 >= 0.9 AND k / t >= 0.0005 AS keep FROM a"""
for _m in ("std", "mad"):
    QUERIES[f"low_cv_{_m}"] = lambda s, d, m=_m: rounded(features.low_cv(cells(s, d), FEATS, _BY, m, 0.55), "cv")
SQL["low_cv_std"] = f"WITH {CELLS}, {_LONG.format('cells')}, g AS (SELECT batch, plate, feature, stddev_pop(value) / nullif(abs(avg(value)), 0) AS cv FROM long GROUP BY ALL) SELECT feature, {r6('avg(cv)')} AS cv, coalesce(avg(cv) > 0.55, false) AS keep FROM g GROUP BY feature"
SQL["low_cv_mad"] = f"WITH {CELLS}, {_LONG.format('cells')}, g AS (SELECT batch, plate, feature, 1.482602218505602 * mad(value) / nullif(abs(quantile_cont(value, 0.5)), 0) AS cv FROM long GROUP BY ALL) SELECT feature, {r6('avg(cv)')} AS cv, coalesce(avg(cv) > 0.55, false) AS keep FROM g GROUP BY feature"
QUERIES["low_variance_mad"] = lambda s, d: rounded(features.low_variance(cells(s, d), FEATS, _BY, 0.05, stabilised=False), "score")
SQL["low_variance_mad"] = f"WITH {CELLS}, {_LONG.format('cells')}, g AS (SELECT batch, plate, feature, 1.482602218505602 * mad(value) AS m FROM long GROUP BY ALL) SELECT feature, {r6('avg(m)')} AS score, avg(m) > 0.05 AS keep FROM g GROUP BY feature"
QUERIES["low_variance"] = lambda s, d: rounded(features.low_variance(cells(s, d), FEATS, _BY, 0.0), "score")
SQL["low_variance"] = f"""WITH {CELLS}, {_LONG.format('cells')}, g AS (SELECT batch, plate, feature, log10(nullif(var_pop(value), 0)) AS lv, log10(nullif(abs(avg(value)), 0)) AS lm FROM long GROUP BY ALL),
s AS (SELECT feature, lv - (regr_slope(lv, lm) OVER w * lm + regr_intercept(lv, lm) OVER w) AS x FROM g WINDOW w AS (PARTITION BY batch, plate)) SELECT feature, {r6('avg(x)')} AS score, coalesce(avg(x) > 0, false) AS keep FROM s GROUP BY feature"""
_CF = ["l_quantity", "l_extendedprice", "mix", "l_tax", "neg"]
_mixed = lambda s, d: cells(s, d).withColumns({"mix": F.col("l_quantity") * 3 + F.col("l_tax"), "neg": -F.col("l_extendedprice")})
_MIX = f"{CELLS}, mixed AS (SELECT *, l_quantity * 3 + l_tax AS mix, -l_extendedprice AS neg FROM cells)"
for _m in ("pearson", "spearman"):
    QUERIES[f"corr_drop_{_m}"] = lambda s, d, m=_m: rounded(features.highly_correlated(_mixed(s, d), _CF, 0.9, m), "worst")
    QUERIES[f"corr_pairs_{_m}"] = lambda s, d, m=_m: rounded(features.correlation_pairs(_mixed(s, d), _CF, m), "r")
QUERIES["corr_drop_negative"] = lambda s, d: rounded(features.highly_correlated(_mixed(s, d), _CF, 0.9, "pearson", neg_corr=True), "worst")
_PAIRS = [(i, j) for j in range(5) for i in range(j)]
_RANKED = f"{_MIX}, src AS (SELECT {', '.join(f'rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}' for f in _CF)} FROM mixed)"


def _corr(src: str, strength: str, pairs: bool) -> str:
    p = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, corr({_CF[i]}, {_CF[j]}) AS r FROM src" for i, j in _PAIRS)
    if pairs:
        return f"WITH {src}, p AS ({p}) SELECT i, j, {r6('r')} AS r FROM p"
    names = "[" + ", ".join(f"'{f}'" for f in _CF) + "]"
    return f"WITH {src}, p AS ({p}), k AS (SELECT unnest(range(5)) AS pos) SELECT list_extract({names}, pos + 1) AS feature, {r6(f'max({strength}) FILTER (WHERE j = pos)')} AS worst, coalesce(max({strength}) FILTER (WHERE j = pos), -1) <= 0.9 AS keep FROM k, p GROUP BY pos"


_PLAIN = f"{_MIX}, src AS (SELECT * FROM mixed)"
SQL |= {"corr_drop_pearson": _corr(_PLAIN, "r", False), "corr_drop_spearman": _corr(_RANKED, "r", False), "corr_pairs_pearson": _corr(_PLAIN, "r", True), "corr_pairs_spearman": _corr(_RANKED, "r", True), "corr_drop_negative": _corr(_PLAIN, "abs(r)", False)}
QUERIES["drop_noise"] = lambda s, d: rounded(features.noise(scale.normalize(cells(s, d), FEATS, [], "standard"), FEATS, "treatment", 0.9995), "noise")
SQL["drop_noise"] = f"""WITH {CELLS}, n AS (SELECT treatment, {', '.join(f'({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}' for f in FEATS)} FROM cells),
l AS (UNPIVOT n ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value), g AS (SELECT treatment, feature, stddev_pop(value) AS s FROM l GROUP BY ALL) SELECT feature, {r6('avg(s)')} AS noise, avg(s) <= 0.9995 AS keep FROM g GROUP BY feature"""

_WELLS = ["l_quantity", "l_extendedprice", "l_discount"]
_wells = lambda s, d: group.aggregate(cells(s, d), ["plate", "well"], _WELLS, "mean")
_WL = f"{CELLS}, wells AS (SELECT plate AS grp, well, {', '.join(f'avg({f}) AS {f}' for f in _WELLS)} FROM cells GROUP BY plate, well), wl AS (UNPIVOT wells ON {', '.join(_WELLS)} INTO NAME feature VALUE value)"
_ADJUSTED = """, zz AS (SELECT grp, feature, (rs - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS score FROM a), tt AS (SELECT *, 1 / (1 + 0.3275911 * abs(score) / sqrt(2)) AS t FROM zz),
pp AS (SELECT grp, feature, score, least(1.0::DOUBLE, 2 * (1 - 0.5 * (1 + (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-score * score / 2))))) AS p FROM tt),
bh AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, feature) AS rk, count(*) OVER (PARTITION BY grp) AS nn FROM pp)
SELECT grp, feature, """ + f"{r6('score')} AS score, {r6('p')} AS p, {r6('least(1.0::DOUBLE, min(p * nn / rk) OVER (PARTITION BY grp ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS p_adjusted FROM bh"
QUERIES["rank_feats_wilcoxon"] = lambda s, d: rounded(features.rank_features(_wells(s, d), _WELLS, "plate"), "score", "p", "p_adjusted")
SQL["rank_feats_wilcoxon"] = f"""WITH {_WL}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature) AS nn FROM wl),
a AS (SELECT grp, feature, sum(r) AS rs, count(*)::DOUBLE AS n1, any_value(nn)::DOUBLE - count(*) AS n2 FROM k GROUP BY grp, feature){_ADJUSTED}"""
QUERIES["rank_feats_wilcoxon_reference"] = lambda s, d: rounded(features.rank_features(_wells(s, d), _WELLS, "plate", "A"), "score", "p", "p_adjusted")
SQL["rank_feats_wilcoxon_reference"] = f"""WITH {_WL}, b AS (SELECT g.grp, feature, value, wl.grp = g.grp AS own FROM wl JOIN (SELECT DISTINCT grp FROM wl WHERE grp <> 'A') g ON wl.grp = g.grp OR wl.grp = 'A'),
k AS (SELECT *, rank() OVER (PARTITION BY grp, feature ORDER BY value) + (count(*) OVER (PARTITION BY grp, feature, value) - 1) / 2.0 AS r FROM b),
a AS (SELECT grp, feature, sum(r) FILTER (WHERE own) AS rs, count(*) FILTER (WHERE own)::DOUBLE AS n1, count(*) FILTER (WHERE NOT own)::DOUBLE AS n2 FROM k GROUP BY grp, feature){_ADJUSTED}"""
QUERIES["rank_feats_ttest"] = lambda s, d: rounded(features.rank_features(_wells(s, d), _WELLS, "plate", "A", "t").select("grp", "feature", "score"), "score", digits=4)
SQL["rank_feats_ttest"] = f"""WITH {_WL}, m AS (SELECT grp, feature, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM wl GROUP BY ALL)
SELECT a.grp, a.feature, {r6('(a.m - b.m) / sqrt((a.n * a.v + b.n * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n))', 4)} AS score FROM m a JOIN m b ON a.feature = b.feature AND b.grp = 'A' WHERE a.grp <> 'A'"""
QUERIES["rank_feats_adjusted"] = lambda s, d: rounded(features.rank_features(_wells(s, d), _WELLS, "plate", method="t"), "score", "p", "p_adjusted", digits=4)
