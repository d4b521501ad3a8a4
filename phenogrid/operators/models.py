"""Iterative models: mixed models, feature clustering, recursive elimination, time warping, random walks, transport.

Numpy kernels run on the driver on feature-by-feature or group-by-group matrices, or on executors in groups that are small by
their meaning (one feature's wells, one pair of series). Rows reach the driver only as a documented, bounded sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions.scratch import cut as cut_plan
from phenogrid.functions.stats import adjust, normal_two_sided
from phenogrid.operators.batch import covariance
from phenogrid.operators.group import sample_rows

# -- mixed models ---------------------------------------------------------------------------------------------------------


@dataclass
class RandomIntercept:
    """A fitted y ~ x with a random intercept by group: coefficients, their covariance, the variance ratio, and each group's predicted offset."""

    beta: np.ndarray
    cov: np.ndarray
    ratio: float
    groups: np.ndarray
    offset: np.ndarray


def reml_fit(y: np.ndarray, x: np.ndarray, groups: np.ndarray) -> RandomIntercept | None:
    """Profile REML in the variance ratio, by golden search; None for a singular fit. An offset is ratio * (sum of the group's residuals) / (1 + ratio * its size)."""
    n, k = x.shape
    if n <= k or not np.isfinite(y).all() or y.std() == 0:
        return None
    names, index = np.unique(groups, return_inverse=True)
    size = np.bincount(index).astype(float)
    sums = lambda a: np.stack([np.bincount(index, c) for c in a.T], 1)
    sx, sy = sums(x), np.bincount(index, y)
    xx, xy, yy = x.T @ x, x.T @ y, float(y @ y)

    def solve(ratio: float):
        w = ratio / (1 + ratio * size)  # V^-1 = I - w 11' in each group
        a = xx - (sx * w[:, None]).T @ sx
        b = xy - (sx * w[:, None]).T @ sy
        c = yy - float(w @ (sy * sy))
        beta = np.linalg.solve(a, b)
        rss = max(c - float(b @ beta), 1e-300)
        loglik = -0.5 * ((n - k) * np.log(rss / (n - k)) + np.log1p(ratio * size).sum() + np.linalg.slogdet(a)[1])
        return loglik, beta, rss / (n - k) * np.linalg.inv(a)

    try:
        lo, hi = -12.0, 8.0
        g = (5**0.5 - 1) / 2
        p, q = hi - g * (hi - lo), lo + g * (hi - lo)
        fp, fq = solve(np.exp(p))[0], solve(np.exp(q))[0]
        for _ in range(60):
            if fp < fq:
                lo, p, fp = p, q, fq
                q = lo + g * (hi - lo)
                fq = solve(np.exp(q))[0]
            else:
                hi, q, fq = q, p, fp
                p = hi - g * (hi - lo)
                fp = solve(np.exp(p))[0]
        best = max((0.0, float(np.exp((lo + hi) / 2))), key=lambda r: solve(r)[0])
        _, beta, cov = solve(best)
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(cov[0, 0]) or cov[0, 0] <= 0:
        return None
    return RandomIntercept(beta, cov, best, names, best * np.bincount(index, y - x @ beta) / (1 + best * size))


def reml_random_intercept(y: np.ndarray, x: np.ndarray, groups: np.ndarray) -> tuple[float, float]:
    """(p of the first coefficient, r2) of y ~ x with a random intercept by group.

    r2 is of the fixed part, clipped at 0. A singular fit gives p = 1 and r2 = 0."""
    fit = reml_fit(y, x, groups)
    if fit is None:
        return 1.0, 0.0
    r2 = max(0.0, 1 - float(((y - x @ fit.beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()))
    return normal_two_sided(float(fit.beta[0] / fit.cov[0, 0] ** 0.5)), r2


def lmem_lines(df: DataFrame, feature: str, treat: str, fixed: str, rand: str, control: object = "ctrl") -> DataFrame:
    """against, group, n, slope, intercept, offset: the lines of a mixed model's plot, one for each treatment and group of random offsets.

    Each treatment's rows and the controls are a model of `feature` on the rank of `fixed` among all rows (from 0), with an intercept. Rows that miss anything are left out."""
    rows = df.filter(X.all_valid([treat, fixed, rand, feature])).select(F.col(treat).cast("string").alias("treat"), F.col(fixed).alias("x"), F.col(rand).cast("string").alias("rand"), F.col(feature).cast("double").alias("y"))
    levels = rows.select("x").distinct()
    ranks = levels.withColumn("rank", F.row_number().over(Window.orderBy("x")) - 1)  # a row for each level of the fixed effect
    rows = rows.join(ranks, "x")
    kinds = rows.filter(F.col("treat") != F.lit(control)).select(F.col("treat").alias("against")).distinct()
    controls = rows.filter(F.col("treat") == F.lit(control)).join(F.broadcast(kinds), how="cross")  # controls once for each of a few treatments
    both = rows.filter(F.col("treat") != F.lit(control)).withColumn("against", F.col("treat")).unionByName(controls)

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rand", "rank", "y"])
        fit = reml_fit(g["y"].to_numpy(float), np.stack([g["rank"].to_numpy(float), np.ones(len(g))], 1), g["rand"].to_numpy())
        n = g.groupby("rand").size()
        out = pd.DataFrame({"group": n.index, "n": n.to_numpy()})
        if fit is None:
            return out.assign(against=key[0], slope=np.nan, intercept=np.nan, offset=np.nan)
        return out.assign(against=key[0], slope=fit.beta[0], intercept=fit.beta[1], offset=fit.offset)

    found = both.groupBy("against").applyInPandas(solve, "group string, n long, against string, slope double, intercept double, offset double")
    return found.select("against", "group", "n", *[X.clean(c).alias(c) for c in ("slope", "intercept", "offset")])


def feature_lmem(df: DataFrame, feats: Sequence[str], treat: str, dose: str, rand: str, control: object = "ctrl", method: str = "bonferroni", alpha: float = 0.05, r2_thresh: float = 0.7, intercept: bool = False, sample_size: int | None = None, row_id: str = "row_id") -> DataFrame:
    """feature, p_min (smallest adjusted p over treatments), r2_mean, r2_std, p_mask, r2_mask, keep (either).

    Each (treatment, feature) is a model of the treatment's and the controls' rows on the rank of dose (controls 0), without
    an intercept unless asked for. Rows are wells: a group is what one treatment has. Rows without dose are ranked 0."""
    if sample_size is not None:
        df = sample_rows(df, sample_size, row_id)
    rows = df.filter(F.col(treat).isNotNull() & F.col(rand).isNotNull()).select(F.col(treat).cast("string").alias("treat"), F.col(dose).cast("double").alias("dose"), F.col(rand).cast("string").alias("rand"), *feats)
    kinds = rows.filter(F.col("treat") != F.lit(control)).select(F.col("treat").alias("against")).distinct()
    controls = rows.filter(F.col("treat") == F.lit(control)).join(F.broadcast(kinds), how="cross")  # controls once for each of a few treatments
    both = rows.filter(F.col("treat") != F.lit(control)).withColumn("against", F.col("treat")).unionByName(controls)
    long = X.long(both, ["against", "treat", "dose", "rand"], feats).filter("value is not null")

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        dose = np.where(g["treat"] == control, -np.inf, g["dose"].fillna(-np.inf))
        rank = np.unique(dose, return_inverse=True)[1].astype(float)
        x = np.stack([rank, np.ones(len(rank))], 1) if intercept else rank[:, None]
        p, r2 = reml_random_intercept(g["value"].to_numpy(float), x, g["rand"].to_numpy())
        return pd.DataFrame({"against": [key[0]], "feature": [key[1]], "p": [p], "r2": [r2]})

    fits = long.groupBy("against", "feature").applyInPandas(solve, "against string, feature string, p double, r2 double")

    def judge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("against")
        low = float(adjust(g["p"].to_numpy(float), method).min())
        mean, sd = float(g["r2"].mean()), float(g["r2"].std()) if len(g) > 1 else 0.0
        return pd.DataFrame({"feature": [key[0]], "p_min": [low], "r2_mean": [mean], "r2_std": [sd], "p_mask": [low <= alpha], "r2_mask": [mean >= r2_thresh], "keep": [low <= alpha or mean >= r2_thresh]})

    return fits.groupBy("feature").applyInPandas(judge, "feature string, p_min double, r2_mean double, r2_std double, p_mask boolean, r2_mask boolean, keep boolean")


# -- clustering -----------------------------------------------------------------------------------------------------------


def linkage(dist: np.ndarray, method: str = "ward") -> np.ndarray:
    """Merges (a, b, height, size) by the nearest-neighbour chain with Lance-Williams updates; clusters n, n+1, ... are the merges, by height."""
    n = len(dist)
    d = dist.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, alive, raw, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        i, j = sorted(chain[-2:])
        chain = chain[:-2]
        h = d[i, j]
        if method == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * h) / (size[i] + size[j] + size)
        elif method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = np.minimum(d[i], d[j])
        raw.append((i, j, h))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
        size[i] += size[j]
    raw.sort(key=lambda m: m[2])
    up, count, out = list(range(n)), np.ones(2 * n - 1), []
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (i, j, h) in enumerate(raw):
        a, b = find(i), find(j)
        x, y = sorted((up[a], up[b]))
        count[n + k] = count[x] + count[y]
        out.append((x, y, h**0.5 if method == "ward" else h, count[n + k]))
        root[b] = a
        up[a] = n + k
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of n items in k clusters, numbered by their smallest item."""
    label = np.arange(n)
    member = {i: [i] for i in range(n)}
    for m, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        member[n + m] = member.pop(int(a)) + member.pop(int(b))
    for c, items in enumerate(sorted(member.values(), key=min)):
        label[items] = c
    return label


def silhouette(dist: np.ndarray, label: np.ndarray) -> float:
    k = label.max() + 1
    if k < 2 or k >= len(label):
        return -1.0
    one = np.eye(k)[label]
    count, total = one.sum(0), dist @ one
    own = count[label]
    a = total[np.arange(len(label)), label] / np.maximum(own - 1, 1)
    mean = np.where(one > 0, np.inf, total / count)
    b = mean.min(1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean())


def feature_distances(df: DataFrame, feats: Sequence[str]) -> np.ndarray:
    """Euclidean distances between feature columns, from one aggregate of moments (p x p numbers)."""
    mean, cov, n = covariance(df, feats)
    gram = (cov + np.outer(mean, mean)) * n
    sq = np.diag(gram)
    return np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * gram, 0))


def estimate_k(dist: np.ndarray, cluster_range: tuple[int, int] = (2, 100), min_k: int = 3) -> int:
    """k with the best silhouette in range(*cluster_range), from min_k on; one tree is cut at each k."""
    merges = linkage(dist)
    scores = {k: silhouette(dist, cut(merges, len(dist), k)) for k in range(max(min_k, cluster_range[0]), min(cluster_range[1], len(dist)))}
    return max(scores, key=lambda k: (scores[k], -k)) if scores else min(min_k, len(dist))


def feature_agglo(df: DataFrame, feats: Sequence[str], k: int | str = "estimate", cluster_range: tuple[int, int] = (2, 100)) -> tuple[DataFrame, dict[str, list[str]]]:
    """(df with features pooled by mean to agglo_0, agglo_1, ...; their members): Ward clustering of the features."""
    dist = feature_distances(df, feats)
    k = estimate_k(dist, cluster_range) if k == "estimate" else int(k)
    label = cut(linkage(dist), len(feats), k)
    groups = {f"agglo_{c}": [f for f, x in zip(feats, label, strict=True) if x == c] for c in range(label.max() + 1)}
    pooled = {}
    for name, members in groups.items():
        total = F.col(members[0])
        for f in members[1:]:
            total = total + F.col(f)
        pooled[name] = total / F.lit(float(len(members)))
    return df.withColumns(pooled).drop(*feats), groups


def svm_rfe(df: DataFrame, feats: Sequence[str], treat: str, n_features: int | None = None, C: float = 1.0, step: int = 1, sample_size: int | None = None, row_id: str = "row_id") -> DataFrame:
    """feature, rank (1: kept), keep: the feature with the smallest sum of squared weights of linear one-against-rest machines goes, until n_features (half) are left."""
    if sample_size is not None:
        df = sample_rows(df, sample_size, row_id)
    rows = StringIndexer(inputCol=treat, outputCol="_y", stringOrderType="alphabetAsc").fit(df).transform(df.na.drop(subset=[*feats, treat])).select("_y", *feats)
    rows = cut_plan(rows)
    left, goal, ranks = list(feats), n_features or max(1, len(feats) // 2), {}
    while len(left) > goal:
        vec = VectorAssembler(inputCols=left, outputCol="_v").transform(rows)
        model = OneVsRest(classifier=LinearSVC(regParam=1 / (C * 1000), maxIter=8), featuresCol="_v", labelCol="_y", parallelism=2).fit(vec)
        weight = sum(np.asarray(m.coefficients.toArray()) ** 2 for m in model.models)
        for i in np.argsort(weight, kind="stable")[: min(step, len(left) - goal)]:
            ranks[left[i]] = len(left) - goal + 1
        left = [f for f in left if f not in ranks]
    return df.sparkSession.createDataFrame([(f, ranks.get(f, 1), f in left) for f in feats], "feature string, rank int, keep boolean")


# -- time warping ---------------------------------------------------------------------------------------------------------


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Root of the least total of squared step costs; one anti-diagonal at a time."""
    cost = ((a[:, None] - b[None]) ** 2).sum(-1)
    n, m = cost.shape
    prev2, prev = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    prev2[0] = 0.0
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        now = np.full(n + 1, np.inf)
        now[i + 1] = cost[i, k - i] + np.minimum(np.minimum(prev[i + 1], prev[i]), prev2[i])
        prev2, prev = prev, now
    return float(prev[n] ** 0.5)


def dtw_pairs(df: DataFrame, groups: Sequence[str], time: str, values: Sequence[str] | str, method: str = "dependent") -> DataFrame:
    """a, b (a < b), distance between the groups' series; names are the groups' values joined by ":". values: feature columns or one embedding column.

    Series are of aggregated groups (treatments), packed to one row each; pairs share an equi-join by blocks."""
    vec = F.col(values).cast("array<double>") if isinstance(values, str) else F.array(*[F.col(v).cast("double") for v in values])
    name = F.concat_ws(":", *[F.col(g).cast("string") for g in groups])
    series = df.filter(X.all_valid([*groups, time])).groupBy(name.alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), vec.alias("v")))), lambda s: s["v"]).alias("s"))
    count = series.agg(F.greatest(F.lit(4), F.ceil(F.count(F.lit(1)) / F.lit(64))).cast("int").alias("_n"))
    series = series.join(F.broadcast(count), how="cross")  # one row
    blk = F.pmod(F.xxhash64("name"), F.col("_n")).cast("int")
    every = F.sequence(F.lit(0), F.col("_n") - 1)
    left = series.select(F.col("name").alias("a"), F.col("s").alias("sa"), blk.alias("p"), F.explode(every).alias("q"))
    right = series.select(F.col("name").alias("b"), F.col("s").alias("sb"), F.explode(every).alias("p"), blk.alias("q"))

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.array(list(a), float), np.array(list(b), float)
            out.append(dtw(a, b) if method == "dependent" else sum(dtw(a[:, i : i + 1], b[:, i : i + 1]) for i in range(a.shape[1])))
        return pd.Series(out)

    return left.join(right, ["p", "q"]).filter("a < b").select("a", "b", distance("sa", "sb").alias("distance"))


#: Pairs of groups (about 2,000 groups) that a tree is built of.
MOST_PAIRS = 2_000_000


def linkage_tree(pairs: DataFrame, method: str = "ward") -> DataFrame:
    """step, left, right, height, size: the tree over groups of a distance table (a, b, distance); leaves are names, merges `#step`."""
    rows = pairs.limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"linkage_tree: a tree of more than {MOST_PAIRS} pairs of groups is not built on one machine")
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = r.distance
    label = lambda i: names[i] if i < len(names) else f"#{i - len(names)}"
    out = [(k, label(int(a)), label(int(b)), float(h), int(s)) for k, (a, b, h, s) in enumerate(linkage(d, method))] if len(names) > 1 else []
    return pairs.sparkSession.createDataFrame(out, "step int, left string, right string, height double, size int")


# -- fates and transport --------------------------------------------------------------------------------------------------


def fate_cluster(df: DataFrame, rep: str, k: int = 10, n_iter: int = 100, centroid_method: str = "median", seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """row_id, terminal, visits, share, is_class: for each object the terminal objects that random walks through it reached.

    Walks start at the object nearest to the centroid; a step goes to one of the k nearest neighbours (itself counts as one) that is
    farther from the centroid, chosen by a hash of (seed, walk, step). The neighbour graph is found by blocks and written; each step joins
    the walks (n_iter rows) with it, until all have ended. Objects that no walk visits have no row."""
    from phenogrid.operators.neighbours import nearest

    mid = X.median("x") if centroid_method == "median" else F.avg("x")
    centre = [r.m for r in df.select(F.posexplode(rep).alias("i", "x")).groupBy("i").agg(mid.alias("m")).orderBy("i").collect()]
    gap = F.aggregate(F.zip_with(F.col(rep), F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
    far = df.select(F.col(row_id).alias("id"), gap.alias("far")).filter(F.col("far").isNotNull())
    near = nearest(df, row_id, F.col(rep), max(1, k - 1))
    out = near.join(far, "id").join(far.select(F.col("id").alias("other"), F.col("far").alias("far2")), "other").filter("far2 > far")
    graph = cut_plan(out.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("next")))
    first = far.orderBy("far", "id").first()
    if first is None:
        return df.select(row_id, F.col(row_id).alias("terminal"), F.lit(0).cast("long").alias("visits"), F.lit(0.0).alias("share"), F.lit(True).alias("is_class")).limit(0)
    walks = df.sparkSession.range(n_iter).select(F.col("id").alias("walk"), F.lit(0).alias("step"), F.lit(first.id).cast(df.schema[row_id].dataType).alias("at"))
    done = cut_plan(walks)
    now = done
    while True:
        pick = F.pmod(F.xxhash64(F.lit(seed), "walk", "step"), F.size("next")).cast("int")
        now = cut_plan(graph.join(F.broadcast(now), F.col("id") == F.col("at")).select("walk", (F.col("step") + 1).alias("step"), F.get("next", pick).alias("at")))  # n_iter rows at most
        if now.isEmpty():
            break
        done = done.unionByName(now)
    end = done.groupBy("walk").agg(F.max_by("at", "step").alias("terminal"))
    visits = done.join(end, "walk").groupBy("at", "terminal").agg(F.count(F.lit(1)).alias("visits"))
    w = Window.partitionBy("at")
    return visits.withColumn("share", F.col("visits") / F.sum("visits").over(w)).withColumn("is_class", F.row_number().over(w.orderBy(F.desc("visits"), "terminal")) == 1).select(F.col("at").alias(row_id), "terminal", "visits", "share", "is_class")


def transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The cheapest flow that meets demand from at most supply: successive shortest paths. Raises if demand exceeds supply."""
    if demand.sum() > supply.sum() + 1e-9:
        raise ValueError("transport: infeasible")
    n, m = cost.shape
    flow, left, need = np.zeros((n, m)), supply.astype(float).copy(), demand.astype(float).copy()
    while need.max() > 1e-12:
        dist, prev = np.full(n + m, np.inf), np.full(n + m, -1)
        dist[:n][left > 1e-12] = 0
        for _ in range(n + m):
            new = dist.copy()
            via = dist[:n, None] + cost
            i = via.argmin(0)
            better = via[i, np.arange(m)] < new[n:] - 1e-12
            new[n:][better], prev[n:][better] = via[i, np.arange(m)][better], i[better]
            back = np.where(flow > 1e-12, new[n:][None] - cost, np.inf)
            j = back.argmin(1)
            better = back[np.arange(n), j] < new[:n] - 1e-12
            new[:n][better], prev[:n][better] = back[np.arange(n), j][better], n + j[better]
            if (new == dist).all():
                break
            dist = new
        t = int(np.where(need > 1e-12, dist[n:], np.inf).argmin())
        path, at = [], n + t
        while prev[at] >= 0:
            path.append((int(prev[at]), at))
            at = int(prev[at])
        amount = min([need[t], left[at]] + [flow[v, u - n] for u, v in path if u >= n])
        for u, v in path:
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[at] -= amount
        need[t] -= amount
    return flow


def state_flows(df: DataFrame, state: str, time: str, rep: str) -> DataFrame:
    """time, next, source, target, flow, cost: for each frame and the one after it, the cheapest way to turn the one's shares of states into the other's.

    A step from one state to another costs the distance of their centroids, the means of `rep` over all rows of the state. Frames are
    solved each on its own; a problem is states by states. Rows without state or time take no part, rows without rep none in the centroids."""
    rows = df.filter(X.all_valid([state, time])).select(F.col(state).alias("s"), F.col(time).alias("t"), F.col(rep).cast("array<double>").alias("v"))
    means = rows.select("s", F.posexplode("v").alias("i", "x")).groupBy("s", "i").agg(F.avg("x").alias("m")).groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("m"))
    centre = {r.s: np.array(r.m, float) for r in means.collect()}  # a row for each state
    names = sorted(r.s for r in rows.select("s").distinct().collect())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    cost = np.array([[np.linalg.norm(centre[a] - centre[b]) if a in centre and b in centre else 0.0 if a == b else np.inf for b in names] for a in names]).reshape(len(names), len(names))
    cost[~np.isfinite(cost)] = cost[np.isfinite(cost)].max(initial=0) * 2 + 1  # states without a centroid are far from all
    shares = rows.groupBy("t", "s").count().groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("s", "count"))).alias("n"))
    pairs = shares.select("t", F.lead("t").over(Window.orderBy("t")).alias("next"), "n", F.lead("n").over(Window.orderBy("t")).alias("m")).filter("next is not null")  # a row for each frame

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                a, z = (np.array([dict(x).get(s, 0) for s in names], float) for x in (r.n, r.m))
                flow = transport(a / a.sum(), z / z.sum() * (1 - 1e-12), cost)
                out += [(r.t, r.next, names[i], names[j], float(flow[i, j]), float(cost[i, j])) for i, j in zip(*np.nonzero(flow > 1e-11), strict=True)]
            yield pd.DataFrame(out, columns=["time", "next", "source", "target", "flow", "cost"])

    return pairs.mapInPandas(solve, f"time {kinds['t']}, next {kinds['t']}, source {kinds['s']}, target {kinds['s']}, flow double, cost double")
