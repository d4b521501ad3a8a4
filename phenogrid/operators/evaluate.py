"""Similarity of aggregated profiles, reproducibility of replicates and effect of treatments.

Pairs are formed in blocks: rows get one of `blocks` numbers, and a pair of blocks is a key, so the quadratic part is work that any
number of executors can share. Rows here are wells or treatments, not objects.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions.scratch import cut
from phenogrid.functions.threads import one_thread


METHODS = ("pearson", "spearman", "kendall", "euclidean", "cityblock", "mahalanobis")


def _ranked(x: np.ndarray) -> np.ndarray:
    """Mean ranks within each row."""
    out = np.empty(x.shape)
    for at in range(0, len(x), 256):
        y = x[at : at + 256]
        out[at : at + 256] = (y[:, None] < y[:, :, None]).sum(2) + ((y[:, None] == y[:, :, None]).sum(2) + 1) / 2
    return out


def _signs(x: np.ndarray) -> np.ndarray:
    """Signs of the differences of all pairs of places: their cosine is Kendall's tau-b."""
    i, j = np.triu_indices(x.shape[1], 1)
    return np.sign(x[:, i] - x[:, j])


def prepared(x: np.ndarray, method: str) -> np.ndarray:
    """Vectors whose products (correlations) or distances are the similarities; NaN where constant."""
    if method not in ("pearson", "spearman", "kendall"):
        return x
    x = x - x.mean(1, keepdims=True) if method == "pearson" else _ranked(x) - (x.shape[1] + 1) / 2 if method == "spearman" else _signs(x)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    with np.errstate(all="ignore"):
        return np.where(size > 0, x / size, np.nan)


def compared(x: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """Similarities of all rows of x with all of y, from prepared vectors."""
    if method in ("pearson", "spearman", "kendall"):
        return x @ y.T
    if x.shape[1] > NARROW and method != "cityblock":
        return _apart(x, y)
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        gap = a[:, None] - b[None]
        out += np.abs(gap) if method == "cityblock" else gap * gap
    return out if method == "cityblock" else np.sqrt(out)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by a matrix product; those that are small beside the vectors, where a product loses digits, are taken from the difference."""
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    sq = size - 2 * (x @ y.T)
    i, j = np.nonzero(sq < 0.1 * size)
    for at in range(0, len(i), SLICE_PAIRS // 16):
        k, m = i[at : at + SLICE_PAIRS // 16], j[at : at + SLICE_PAIRS // 16]
        sq[k, m] = ((x[k] - y[m]) ** 2).sum(1)
    return np.sqrt(np.maximum(sq, 0))


def _tau(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kendall's tau-b from signs, whose products are whole numbers: exact in single precision."""
    with np.errstate(all="ignore"):
        tau = (x @ y.T) / np.sqrt(np.outer(np.abs(x).sum(1, dtype=float), np.abs(y).sum(1, dtype=float)))
    return np.where(np.isfinite(tau), tau, np.nan)


#: Vectors up to so many components are compared component by component; rows of a packed block; fewest blocks of a table that is worth it; pairs that a task compares and passes on at a time.
NARROW, PACK_ROWS, FEW_BLOCKS, SLICE_PAIRS = 8, 16_384, 8, 1_000_000


def _packed(rows: DataFrame, labels: Sequence[str], blocks: int, turn: np.ndarray | None) -> DataFrame:
    """blk, head (id and labels), width, body (vectors; single precision where that loses nothing) of rows (id, labels, v), in a row for each block."""

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = _matrix(group.column("v"))
        x = x if turn is None or x.shape[1] != len(turn) else x @ turn.T
        short = x.astype(np.float32)
        head = pa.BufferOutputStream()
        with pa.ipc.new_stream(head, group.select(["id", *labels]).schema) as out:
            out.write_table(group.select(["id", *labels]))
        body = short if np.array_equal(short, x, equal_nan=True) else x
        return pa.table({"blk": pa.array([key[0].as_py()], pa.int32()), "head": pa.array([head.getvalue().to_pybytes()], pa.binary()), "width": pa.array([x.shape[1]], pa.int32()), "body": pa.array([body.tobytes()], pa.binary())})

    dealt = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("blk").applyInArrow(pack, "blk int, head binary, width int, body binary")


def _unpacked(row: dict) -> tuple[pa.Table, np.ndarray]:
    head = pa.ipc.open_stream(row["head"]).read_all().combine_chunks()
    x = np.frombuffer(row["body"], np.float32 if len(row["body"]) == 4 * row["width"] * head.num_rows else np.float64)
    return head, x.reshape(head.num_rows, row["width"])


def similarity(df: DataFrame, labels: Sequence[str], vector: Column, method: str = "pearson", row_id: str = "row_id", block_rows: int = 512, code_compatible: bool = False) -> DataFrame:
    """a, b (row ids, a < b), <label>_a, <label>_b, sim. `mahalanobis` uses the inverse covariance of all rows, or with code_compatible the city-block distance.

    Rows are packed into blocks of block_rows to PACK_ROWS, and each pair of blocks is a task's: a row is shuffled once and then copied once for
    each block, inside its block's bytes, so that copies grow with rows / PACK_ROWS. A task compares and passes on SLICE_PAIRS pairs at a time."""
    if method not in METHODS:
        raise ValueError(method)
    if method == "mahalanobis" and code_compatible:
        method = "cityblock"
    rows = df.select(F.col(row_id).alias("id"), *labels, vector.cast("array<double>").alias("v")).filter("id is not null")
    turn = None
    if method == "mahalanobis":
        turn, method = whitening(rows, "v"), "euclidean"
    count = rows.count()
    blocks = max(1, -(-count // PACK_ROWS), min(FEW_BLOCKS, -(-count // block_rows)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["a", "b", *[f"{c}_{x}" for x in "ab" for c in labels], "sim"]
    schema = f"a {kinds['id']}, b {kinds['id']}, " + "".join(f"`{c}_{x}` {kinds[c]}, " for x in "ab" for c in labels) + "sim double"

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        sides = {r["blk"]: _unpacked(r) for b in batches for r in b.to_pylist()}
        p, q = (k.as_py() for k in key)
        if p not in sides or q not in sides:
            return
        (one, x), (two, y) = sides[p], sides[q]
        if x.shape[1] != y.shape[1]:  # a side without any vector
            x, y = (np.full((len(u), 1), np.nan) if np.isnan(u).all() else u for u in (x, y))
            x, y = (np.full((len(u), max(x.shape[1], y.shape[1])), np.nan) if np.isnan(u).all() else u for u in (x, y))
        numbers = not pa.types.is_string(one.schema.field("id").type)
        ids, ids2 = (t.column("id").to_numpy() if numbers else np.array(t.column("id").to_pylist(), object) for t in (one, two))
        wide = min(len(y), 2048)
        for right in range(0, len(y), wide):
            ready = _ready(y[right : right + wide], method)
            tall = max(1, SLICE_PAIRS // len(ready))
            for left in range(0, len(x), tall):
                if p == q and left >= right + wide:
                    continue  # rows are in order of id
                mine = _ready(x[left : left + tall], method)
                sim = _tau(mine, ready) if method == "kendall" else compared(mine, ready, method)
                u, v = ids[left : left + tall], ids2[right : right + wide]
                if p == q:
                    i, j = np.nonzero(u[:, None] < v[None])
                    sim, swap = sim[i, j], np.zeros(len(i), bool)
                else:
                    i, j = (k.ravel() for k in np.indices(sim.shape, np.int32))
                    sim, swap = sim.ravel(), (u[:, None] > v[None]).ravel()
                    if (u[:, None] == v[None]).any():
                        keep = u[i] != v[j]
                        i, j, sim, swap = i[keep], j[keep], sim[keep], swap[keep]
                first, second = np.where(swap, j + len(u), i), np.where(swap, i, j + len(u))
                both = {c: pa.concat_arrays([one.column(c).chunk(0).slice(left, len(u)), two.column(c).chunk(0).slice(right, len(v))]) for c in ["id", *labels]}
                ends = [both["id"].take(pa.array(k)) for k in (first, second)]
                yield pa.RecordBatch.from_arrays([*ends, *[both[c].take(pa.array(k)) for k in (first, second) for c in labels], pa.array(sim, pa.float64(), mask=np.isnan(sim))], names)

    packed = cut(_packed(rows, labels, blocks, turn))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    met = packed.withColumn("o", F.explode(every)).select(F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "head", "width", "body")
    return met.repartition(min(blocks * (blocks + 1) // 2, 4_096), "p", "q").groupBy("p", "q").applyInArrow(run, schema)


def _ready(x: np.ndarray, method: str) -> np.ndarray:
    return _signs(x).astype(np.float32) if method == "kendall" else prepared(x.astype(float), method)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; NaN where missing."""
    given = column.to_pylist()
    width = max((len(x) for x in given if x), default=1)
    return np.array([[np.nan if y is None else y for y in u] if u else [np.nan] * width for u in given], float).reshape(-1, width)


def _blocks(rows: DataFrame, labels: Sequence[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, labels, v, p, q; of the right with a 2) of every pair of blocks p <= q."""
    blocks = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block_rows))).alias("_n"))
    rows = rows.join(F.broadcast(blocks), how="cross").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("_n")))  # one row
    every = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    left = rows.select("id", *labels, "v", F.col("blk").alias("p"), F.explode(every).alias("q")).filter("p <= q")
    right = rows.select(F.col("id").alias("id2"), *[F.col(c).alias(f"{c}_2") for c in labels], F.col("v").alias("v2"), F.explode(every).alias("p2"), F.col("blk").alias("q2")).filter("p2 <= q2")
    return left, right


#: Rows of a block whose similarities to another block are one matrix product; widest vectors whose products are summed by label; labels of a block; numbers that a task sums up before it passes them on.
PAIR_ROWS, MOST_WIDE, LABEL_ROWS, HELD_NUMBERS = 2048, 1024, 256, 30_000_000


def _label_sums(rows: DataFrame, labels: Sequence[str], method: str, wide: int) -> DataFrame:
    """pair_sums without pairs: of the unit vectors u of two labels, the sum of all u.w is (sum of u).(sum of w), and that of their squares the inner product of the sums of uu' and ww'.

    Each label's sums are made in one pass over the rows and met with the other labels', in blocks of labels."""
    upper = np.triu_indices(wide)
    scale = np.where(upper[0] == upper[1], 1.0, np.sqrt(2.0))  # so that products of half matrices are those of whole ones
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*labels).schema}
    held_schema = ", ".join(f"`{c}` {kinds[c]}" for c in labels) + ", part int, n long, blob binary"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        task, held = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            parts = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
            blobs = [np.concatenate([total, square[upper] * scale]).tobytes() for _, total, square in held.values()]
            made = pa.RecordBatch.from_arrays([*parts, pa.array([task] * len(keys), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array(blobs, pa.binary())], [*labels, "part", "n", "blob"])
            held.clear()
            return made

        for b in batches:
            t = pa.Table.from_batches([b])
            types = [b.schema.field(c).type for c in labels]
            x, step = _matrix(t.column("v")), max(1, HELD_NUMBERS // wide**2)
            x = np.concatenate([prepared(x[i : i + step], method) for i in range(0, len(x), step)]) if len(x) else x
            order: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[t.column(c).to_pylist() for c in labels], strict=True)):
                order.setdefault(k, []).append(i)
            for k, at in order.items():
                part = x[at]
                part = part[np.isfinite(part).all(1)]
                n, total, square = held.get(k, (0, 0.0, 0.0))
                held[k] = (n + len(part), total + part.sum(0), square + part.T @ part)
            if len(held) * wide * wide > HELD_NUMBERS:
                yield out()
        if held:
            yield out()

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        blob = sum(np.frombuffer(x) for x in group.column("blob").to_pylist()).tobytes()
        first = group.slice(0, 1)
        return first.set_column(group.column_names.index("n"), "n", pa.array([sum(group.column("n").to_pylist())], pa.int64())).set_column(group.column_names.index("blob"), "blob", pa.array([blob], pa.binary()))

    sums = rows.select(*labels, "v").mapInArrow(tally, held_schema)
    for parts in (256, 1):
        sums = sums.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy(*labels, "part").applyInArrow(add, held_schema)
    per = cut(sums.filter("n > 0").select(F.to_json(F.struct(*labels)).alias("id"), *labels, F.struct("n", "blob").alias("v")))
    left, right = _blocks(per, labels, LABEL_ROWS)
    names = [f"{c}_{x}" for x in "ab" for c in labels] + ["n", "total", "squares"]

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        one_thread()
        types = [one.schema.field(c).type for _ in "ab" for c in labels] + [pa.int64(), pa.float64(), pa.float64()]
        if not one.num_rows or not two.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        (n, x), (m, y) = ((np.array([v["n"] for v in t.column(c).to_pylist()]), np.array([np.frombuffer(v["blob"]) for v in t.column(c).to_pylist()])) for t, c in ((one, "v"), (two, "v2")))
        total, squares, count = x[:, :wide] @ y[:, :wide].T, x[:, wide:] @ y[:, wide:].T, np.outer(n, m)
        ids, ids2 = np.array(one.column("id").to_pylist(), object), np.array(two.column("id2").to_pylist(), object)
        own = ids[:, None] == ids2[None]
        each = np.broadcast_to(n[:, None].astype(float), own.shape)  # unit vectors: their squared lengths sum up to their number
        count, total, squares = np.where(own, count - each, count), np.where(own, total - each, total), np.where(own, squares - each, squares)
        half = np.where(own, 0.5, 1.0)
        use = (own | (ids[:, None] < ids2[None]) if one.column("p")[0] == one.column("q")[0] else np.ones_like(own)) & (count > 0)
        i, j = np.nonzero(use)
        sides = [one.column(c).combine_chunks().take(pa.array(i)) for c in labels] + [two.column(f"{c}_2").combine_chunks().take(pa.array(j)) for c in labels]
        return pa.table([*sides, pa.array((count * half)[i, j].astype(np.int64)), pa.array((total * half)[i, j]), pa.array((squares * half)[i, j])], names=names)

    schema = ", ".join(f"`{c}_{x}` {kinds[c]}" for x in "ab" for c in labels)
    return left.groupBy("p", "q").cogroup(right.groupBy("p2", "q2")).applyInArrow(run, f"{schema}, n long, total double, squares double")


def pair_sums(df: DataFrame, labels: Sequence[str], vector: Column, method: str = "pearson", row_id: str = "row_id") -> DataFrame:
    """<label>_a, <label>_b, n, total, squares: what `reproducibility` and `effect` need of all pairs of rows (two rows' labels in either order), without a row for each pair.

    Pairs without a similarity do not count. Up to MOST_WIDE components no pair is formed: one pass over the rows sums up products by
    label. Beyond, two blocks of rows meet in one matrix product; the work is quadratic, what comes out is not."""
    if method not in ("pearson", "spearman"):
        raise ValueError(method)
    wide = df.select(F.size(vector).alias("n")).filter("n > 0").limit(1).collect()
    if wide and wide[0].n <= MOST_WIDE:
        return _label_sums(df.select(*labels, vector.cast("array<double>").alias("v")).filter(F.size("v") == wide[0].n), labels, method, wide[0].n)
    left, right = _blocks(df.select(F.col(row_id).alias("id"), *labels, vector.cast("array<double>").alias("v")), labels, PAIR_ROWS)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*labels).schema}
    schema = ", ".join(f"`{c}_{x}` {kinds[c]}" for x in "ab" for c in labels)

    def side(t: pa.Table, names: list[str], v: str) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Unit vectors (NaN: none), each row's number of its labels, and the labels."""
        x = prepared(_matrix(t.column(v)), method)
        seen: dict[tuple, int] = {}
        code = np.array([seen.setdefault(k, len(seen)) for k in zip(*[t.column(c).to_pylist() for c in names], strict=True)], np.int64)
        return x, code, list(seen)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        one_thread()
        sums: dict[tuple, list] = {}
        if one.num_rows and two.num_rows:
            (x, a, named), (y, b, named2) = side(one, list(labels), "v"), side(two, [f"{c}_2" for c in labels], "v2")
            sim = x @ y.T
            fits = np.isfinite(sim)
            if one.column("p")[0] == one.column("q")[0]:
                ids, ids2 = one.column("id").to_numpy(), two.column("id2").to_numpy()
                fits &= ids[:, None] < ids2[None]
            sim = np.where(fits, sim, 0.0)
            hot, hot2 = np.eye(len(named))[a], np.eye(len(named2))[b]
            n, total, squares = (hot.T @ m @ hot2 for m in (fits.astype(float), sim, sim * sim))
            for i, j in zip(*np.nonzero(n), strict=True):
                sums[named[i] + named2[j]] = [int(n[i, j]), float(total[i, j]), float(squares[i, j])]
        out = [[*k, *v] for k, v in sums.items()]
        names = [f"{c}_{x}" for x in "ab" for c in labels] + ["n", "total", "squares"]
        types = [one.schema.field(c).type for _ in "ab" for c in labels] + [pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)

    met = left.groupBy("p", "q").cogroup(right.groupBy("p2", "q2")).applyInArrow(run, f"{schema}, n long, total double, squares double")
    return met.groupBy(*[f"{c}_{x}" for x in "ab" for c in labels]).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])


def _mean(pairs: DataFrame) -> Column:
    return F.avg("sim") if "sim" in pairs.columns else X.div(F.sum("total"), F.sum("n"))


def _deviation(pairs: DataFrame) -> Column:
    """Of the sample."""
    if "sim" in pairs.columns:
        return F.stddev_samp("sim")
    n = F.sum("n")
    return F.sqrt(X.div(F.greatest(F.sum("squares") - X.div(F.sum("total") * F.sum("total"), n), F.lit(0.0)), F.nullif(n - 1, F.lit(0))))


def whitening(rows: DataFrame, vector: str) -> np.ndarray:
    """The inverse root of the vectors' covariance: distances of vectors times it are Mahalanobis distances. d x d numbers go to the driver."""
    from phenogrid.operators.batch import covariance, inverse_root

    n = rows.select(F.size(vector)).first()
    n = n[0] if n else 0
    names = [f"_{i}" for i in range(n)]
    wide = rows.select(*[F.get(vector, F.lit(i)).alias(c) for i, c in enumerate(names)])
    _, cov, _ = covariance(wide, names, sample=True)
    return inverse_root(cov, 1e-12)


def _same(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return out


def reproducibility(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, mean_sim (of the condition's replicate pairs), z against all pairs of different conditions, percentile. pairs: of `similarity` or `pair_sums`."""
    null = pairs.filter(~_same(groups)).agg(_mean(pairs).alias("_m"), _deviation(pairs).alias("_s"))
    per = pairs.filter(_same(groups)).groupBy(*[F.col(f"{c}_a").alias(c) for c in groups]).agg(_mean(pairs).alias("mean_sim"))
    return _scored(per.join(F.broadcast(null), how="cross"), groups, "mean_sim")  # one row


def _scored(df: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    z = X.div(F.col(score) - F.col("_m"), F.col("_s"))
    return df.select(*groups, score, z.alias("z"), X.phi(F.abs(z)).alias("percentile"))


def effect(pairs: DataFrame, group: str, others: Sequence[str] = (), control_id: object = "ctrl") -> DataFrame:
    """group, others, effect (mean similarity to controls), z, percentile. The null is of control-control pairs; with others, the mean over their levels of mean and deviation (pairs within a level)."""
    a, b = F.col(f"{group}_a") == F.lit(control_id), F.col(f"{group}_b") == F.lit(control_id)
    one = pairs.filter(a != b)
    keys = [F.when(a, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(c) for c in (group, *others)]
    per = one.groupBy(*keys).agg(_mean(pairs).alias("effect"))
    both = pairs.filter(a & b)
    if others:
        level = both.filter(_same(others)).groupBy(*[F.col(f"{c}_a").alias(c) for c in others]).agg(_mean(pairs).alias("_m"), _deviation(pairs).alias("_s"))
        null = level.agg(F.avg("_m").alias("_m"), F.avg("_s").alias("_s"))
    else:
        null = both.agg(_mean(pairs).alias("_m"), _deviation(pairs).alias("_s"))
    return _scored(per.join(F.broadcast(null), how="cross"), [group, *others], "effect")  # one row


def repro_effect(df: DataFrame, groups: Sequence[str], treat: str, vector: Column, others: Sequence[str] = (), method: str = "pearson", control_id: object = "ctrl", row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(reproducibility, effect) from one comparison of all rows, of which only sums by labels are kept."""
    labels = list(dict.fromkeys([*groups, treat, *others]))
    sums = cut(pair_sums(df, labels, vector, method, row_id))
    return reproducibility(sums, groups), effect(sums, treat, others, control_id)


def best_concentration(df: DataFrame, pairs: DataFrame, treat: str, conc: str, control_id: object = "ctrl") -> tuple[DataFrame, DataFrame]:
    """(treat, conc, effect percentile of each treatment's strongest concentration; the rows at it and all controls). Ties go to the smaller concentration."""
    scores = effect(pairs, treat, [conc], control_id)
    best = scores.groupBy(treat).agg(F.max_by(F.struct(conc, "effect", "percentile"), F.struct(F.round("percentile", 9), -F.col(conc))).alias("b")).select(treat, f"b.{conc}", "b.effect", "b.percentile")
    chosen = df.join(best.select(treat, conc), [treat, conc], "left_semi").unionByName(df.filter(F.col(treat) == F.lit(control_id)))
    return best, chosen


def quartiles(scores: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(*by, *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])
