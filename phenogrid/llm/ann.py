"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample of `SAMPLE_ROWS` vectors: the sample's neighbour graph is cut into parts of equal size (median
splits along main directions, then moves and swaps that put nodes with most of their neighbours, under a size limit). A
small network with one hidden layer learns which parts a vector's neighbours lie in. The number of parts that a query
probes is the smallest at which the network reaches `TARGET_RECALL` on sample vectors that it was not trained on; data
without structure thus gets many probes rather than bad results. Parts have about PART_ROWS rows; a table that
needs more than MAX_PARTS of them has two levels: each part is cut again in the same way, from a sample of its own
rows that a task of its own fits on, so that the number of parts grows with the rows.

Search: every row is put in its most probable part. Parts are laid into blocks of about `BLOCK_ROWS` rows, queries into groups,
and each (block, query group) is a matrix product of the queries that probe a part of the block; the blocks' best meet in a window. Scores are
computed again for each pair that is returned, on the original vectors in double precision.

Of vectors that are equal in all components only the k + 1 smallest ids can be among a query's k nearest; the others leave
before the shuffle. So a vector that a third of all rows share is no hot spot, and no result changes.

Defined results: vectors that are null, zero, of another length than the most common (the shorter on ties), or hold a null
or non-finite component take no part; neither do rows with a null id. Ties go to the smaller id. An id that stands for
several rows is one candidate, with its best score, and never its own neighbour. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.functions.threads import one_thread
from phenogrid.llm.common import materialise, remove_table, table

SAMPLE_ROWS, TEST_ROWS = 8_192, 512
TARGET_RECALL = 0.94
#: Rows of a part; parts of a level at most; rows of a block; queries of a group.
PART_ROWS, MAX_PARTS, BLOCK_ROWS, GROUP_QUERIES = 64, 256, 8_192, 4_096
#: Blocks that a small table is cut into, if they then have as many rows.
FEW_BLOCKS, LEAST_BLOCK = 24, 512


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row (unit rows), in blocks."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12, slack: float = 0.1, seed: int = 1) -> np.ndarray:
    """Cut the neighbour graph into parts of nearly equal size with few edges between them."""
    n = len(x)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)

    def split(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        y = x[rows] - x[rows].mean(0)
        v = rng.normal(size=x.shape[1])
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-30
        left = count // 2
        order = rows[np.argsort(y @ v, kind="stable")]
        cut = len(rows) * left // count
        split(order[:cut], first, left)
        split(order[cut:], first + left, count - left)

    split(np.arange(n), 0, parts)
    limit = int(np.ceil(n / parts * (1 + slack)))
    src = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.concatenate([src, graph.ravel()]), np.concatenate([graph.ravel(), src])
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        votes = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            p, q = part[i], best[i]
            if size[q] < limit and rng.random() < 0.7:
                part[i] = q
                size[p] -= 1
                size[q] += 1
                moved += 1
        if moved < n // 1000:
            break
    return part


@dataclass
class Router:
    """The network: probabilities of parts for unit vectors. Fields are its weights, and the number of parts to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def energy(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, every: bool) -> np.ndarray:
        """Each row's parts to probe, or the first of them alone, from the most probable."""
        e = self.energy(x)
        return np.argsort(-e, axis=1, kind="stable")[:, : self.probes] if every else e.argmax(1)[:, None]


@dataclass
class Index:
    """The router of the whole table, and those of parts that are cut again."""

    root: Router
    children: dict[int, Router]
    width: int  # numbers of parts that a part's number stands before

    def parts(self, x: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, parts) that together say which parts each row (of length 1) probes, or lies in; parts has a column for each of a row's."""
        top = self.root.ranked(x, every)
        if not self.children:
            yield np.arange(len(x)), top * self.width
            return
        for p in np.unique(top):
            at = np.flatnonzero((top == p).any(1))
            yield at, p * self.width + (self.children[p].ranked(x[at], every) if p in self.children else np.zeros((len(at), 1), np.int64))


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 800, batch: int = 512, rate: float = 0.004, seed: int = 2) -> Router:
    """Fit the network to each row's distribution over parts, by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5 * 2, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for t in range(1, steps + 1):
        i = rng.integers(0, len(x), min(batch, len(x)))
        h = np.maximum(x[i] @ p[0] + p[1], 0)
        e = h @ p[2] + p[3]
        e = np.exp(e - e.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - target[i]) / len(i)
        gh = (g @ p[2].T) * (h > 0)
        for k, grad in enumerate((x[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
            grad = grad + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            p[k] = p[k] - rate * (1 - 0.9 * t / steps) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return Router(*p, probes=parts)


def fit(sample: np.ndarray, rows: int, k: int = 5, graph_k: int = 10, target_recall: float = TARGET_RECALL, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> Router:
    """A router from sample vectors, for a table of `rows` rows."""
    parts = int(min(max_parts, max(1, -(-rows // part_rows)), max(1, len(sample) // 32)))
    d = sample.shape[1] if sample.ndim == 2 else 1
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    x = scaled(sample)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    held = min(TEST_ROWS, len(x) // 8)
    test, x = x[:held], x[held:]
    graph = neighbours(x, min(graph_k, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    target /= target.sum(1, keepdims=True)
    router = train_router(x, target)
    # how far down a test vector's list of parts its true neighbours in the sample lie
    home = router.energy(x).argmax(1)
    near = np.argpartition(-(test @ x.T), min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
    order = np.argsort(-router.energy(test), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None], 1)
    depth = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    router.probes = int(depth[min(len(depth) - 1, int(np.ceil(target_recall * len(depth))))]) + 1
    return router


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine, so that squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """id and vec (the components as doubles, in bytes) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pc.equal(pc.fill_null(pc.list_value_length(b.column(1)), -1), dim)
            keep = pc.and_(keep, pc.is_valid(b.column(0)))
            ids, vecs = b.column(0).filter(keep), b.column(1).filter(keep)
            x = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) + 0.0
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            x = np.ascontiguousarray(x[fine])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"])

    named = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("v"))
    return named.mapInArrow(run, "id long, vec binary")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def packed(x: np.ndarray) -> bytes:
    """Vectors in bytes; in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if np.array_equal(short, x) else x).tobytes()


def unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * rows * dim else np.float64).astype(np.float64).reshape(rows, dim)


def best(query: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, asked: np.ndarray | None = None, column: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, id, score) of each query's k best rows of a block, and what ties with the last; of the rows i only for which asked[:, column[i]] holds."""
    query, x = scaled(query), scaled(x)
    a = query / np.linalg.norm(query, axis=1, keepdims=True)
    b = x / np.linalg.norm(x, axis=1, keepdims=True)
    for at in range(0, len(a), 256):
        s = a[at : at + 256] @ b.T
        s[query_ids[at : at + 256, None] == ids[None]] = -3
        if asked is not None:
            s[~asked[at : at + 256][:, column]] = -3
        low = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.full((len(s), 1), -2.0)
        i, j = np.nonzero((s >= low - 1e-9) & (s > -2.5))
        u, v = query[at + i], x[j]
        exact = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
        yield query_ids[at + i], ids[j], exact


def search(base: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows found for each row of base for which `queries` holds."""
    spark = base.sparkSession
    dims = base.select(F.size(vector_col).alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = dims[0] if dims else 1
    same = Window.partitionBy(F.sha2("vec", 256), "vec").orderBy("id")
    rows = materialise(vectors(base, id_col, vector_col, dim).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n"), "vectors")
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS + TEST_ROWS).toArrow()
    deep = total > max_parts * part_rows * 4  # parts of four times their size at one level
    aim = TARGET_RECALL ** (0.5 if deep else 1)
    index = Index(fit(matrix(drawn.column("vec"), dim), total, k, target_recall=aim, part_rows=part_rows, max_parts=max_parts), {}, max_parts)

    def routed(frame: DataFrame) -> DataFrame:
        """id, vec, part: the part that each row lies in."""
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            for b in batches:
                x, part = unit(matrix(b.column(1), dim)), np.zeros(b.num_rows, np.int32)
                for at, own in shared.value.parts(x, False) if len(x) else ():
                    part[at] = own[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part)], ["id", "vec", "part"])

        return frame.mapInArrow(run, "id long, vec binary, part int")

    placed = materialise(routed(rows), "placed")
    if deep:
        place = Window.partitionBy("part").orderBy(F.xxhash64("id"), "id")
        drawn = placed.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= SAMPLE_ROWS + TEST_ROWS)
        sizes = F.broadcast(placed.groupBy("part").agg(F.count("*").alias("n")))  # at most MAX_PARTS rows

        def fit_part(group: pa.Table) -> pa.Table:
            one_thread()
            group = group.sort_by("place")
            r = fit(matrix(group.column("vec"), dim), group.column("n")[0].as_py(), k, target_recall=aim, part_rows=part_rows, max_parts=max_parts)
            small = Router(*[w.astype(np.float32) for w in (r.w1, r.b1, r.w2, r.b2)], r.probes)
            return pa.table({"part": group.column("part").slice(0, 1), "router": pa.array([pickle.dumps(small)], pa.binary())})

        fitted = drawn.join(sizes, "part").filter(F.col("n") > part_rows).groupBy("part").applyInArrow(fit_part, "part int, router binary")
        index.children = {r[0] // max_parts: pickle.loads(r[1]) for r in fitted.collect()}  # at most MAX_PARTS routers of bounded size
        first, placed = placed, materialise(routed(rows), "placed")
        remove_table(first)
    wanted = vectors(base.filter(queries), id_col, vector_col, dim)
    # parts in order of number are laid into blocks of about the same size; a part of more rows than a block is dealt over several
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # at most MAX_PARTS * MAX_PARTS
    block_rows = max(1, min(BLOCK_ROWS, max(LEAST_BLOCK, total // FEW_BLOCKS)))
    first, spread, held, at = [], [], 0, 0
    for _, n in sizes:
        if held and held + n > block_rows:
            held, at = 0, at + 1
        first.append(at)
        spread.append(-(-n // block_rows))
        held += n
        if spread[-1] > 1:
            held, at = 0, at + spread[-1]
    numbers = np.array([p for p, _ in sizes], np.int64)
    where = spark.createDataFrame(pa.table({"part": pa.array(numbers, pa.int32()), "first": pa.array(first, pa.int32()), "spread": pa.array(spread, pa.int32())}))
    in_block: dict[int, np.ndarray] = {}  # places in `numbers` of the parts of each block
    for i, (b, w) in enumerate(zip(first, spread, strict=True)):
        for c in range(b, b + w):
            in_block.setdefault(c, []).append(i)
    in_block = {b: np.array(v) for b, v in in_block.items()}

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("id", "ascending")])
        cells = [group.column("id").to_numpy().tobytes(), group.column("part").to_numpy().astype(np.int32).tobytes(), packed(matrix(group.column("vec"), dim))]
        return pa.table({"blk": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in zip(("ids", "parts", "vecs"), cells, strict=True)}})

    own = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("spread"))).cast("int")
    blocks = materialise(placed.join(F.broadcast(where), "part").select("id", "vec", "part", own.alias("blk")).groupBy("blk").applyInArrow(pack, "blk int, ids binary, parts binary, vecs binary"), "blocks")

    def found_in(queries: DataFrame, all_parts: bool) -> DataFrame:
        """query_id, rank, id, score: the best of the parts that each query (id, vec) asks, or of all.

        A group of queries goes to each block that holds a part of theirs, once, with a bit for each query and part; the block goes to each
        group, once. So what is shuffled does not grow with the parts that a query probes, and a task holds a block and a group."""
        shared = spark.sparkContext.broadcast(index)
        groups = max(1, -(-queries.count() // GROUP_QUERIES))

        def ask(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            given = pa.Table.from_batches(list(batches)).sort_by("id")
            ids, x = given.column("id").to_numpy(), matrix(given.column("vec"), dim)
            asked = np.full((len(x), len(numbers)), all_parts)
            for rows_at, probed in () if all_parts else shared.value.parts(unit(x), True):
                place = np.minimum(np.searchsorted(numbers, probed), len(numbers) - 1)
                there = numbers[place] == probed  # others hold no rows
                asked[np.broadcast_to(rows_at[:, None], probed.shape)[there], place[there]] = True
            for b, parts_at in in_block.items():
                mine = asked[:, parts_at]
                some = mine.any(1)
                if some.any():
                    cells = [ids[some].tobytes(), packed(x[some]), np.packbits(mine[some]).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([key[0].as_py()], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["blk", "grp", "ids", "vecs", "asked"])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            one_thread()
            out = []
            if left.num_rows and right.num_rows:
                (q,), (r,) = left.to_pylist(), right.to_pylist()
                query_ids, ids = np.frombuffer(q["ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                query, x = unpacked(q["vecs"], len(query_ids), dim), unpacked(r["vecs"], len(ids), dim)
                here = numbers[in_block[q["blk"]]]
                asked = np.unpackbits(np.frombuffer(q["asked"], np.uint8), count=len(query_ids) * len(here)).reshape(len(query_ids), -1).astype(bool)
                column = np.searchsorted(here, np.frombuffer(r["parts"], np.int32))
                if asked.mean() > 0.25:
                    out = list(best(query, query_ids, x, ids, k, asked, column))
                else:  # few parts each: part by part
                    ends = np.searchsorted(column, np.arange(len(here) + 1))
                    for c, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        mine = asked[:, c]
                        if a < z and mine.any():
                            out += best(query[mine], query_ids[mine], x[a:z], ids[a:z], k)
            names, kinds = ["query_id", "id", "score"], (np.int64, np.int64, np.float64)
            return pa.table({n: np.concatenate([o[c] for o in out]) if out else np.empty(0, t) for c, (n, t) in enumerate(zip(names, kinds, strict=True))})

        dealt = queries.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("grp").applyInArrow(ask, "blk int, grp int, ids binary, vecs binary, asked binary")
        copied = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        keys = ["blk", "grp"]
        tasks = max(1, min(4_096, len(in_block) * groups))
        met = dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(copied.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score double")
        best_of = met.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return best_of.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    found = found_in(wanted, False)
    if index.children or index.root.probes < index.root.parts:
        # a query whose parts hold fewer than k candidates asks all parts; parts of even size leave such queries to tiny or odd tables
        found = materialise(found, "found")
        full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
        short = materialise(wanted.join(full, "id", "left_anti"), "short")
        if not short.isEmpty():
            found = found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(found_in(short, True))
    return found


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")
