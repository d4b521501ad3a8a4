"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition sorts its digests into runs of at most RUN_ROWS rows and folds equal ones, so a group of copies that
holds a third of all rows leaves a partition as a few entries. The digest space is cut into ranges; a run's part of a range travels
as one row, in order. Within a range, runs meet in binomial rounds: `fan_in` = 2**k neighbouring partitions exchange their runs at
once, and the task that gets them merges pairs, pairs of pairs and so on (k rounds), until one run is left. Each merge keeps the
smallest identifier of what it verified as equal: digest, length and a second, independent hash must all agree.

Defined results: a null text counts as empty. A null id sorts after all others. Of rows that agree in text and id, the
first read stays. An empty table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm.common import SPACE, col, free_name, lean, materialise, table, task_count

#: Entries of one digest range that a merge task should hold at the root; rows that a first run takes in at most.
RANGE_ROWS, RUN_ROWS = 50_000, 200_000
_KEY = ["digest", "check", "length"]
# An entry is a string of bytes that sorts as it should: digest, check, length (which must agree), none, id, row (of which the smallest stays).
_SAME, _ENTRY = 48, 65


def _bytes(x: np.ndarray) -> np.ndarray:
    """Whole numbers as eight bytes each, which sort as the numbers do."""
    return (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)


def _numbers(x: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(x).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


class Run:
    """Sorted entries without equal ones, and how many rows each stands for."""

    def __init__(self, entries: np.ndarray, n: np.ndarray):
        head = entries.view(np.uint8).reshape(-1, _ENTRY)[:, :_SAME]
        first = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]).any(1)][: len(entries)])
        self.entries, self.n = entries[first], np.add.reduceat(n, first) if len(first) else n

    @classmethod
    def sorted_from(cls, digest: np.ndarray, check: np.ndarray, length: np.ndarray, none: np.ndarray, ids: np.ndarray, row: np.ndarray) -> Run:
        entries = np.concatenate([digest, _bytes(check), _bytes(length), none[:, None].astype(np.uint8), _bytes(ids), _bytes(row)], 1)
        entries = np.sort(np.ascontiguousarray(entries).view(f"S{_ENTRY}").ravel(), kind="stable")
        return cls(entries, np.ones(len(entries), np.int64))

    def merged(self, other: Run) -> Run:
        """One merge: every entry of the other run goes behind those that are not larger."""
        at = np.searchsorted(self.entries, other.entries, side="right") + np.arange(len(other.entries))
        entries, n = np.empty(len(self.entries) + len(other.entries), self.entries.dtype), np.empty(len(self.entries) + len(other.entries), np.int64)
        mine = np.ones(len(entries), bool)
        mine[at] = False
        entries[at], entries[mine], n[at], n[mine] = other.entries, self.entries, other.n, self.n
        return Run(entries, n)

    def pack(self) -> bytes:
        return self.entries.tobytes() + self.n.tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> Run:
        count = len(blob) // (_ENTRY + 8)
        return cls(np.frombuffer(blob, f"S{_ENTRY}", count), np.frombuffer(blob, np.int64, count, count * _ENTRY))


def merge_all(runs: list[Run]) -> Run:
    """Binomial rounds: neighbours merge in pairs, then pairs of pairs, until one run is left."""
    while len(runs) > 1:
        runs = [runs[i].merged(runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _first_runs(buckets: int):
    """One partition's rows (run, digest, check, length, id, row) to its sorted runs, cut by digest range; at most RUN_ROWS rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("id")
            digest = np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            whole = Run.sorted_from(digest, t.column("check").to_numpy(), t.column("length").to_numpy(), ids.is_null().to_numpy(), ids.fill_null(0).to_numpy(), t.column("row").to_numpy())
            prefix = whole.entries.view(np.uint8).reshape(-1, _ENTRY)[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
            kinds, begins = np.unique(prefix * buckets >> 32, return_index=True)
            parts = [Run(e, n).pack() for e, n in zip(np.split(whole.entries, begins[1:]), np.split(whole.n, begins[1:]), strict=True)]
            number = t.column("run")[0].as_py()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([number] * len(kinds), pa.int32()), pa.array(parts, pa.binary())], ["bucket", "run", "entries"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= RUN_ROWS:
                yield out()
        if held:
            yield out()

    return run


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    run = merge_all([Run.unpack(x) for x in group.column("entries").to_pylist()])
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([key[1].as_py()], pa.int32()), "entries": pa.array([run.pack()], pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of runs as rows."""
    for b in batches:
        for blob in b.column(0).to_pylist():
            run = Run.unpack(blob)
            u = run.entries.view(np.uint8).reshape(-1, _ENTRY)
            ids = pa.array(_numbers(u[:, 49:57]), mask=u[:, 48] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in u[:, :32]], pa.binary()), *(pa.array(_numbers(u[:, k : k + 8])) for k in (32, 40)), ids, pa.array(_numbers(u[:, 57:65])), pa.array(run.n)], ["digest", "check", "length", "id", "row", "n"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (the row's place in the read), digest, check, length of each normalised text."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return (
        docs.select(F.col(id_col).cast("long").alias("id"), text.alias("_text"))
        .select("id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("_text", 256)).alias("digest"), F.xxhash64("_text").alias("check"), F.length("_text").cast("long").alias("length"))
    )


def merge_runs(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """digest, check, length, id, row, n of every distinct text of `rows` (a materialised result of digests())."""
    buckets = max(1, -(-rows.count() // RANGE_ROWS))
    runs = max(1, task_count(rows))
    named = rows.select(F.spark_partition_id().alias("run"), "digest", "check", "length", "id", "row")
    held = named.mapInArrow(lean(_first_runs(buckets)), "bucket int, run int, entries binary")
    while True:
        runs = -(-runs // fan_in)
        held = held.withColumn("up", F.floor(F.col("run") / fan_in).cast("int")).groupBy("bucket", "up").applyInArrow(_merge, "bucket int, run int, entries binary")
        if runs <= 1:
            break
    return held.select("entries").mapInArrow(lean(_rows), "digest binary, check long, length long, id long, row long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """id, row, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(merge_runs(rows, fan_in).select(*_KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")), "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # At most 1000 groups can hold more than a thousandth of all rows: those are safe to broadcast, and no other key is hot.
    heavy = groups.filter(F.col("group_size") > max(1000, total // 1000))
    light = groups.filter(F.col("group_size") <= max(1000, total // 1000))
    joined = rows.join(F.broadcast(heavy), _KEY).unionByName(rows.join(F.broadcast(heavy.select(*_KEY)), _KEY, "left_anti").join(light, _KEY))
    return joined.select(
        "id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns unchanged.

    Only the ids of the rows that go are joined back. Where ids repeat, the copies of a row are told apart by their text's digest
    and numbered, so that exactly one row of each group of equal texts stays."""
    found = exact_dedup(docs, id_col, text_col)
    own, gone_id, gone_sha, stay = (free_name(docs, x) for x in ("_own", "_id", "_sha", "_stay"))
    gone = found.groupBy(F.col("id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).agg(F.sum(F.col("kept").cast("int")).alias(stay), F.count("*").alias("_rows")).filter(F.col(stay) < F.col("_rows")).drop("_rows")
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    marked = docs.withColumn(own, F.sha2(text, 256)).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_sha)), "left")
    columns = [col(c) for c in docs.columns]
    once = marked.filter(F.col(stay).isNull()).select(*columns)
    # rows that repeat in id and text and of which one stays: any of them, they can differ in other columns only
    twice = marked.filter(F.col(stay) == 1).dropDuplicates([id_col, own]).select(*columns)
    return once.unionByName(twice)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
