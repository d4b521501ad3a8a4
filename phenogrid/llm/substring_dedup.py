"""Removal of long passages that an earlier document has, by compaction of a sparse de Bruijn graph.

Edges. A token k-mer is an edge of the graph. Of all k-mers only those are kept that are the smallest, by hash, in some
window of 50 words: k = 26, and 25 k-mers to a window. A window's smallest k-mer depends on its words alone, so two equal
windows keep the same edge, and about one k-mer in thirteen is stored.

Compaction. Edges that stand in one document only are dropped. Each repeated edge is tied by a join to its first source
coordinates: the smallest document and position where it stands. In a document, neighbouring edges whose first coordinates
are neighbours at the same distance in one document form a nonbranching path; since they are at most k words apart, the
path's words are equal to the words at the source from end to end. Windows inside a path whose source is a smaller document
are removed without another look.

Verification. Where a path ends or branches, windows reach beyond it. Those windows, and the windows of the same edges at
their source coordinates, are hashed in full (two 64-bit hashes of 50 words) and meet in a join that finds the smallest
document of each.

No group is ever collected: hot passages are joined on their edge, whose first coordinates are found with partial
aggregation; only what belongs to one document comes together.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Defined results: a null or empty text has no words. A document with a null id
neither gives nor loses words. Rows that share an id are no smaller than one another; each is judged by its own text.
An empty table gives an empty result. Other columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import BASE_B, WordHashes, materialise, rolling, table

WINDOW = 50
EDGE = WINDOW // 2 + 1
_RUN = WINDOW - EDGE + 1  # k-mers of a window
_BATCH_CHARS = 1_500_000


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def edges_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined words of several texts: hashes of all k-mers, the smallest in each window (0 where a window crosses texts), and which are kept."""
    n = len(hashes)
    if n < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    kmers = rolling(hashes, EDGE) | np.uint64(1)
    low = _slide(kmers, _RUN, np.minimum)
    valid = np.zeros(len(low) + 1, np.int8)
    long = ends - starts >= WINDOW
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - WINDOW + 1, -1)
    low = np.where(np.cumsum(valid)[:-1] > 0, low, np.uint64(0))
    pad = np.zeros(_RUN - 1, np.uint64)
    return kmers, low, _slide(np.concatenate([pad, low, pad]), _RUN, np.maximum)[: len(kmers)] == kmers


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at])
        while end < len(texts) and chars + len(texts[end]) <= _BATCH_CHARS:
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind (tells the texts of one id apart), text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("id"), F.hash(text).alias("kind"), text.alias("text"))


def edges(named: DataFrame) -> DataFrame:
    """edge, id, kind, pos of the kept k-mers of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            ids, kinds = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            texts = [x.encode() for x in b.column(2).to_pylist()]
            for at, end in _batches(texts):
                words = [t.split() for t in texts[at:end]]
                length = np.array([len(w) for w in words])
                ends = np.cumsum(length)
                starts = ends - length
                kmers, _, kept = edges_of(hashes.of([x for w in words for x in w]), starts, ends)
                pos = np.flatnonzero(kept)
                doc = np.searchsorted(ends, pos, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(kmers[pos].view(np.int64)), pa.array(ids[at:end][doc].astype(np.int64)), pa.array(kinds[at:end][doc].astype(np.int32)), pa.array((pos - starts[doc]).astype(np.int32))], ["edge", "id", "kind", "pos"])

    return named.filter("id is not null").mapInArrow(run, "edge long, id long, kind int, pos int")


def paths(kept: DataFrame) -> DataFrame:
    """Each occurrence of a repeated edge with its source (src, src_pos) and the path it lies on (words first to last, end exclusive)."""
    first = kept.groupBy("edge").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last"))
    first = first.filter(F.col("first.id") != F.col("last")).select("edge", F.col("first.id").alias("src"), F.col("first.pos").alias("src_pos"))
    # written, so that the join below deals out both sides itself and can split an edge that stands very often
    first = materialise(first, "sources")
    found = kept.join(first, "edge").withColumn("shift", F.col("pos") - F.col("src_pos"))
    order = Window.partitionBy("id", "kind").orderBy("pos")
    before = F.lag(F.struct("src", "shift", "pos")).over(order)
    breaks = F.coalesce((before["src"] != F.col("src")) | (before["shift"] != F.col("shift")) | (F.col("pos") - before["pos"] > EDGE), F.lit(True))
    found = found.withColumn("path", F.sum(breaks.cast("int")).over(order))
    whole = Window.partitionBy("id", "kind", "path")
    return found.withColumn("start", F.min("pos").over(whole)).withColumn("end", (F.max("pos").over(whole) + EDGE).cast("int"))


def removed_words(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words lie in the spans."""
    step = np.zeros(n + 1, np.int32)
    for a, b in spans:
        step[a] += 1
        step[min(b, n)] -= 1
    return np.cumsum(step[:-1]) > 0


def _result(words: list[bytes], gone: np.ndarray | None) -> tuple[int, str]:
    if gone is None or not gone.any():
        return 0, hashlib.sha256(b" ".join(words)).hexdigest()
    left = [words[i] for i in np.flatnonzero(~gone).tolist()]
    return len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


_WORK = "id long, kind int, n_words long, n_removed long, kept_sha256 string, kept_text string, text string, spans array<int>, w1 array<long>, w2 array<long>, at array<int>"


def _look(keep_text: bool):
    """For each text and its jobs (0, start, end: a path to remove; 1, pos: an edge to verify): the final row, or the windows to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out: list[tuple] = []
            for i, kind, text, jobs in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                words = text.encode().split()
                n = len(words)
                spans = sorted({(j["a"], j["b"]) for j in jobs or () if not j["verify"]})
                gone = removed_words(n, spans) if spans else None
                spots = sorted({j["a"] for j in jobs or () if j["verify"]})
                if spots:
                    h = hashes.of(words)
                    kmers, low, _ = edges_of(h, np.array([0]), np.array([n]))
                    # windows whose smallest k-mer is one of the edges, but for those that lie in a removed path
                    ask = np.zeros(len(low), bool)
                    for p in spots:
                        s = max(0, p - _RUN + 1)
                        ask[s : p + 1] |= low[s : p + 1] == kmers[p]
                    for a, e in spans:
                        ask[a : e - WINDOW + 1] = False
                    at = np.flatnonzero(ask)
                    if len(at):
                        w1, w2 = rolling(h, WINDOW).view(np.int64)[at], rolling(h, WINDOW, BASE_B).view(np.int64)[at]
                        out.append((i, kind, n, None, None, None, text, [x for s in spans for x in s], w1, w2, at.astype(np.int32)))
                        continue
                n_removed, sha = _result(words, gone)
                kept = None
                if keep_text:
                    kept = text if not n_removed else b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
                out.append((i, kind, n, n_removed, sha, kept, None, None, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [()] * 11
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _WORK.split(", ")])

    return run


def _finish(keep_text: bool):
    """For each text with verified windows: the final row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, spans, found in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                words = text.encode().split()
                every = list(zip(spans[::2], spans[1::2], strict=True)) + [(s, s + WINDOW) for s in found or ()]
                gone = removed_words(len(words), every)
                n_removed, sha = _result(words, gone)
                kept = None
                if keep_text:
                    kept = text if not n_removed else b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
                out.append((i, len(words), n_removed, sha, kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, and with keep_text kept_text (a text that loses nothing stays as it is)."""
    named = _named(docs, id_col, text_col)
    kept = materialise(edges(named), "edges")
    found = materialise(paths(kept), "paths")
    inside = (F.col("start") <= F.col("pos") - (_RUN - 1)) & (F.col("end") >= F.col("pos") + WINDOW)
    loose = found.filter(~inside)
    at_source = found.filter((F.col("id") == F.col("src")) & (F.col("pos") == F.col("src_pos")) & inside).join(loose.select("edge").distinct(), "edge", "left_semi")

    def job(verify: bool, a: Column, b: Column) -> Column:
        return F.struct(F.lit(verify).alias("verify"), a.cast("int").alias("a"), b.cast("int").alias("b")).alias("job")

    drop = found.filter((F.col("src") < F.col("id")) & (F.col("end") - F.col("start") >= WINDOW) & (F.col("pos") == F.col("start")))
    jobs = drop.select("id", "kind", job(False, F.col("start"), F.col("end"))).unionByName(loose.unionByName(at_source).select("id", "kind", job(True, F.col("pos"), F.col("pos"))))
    jobs = jobs.groupBy("id", "kind").agg(F.collect_list("job").alias("jobs"))
    work = materialise(named.join(jobs, ["id", "kind"], "left").select("id", "kind", "text", "jobs").mapInArrow(_look(keep_text), _WORK), "work")
    windows = work.filter("at is not null").select("id", "kind", F.explode(F.arrays_zip("w1", "w2", "at")).alias("w")).select("id", "kind", "w.w1", "w.w2", "w.at")
    windows = materialise(windows, "windows")
    low = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("w1", "w2", "low")
    low = materialise(low, "lowest")
    hits = windows.join(low, ["w1", "w2"]).filter(F.col("low") < F.col("id")).groupBy("id", "kind").agg(F.collect_list("at").alias("found"))
    open_ = work.filter("at is not null").select("id", "kind", "text", "spans").join(hits, ["id", "kind"], "left").select("id", "text", "spans", "found")
    out = work.filter("at is null").select("id", "n_words", "n_removed", "kept_sha256", "kept_text").unionByName(open_.mapInArrow(_finish(keep_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))
    return out if keep_text else out.drop("kept_text")


def op4_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
wins AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS f FROM wins GROUP BY h),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM wins JOIN firsts USING (h) WHERE f < doc_id),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM e ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
