"""Quality rules: counts of a text against fixed limits, and a logistic regression of hashed word and character n-grams.

A text's features are how often each n-gram stands in it, as a share of all of its kind: bytes in ones to fours, words alone and in
pairs, hashed into DIMS places. So a margin is a sum of six means of weights: one look-up for each n-gram, no vector is built, and a text
is read in pieces of PIECE bytes. The regression is fitted by L-BFGS, the rarer class weighing more, and its margins become probabilities through a
logistic curve fitted on margins of rows held out in turn. A text is kept if it fails no base rule and its probability of
being good is KEEP_SCORE at least.

The model is fitted on at most SAMPLE_ROWS labelled rows, those with the smallest hash of their id, one row for each id. A row's
features travel as (place, share) or as all DIMS shares, whichever is shorter, in half precision: at most 2 * DIMS bytes, which
bounds what the driver holds. All counts, features and scores cover whole texts of all rows.

Defined results: a null text counts as empty: no words, which fails a base rule. A text without n-grams of a kind has mean 0 there. A row
that is labelled more than once has its highest label; of rows that share an id, the fit sees the one whose features' bytes are the
smallest; labels other than 0 and 1 are ignored. With one class only, every score is that class's smoothed share; without labels it is 0.5.
Null ids are judged and count as text "" for the fold. Repeated rows are each judged. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from phenogrid.llm.common import BASE_A, WordHashes, col, crc_mod, free_name, rolling, table
from phenogrid.llm.quality import logistic

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 1_200
FOLDS, PARTS, PENALTY = 5, 3, 1e-4
#: Fixed limits: least words of a text, most repeated words in a hundred, words of a window, least probability of a good text.
LEAST_WORDS, MOST_REPEATED, WINDOW, KEEP_SCORE = 20, 30, 8, 0.5
#: Bits of the places of bytes in twos, threes and fours, of words and of pairs of words; where each kind begins.
BITS = (13, 14, 14, 12, 14)
BEGINS = tuple(int(x) for x in np.cumsum([0, 256, *(1 << b for b in BITS)]))
DIMS = BEGINS[-1]
PIECE = 1 << 20
_MIX = np.uint32(0x9E3779B1)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def byte_places(b: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, places) of the byte n-grams that start in [begin, end)."""
    yield 0, b[begin:end]
    x = b[begin:end].astype(np.uint32)
    for n in (2, 3, 4):
        more = b[begin + n - 1 : end + n - 1]
        x = x[: len(more)] << np.uint32(8) | more
        yield n - 1, ((x * _MIX) >> np.uint32(32 - BITS[n - 2])) + np.uint32(BEGINS[n - 1])


def word_places(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, places) of words and of pairs of words, from the words' hashes."""
    yield 4, (h >> np.uint64(64 - BITS[3])).astype(np.int64) + BEGINS[4]
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(BASE_A)
    yield 5, (pair >> np.uint64(64 - BITS[4])).astype(np.int64) + BEGINS[5]


def places(text: bytes, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    b = np.frombuffer(text, np.uint8)
    for begin in range(0, len(b), PIECE):
        yield from byte_places(b, begin, min(len(b), begin + PIECE))
    yield from word_places(hashes)


def shares(text: bytes, hashes: np.ndarray) -> bytes:
    """A text's features, packed: the first byte says whether places or all shares follow."""
    n = np.zeros(6)
    held: list[np.ndarray] = [np.zeros(DIMS)]
    for kind, at in places(text, hashes):
        held.append(at)
        n[kind] += len(at)
        if kind >= 3:  # the last kind of a piece
            held = [held[0] + np.bincount(np.concatenate(held[1:]), minlength=DIMS)]
    x = (held[0] / np.repeat(np.maximum(n, 1), np.diff(BEGINS))).astype(np.float16)
    at = np.flatnonzero(x)
    return b"p" + at.astype("<u2").tobytes() + x[at].tobytes() if 2 * len(at) <= DIMS else b"a" + x.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and shares."""
    if data[:1] == b"a":
        x = np.frombuffer(data, np.float16, offset=1)
        at = np.flatnonzero(x)
        return at, x[at].astype(np.float64)
    n = (len(data) - 1) // 4
    return np.frombuffer(data, "<u2", n, 1).astype(np.int64), np.frombuffer(data, np.float16, n, 1 + 2 * n).astype(np.float64)


def repeated_words(h: np.ndarray, width: int = WINDOW) -> int:
    """Words that stand in a window of `width` words which the text has twice or more."""
    if len(h) <= width:
        return 0
    windows = rolling(h, width)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(windows)] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """COUNTS of a text."""
    b = np.frombuffer(text, np.uint8)
    chars = symbols = 0
    for i in range(0, len(b), PIECE):
        part = b[i : i + PIECE]
        chars += int(((part & 0xC0) != 0x80).sum()) - int(_SPACE[part].sum())  # code points but white space
        symbols += int(_SYMBOLS[part].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else []
    return len(hashes), chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, text: bytes, hashes: np.ndarray) -> float:
        total, n = np.zeros(6), np.zeros(6)
        for kind, at in places(text, hashes):
            total[kind] += self.weights[at].sum()
            n[kind] += len(at)
        return self.bias + float((total / np.maximum(n, 1)).sum())

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -700, 700)))


class Rows:
    """Sparse rows, in order of rows for products with weights and in order of places for products with residuals. Each entry takes 24 bytes."""

    def __init__(self, data: list[bytes]):
        rows = [unpacked(x) for x in data]
        self.n = len(rows)
        self.at = np.concatenate([a.astype(np.int32) for a, _ in rows])
        self.x = np.concatenate([x.astype(np.float32) for _, x in rows])
        sizes = np.array([len(a) for a, _ in rows])
        self.full = np.flatnonzero(sizes)
        self.begins = (np.cumsum(sizes) - sizes)[self.full]
        by = np.argsort(self.at, kind="stable")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[by]
        self.turned = self.x[by]
        self.seen, self.firsts = np.unique(self.at[by], return_index=True)

    def margins(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(self.x * w[self.at], self.begins)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(DIMS)
        if len(self.seen):
            out[self.seen] = np.add.reduceat(self.turned * r[self.row], self.firsts)
        return out


def regression(rows: Rows, labels: np.ndarray, used: np.ndarray, penalty: float = PENALTY, steps: int = 100, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression with a squared penalty over the rows `used`, by L-BFGS. Each class weighs one half."""
    y = labels > 0
    each = np.where(y, 0.5 / (y & used).sum(), 0.5 / (~y & used).sum()) * used

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = rows.margins(w[:-1]) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
        r = each * (p - y)
        value = float((each * np.logaddexp(0, np.where(y, -m, m))).sum() + penalty / 2 * (w[:-1] @ w[:-1]))
        return value, np.append(rows.back(r) + penalty * w[:-1], r.sum())

    w = np.zeros(DIMS + 1)
    value, g = loss(w)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, parts = -g, []
        for s, t in reversed(kept):
            a = (s @ way) / (s @ t)
            way = way - a * t
            parts.append(a)
        way = way * ((kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]) if kept else 1 / max(np.abs(g).max(), 1e-12))
        for (s, t), a in zip(kept, reversed(parts), strict=True):
            way = way + (a - (t @ way) / (s @ t)) * s
        slope, size = float(g @ way), 1.0
        while True:  # halved until the loss falls enough
            after, g_after = loss(w + size * way)
            if after <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, t = size * way, g_after - g
        done = value - after < 1e-7
        w, value, g = w + s, after, g_after
        if s @ t > 1e-14:
            kept = [*kept[-memory + 1 :], (s, t)]
        if done:
            break
    return w[:-1], float(w[-1])


def fit(data: list[bytes], labels: np.ndarray) -> Model:
    zero = np.zeros(DIMS)
    if not len(data) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(data) + 2)
        return Model(zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    rows = Rows(data)
    margins, part = np.zeros(rows.n), np.arange(rows.n) % PARTS
    for k in range(PARTS):
        used = part != k
        if used.all() or labels[used].min() == labels[used].max():
            continue
        w, bias = regression(rows, labels, used)
        margins[~used] = (rows.margins(w) + bias)[~used]
    w, bias = regression(rows, labels, np.ones(rows.n, bool))
    return Model(w, bias, *logistic(margins, labels))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows whose id's crc32 mod `folds` is not 0."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    known = known.filter(crc_mod(F.col("id"), folds) != 0).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id")  # at most sample_rows rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            found = [shares(t, words.of(t.split())) for t in ((x or "").encode() for x in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["id", "found", "y"])

    kind = texts.schema["id"].dataType.simpleString()
    got = texts.mapInArrow(featurise, f"id {kind}, found binary, y int").groupBy("id").agg(F.min("found").alias("found"), F.min("y").alias("y")).toArrow().sort_by("id")
    return fit(got.column("found").to_pylist(), np.array(got.column("y").to_pylist(), np.int64))


def judge(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """The columns `carry` of docs, the COUNTS, base_failed, score and kept, under names that free_name makes differ from those of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [free_name(docs, x) for x in (*COUNTS, "base_failed", "score", "kept")]
    kinds = [*[LongType()] * len(COUNTS), BooleanType(), DoubleType(), BooleanType()]
    text_name = free_name(docs, "_judged")
    named = docs.select(*[col(c) for c in carry], col(text_col).alias(text_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = WordHashes(), shared.value
        for b in batches:
            found, margins = [], []
            for x in b.column(len(carry)).to_pylist():
                text = (x or "").encode()
                hashes = words.of(text.split())
                found.append(counts(text, hashes))
                margins.append(m.margin(text, hashes))
            n = np.array(found, np.int64).reshape(-1, len(COUNTS))
            failed = (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > MOST_REPEATED * n[:, 0])
            score = m.score(np.array(margins))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *map(pa.array, n.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_score))], [*carry, *names])

    schema = StructType([*named.schema.fields[: len(carry)], *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return named.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass the rules and the model, all columns unchanged."""
    return judge(docs, train(docs, labels), docs.columns).filter(col(free_name(docs, "kept"))).select(*[col(c) for c in docs.columns])


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judge(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", *COUNTS, "base_failed", "kept", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score")
