"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators of two kinds: of a text's bytes (1 to 3), and of its words' shapes (1 to 3), where a shape
says the word's case, last character, number of symbols, and whether it repeats the word before. Indicators are scaled by
the log-count ratio of the two classes, each row is brought to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. Margins become scores through a logistic curve fitted on margins of rows that were held out in turn.

The model is fitted on at most `SAMPLE_ROWS` labelled rows, those with the smallest hash of their id, one row for each id; a row's
features travel as a list or as DIMS bits, whichever is shorter, which bounds what the driver holds (SAMPLE_ROWS times 31 kB).
All else, features and scores, covers whole texts of all rows.

Defined results: a null text counts as empty; an empty text has no features and gets the score of the intercept. A row that
is labelled more than once has its highest label; of rows that share an id, the fit sees the one whose features' bytes are the
smallest; labels other than 0 and 1 are ignored. With one class only, every score
is that class's smoothed share; without labels it is 0.5. Null ids are scored and count as text "" for the fold. Repeated
rows are each scored. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from phenogrid.llm.common import col, crc_mod, free_name, hash64, lean, sliced, table

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 4_000
THRESHOLD = 0.3
#: Bytes of text that a scoring task takes out of a batch at a time.
BATCH_BYTES = 1_500_000
FOLDS = 5

# Where each kind of n-gram has its features.
_B2, _B3, _W1, _W2, _W3 = 256, 65_792, 196_864, 196_992, 213_376
DIMS = _W3 + (1 << 15)
_ONE, _TWO = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


class _Shapes(dict):
    """word -> hash with the shape in the low 6 bits."""

    def __missing__(self, word: bytes) -> int:
        letters = bytes(c for c in word if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
        upper = sum(65 <= c <= 90 for c in letters)
        lower = sum(97 <= c <= 122 for c in letters)
        case = 3 if not letters else 2 if not lower and upper > 1 else 1 if upper else 0
        last = word[-1]
        tail = 2 if last in b".,;:?" else 0 if chr(last).isalnum() and last < 128 else 1 if last >= 128 else 3
        symbols = min(3, sum(not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in word))
        value = self[word] = hash64(word) & ~63 | case << 4 | tail << 2 | symbols
        return value


def packed(found: np.ndarray) -> bytes:
    """Features as a list of numbers, or as bits if that is shorter; the first byte says which."""
    if 4 * len(found) <= DIMS // 8:
        return b"l" + found.astype(np.int32).tobytes()
    bits = np.zeros(DIMS, bool)
    bits[found] = True
    return b"b" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32, offset=1) if data[:1] == b"l" else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=DIMS)).astype(np.int32)


class Features:
    def __init__(self):
        self.shapes = _Shapes()
        self.mask = np.zeros(DIMS, bool)

    def of(self, text: bytes) -> np.ndarray:
        """The sorted features that a text has."""
        mask = self.mask
        b = np.frombuffer(text, np.uint8)
        mask[b] = True
        if len(b) > 1:
            pair = b[:-1].astype(np.uint32) << np.uint32(8) | b[1:]
            mask[pair + np.uint32(_B2)] = True
            if len(b) > 2:
                mask[((pair[:-1] * _ONE ^ b[2:] * _TWO) >> np.uint32(15)) + np.uint32(_B3)] = True
        if len(self.shapes) > 300_000:
            self.shapes.clear()
        words = text.split()
        h = np.fromiter(map(self.shapes.__getitem__, words), np.uint64, len(words))
        if len(h):
            s = (h & np.uint64(63)).astype(np.uint32)
            s[1:] += np.uint32(64) * (h[1:] == h[:-1])
            mask[s + np.uint32(_W1)] = True
            if len(s) > 1:
                pair = s[:-1] << np.uint32(7) | s[1:]
                mask[pair + np.uint32(_W2)] = True
                if len(s) > 2:
                    mask[((pair[:-1] * _ONE ^ s[2:] * _TWO) >> np.uint32(17)) + np.uint32(_W3)] = True
        found = np.flatnonzero(mask)
        mask[found] = False
        return found


@dataclass
class Model:
    weights: np.ndarray  # of each feature, times its ratio
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        norm = float(np.sqrt(r @ r))
        return self.bias + (float(self.weights[found].sum()) / norm if norm else 0.0)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -700, 700)))


class Rows:
    """Packed features of rows, unpacked as they are read."""

    def __init__(self, data: list[bytes]):
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.data[i])

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(unpacked, self.data)

    def where(self, keep: np.ndarray) -> Rows:
        return Rows([x for x, k in zip(self.data, keep, strict=True) if k])


def log_ratios(rows: Rows, labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)), with p and q the smoothed counts of the indicators in each class."""
    p, q = np.full(DIMS, smooth), np.full(DIMS, smooth)
    for found, y in zip(rows, labels, strict=True):
        (p if y else q)[found] += 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[(p + q) <= 2 * smooth + 2] = 0.0  # seen in fewer than three rows
    return r


def dual_descent(rows: Rows, labels: np.ndarray, ratios: np.ndarray, cost: float = 4.0, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """The hinge-loss SVM's weights and bias by dual coordinate descent. The rarer class costs more, by the inverse of its share."""
    y = np.where(labels > 0, 1.0, -1.0)
    norms = np.array([np.sqrt(r @ r) or 1.0 for r in (ratios[found] for found in rows)])
    share = labels.mean()
    top = np.where(labels > 0, cost / (2 * share), cost / (2 * (1 - share)))
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at = rows[i]
            x = ratios[at] / norms[i]
            gradient = y[i] * (w[at] @ x + bias) - 1
            square = float(x @ x) + 1  # the bias is one more feature
            new = min(max(alpha[i] - gradient / square, 0.0), top[i])
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[at] += step * y[i] * x
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton's method with smoothed labels."""
    up, down = (labels > 0).sum(), (labels == 0).sum()
    t = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 1), (p - t).sum()])
        d = p * (1 - p)
        h = np.array([[(d * margins * margins).sum() + 1e-3, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def fit(rows: Rows, labels: np.ndarray, parts: int = 3) -> Model:
    zero = np.zeros(DIMS)
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(rows) + 2)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    margins, part = np.zeros(len(rows)), np.arange(len(rows)) % parts
    for k in range(parts):
        inner = part != k
        a = rows.where(inner)
        if labels[inner].min() == labels[inner].max():
            continue
        r = log_ratios(a, labels[inner])
        w, bias = dual_descent(a, labels[inner], r)
        held = Model(w * r, r, bias, 1, 0)
        for i in np.flatnonzero(~inner):
            margins[i] = held.margin(rows[i])
    r = log_ratios(rows, labels)
    w, bias = dual_descent(rows, labels, r)
    return Model(w * r, r, bias, *logistic(margins, labels))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows whose id's crc32 mod `folds` is not 0."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    known = known.filter(crc_mod(F.col("id"), folds) != 0).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id")  # at most sample_rows rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [packed(features.of((x or "").encode())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["id", "found", "y"])

    kind = texts.schema["id"].dataType.simpleString()
    got = texts.mapInArrow(lean(featurise), f"id {kind}, found binary, y int").groupBy("id").agg(F.min("found").alias("found"), F.min("y").alias("y")).toArrow().sort_by("id")
    rows = Rows(got.column("found").to_pylist())
    return fit(rows, np.array(got.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id and score; with `carry` all columns of docs and the score under the name that `score_name` gives."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights, model.ratios, model.bias, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for b in batches:
            texts = sliced(b.column(b.schema.get_field_index(text_name)), BATCH_BYTES)
            got = m.score(np.array([m.margin(features.of(x.encode())) for part in texts for x in part]))
            if carry:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, last])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], ["id", "score"])

    if carry:
        text_name, last = text_col, score_name(docs)
        return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(last, DoubleType())]))
    text_name = "text"
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return named.mapInArrow(lean(run), f"id {named.schema['id'].dataType.simpleString()}, score double")


def score_name(docs: DataFrame) -> str:
    return free_name(docs, "_score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns unchanged."""
    return score(docs, train(docs, labels), carry=True).filter(F.col(score_name(docs)) >= threshold).select(*[col(c) for c in docs.columns])


def op5_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
