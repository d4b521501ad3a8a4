"""Language-model scores of texts: a log-bilinear neural model over words, trained by noise-contrastive estimation.

Event space. Tokens are lower-cased words and one end per text. The most frequent words of the training texts and the end are
units of their own, `own_words(tokens)` of them: a number that grows with the corpus. All other words, seen or not, fall
into SHAPES units by shape (kind of the last byte, first letter beyond ASCII; words of more than 64 bytes have a unit of their own);
within such a unit a word has its smoothed share of the unit's count, and one more event is the unseen word.

Model. P(word | two tokens before) = P(class | context) * P(unit | class, context) * share of the word in its unit. The first
two factors are log-bilinear: the context is a vector, the sum of the two tokens' vectors each through a matrix for its place; its
product with a class's or unit's vector plus a bias is the energy. The most frequent units are classes of one; the others, in the
order of their last letters, are cut into classes of about the square root of their number. So batched matrix products give
normalised log-probabilities at the cost of two square roots of the vocabulary for each token.

Training. Noise-contrastive estimation in numpy: each factor learns to tell the true class or unit from noise of the unigram
distribution; the noise's part of the gradient is its expectation, not a draw. Training goes in rounds: each task passes over its
texts of the round from the same parameters; then the tasks' moves are averaged in a tree (a word's vector by how often the
task met it), and the next round starts. The more tokens, the more rounds: every SLICE_TOKENS of them are a round of their own, a slice of
the texts by a hash (MOST_SLICES at most, then slices grow), so each text is in one. As many tasks share a round as
have TASK_TOKENS each, but no more than LEAST_TASKS or the cluster's cores: so steps in sequence grow with the corpus, and neither the
number of files nor of partitions decides what is learnt. Corpora of fewer than FEW_TOKENS tokens are one slice, passed over
MOST_PASSES times at most and in smaller steps, so that these too see enough of them.

What is collected is bounded: SHARED_WORDS words of at most 64 bytes with their counts, and the parameters (MAX_OWN words).
The other words' counts meet their documents in a join, in which no word is hot: the frequent ones are shared. Longer words
than 64 bytes stand for themselves by a digest. No score depends on which words are shared.

Defined results: a null text is empty: one token, the end. A null id counts as text "" for the held-out rule. Repeated rows
are each counted and scored. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions.threads import one_thread
from phenogrid.llm.common import crc_mod, materialise, table, task_count

#: Words whose counts every worker holds; words with vectors of their own at most.
SHARED_WORDS, MAX_OWN = 262_144, 65_536
#: Units of all other words: 64 shapes, and long words.
SHAPES = 65
SMOOTH = 0.1
END = b""  # not a word
#: Distinct words that a task counts before it passes them on.
FLUSH_WORDS = 300_000
#: Length of the vectors, classes of one unit, noise events for each true one, tokens of a step, rows of a product, first rate.
WIDTH, SINGLES, NOISE, BATCH, BLOCK, RATE = 16, 32, 100.0, 16_384, 512, 0.15
#: Tokens below which a corpus is passed over more than once, and how often at most; tokens of a slice, about, and most slices; tokens of a task in a round, and how many tasks share a round where the cluster has fewer cores.
FEW_TOKENS, MOST_PASSES, SLICE_TOKENS, MOST_SLICES, TASK_TOKENS, LEAST_TASKS = 4_000_000, 8, 1_000_000, 16, 200_000, 64


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without the end. (bytes.split and bytes.lower know ASCII only.)"""
    return (text or "").encode().lower().split()


def key_of(word: bytes) -> bytes:
    return word if len(word) <= 64 else b"\xff" + hashlib.sha256(word).digest()


def shape(key: bytes) -> int:
    """0 to 63: kind of the last byte (8) and the first letter beyond ASCII (8); 64: a long word's digest."""
    if key[0] == 0xFF:
        return 64
    last = key[-1]
    kind = 0 if 97 <= last <= 122 else 1 if last >= 128 else 2 if last == 46 else 3 if last == 44 else 4 if 48 <= last <= 57 else 5 + last % 3
    beyond = -1 if key.isascii() else next((key[i] * 64 + key[i + 1] for i in range(len(key) - 1) if key[i] >= 0xC0), -1)
    return kind * 8 + (1 + beyond % 7 if beyond >= 0 else 0)


def own_words(total: int) -> int:
    """How many words get vectors of their own in a corpus of `total` tokens."""
    return int(min(MAX_OWN, math.isqrt(total) // 2))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return got

    for b in batches:
        for text in b.column(0).to_pylist():
            held.update(tokens(text))
            held[END] += 1
            if len(held) > FLUSH_WORDS:
                yield out()
    if held:
        yield out()


@dataclass
class Lexicon:
    """What workers know of the words: the shared ones' counts and units; the units' classes, counts and masses."""

    words: list[bytes]  # shared; the end is the first
    counts: np.ndarray
    unit: np.ndarray  # of each shared word
    of_shape: np.ndarray  # the unit of each shape
    first: np.ndarray  # of each class the first of its units, and the number of units at the end
    tally: np.ndarray  # training tokens of each unit
    log_mass: np.ndarray  # of each unit: log10 of what the counts of a shape's words are shares of; 0 for words of their own

    @property
    def kind(self) -> type:
        """Of the numbers of units where they are stored or sorted: two bytes if these do."""
        return np.uint16 if len(self.tally) <= 1 << 16 else np.int32

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class _Numbers(dict):
    """word -> its place among the shared words; of any other word, minus its shape, minus 1."""

    def __missing__(self, word: bytes) -> int:
        key = key_of(word)
        value = self.get(key) if key is not word else None
        return -1 - shape(key) if value is None else value


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over the texts of docs (one column)."""
    return docs.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, total: int, shared: int = SHARED_WORDS) -> Lexicon:
    # a cut on the counts' scale instead of a top-k, whose candidates would all meet in one task; at most a few thousand levels
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)

    def least(most: int) -> int:
        """The lowest level at which at most so many words stand above."""
        held, low = 0, 1 << 30
        for at, n in sizes:
            held += n
            if held > most:
                break
            low = at
        return low

    top = counts.filter((level >= least(shared)) | (F.col("word") == END)).select("word", "c", level.alias("level")).toArrow().to_pylist()
    top = sorted((r for r in top if r["word"] != END), key=lambda r: (-r["c"], r["word"]))
    cut = least(min(own_words(total), shared))
    own = [r["word"] for r in top if r["level"] >= cut]
    taken = counts.sparkSession.sparkContext.broadcast(frozenset([END, *own]))

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, n, end = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64), 0
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in taken.value:
                    mass[shape(w)] += c
                    n[shape(w)] += 1
                elif w == END:
                    end += c
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES + 1), pa.int32()), pa.array([*mass, end], pa.int64()), pa.array([*n, 0], pa.int64())], ["s", "mass", "n"])

    mass, n = np.zeros(SHAPES + 1), np.zeros(SHAPES + 1)
    for s, m, k in counts.select("word", "c").mapInArrow(masses, "s int, mass long, n long").groupBy("s").agg(F.sum("mass"), F.sum("n")).collect():
        mass[s], n[s] = m, k
    # the units: the end, then the heaviest as classes of one, then the rest by their last letters in classes of even size
    units = [(r["c"], r["word"], None) for r in top[: len(own)]] + [(int(mass[s]), bytes([255, s]), s) for s in range(SHAPES)]
    units.sort(key=lambda x: (-x[0], x[1]))
    rest = sorted(units[SINGLES - 1 :], key=lambda x: (x[1][::-1], x[1]))
    units = [(int(mass[SHAPES]), END, None), *units[: SINGLES - 1], *rest]
    alone = len(units) - len(rest)
    cuts = np.linspace(alone, len(units), max(1, math.isqrt(len(rest))) + 1).astype(int)[1:] if rest else []
    place = {w: i for i, (_, w, s) in enumerate(units) if s is None}
    of_shape = np.zeros(SHAPES, np.int32)
    log_mass = np.zeros(len(units))
    for i, (c, _, s) in enumerate(units):
        if s is not None:
            of_shape[s] = i
            log_mass[i] = math.log10(c + SMOOTH * (n[s] + 1))  # and the unseen word
    words, freq = [END, *[r["word"] for r in top]], [int(mass[SHAPES]), *[r["c"] for r in top]]
    unit = np.array([place[w] if w in place else of_shape[shape(w)] for w in words], np.int32)
    return Lexicon(words, np.array(freq, np.int64), unit, of_shape, np.array([*range(alone + 1), *cuts], np.int64), np.array([u[0] for u in units], float), log_mass)


def annotate(docs: DataFrame, lex: Lexicon, id_col: str, text_col: str, folds: int) -> DataFrame:
    """For each text: its tokens' units, what the shared words give to both scores, and the other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_shared long, part double, rest double, units binary, words array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        numbers = _Numbers(zip(lex.words, range(len(lex.words)), strict=True))
        logs = np.log10(lex.counts + SMOOTH)
        in_shape = np.isin(lex.unit, lex.of_shape)
        for b in batches:
            n, known, part, rest, units, words, times = [], [], [], [], [], [], []
            for text in b.column(2).to_pylist():
                found = tokens(text)
                at = np.zeros(len(found) + 1, np.int32)  # the last is the end
                at[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                rare, held = np.flatnonzero(at < 0), at[at >= 0]
                got = lex.unit[np.maximum(at, 0)]
                got[rare] = lex.of_shape[-1 - at[rare]]
                units.append(got.astype(lex.kind).tobytes())
                n.append(len(at))
                known.append(int((lex.counts[held] > 0).sum()))
                part.append(float(logs[held].sum()))
                rest.append(float(logs[held[in_shape[held]]].sum()))
                few = Counter([key_of(found[i]) for i in rare.tolist()])
                words.append(list(few))
                times.append(list(few.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(part, pa.float64()), pa.array(rest, pa.float64()), pa.array(units, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], ["id", "held_out", "n_tokens", "n_shared", "part", "rest", "units", "words", "times"])

    named = docs.select(docs[id_col].alias("id"), (crc_mod(docs[id_col], folds) == 0).alias("held_out"), docs[text_col].alias("text"))
    return named.mapInArrow(run, schema)


Parameters = dict[str, np.ndarray]


def start(lex: Lexicon, width: int = WIDTH, seed: int = 7) -> Parameters:
    """Small random vectors; biases that give the unigram distribution."""
    rng = np.random.default_rng(seed)
    units, n = len(lex.tally), len(lex.first) - 1
    mass = lex.tally + 0.5
    by_class = np.add.reduceat(mass, lex.first[:-1])
    p = {
        "R": rng.normal(0, 0.1, (units, width)), "A": np.eye(width) * 0.7, "B": np.eye(width) * 0.7,
        "K": rng.normal(0, 0.1, (n, width)), "k": np.log(by_class / by_class.sum()),
        "Q": rng.normal(0, 0.1, (units, width)), "q": np.log(mass / by_class[lex.class_of]),
    }
    return {name: x.astype(np.float32) for name, x in p.items()}


def contexts(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token two before, token before, token) over texts; a text starts after two ends."""
    w = np.concatenate(units)
    ends = np.cumsum([len(u) for u in units])[:-1]
    u, v = np.zeros_like(w), np.zeros_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    for at, x in ((ends, v), (ends, u), (ends[ends + 1 < len(w)] + 1, u)):
        x[at] = 0
    return u, v, w


def _with(x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """x with one more column: a product of [x, 1] and [vectors, bias] holds the bias."""
    out = np.empty((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = x, last
    return out


def _contrast(x: np.ndarray, vectors: np.ndarray, bias: np.ndarray, noise: np.ndarray, true: np.ndarray) -> np.ndarray:
    """The gradient of the noise-contrastive loss by the energies: expected noise events taken for true, less true ones missed.

    x has a column of ones; bias is less the log of the noise. Blocks of rows stay in the processor's cache."""
    grad = np.empty((len(x), len(noise)), np.float32)
    minus = np.ascontiguousarray(-_with(vectors, bias).T)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), BLOCK):
            s = grad[at : at + BLOCK]
            np.matmul(x[at : at + BLOCK], minus, out=s)
            np.exp(s, out=s)
            s += 1
            np.divide(noise, s, out=s)
            rows, t = np.arange(len(s)), true[at : at + BLOCK]
            s[rows, t] -= 1 - s[rows, t] / noise[t]
    return grad


class Trainer:
    """Passes over texts with adaptive steps (squared gradients are summed for each parameter)."""

    def __init__(self, p: Parameters, lex: Lexicon, rate: float):
        self.p, self.first, self.class_of, self.rate, self.kind = {k: x.copy() for k, x in p.items()}, lex.first, lex.class_of.astype(lex.kind), rate, lex.kind
        self.batch = int(min(BATCH, max(256, lex.tally.sum() * BATCH / FEW_TOKENS)))
        self.square = {k: np.full(x.shape, 1e-2, np.float32) for k, x in p.items()}
        mass = lex.tally + 0.5
        by_class = np.add.reduceat(mass, lex.first[:-1])
        self.class_noise = (NOISE * by_class / by_class.sum()).astype(np.float32)
        self.unit_noise = (NOISE * mass / by_class[self.class_of]).astype(np.float32)
        self.log_class, self.log_unit = np.log(self.class_noise), np.log(self.unit_noise)
        self.met = np.zeros(len(mass), np.float32)

    def _move(self, name: str, at, grad: np.ndarray) -> None:
        s = self.square[name][at] + grad * grad
        self.square[name][at] = s
        self.p[name][at] -= np.float32(self.rate) * grad / np.sqrt(s)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        ru, rv = p["R"][u], p["R"][v]
        h = ru @ p["A"] + rv @ p["B"]
        c = self.class_of[w]
        one = _with(h, 1)
        g = _contrast(one, p["K"], p["k"] - self.log_class, self.class_noise, c)
        dh = g @ p["K"]
        dk = g.T @ one
        order = np.argsort(c, kind="stable")
        kinds, begins = np.unique(c[order], return_index=True)
        for cls, rows in zip(kinds.tolist(), np.split(order, begins[1:]), strict=True):
            a, b = self.first[cls], self.first[cls + 1]
            if b - a < 2:
                continue
            x, part = one[rows], slice(a, b)
            g = _contrast(x, p["Q"][part], p["q"][part] - self.log_unit[part], self.unit_noise[part], w[rows] - a)
            dh[rows] += g @ p["Q"][part]
            dq = g.T @ x
            self._move("Q", part, dq[:, :-1])
            self._move("q", part, dq[:, -1])
        self._move("K", slice(None), dk[:, :-1])
        self._move("k", slice(None), dk[:, -1])
        du, dv = dh @ p["A"].T, dh @ p["B"].T
        self._move("A", slice(None), ru.T @ dh)
        self._move("B", slice(None), rv.T @ dh)
        both = np.concatenate([u, v]).astype(self.kind)  # two bytes are sorted by counting
        order = np.argsort(both, kind="stable")
        seen, begins, times = np.unique(both[order], return_index=True, return_counts=True)
        self._move("R", seen, np.add.reduceat(np.concatenate([du, dv])[order], begins))
        self.met[seen] += times

    def texts(self, units: list[np.ndarray]) -> None:
        u, v, w = contexts(units)
        for at in range(0, len(w), self.batch):
            s = slice(at, at + self.batch)
            self.step(u[s], v[s], w[s])


_CHUNKS = 32


def averaged(rows: DataFrame, p: Parameters, lex: Lexicon, rate: float, fan_in: int = 32) -> Parameters:
    """One round: every task passes over its texts from p; the moves are averaged in a tree, chunk by chunk."""
    sc = rows.sparkSession.sparkContext
    given = sc.broadcast((p, replace(lex, words=[], counts=lex.counts[:0], unit=lex.unit[:0])))  # training reads units, never words
    sizes = {k: x.size for k, x in p.items()}
    length = -(-sum(sizes.values()) // _CHUNKS)

    def blob(x: np.ndarray) -> bytes:
        return zlib.compress(x.astype(np.float32).tobytes(), 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        before, lex = given.value
        t, n = Trainer(before, lex, rate), 0
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, lex.kind).astype(np.int32))
                size += len(held[-1])
                if size >= 4 * BATCH:
                    t.texts(held)
                    n, held, size = n + size, [], 0
            if held:
                t.texts(held)
                n += size
        if not n:
            return
        weight = {k: np.full(x.shape, n, np.float32) for k, x in before.items()}
        weight["R"] = np.repeat(t.met[:, None], before["R"].shape[1], 1)
        flat = np.zeros((2, length * _CHUNKS), np.float32)
        flat[1, : sum(sizes.values())] = np.concatenate([weight[k].ravel() for k in before])
        flat[0, : sum(sizes.values())] = np.concatenate([(t.p[k] - before[k]).ravel() for k in before])
        flat[0] *= flat[1]
        chunks = flat.reshape(2, _CHUNKS, length)
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([TaskContext.get().partitionId()] * _CHUNKS, pa.int32()), pa.array([blob(chunks[:, i]) for i in range(_CHUNKS)], pa.binary())], ["chunk", "part", "blob"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.float32) for x in group.sort_values("part")["blob"])
        return pd.DataFrame({"chunk": [key[0]], "part": [key[1]], "blob": [blob(total)]})

    parts = max(1, task_count(rows))
    held = rows.mapInArrow(tally, "chunk int, part int, blob binary")
    while True:
        parts = -(-parts // fan_in)
        held = held.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("chunk", "part").applyInPandas(add, "chunk int, part int, blob binary")
        if parts <= 1:
            break
    total = np.zeros((2, _CHUNKS, length), np.float32)
    for chunk, _, x in held.collect():
        total[:, chunk] += np.frombuffer(zlib.decompress(x), np.float32).reshape(2, length)
    total = total.reshape(2, -1)
    move = total[0] / np.maximum(total[1], 1)
    out, at = {}, 0
    for k, x in p.items():
        out[k] = x + move[at : at + x.size].reshape(x.shape)
        at += x.size
    given.unpersist()
    return out


def _log_softmax_at(x: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log of the softmax of x @ vectors.T + bias at one place of each row; x has a column of ones."""
    out = np.empty(len(x))
    given, ones = np.ascontiguousarray(_with(vectors, bias).T), np.ones(len(bias), np.float32)
    for begin in range(0, len(x), BLOCK):
        e = x[begin : begin + BLOCK] @ given
        rows, t = np.arange(len(e)), at[begin : begin + BLOCK]
        true = e[rows, t]
        if -60 < e.min() and e.max() < 60:
            np.exp(e, out=e)
            out[begin : begin + BLOCK] = true - np.log(e @ ones)
        else:  # exponentials could leave the range of floats
            top = e.max(1, keepdims=True)
            out[begin : begin + BLOCK] = true - top[:, 0] - np.log(np.exp(e - top).sum(1))
    return out


class Scorer:
    """Normalised log10 P(unit | two units before), by batched matrix products."""

    def __init__(self, p: Parameters, lex: Lexicon):
        self.p, self.first, self.class_of = p, lex.first, lex.class_of.astype(lex.kind)
        self.a, self.b = p["R"] @ p["A"], p["R"] @ p["B"]

    def log_probabilities(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        p, out = self.p, np.empty(len(w))
        for begin in range(0, len(w), 4 * BATCH):
            s = slice(begin, begin + 4 * BATCH)
            h, c, x = _with(self.a[u[s]] + self.b[v[s]], 1), self.class_of[w[s]], w[s]
            got = _log_softmax_at(h, p["K"], p["k"], c)
            order = np.argsort(c, kind="stable")
            kinds, begins = np.unique(c[order], return_index=True)
            for cls, rows in zip(kinds.tolist(), np.split(order, begins[1:]), strict=True):
                lo, hi = self.first[cls], self.first[cls + 1]
                if hi - lo > 1:
                    got[rows] += _log_softmax_at(h[rows], p["Q"][lo:hi], p["q"][lo:hi], x[rows] - lo)
            out[s] = got
        return out / math.log(10)


def plan(tokens: int, partitions: int, cores: int) -> tuple[int, int, int]:
    """(passes, slices, tasks of a round)."""
    passes = int(min(MOST_PASSES, max(1, FEW_TOKENS // max(1, tokens))))
    slices = int(min(MOST_SLICES, max(1, tokens // SLICE_TOKENS))) if passes == 1 else 1
    return passes, slices, int(min(partitions, max(LEAST_TASKS, cores), max(1, tokens // slices // TASK_TOKENS)))


def train(rows: DataFrame, lex: Lexicon) -> Parameters:
    """Fit the model on `rows` (units, and row, by which slices are dealt)."""
    p = start(lex)
    passes, slices, tasks = plan(int(lex.tally.sum()), task_count(rows), rows.sparkSession.sparkContext.defaultParallelism)
    rounds = passes * slices
    for k in range(rounds):
        part = rows if slices == 1 else rows.filter(F.pmod(F.xxhash64("row"), F.lit(slices)) == k % slices)
        fall = min(k / 2, 3.5 * k / max(1, rounds - 1))  # the last of many rounds takes steps as small as the last of eight
        p = averaged(part.select("units").coalesce(tasks), p, lex, RATE / (1 + fall))
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, shared: int = SHARED_WORDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    training = docs.filter(crc_mod(docs[id_col], folds) != 0).select(docs[text_col].alias("text"))
    counts = materialise(count_words(training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    lex = lexicon(counts, total, shared)
    rows = materialise(annotate(docs, lex, id_col, text_col, folds).withColumn("row", F.monotonically_increasing_id()), "tokens")
    p = train(rows.filter(~F.col("held_out")).select("units", "row"), lex)
    given = spark.sparkContext.broadcast((p, replace(lex, words=[], counts=lex.counts[:0], unit=lex.unit[:0])))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        p, lex = given.value
        scorer = Scorer(p, lex)
        for b in batches:
            units = [np.frombuffer(x, lex.kind).astype(np.int32) for x in b.column(b.num_columns - 1).to_pylist()]
            got = np.empty(0)
            if units:
                u, v, w = contexts(units)
                each = scorer.log_probabilities(u, v, w) - lex.log_mass[w]
                got = np.add.reduceat(each, np.cumsum([0, *[len(x) for x in units[:-1]]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], [*b.schema.names[:-1], "model"])

    kind = rows.schema["id"].dataType.simpleString()
    kept = ["row", "id", "held_out", "n_tokens", "n_shared", "part", "rest"]
    scored = rows.select(*kept, "units").mapInArrow(model, f"row long, id {kind}, held_out boolean, n_tokens long, n_shared long, part double, rest double, model double")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    out = scored.join(met, "row", "left")
    logs = F.coalesce("rare", F.lit(0.0))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_shared") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + logs - F.col("n_tokens") * math.log10(total + SMOOTH * (distinct + 1))).alias("base_score"), (F.col("model") + F.col("rest") + logs).alias("score"),
    )


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
