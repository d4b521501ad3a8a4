"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A text is cut into words, and a word into pieces by the tokenizer's pattern. The words of the whole corpus are counted; the most
frequent ones, SHARED_WORDS at most, are merged once, in tasks of which each has some of them, and every worker gets their ids.
Rarer words are merged where they stand: the distinct ones of a slice of documents. Cutting, counting and putting documents
together from their words' ids are Arrow's columns; only the pattern makes strings, one for each piece of a distinct word.

Merging works on all pieces at hand at once. Short pieces form matrices, a row for each piece, with the rank of every pair of
neighbours beside it; in each round every piece makes its lowest merge, the leftmost of equal ones, and is a symbol shorter. Long
pieces form one array of symbols with links to the left and right neighbours; an inverted index maps each mergeable pair to the
positions where it stands; merges are replayed in rank order over the whole index, and each touches only the two neighbours of
its position.

A piece must come out as if it were encoded alone, lowest rank first, leftmost first. The rounds do so by themselves. Replaying
a rank over all long pieces at once keeps that as long as no merge creates a pair of a lower rank; a piece where one does is
encoded on its own instead.

No match of SPACED patterns holds a space after anything but white space, so a space between two other characters always begins
a piece. Texts are cut there, and the pattern runs once over each distinct word. With any other pattern it runs over the texts,
and its matches are the words.

Defined results: a null text counts as empty: no ids. Every byte sequence has an encoding, since all 256 bytes have ranks.
A null id is kept. Repeated rows are encoded each. Other columns are ignored. Very long pieces are encoded whole. An empty table
gives an empty result. No result depends on which words are shared.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm.common import frequent, lean, materialise, remove_table, spans, table

#: Words that all workers know, of SHARED_BYTES at most; distinct words that a task counts before it passes them on, and their bytes.
SHARED_WORDS, SHARED_BYTES, FLUSH_WORDS, FLUSH_BYTES = 262_144, 64, 1_000_000, 32_000_000
#: Bytes of text that are cut into words at a time, and of pieces that one replay works on; longer pieces than LONG are merged by the index.
SLICE_BYTES, REPLAY_BYTES, LONG = 8_000_000, 2_000_000, 64
#: Patterns that may be matched between spaces.
SPACED = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: A pair of neighbours is one number: left * _SHIFT + right.
_SHIFT = 1 << 24


def _offsets(texts: pa.Array) -> np.ndarray:
    """Where each text, or binary value, begins in the bytes, and the last ends."""
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


def _bytes(texts: pa.Array) -> np.ndarray:
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)


def _binary(begins: np.ndarray, values: np.ndarray | pa.Buffer | None) -> pa.Array:
    """The binary values that begin there; the last entry is where the last ends."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(np.ascontiguousarray(begins, np.int32)), pa.py_buffer(b"" if values is None else values)])


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.spaced = pattern in SPACED
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: byte -> its rank; the first symbols of any piece
        self.first = [ranks[bytes([b])] for b in range(256)]
        #: the bytes of every id, and its decimal text after a comma
        self.token_bytes = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.binary())
        self.decimal = pa.array([b",%d" % i for i in range(max(self.tokens) + 1)], pa.binary())
        #: pair -> rank of the two together, for every way to cut a token into two tokens
        self.merges = {ranks[t[:i]] * _SHIFT + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        #: the same, sorted by pair
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[x] for x in self.pairs.tolist()], np.int32)
        #: rank of two bytes together, or -1, at first byte * 256 + second byte
        self.bytes2 = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.width = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of the texts; all words as places among those; where the words of each text begin, and the last end.

        A word after a space stands without it. A word that begins with a space stands for what follows it: a text's first, or one
        that ends in white space. No other word is empty or has white space at an end."""
        if not self.spaced:
            found = [self.split(t) for t in texts.to_pylist()]
            coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            return coded.dictionary, coded.indices.to_numpy(), np.cumsum([0, *map(len, found)])
        parts = pc.split_pattern(texts, " ")
        begins, flat = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
        coded = flat.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        own = np.zeros(len(at), bool)  # words that do not stand for themselves
        own[begins[:-1]] = True
        left, right = (pc.or_(pc.equal(distinct, ""), pc.not_equal(trim(distinct), distinct)).to_numpy(zero_copy_only=False) for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        cut = None
        if left.any() or right.any():
            # white space beside a space: the words are put together again
            first, cut = own, own.copy()
            cut[1:] |= ~(right[at[:-1]] | left[at[1:]])
            starts = np.flatnonzero(cut)
            last = np.append(starts[1:], len(at)) - 1
            made = first[starts] | (last > starts) | right[at[last]]
            starts, last = starts[made], last[made]
            own = np.zeros(len(at), bool)
            own[starts] = True
            ends, spaces = _offsets(flat), np.arange(len(at)) - np.cumsum(first) + 1
            raw = _bytes(texts)[_offsets(texts)[0] : _offsets(texts)[-1]].tobytes()
            lead = np.where(first[starts], 1, np.where(right[at[last]], 2, 0)).tolist()
            froms, tos = (ends[starts] - ends[0] + spaces[starts]).tolist(), (ends[last + 1] - ends[0] + spaces[last]).tolist()
            more = pa.array([b" " * n + raw[i:j] for n, i, j in zip(lead, froms, tos, strict=True)], pa.binary()).cast(pa.string())
        else:
            more = pc.binary_join_element_wise(" ", flat.take(pa.array(begins[:-1])), "")
        more = more.dictionary_encode()
        used = np.zeros(len(distinct), bool)
        used[at[~own if cut is None else cut & ~own]] = True
        place = (np.cumsum(used, dtype=np.int32) - np.int32(1))[at]
        place[own] = used.sum() + more.indices.to_numpy()
        if cut is not None:
            place, begins = place[cut], np.concatenate([[0], np.cumsum(cut)])[begins]
        return pa.concat_arrays([distinct.filter(pa.array(used)), more.dictionary]), place, begins

    def pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of the words, taken in some order; where those of each word begin, and the last end; that order."""
        if not self.spaced:
            return words, np.arange(len(words) + 1), np.arange(len(words))
        inside = pc.match_substring(words, " ")
        plain, rest = words.filter(pc.invert(inside)), words.filter(inside)
        found = self.split(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()) if len(plain) else []
        n, begins = len(found), []
        for w in rest.to_pylist():
            begins.append(len(found))
            found += self.split(w[1:] if w[0] == " " else " " + w)
        got = pa.array(found, pa.string())
        # a piece begins with a space where a word of `plain` begins, and nowhere else
        led = np.flatnonzero(_bytes(got)[_offsets(got)[:n]] == 32)
        inside = inside.to_numpy(zero_copy_only=False)
        return got, np.concatenate([led, begins, [len(found)]]).astype(np.int64), np.concatenate([np.flatnonzero(~inside), np.flatnonzero(inside)])

    def word_ids(self, words: pa.Array) -> pa.Array:
        """The ids of each word as bytes."""
        out = [pa.array([], pa.binary())]
        for a, b in spans(words, REPLAY_BYTES):
            found, begins, order = self.pieces(words.slice(a, b - a))
            coded = found.dictionary_encode()
            each = merged(coded.dictionary, self).take(coded.indices)
            out.append(_binary(_offsets(each)[begins], each.buffers()[2]).take(pa.array(np.argsort(order, kind="stable"))))
        return pa.concat_arrays(out)


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once in a process."""
    return Vocabulary(load_ranks(path), pattern)


def encode_alone(piece: bytes, v: Vocabulary) -> list[int]:
    """One piece by the definition, with a heap of candidate merges: lowest rank first, then leftmost."""
    ids, merges = [v.first[b] for b in piece], v.merges
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := merges.get(ids[i] * _SHIFT + ids[i + 1], -1)) >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if ids[i] < 0 or (j := right[i]) < 0 or merges.get(ids[i] * _SHIFT + ids[j]) != rank:
            continue
        ids[i], ids[j] = rank, -1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := merges.get(rank * _SHIFT + ids[k], -1)) >= 0:
                heapq.heappush(heap, (r, i))
        if (h := left[i]) >= 0 and (r := merges.get(ids[h] * _SHIFT + rank, -1)) >= 0:
            heapq.heappush(heap, (r, h))
    return [x for x in ids if x >= 0]


def replay(pieces: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each piece."""
    return [np.frombuffer(x, v.width).tolist() for x in merged(pa.array(pieces, pa.binary()), v).to_pylist()]


def merged(pieces: pa.Array, v: Vocabulary) -> pa.Array:
    """The ids of each piece as bytes: pieces that are tokens need no merges, short ones are merged in rounds, long ones by the index."""
    pieces = pieces.cast(pa.binary())
    ids = pc.index_in(pieces, value_set=v.token_bytes).fill_null(-1).to_numpy()
    ends, data = _offsets(pieces), _bytes(pieces)
    begins, length = ends[:-1], np.diff(ends)
    short, long = (np.flatnonzero((ids < 0) & x) for x in ((length > 0) & (length <= LONG), length > LONG))
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parted(short, length):
        made += ((part[who], symbols) for who, symbols in by_rounds(data, begins[part], length[part], v))
    for part in parted(long, length):
        for i, x in zip(part.tolist(), by_index([data[a:b].tobytes() for a, b in zip(begins[part].tolist(), ends[part + 1].tolist(), strict=True)], v), strict=True):
            made.append((np.array([i]), np.frombuffer(x, v.width)[None]))
    n = (ids >= 0).astype(np.int64)
    for who, symbols in made:
        n[who] = symbols.shape[1]
    starts = np.concatenate([[0], np.cumsum(n)])
    flat = np.empty(starts[-1], v.width)
    flat[starts[:-1][ids >= 0]] = ids[ids >= 0]
    for who, symbols in made:
        flat[starts[who][:, None] + np.arange(symbols.shape[1])] = symbols
    return _binary(starts * flat.itemsize, flat)


def parted(which: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Parts of `which` of about REPLAY_BYTES together."""
    at = np.cumsum(length[which], dtype=np.int64) // REPLAY_BYTES
    return np.split(which, np.flatnonzero(np.diff(at)) + 1) if len(which) else []


_NEVER = np.int32(1 << 30)


def _rank_of(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The rank of each pair, or _NEVER."""
    pair = left.astype(np.int64) * _SHIFT + right
    at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
    return np.where(v.pairs[at] == pair, v.pair_ranks[at], _NEVER)


def by_rounds(data: np.ndarray, begins: np.ndarray, length: np.ndarray, v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places among the pieces, their ids, a row for each) of pieces of n symbols that are done; in each round every other one makes its lowest merge and joins the pieces of n - 1 bytes."""
    order = np.argsort(length, kind="stable")
    bounds = np.searchsorted(length[order], np.arange(length.max(initial=0) + 2)).tolist()
    first, bytes2 = np.array(v.first, np.int32), np.where(v.bytes2 < 0, _NEVER, v.bytes2).astype(np.int32)
    who, symbols, ranks = np.empty(0, np.int64), None, None  # of the last round's pieces
    for n in range(len(bounds) - 2, 0, -1):
        fresh = order[bounds[n] : bounds[n + 1]]
        raw = data[begins[fresh][:, None] + np.arange(n)]
        fresh_ranks = bytes2[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
        if len(who):
            who, symbols, ranks = np.concatenate([who, fresh]), np.concatenate([symbols, first[raw]]), np.concatenate([ranks, fresh_ranks])
        else:
            who, symbols, ranks = fresh, first[raw], fresh_ranks
        if not len(who):
            continue
        at = ranks.argmin(1) if n > 1 else np.zeros(len(who), np.int64)
        low = ranks[np.arange(len(who)), at] if n > 1 else np.full(len(who), _NEVER)
        done = low == _NEVER
        if done.any():
            yield who[done], symbols[done]
            who, at, low, symbols, ranks = (x[~done] for x in (who, at, low, symbols, ranks))
        if not len(who):
            continue
        rows = np.arange(len(who))
        # the merged symbol stands at `at`; the one after it goes, and so does the pair of the two
        symbols[rows, at] = low
        keep = np.arange(n) != (at + 1)[:, None]
        symbols = symbols[keep].reshape(-1, n - 1)
        ranks = ranks[keep[:, 1:]].reshape(-1, n - 2)
        r = rows[at > 0]
        k = at[r]
        ranks[r, k - 1] = _rank_of(symbols[r, k - 1], symbols[r, k], v)
        r = rows[at < n - 2]
        k = at[r]
        ranks[r, k] = _rank_of(symbols[r, k], symbols[r, k + 1], v)


def by_index(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Every merge in rank order over an inverted index of all pieces."""
    if not pieces:
        return []
    # all pieces in one row of symbols, a wall (-1) after each; neighbours that can merge, by rank
    length = np.array([len(p) for p in pieces])
    ends = np.cumsum(length + 1) - 1  # the walls
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = np.array(v.first, np.int64)[raw]
    symbols[ends] = -1
    n = len(symbols)
    rank2 = v.bytes2[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    rank2[ends[:-1]] = -1
    rank2[ends - 1] = -1
    at = np.flatnonzero(rank2 >= 0)
    at = at[np.argsort(rank2[at], kind="stable")]
    kinds, starts = np.unique(rank2[at], return_index=True)
    index = dict(zip(kinds.tolist(), (x.tolist() for x in np.split(at, starts[1:])), strict=True)) if len(at) else {}
    ids, left, right = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    odd: list[int] = []
    rank_of = v.merges.get
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        turn = index.pop(rank)
        turn.sort()
        for i in turn:
            a = ids[i]
            if a < 0:
                continue
            j = right[i]
            b = ids[j]
            if b < 0 or rank_of(a * _SHIFT + b) != rank:
                continue
            ids[i] = rank
            ids[j] = -2
            right[i] = k = right[j]
            left[k] = i
            c = ids[k]
            if c >= 0 and (r := rank_of(rank * _SHIFT + c)) is not None:
                if r <= rank:
                    odd.append(i)
                elif r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(heap, r)
            h = left[i]
            if h >= 0 and (c := ids[h]) >= 0 and (r := rank_of(c * _SHIFT + rank)) is not None:
                if r <= rank:
                    odd.append(i)
                elif r in index:
                    index[r].append(h)
                else:
                    index[r] = [h]
                    heapq.heappush(heap, r)
    done = np.array(ids)
    flat, step = done[done >= 0].astype(v.width).tobytes(), np.dtype(v.width).itemsize
    stops = (np.cumsum(done >= 0)[ends] * step).tolist()
    out = [flat[a:b] for a, b in pairwise([0, *stops])]
    for k in set(np.searchsorted(ends, odd).tolist()):
        out[k] = np.array(encode_alone(pieces[k], v), v.width).tobytes()
    return out


class Encoder:
    """Knows the shared words and merges all others of the texts at hand. `shared`: columns word and ids, as bytes."""

    def __init__(self, v: Vocabulary, shared: pa.Table | None = None):
        self.v = v
        self.known, self.ids = (pa.concat_arrays([pa.array([], t), *(shared.column(k).chunks if shared else [])]) for k, t in enumerate((pa.string(), pa.binary())))

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts; where those of each begin, and the last end."""
        words, at, begins = self.v.words(texts)
        place = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy()
        rare = place < 0
        place = np.where(rare, len(self.known) - 1 + np.cumsum(rare), place)
        ids = pa.concat_arrays([self.ids, self.v.word_ids(words.filter(pa.array(rare)))]).take(pa.array(place[at]))
        ends = _offsets(ids)
        flat = _bytes(ids)[: ends[-1]].view(self.v.width)
        return flat, ends[begins] // flat.itemsize

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        flat, ends = self.encoded(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in pairwise(ends.tolist())]


def text_digests(flat: np.ndarray, ends: np.ndarray, texts: pa.Array, v: Vocabulary) -> tuple[list[str], list[str]]:
    """Of each text, SHA-256 of its decimal ids joined by commas and of what its ids decode to."""
    ids = pa.array(flat)
    decimal, decoded = v.decimal.take(ids), v.token_bytes.take(ids)
    of_ids, of_bytes, of_text = _offsets(decimal)[ends], _offsets(decoded)[ends], _offsets(texts)
    numbers, back = memoryview(_bytes(decimal)), memoryview(_bytes(decoded))
    if decoded.null_count or not np.array_equal(of_bytes, of_text - of_text[0]) or not np.array_equal(_bytes(decoded)[: of_bytes[-1]], _bytes(texts)[of_text[0] : of_text[-1]]):
        raise ValueError("decoding does not give back the text")
    return [hashlib.sha256(numbers[a + 1 : b]).hexdigest() for a, b in pairwise(of_ids.tolist())], [hashlib.sha256(back[a:b]).hexdigest() for a, b in pairwise(of_bytes.tolist())]


def texts_of(column: pa.Array) -> Iterator[pa.Array]:
    """The texts, null as empty, about SLICE_BYTES at a time."""
    texts = column.cast(pa.string()).fill_null("")
    return (texts.slice(a, b - a) for a, b in spans(texts, SLICE_BYTES))


def count_words(ranks_path: str, pattern: str):
    """Texts to (word, c): words of SHARED_BYTES at most, and how often they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path, pattern)
        none = pa.array([], pa.string()), np.empty(0, np.int64)

        def out(words: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            whole = pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "c"])
            return (whole.slice(i, 1 << 16) for i in range(0, len(words), 1 << 16))

        words, counts = none
        for b in batches:
            for texts in texts_of(b.column(0)):
                found, at, _ = v.words(texts)
                short = np.diff(_offsets(found)) <= SHARED_BYTES
                coded = pa.concat_arrays([words, found.filter(pa.array(short))]).dictionary_encode()
                each = np.concatenate([counts, np.bincount(at, minlength=len(found))[short]])
                words, counts = coded.dictionary, np.bincount(coded.indices.to_numpy(), each, len(coded.dictionary)).astype(np.int64)
                if len(words) > FLUSH_WORDS or words.nbytes > FLUSH_BYTES:
                    yield from out(words, counts)
                    words, counts = none
        yield from out(words, counts)

    return run


def dictionary(texts: DataFrame, ranks_path: str, pattern: str, most: int = SHARED_WORDS) -> pa.Table:
    """(word, ids) of the most frequent words of the corpus, at most `most`; those that stand only once are left out."""
    counts = texts.mapInArrow(lean(count_words(ranks_path, pattern)), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 1")
    counts = materialise(counts, "words")
    level, least = frequent(counts, most)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path, pattern)
        for b in batches:
            words = b.column(0).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, v.word_ids(words)], ["word", "ids"])

    got = counts.filter(level >= least).select("word").mapInArrow(lean(merge), "word string, ids binary").toArrow()
    remove_table(counts)
    return got


def decode(ids: Iterable[int], v: Vocabulary) -> bytes:
    tokens = v.tokens
    return b"".join(map(tokens.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, shared_pieces: int = SHARED_WORDS) -> DataFrame:
    """id; n_tokens; with `ids` the ids; with `digests` ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.

    Decoding is checked: it must give back the text's bytes. ranks_path must be readable on every executor."""

    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(named.select("text"), ranks_path, pattern, shared_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks_path, pattern)
        encoder = Encoder(v, shared.value)
        for b in batches:
            at = 0
            for texts in texts_of(b.column(1)):
                flat, ends = encoder.encoded(texts)
                cols = [b.column(0).slice(at, len(texts)), pa.array(np.diff(ends).astype(np.int64))]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
                if digests:
                    cols += [pa.array(x, pa.string()) for x in text_digests(flat, ends, texts, v)]
                yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])
                at += len(texts)

    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long" + (", ids array<int>" if ids else "") + (", ids_sha256 string, decoded_sha256 string" if digests else "")
    return named.mapInArrow(lean(renamed(run, schema)), schema)


def renamed(run, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches):
        for b in run(batches):
            yield b.rename_columns(names)

    return go


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)
    return out.withColumnRenamed("id", "doc_id")
