"""Near-duplicate detection by DartMinHash signatures, banded joins and exact verification.

Sketch. A weighted set is a region: an element of weight w is a strip of that width. Darts are a fixed Poisson process over
(element, width, rank) that all documents share: each unit layer of an element gets darts at exponential gaps, from a hash
of (element, layer, number). A dart that falls inside the strip counts; its hash names one of K coordinates, and each
coordinate keeps the dart of smallest rank. Two sets agree in a coordinate with probability equal to their weighted Jaccard
similarity. Only darts of rank up to (K ln K + 2 K) / total weight are thrown, so the work is the set's size plus about
K ln K darts; a set that leaves a coordinate empty is thrown at again with twice the rank.

Join. Documents with equal weighted sets are one node. BANDS bands of ROWS coordinates make buckets. Within a bucket nodes
are paired with one leader, the member that meets most others over all its buckets; pairs are verified on the whole texts,
and verified links are contracted to components. Then, in each bucket that still holds several components, the nodes
outside the largest are compared with all, in blocks of which only links come out. So each pair that shares a bucket is
verified or known to be connected: no link is lost, and a group of thousands of near copies makes about one row for each.

Shingles are of five words `[^\\x20\\x09-\\x0D]+`; a text of one to four words is one shingle. A shingle's weight is the number
of times it stands in the text, and the similarity is the sum of the smaller weights over that of the larger ones; with
weighted=False all weights are 1, and it is that of the sets. Names and verification work on unit layers: a shingle of weight
3 is three elements, of which another text's share is the smaller number, so that sets of layers have the weighted similarity.

Defined results: a document without words (null or empty text) is a class of its own. Null ids take no part and get a null
class. Rows that repeat an id are one document for each text; equal texts share a class. Long texts are read whole. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.functions.threads import one_thread
from phenogrid.llm.common import BASE_A, BASE_B, WordHashes, free_name, lean, materialise, mix, powers, remove_table, rolling, sliced, table
from phenogrid.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 21, 6
K = BANDS * ROWS
#: Pairs that one verification group should hold.
GROUP_PAIRS = 1_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[bytes], hashes: WordHashes, width: int = WIDTH) -> list[np.ndarray]:
    """Hashes of all runs of `width` words of each text, in order."""
    words = [t.split() for t in texts]
    every = hashes.of([w for ws in words for w in ws])
    runs = rolling(every, width)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(runs[at : at + n - width + 1])
        elif n:
            out.append(mix(rolling(every[at : at + n], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def layers(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The unit layers of elements with whole weights: the first is the element itself, the others have hashes of their own."""
    if not len(elements) or counts.max() == 1:
        return elements
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    every = np.repeat(elements, counts)
    with np.errstate(over="ignore"):
        return np.where(number > 0, mix(every + number.astype(np.uint64) * np.uint64(BASE_B)), every)


def bags(texts: list[bytes], hashes: WordHashes, weighted: bool = True) -> list[np.ndarray]:
    """The layers of each text's shingles, sorted and distinct."""
    out = []
    for s in shingles(texts, hashes):
        elements, counts = np.unique(s, return_counts=True)
        out.append(np.unique(layers(elements, counts)) if weighted else elements)
    return out


def _throw(elements: np.ndarray, room: np.ndarray, limit: np.ndarray, owner: np.ndarray, best: np.ndarray, k: int) -> None:
    """Throw darts at unit layers until their rank passes the layer's limit; best[owner * k + coordinate] keeps the smallest (rank, dart)."""
    rank = np.zeros(len(elements))
    number = 0
    while len(elements):
        with np.errstate(over="ignore"):
            dart = mix(elements + np.uint64((number * BASE_A) & 0xFFFFFFFFFFFFFFFF))
        rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        on = rank <= limit
        if not on.all():
            elements, room, limit, owner, rank, dart = (x[on] for x in (elements, room, limit, owner, rank, dart))
        if not len(elements):
            break
        with np.errstate(over="ignore"):
            spot = mix(dart + np.uint64(BASE_B))
        coordinate = (spot >> np.uint64(40)) % np.uint64(k)
        value = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (spot & np.uint64(0xFFFFFFFF))
        inside = None if room.min() >= 1 else ((dart & np.uint64(0x7FF)).astype(np.float64) + 0.5) / 2048 <= room
        at = owner * k + coordinate.astype(np.int64)
        if inside is None:
            np.minimum.at(best, at, value)
        else:
            np.minimum.at(best, at[inside], value[inside])
        number += 1


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = K) -> np.ndarray:
    """A row of k coordinates for each non-empty set (elements are distinct hashes); weights are 1 if not given."""
    best = np.full((len(sets), k), _EMPTY)
    todo, boost = np.array([i for i, s in enumerate(sets) if len(s)], np.int64), 1.0
    thrown = k * np.log(k) + 2 * k
    while len(todo):
        elements, room, owner, total = [], [], [], []
        for i in todo.tolist():
            s, w = sets[i], weights[i] if weights is not None else None
            if w is None or len(s) and w.min() == w.max() == 1:
                strips, left, mass = s, np.ones(len(s)), float(len(s))
            else:
                depth = np.ceil(w).astype(np.int64)
                strips = layers(s, depth)
                left, mass = np.minimum(np.repeat(w, depth) - (np.arange(len(strips)) - np.repeat(np.cumsum(depth) - depth, depth)), 1.0), float(w.sum())
            elements.append(strips)
            room.append(left)
            owner.append(np.full(len(strips), i))
            total.append(np.full(len(strips), thrown * boost / mass))
        _throw(np.concatenate(elements), np.concatenate(room), np.concatenate(total), np.concatenate(owner), best.reshape(-1), k)
        todo = todo[(best[todo] == _EMPTY).any(1)]
        boost *= 2
    return best


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    out = np.empty((len(signatures), bands), np.uint64)
    step = powers(BASE_A, rows + 1)
    with np.errstate(over="ignore"):
        for b in range(bands):
            out[:, b] = mix((mix(signatures[:, b * rows : (b + 1) * rows]) * step[:rows]).sum(1, dtype=np.uint64) + np.uint64(b + 1) * step[rows])
    return out


def set_name(s: np.ndarray) -> bytes:
    """128 bits that name a set of distinct elements."""
    with np.errstate(over="ignore"):
        a, b = mix(s + np.uint64(BASE_B)).sum(dtype=np.uint64), mix(s ^ np.uint64(BASE_A)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


#: Bytes of text sketched at a time.
_BATCH_CHARS = 1_500_000


def sketch(docs: DataFrame, id_col: str, text_col: str, weighted: bool = True) -> DataFrame:
    """id, node (the name of the weighted shingle set, null without words) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            at = 0
            for texts in sliced(b.column(1), _BATCH_CHARS):
                found = [np.unique(s, return_counts=True) for s in shingles([t.encode() for t in texts], hashes)]
                sets = [x[0] for x in found]
                keys = band_keys(dart_signatures(sets, [x[1].astype(float) for x in found] if weighted else None)).view(np.int64)
                nodes = [set_name(layers(*x) if weighted else x[0]) if len(x[0]) else None for x in found]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(nodes, pa.binary()), flat], ["id", "node", "bands"])
                at += len(texts)

    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return named.mapInArrow(lean(run), f"id {named.schema['id'].dataType.simpleString()}, node binary, bands array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, weighted: bool = True) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts' shingle sets are at least so similar. texts: node, text.

    A pair goes to the group of its hub a, cut into parts by b; a group holds many small hubs or a part of a large one."""
    count = pairs.count()
    if not count:
        return pairs.select("a", "b")
    groups = max(1, -(-count // GROUP_PAIRS))
    salt = F.pmod(F.xxhash64("b"), F.lit(groups)).cast("int")
    hub = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / GROUP_PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(hub, "a").select("a", "b", F.pmod(F.xxhash64("a", F.pmod(salt, F.col("parts"))), F.lit(groups)).cast("int").alias("g"))
    dealt = materialise(dealt, "pairs")
    members = dealt.join(texts, dealt["b"] == texts["node"]).select("g", "a", "b", "text")
    hubs = dealt.select("g", "a").distinct().join(texts, F.col("a") == texts["node"]).select(F.col("g").alias("hub_g"), F.col("a").alias("hub"), F.col("text").alias("hub_text"))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, keep_a, keep_b = WordHashes(), [], []
        sets = {a: bags([(t or "").encode()], hashes, weighted)[0] for a, t in zip(right.column("hub").to_pylist(), right.column("hub_text").to_pylist(), strict=True)}
        for a, b, t in zip(*(left.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
            if a in sets and similarity(sets[a], bags([(t or "").encode()], hashes, weighted)[0]) >= threshold:
                keep_a.append(a)
                keep_b.append(b)
        return pa.table({"a": pa.array(keep_a, pa.binary()), "b": pa.array(keep_b, pa.binary())})

    return members.groupBy("g").cogroup(hubs.groupBy("hub_g")).applyInArrow(judge, "a binary, b binary")


#: Nodes of one bucket that a block holds on a side; rows that a group of blocks should hold.
BLOCK, GROUP_ROWS = 1_024, 2_000


def common_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by matrix products over the elements that both sides have."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    rows = [[x[np.isin(x, both, assume_unique=True)] for x in side] for side in (a, b)]
    places = [[np.searchsorted(both, x) for x in side] for side in rows]
    for at in range(0, len(both), columns):
        m = []
        for side in places:
            one = np.zeros((len(side), min(columns, len(both) - at)), np.float32)
            for i, x in enumerate(side):
                x = x[(x >= at) & (x < at + columns)] - at
                one[i, x] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def compare_blocks(left: DataFrame, texts: DataFrame, threshold: float, weighted: bool = True) -> DataFrame:
    """Links (a, b) between nodes of different label in one bucket (rows: bucket, node, label).

    In each bucket the nodes outside the most frequent label meet all nodes. Both sides are cut into blocks; a pair of
    blocks is compared by matrix products, and only pairs that are similar enough leave it."""
    sizes = left.groupBy("bucket", "label").count()
    big = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("big"), F.sum("count").alias("n"), F.max("count").alias("most"))
    big = big.select("bucket", "big", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("minor_parts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rows = left.join(big, "bucket")
    groups = max(1, -(-left.count() // GROUP_ROWS))
    i, j = F.pmod(F.xxhash64("node"), F.col("minor_parts")).cast("int"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    minor = rows.filter(F.col("label") != F.col("big")).withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = rows.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor_parts") - 1)))

    def dealt(frame: DataFrame, tag: str) -> DataFrame:
        g = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)).cast("int")
        found = frame.select(g.alias(f"g{tag}"), "bucket", "i", "j", "node", "label").join(texts, "node")
        return found.select(f"g{tag}", *[F.col(c).alias(f"{c}{tag}") for c in ("bucket", "i", "j", "node", "label", "text")])

    def judge(one: pa.Table, two: pa.Table) -> pa.Table:
        one_thread()
        hashes, sets = WordHashes(), {}

        def blocks(side: pa.Table) -> dict[tuple, list[tuple[bytes, bytes]]]:
            cols = [side.column(c).to_pylist() for c in range(1, 7)]
            out: dict[tuple, list[tuple[bytes, bytes]]] = {}
            for bucket, i, j, node, label, text in zip(*cols, strict=True):
                if node not in sets:
                    sets[node] = bags([(text or "").encode()], hashes, weighted)[0]
                out.setdefault((bucket, i, j), []).append((node, label))
            return out

        a, b, found = blocks(one), blocks(two), set()
        for key, small in a.items():
            large = b.get(key)
            if not large:
                continue
            x, y = [sets[n] for n, _ in small], [sets[n] for n, _ in large]
            common = common_counts(x, y)
            total = np.array([len(v) for v in x], np.float32)[:, None] + np.array([len(v) for v in y], np.float32)[None] - common
            for p, q in zip(*np.nonzero(common >= threshold * total.astype(float) - 1e-9), strict=True):
                if small[p][1] != large[q][1]:
                    found.add((min(small[p][0], large[q][0]), max(small[p][0], large[q][0])))
        pairs = sorted(found)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return dealt(minor, "1").groupBy("g1").cogroup(dealt(every, "2").groupBy("g2")).applyInArrow(judge, "a binary, b binary")


def _names(texts: pa.Array, hashes: WordHashes, weighted: bool) -> list[bytes | None]:
    """The name of each text's shingle set, null without words; the words of few texts are held at a time."""
    return [set_name(x) if len(x) else None for part in sliced(texts, _BATCH_CHARS) for x in bags([t.encode() for t in part], hashes, weighted)]


def candidate_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, weighted: bool = True) -> DataFrame:
    """node, text of the nodes (node, id). The one join with the texts of all documents. Where an id repeats, the text that has the node's set."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            same = [x == n for x, n in zip(_names(b.column(1), hashes, weighted), b.column(0).to_pylist(), strict=True)]
            yield b.filter(pa.array(same, pa.bool_()))

    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = nodes.join(named, "id").select("node", "text").mapInArrow(lean(own), "node binary, text string")
    return found.dropDuplicates(["node"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, weighted: bool = True, nodes_too: bool = False) -> DataFrame:
    """id, class_id (the smallest id of the class) of every row; with nodes_too also node (the name of its shingle set) and gone (whether another id or set of its class stays)."""
    rows = materialise(sketch(docs, id_col, text_col, weighted), "sketch")
    nodes = rows.filter("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    member = materialise(dealt.join(shared, "bucket"), "members")
    # a bucket's leader is the member that meets the most others in all its buckets: of a group of near copies, the one nearest to all
    met = member.groupBy("node").agg(F.sum("n").alias("met"))
    texts = materialise(candidate_texts(docs, met.join(nodes.select("node", "id"), "node").select("node", "id"), id_col, text_col, weighted), "texts")
    led = member.join(met, "node")
    lead = led.groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    stars = led.join(lead, "bucket").filter(F.col("leader") != F.col("node")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = materialise(verify(materialise(stars, "stars"), texts, threshold, weighted), "links1")
    label = components(links)
    # what still lies in different components of one bucket is compared outright, inside blocks: only links come out
    left = member.select("bucket", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = left.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket")
    left = materialise(left.join(mixed, "bucket").select("bucket", "node", "label"), "open")
    links = materialise(links.unionByName(compare_blocks(left, texts, threshold, weighted)), "links2")
    label = components(links)
    for done in (member, texts):
        remove_table(done)
    # names: the smallest id of each component; then back to the rows, with groups that could be hot by broadcast
    named = nodes.select("node", "id", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min(F.struct("id", "node")).alias("first"))
    final = materialise(named.join(smallest, "label").select("node", "n", F.col("first.id").alias("class_id"), (F.col("node") == F.col("first.node")).alias("stays")), "classes")
    total = final.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(1000, total // 1000)  # at most 1000 nodes
    heavy, light = final.filter(hot).drop("n"), final.filter(~hot).drop("n")
    body = rows.select("id", "node")
    with_words = body.filter("node is not null and id is not null")
    out = with_words.join(F.broadcast(heavy), "node").unionByName(with_words.join(F.broadcast(heavy.select("node")), "node", "left_anti").join(light, "node"))
    names = ["id", "class_id", "node", "gone"] if nodes_too else ["id", "class_id"]
    rest = body.filter("node is null or id is null").select("id", F.col("id").alias("class_id"), "node", F.lit(False).alias("gone"))
    return out.withColumn("gone", ~F.col("stays") | (F.col("id") != F.col("class_id"))).select(*names).unionByName(rest.select(*names))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = True, **options) -> DataFrame:
    """The rows of docs but for those whose class has a smaller id, or the same id with another text; all columns unchanged.

    Where an id stands for several texts, of which some go, its rows are told apart by their shingle sets."""
    name, set_col = free_name(docs, "_gone"), free_name(docs, "_set")
    found = classes(docs, id_col, text_col, weighted=weighted, nodes_too=True, **options)
    per = found.filter("id is not null").groupBy(F.col("id").alias(name)).agg(F.bool_and("gone").alias("every"), F.bool_or("gone").alias("some")).filter("some")
    per = materialise(per, "gone")
    mixed = per.filter(~F.col("every")).select(name)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_names(b.column(text_col), hashes, weighted), pa.binary())], [*b.schema.names, set_col])

    same = docs.columns
    part = docs.join(mixed, docs[id_col] == F.col(name), "left_semi")
    part = part.mapInArrow(lean(named), T.StructType([*part.schema.fields, T.StructField(set_col, T.BinaryType())]))
    gone = found.filter("gone").select(F.col("id").alias(name), F.col("node").alias("_node")).distinct()
    part = part.join(gone, (part[id_col] == F.col(name)) & (part[set_col] == F.col("_node")), "left_anti").select(*same)
    return docs.join(per.select(name), docs[id_col] == F.col(name), "left_anti").unionByName(part)


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
