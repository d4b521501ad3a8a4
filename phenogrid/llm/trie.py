"""Prefix trie of conversations, from sorted matrices of turn ids.

A turn's id is a 128-bit hash of role and text, a conversation the sequence of its turns' ids. Spark deals the sequences out by range of
(sequence, conv_id), so that a shard holds neighbours, and a group of equal conversations of any size spreads over shards. A shard
numbers its ids in order and lays its rows into a padded matrix, BLOCK columns at a time (rows that still agree go on to the next
columns). numpy's lexsort orders them; changes between neighbouring rows, OR-accumulated over the columns, mark where a node of each
depth starts; reduceat sums every depth, deepest first. Depths that only one row reaches are done at once.

Only nodes on the path of a shard's first or last row can reach into other shards. A shard passes these two paths on, with what its own
nodes below them add up to, and FAN neighbouring shards' paths are rows of the next matrix, by the same code; after a few levels one
matrix holds what is left. Nodes under such a path learn their parent's conv_id by a join on (shard, parent).

The hash of a node's own members needs their ids in order. Shards give it in pieces, since a group of equal conversations can lie in
several; one stream for each such node hashes its pieces in order and holds one piece.

Defined results: null role or text is empty text. Rows without conv_id take no part. Turns with equal numbers stand in the order of
their ids' hexadecimal digits (SQL: md5 of role and text), repeated rows count as turns. A conversation without turns ends at the root.
A conversation is one row of 24 bytes a turn. The remainder of a negative conv_id is negative. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm.common import materialise, table

#: Cells (turns and ends) of a shard, about; columns of a matrix; shards that meet at the next level.
SHARD_CELLS, BLOCK, FAN = 131_072, 64, 64
#: Bytes of a turn's id.
_KEY = 16
_NONE = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: What a row says of the node at each of its depths: members, smallest id, and what stands below it outside the matrix: children, leaves, saved tokens.
_STATS = ("n", "least", "kids", "leaves", "saved")
_ROWS = 8192


def ordered(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (sequence, tie), and how many turns each has in common with the row before; row i is ids[begin[i] : begin[i] + length[i]]."""
    order = np.argsort(tie, kind="stable")
    common = np.zeros(len(order), np.int64)
    group = np.zeros(len(order), np.int64)
    at, done = np.arange(len(order)), 0  # places of rows that agree in `done` turns with a neighbour, of which one goes on
    while len(at):
        rows = order[at]
        width = min(BLOCK, int(length[rows].max()) - done)
        take = (length[rows] - done).clip(0, width)
        m = np.full((len(rows), width), -1, np.int64)  # padding comes before every id
        r = np.repeat(np.arange(len(rows)), take)
        c = np.arange(len(r)) - np.repeat(np.cumsum(take) - take, take)
        m[r, c] = ids[begin[rows][r] + done + c]
        by = np.lexsort((tie[rows], *m.T[::-1], group[at]))
        order[at] = rows = rows[by]
        m = m[by]
        change = np.ones((len(rows), width + 1), bool)
        change[1:, 0] = group[at][1:] != group[at][:-1]
        change[1:, 1:] = m[1:] != m[:-1]
        starts = np.logical_or.accumulate(change, axis=1)
        same = np.flatnonzero(~change[:, 0])
        common[at[same]] = np.minimum(done + (~starts[same, 1:]).sum(1), np.minimum(length[rows[same]], length[rows[same - 1]]))
        first = np.flatnonzero(starts[:, -1])
        new = np.cumsum(starts[:, -1]) - 1
        group[at] = new
        go = (np.bincount(new) > 1) & (np.maximum.reduceat(length[rows], first) > done + width)
        at = at[go[new]]
        done += width
    common[:1] = -1
    return order, common


@dataclass
class Nodes:
    """Nodes as columns; `at` is the place of a node's first row, `side` says on which boundary path its parent lies (0: none, 1: first, 2: last)."""

    columns: dict[str, list[np.ndarray]] = field(default_factory=lambda: {k: [] for k in ("conv_id", "depth", "parent", "n", "kids", "leaves", "saved", "at", "side")})

    def add(self, **parts: np.ndarray) -> None:
        for k, v in parts.items():
            self.columns[k].append(np.asarray(v, np.int64))

    def whole(self) -> dict[str, np.ndarray]:
        return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in self.columns.items()}


def build(ids: np.ndarray, length: np.ndarray, chars: np.ndarray, stats: dict[str, np.ndarray], tie: np.ndarray, top: bool) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], list[tuple[int, dict[str, np.ndarray]]]]:
    """(order, common, nodes, paths) of one matrix.

    ids are the rows' turns one after the other; chars and stats have one entry more for each row, the root's. paths are (place of the row,
    stats of each depth) of the first and last rows; with `top` there are none, and all nodes are whole."""
    rows = len(length)
    order, common = ordered(ids, np.cumsum(length) - length, length, tie)
    size, base = length[order], (np.cumsum(length + 1) - length - 1)[order]
    most = min(int(size.max()), int(common.max()) + 1)  # beyond this depth every node has one row
    nodes = Nodes()
    leaf, saved, child = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    paths = [] if top else [(0, {k: stats[k][base[0] : base[0] + size[0] + 1].copy() for k in _STATS})]
    if not top and rows > 1:
        paths.append((rows - 1, {k: stats[k][base[-1] : base[-1] + size[-1] + 1].copy() for k in _STATS}))

    # the tails: one row for each node, from the depth after `most`
    long = np.flatnonzero(size > most)
    if not top:
        long = long[(long > 0) & (long < rows - 1)]
    deeper = None
    if len(long):
        count = size[long] - most
        row = np.repeat(long, count)
        ends = np.cumsum(count)
        d = most + 1 + np.arange(len(row)) - np.repeat(ends - count, count)
        f = base[row] + d
        kids = stats["kids"][f] + (d < size[row])

        def below(x: np.ndarray) -> np.ndarray:
            """Sum of x from here to the row's end."""
            c = np.cumsum(x)
            return np.repeat(c[ends - 1], count) - c + x

        leaves, gain = below((kids == 0).astype(np.int64)), below((stats["n"][f] - 1) * chars[f])
        head = ends - count
        leaf[long], saved[long], child[long] = leaves[head], gain[head], 1
        values = {"conv_id": stats["least"][f], "depth": d, "n": stats["n"][f], "kids": kids, "leaves": stats["leaves"][f] + leaves, "saved": stats["saved"][f] + gain, "at": row}
        rest = np.ones(len(row), bool)
        rest[head] = False
        nodes.add(**{k: v[rest] for k, v in values.items()}, parent=stats["least"][f - 1][rest], side=np.zeros(rest.sum()))
        deeper = {k: v[head] for k, v in values.items()}  # their parents are still to come

    here = [np.arange(rows)]
    for d in range(1, most + 1):
        here.append(here[-1][size[here[-1]] >= d])
    for d in range(most, -1, -1):
        at = here[d]
        begins = np.flatnonzero(common[at] < d)
        first, many = at[begins], np.diff(np.r_[begins, len(at)])
        f = base[at] + d
        n, least = np.add.reduceat(stats["n"][f], begins), np.minimum.reduceat(stats["least"][f], begins)
        kids = np.add.reduceat(stats["kids"][f] + child[at], begins)
        side = np.zeros(len(first), np.int64)
        if not top:
            side[-1:] = np.where(at[-1:] == rows - 1, 2, 0)
            side[:1] = np.where(first[:1] == 0, 1, side[:1])
        inner = side == 0
        leaf[first] += inner & (kids == 0)
        saved[first] += np.where(inner, (n - 1) * chars[f[begins]], 0)
        leaves, gain = np.add.reduceat(stats["leaves"][f] + leaf[at], begins), np.add.reduceat(stats["saved"][f] + saved[at], begins)
        child[:] = 0
        child[first[inner]] = 1
        if deeper is not None:
            up, low = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            up[at], low[at] = np.repeat(least, many), np.repeat(side, many)
            nodes.add(**deeper, parent=up[deeper["at"]], side=low[deeper["at"]])
        values = {"conv_id": least, "depth": np.full(len(first), d), "n": n, "kids": kids, "leaves": leaves, "saved": gain, "at": first}
        deeper = {k: v[inner] for k, v in values.items()}
        for i in np.flatnonzero(side):  # two at most
            for k, v in zip(_STATS, (n, least, kids, leaves, gain), strict=True):
                paths[side[i] - 1][1][k][d] = v[i]
        if len(paths) > 1 and side[0] == 1 and size[-1] >= d and at[-1] == rows - 1 and len(first) == 1:  # one node on both paths counts once
            for k in _STATS:
                paths[1][1][k][d] = _NONE if k == "least" else 0
    if deeper is not None and len(deeper["at"]):  # the root
        nodes.add(**deeper, parent=np.full(len(deeper["at"]), _NONE), side=np.zeros(len(deeper["at"])))
    return order, common, nodes.whole(), paths


def _numbers(seqs: list[bytes]) -> np.ndarray:
    """A number for every turn of every row, in the order of the ids."""
    joined = b"".join(seqs)
    return np.unique(np.frombuffer(joined, f"S{_KEY}"), return_inverse=True)[1] if joined else np.zeros(0, np.int64)


def prefixes(sequence: bytes) -> bytes:
    """A 16-byte name of every prefix, the empty one first."""
    h = hashlib.md5(usedforsecurity=False)
    out = [h.digest()]
    for i in range(0, len(sequence), _KEY):
        h.update(sequence[i : i + _KEY])
        out.append(h.copy().digest())
    return b"".join(out)


def _name(names: bytes, depth: int) -> bytes:
    return names[depth * _KEY : (depth + 1) * _KEY]


# kinds of a shard's rows: nodes whose parent is known, nodes under a path, paths, pieces of members' ids, names of the parents asked for
_NODE, _UNDER, _PATH, _PIECE, _ASKED = range(5)
_SCHEMA = "kind int, shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, seq binary, names binary, numbers binary"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary())]
    + [(k, pa.int64()) for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string()), ("seq", pa.binary()), ("names", pa.binary()), ("numbers", pa.binary())]
)


def _table(n: int, **columns) -> pa.Table:
    return pa.table([c if isinstance(c := columns.get(f.name), pa.Array) else pa.array([None] * n if c is None else c, f.type) for f in _ARROW], schema=_ARROW)


def _paths(shard: int, order: np.ndarray, seqs: list[bytes], names: dict[int, bytes], chars: list[np.ndarray], paths: list) -> pa.Table:
    rows = [order[at] for at, _ in paths]
    numbers = [np.concatenate([chars[r], *[s[k] for k in _STATS]]).tobytes() for r, (_, s) in zip(rows, paths, strict=True)]
    return _table(len(rows), kind=[_PATH] * len(rows), shard=[shard] * len(rows), seq=[seqs[r] for r in rows], names=[names[at] for at, _ in paths], numbers=numbers)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one shard's conversations (conv_id, seq, chars)."""
    from pyspark import TaskContext

    t = pa.Table.from_batches(list(batches), pa.schema([("conv_id", pa.int64()), ("seq", pa.binary()), ("chars", pa.list_(pa.int32()))])).combine_chunks()
    if not t.num_rows:
        return
    shard = TaskContext.get().partitionId()
    convs, seqs = t.column("conv_id").to_numpy(), t.column("seq").to_pylist()
    length = np.array([len(s) // _KEY for s in seqs], np.int64)
    ids = _numbers(seqs)
    own = np.cumsum(length + 1) - length - 1
    chars = np.zeros(len(ids) + len(seqs), np.int64)
    inner = np.ones(len(chars), bool)
    inner[own] = False
    chars[inner] = t.column("chars").combine_chunks().flatten().to_numpy()
    zero = np.zeros(len(chars), np.int64)
    stats = {"n": np.ones(len(chars), np.int64), "least": np.repeat(convs, length + 1), "kids": zero, "leaves": zero, "saved": zero}
    order, common, nodes, paths = build(ids, length, chars, stats, convs, False)
    size, sorted_convs = length[order], convs[order]
    names = {at: prefixes(seqs[order[at]]) for at, _ in paths}

    # members that end at a node: equal rows follow each other, the node's other members come after them
    fresh = np.flatnonzero((common < size) | np.r_[True, size[1:] != size[:-1]])
    pieces = {int(a): ",".join(map(str, sorted_convs[a:z].tolist())) for a, z in zip(fresh, np.r_[fresh[1:], len(size)], strict=True)}
    held = []
    for begin, members in pieces.items():  # rows that end on a path: what other shards hold of that node is not known here
        own_seq = seqs[order[begin]]
        on = next((at for at in names if seqs[order[at]].startswith(own_seq)), None)
        if on is not None:
            held.append((_name(names[on], len(own_seq) // _KEY), members))

    n = len(nodes["at"])
    digests = {a: hashlib.sha256(x.encode()).hexdigest() for a, x in pieces.items()}
    ended = size[nodes["at"]] == nodes["depth"]
    ends = [digests[a] if e else _NO_ENDS for a, e in zip(nodes["at"].tolist(), ended.tolist(), strict=True)]
    last = {s: at for s, (at, _) in zip((1, 2), paths, strict=False)}
    parents = [None if not s else _name(names[last[s]], d - 1) for s, d in zip(nodes["side"].tolist(), nodes["depth"].tolist(), strict=True)]
    under = nodes["side"] > 0
    whole = _table(
        n, kind=np.where(under, _UNDER, _NODE).astype(np.int32), shard=np.full(n, shard, np.int32), parent_key=parents, conv_id=nodes["conv_id"], depth=nodes["depth"], parent_conv_id=pa.array(nodes["parent"], mask=under),
        n_convs=nodes["n"], n_children=nodes["kids"], n_leaves=nodes["leaves"], saved_tokens=nodes["saved"], ends=ends,
    )
    yield from whole.to_batches(_ROWS)
    asked = sorted({p for p in parents if p is not None})
    yield from _table(len(asked), kind=[_ASKED] * len(asked), shard=[shard] * len(asked), key=asked).to_batches(_ROWS)
    yield from _table(len(held), kind=[_PIECE] * len(held), shard=[shard] * len(held), key=[k for k, _ in held], ends=[x for _, x in held]).to_batches(_ROWS)
    per_row = {order[at]: chars[own[order[at]] : own[order[at]] + length[order[at]] + 1] for at, _ in paths}
    yield from _paths(shard, order, seqs, names, per_row, paths).to_batches(_ROWS)


def _meet(top: bool):
    """The paths of neighbouring shards as one matrix."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, seqs, names = key[0].as_py(), group.column("seq").to_pylist(), group.column("names").to_pylist()
        length = np.array([len(s) // _KEY for s in seqs], np.int64)
        ids = _numbers(seqs)
        parts = [np.frombuffer(x, np.int64).reshape(1 + len(_STATS), -1) for x in group.column("numbers").to_pylist()]
        chars, *stats = (np.concatenate([p[i] for p in parts]) for i in range(1 + len(_STATS)))
        order, _, nodes, paths = build(ids, length, chars, dict(zip(_STATS, stats, strict=True)), np.arange(len(seqs)), top)
        row = order[nodes["at"]].tolist()
        depth = nodes["depth"].tolist()
        keys = [_name(names[r], d) for r, d in zip(row, depth, strict=True)]
        parents = [_name(names[r], d - 1) if d else None for r, d in zip(row, depth, strict=True)]
        n = len(row)
        whole = _table(
            n, kind=[_NODE] * n, shard=[shard] * n, key=keys, parent_key=parents, conv_id=nodes["conv_id"], depth=nodes["depth"], n_convs=nodes["n"], n_children=nodes["kids"], n_leaves=nodes["leaves"], saved_tokens=nodes["saved"]
        )
        return pa.concat_tables([whole, _paths(shard, order, seqs, {at: names[order[at]] for at, _ in paths}, {order[at]: parts[order[at]][0] for at, _ in paths}, paths)])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; one piece is held."""
    now, h = None, None
    for b in batches:
        keys, digests = [], []
        for key, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key != now:
                if h is not None:
                    keys.append(now)
                    digests.append(h.hexdigest())
                now, h = key, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of key, the hash of role and text in hexadecimal digits, and chars): each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    named = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).isNotNull().alias("given"), F.col(turn_col).alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"), F.length(text).alias("chars")
    )
    listed = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("given", "turn", "key", "chars"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, shared: int = 6, block: int = 100) -> DataFrame:
    """conv_id, turns: the first h turns of the conversation that opens the block of `block` ids, then the own turns after the first h; h is crc32(conv_id) mod `shared`."""
    own = materialise(sequences(turns), "turns")
    hub = F.col("conv_id") - F.col("conv_id") % block
    heads = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("hub"), F.slice("turns", 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    joined = own.withColumn("hub", hub).withColumn("h", h).join(heads, "hub", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def trie(convs: DataFrame, shards: int | None = None, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node; convs is (conv_id, turns) as sequences() gives it."""
    spark = convs.sparkSession
    flat = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")).alias("seq"), F.transform("turns", lambda x: x["chars"]).alias("chars"))
    flat = materialise(flat, "sequences")
    cells = flat.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    shards = shards or max(1, -(-cells // SHARD_CELLS), min(cells, spark.sparkContext.defaultParallelism))
    low = materialise(flat.repartitionByRange(shards, "seq", "conv_id").mapInArrow(_shard, _SCHEMA), "shards")

    paths, edges = low.filter(F.col("kind") == _PATH), None
    groups = (paths.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // fan)
        met = paths.withColumn("up", F.floor(F.col("shard") / fan).cast("int")).groupBy("up").applyInArrow(_meet(groups == 1), _SCHEMA)
        level = materialise(met, "paths")
        found = level.filter(F.col("kind") == _NODE)
        edges = found if edges is None else edges.unionByName(found)
        if groups == 1:
            break
        paths = level.filter(F.col("kind") == _PATH)

    pieces = low.filter(F.col("kind") == _PIECE).select("key", "shard", "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hashed, "key binary, ends_sha256 string")
    ids = edges.select("key", F.col("conv_id").alias("parent_conv_id"))
    top = edges.drop("parent_conv_id").join(ids.withColumnRenamed("key", "parent_key"), "parent_key", "left").join(digests, "key", "left")
    asked = low.filter(F.col("kind") == _ASKED).select("shard", "key").join(ids, "key").withColumnRenamed("key", "parent_key")
    under = low.filter(F.col("kind") == _UNDER).drop("parent_conv_id").join(asked, ["shard", "parent_key"])

    def columns(df: DataFrame, ends: Column) -> DataFrame:
        return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))

    parts = [columns(low.filter(F.col("kind") == _NODE), F.col("ends")), columns(under, F.col("ends")), columns(top, F.coalesce("ends_sha256", F.lit(_NO_ENDS)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


SQL = """
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'key': key, 'chars': chars} ORDER BY turn NULLS FIRST, key) AS turns FROM t GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM hashed AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (
  SELECT conv_id, len(turns) AS ends_at, d AS depth, md5(array_to_string(list_transform(turns[1:d], lambda x: x.key), '')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.key), '')) END AS up, CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM built)),
n AS (
  SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CASE WHEN ends_at = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
below AS (
  SELECT p.depth, p.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.node)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN below USING (depth, node) LEFT JOIN n AS q ON q.depth = m.depth - 1 AND q.node = m.up
"""
