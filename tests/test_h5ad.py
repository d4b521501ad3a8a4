"""The h5ad source on files that are written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.sources import h5ad, hdf5

NONE = (1 << 64) - 1


def pad(data, n=8):
    return data + b"\0" * (-len(data) % n)


INT8 = bytes([0x10, 8, 0, 0]) + struct.pack("<IHH", 1, 0, 8)
INT32 = bytes([0x10, 8, 0, 0]) + struct.pack("<IHH", 4, 0, 32)
INT64 = bytes([0x10, 8, 0, 0]) + struct.pack("<IHH", 8, 0, 64)
F32 = bytes([0x11, 0x20, 31, 0]) + struct.pack("<IHHBBBBI", 4, 0, 32, 23, 8, 0, 23, 127)
F64 = bytes([0x11, 0x20, 63, 0]) + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023)
BOOL = bytes([0x18, 2, 0, 0]) + struct.pack("<I", 1) + INT8 + pad(b"FALSE\0") + pad(b"TRUE\0") + b"\0\1"
TEXT = bytes([0x19, 1, 0, 0]) + struct.pack("<I", 16) + bytes([0x13, 0, 0, 0]) + struct.pack("<I", 1)
KINDS = {np.dtype("i1"): INT8, np.dtype("<i4"): INT32, np.dtype("<i8"): INT64, np.dtype("<f4"): F32, np.dtype("<f8"): F64, np.dtype(bool): BOOL}


class Writer:
    def __init__(self):
        self.b = bytearray(96)

    def put(self, data):
        self.b += b"\0" * (-len(self.b) % 8)
        at = len(self.b)
        self.b += data
        return at

    def texts(self, values):
        """References into a collection of variable-length values."""
        objects, refs = b"", []
        for i, v in enumerate(values, 1):
            data = v.encode()
            objects += struct.pack("<HHIQ", i, 1, 0, len(data)) + pad(data)
            refs.append((len(data), i))
        at = self.put(b"GCOL\1\0\0\0" + struct.pack("<Q", 16 + len(objects) + 16) + objects + bytes(16))
        return b"".join(struct.pack("<IQI", n, at, i) for n, i in refs)

    def raw(self, x):
        if isinstance(x, str):
            return TEXT, (), self.texts([x])
        if isinstance(x, list) or x.dtype == object:
            return TEXT, (len(x),), self.texts(list(x))
        if x.dtype.kind == "S":
            return bytes([0x13, 0, 0, 0]) + struct.pack("<I", x.dtype.itemsize), x.shape, x.tobytes()
        return KINDS[x.dtype], x.shape, x.tobytes()

    @staticmethod
    def space(shape):
        return bytes([1, len(shape), 0, 0, 0, 0, 0, 0]) + b"".join(struct.pack("<Q", n) for n in shape)

    def attribute(self, name, value):
        kind, shape, data = self.raw(value)
        name, space = name.encode() + b"\0", self.space(shape)
        return 12, struct.pack("<BBHHH", 1, 0, len(name), len(kind), len(space)) + pad(name) + pad(kind) + pad(space) + data

    def header(self, messages, split=None):
        """An object header; with split, the messages from there on stand in a continuation."""
        body = lambda ms: b"".join(struct.pack("<HHB3x", k, len(pad(d)), 0) + pad(d) for k, d in ms)
        if split:
            rest = body(messages[split:])
            messages = [*messages[:split], (16, struct.pack("<QQ", self.put(rest), len(rest)))]
        data = body(messages)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(data)) + data)

    def data(self, x, chunk=None, filters=(), attrs=None):
        kind, shape, data = self.raw(x)
        messages = [(1, self.space(shape)), (3, kind)]
        size = len(data) // max(1, int(np.prod(shape)))
        if chunk is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(data) if data else NONE, len(data))))
        else:
            whole = np.frombuffer(data, f"V{size}").reshape(shape)
            keys = []
            for at in np.ndindex(*[-(-n // c) for n, c in zip(shape, chunk, strict=True)]):
                begin = [a * c for a, c in zip(at, chunk, strict=True)]
                block = np.zeros(chunk, f"V{size}")
                part = whole[tuple(slice(b, b + c) for b, c in zip(begin, chunk, strict=True))]
                block[tuple(slice(0, n) for n in part.shape)] = part
                stored = block.tobytes()
                for f in filters:
                    stored = np.frombuffer(stored, np.uint8).reshape(-1, size).T.tobytes() if f == 2 else zlib.compress(stored) if f == 1 else stored + b"sum."
                keys.append((struct.pack("<II", len(stored), 0) + b"".join(struct.pack("<Q", b) for b in [*begin, 0]), self.put(stored)))
            leaves = [keys[i : i + 3] for i in range(0, len(keys), 3)]
            node = lambda level, items: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(items), NONE, NONE) + b"".join(k + struct.pack("<Q", a) for k, a in items) + items[-1][0])
            tree = node(1, [(leaf[0][0], node(0, leaf)) for leaf in leaves])
            messages.append((8, struct.pack("<BBBQ", 3, 2, len(shape) + 1, tree) + b"".join(struct.pack("<I", c) for c in (*chunk, size))))
            if filters:
                messages.append((11, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", f, 0, 0, n) + struct.pack("<II", size if f == 2 else 6, 0) * n for f, n in ((f, 0 if f == 3 else 1) for f in filters))))
        return self.header(messages + [self.attribute(k, v) for k, v in (attrs or {}).items()], split=2)

    def group(self, children, attrs=None):
        names, segment, entries = sorted(children), b"\0" * 8, b""
        for n in names:
            entries += struct.pack("<QQII16x", len(segment), children[n], 0, 0)
            segment += pad(n.encode() + b"\0")
        heap = self.put(b"HEAP\0\0\0\0" + struct.pack("<QQQ", len(segment), 1, self.put(segment)))
        half = len(names) // 2 or len(names)
        leaves = [self.put(b"SNOD\1\0" + struct.pack("<H", len(e) // 40) + e) for e in (entries[: 40 * half], entries[40 * half :]) if e]
        tree = self.put(b"TREE" + struct.pack("<BBHQQQ", 0, 0, len(leaves), NONE, NONE, 0) + b"".join(struct.pack("<QQ", a, 8) for a in leaves))
        return self.header([(17, struct.pack("<QQ", tree, heap))] + [self.attribute(k, v) for k, v in (attrs or {}).items()])

    def save(self, path, root):
        self.b[:96] = hdf5.SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHIQQQQQQII16x", 4, 16, 0, 0, NONE, len(self.b), NONE, 0, root, 0, 0)
        path.write_bytes(bytes(self.b))
        return str(path)


N, P = 250, 7


def build(path, sparse=False):
    rng = np.random.default_rng(1)
    w = Writer()
    x = rng.normal(size=(N, P)).astype("<f4")
    x[3, 2], x[4, 4] = np.nan, np.inf
    if sparse:
        x = np.where(rng.random((N, P)) < 0.3, x, 0).astype("<f4")
        x[10:20] = 0
        at = np.nonzero(x)
        matrix = w.group(
            {"data": w.data(x[at], (40,), (2, 1)), "indices": w.data(at[1].astype("<i4")), "indptr": w.data(np.r_[0, np.cumsum((x != 0).sum(1))].astype("<i4"))},
            {"encoding-type": "csr_matrix", "shape": np.array([N, P])},
        )
    else:
        matrix = w.data(x, (32, 3), (2, 1, 3))
    cells = [f"cell-{i}é" for i in range(N)]
    codes = rng.integers(-1, 2, N).astype("i1")
    wells = np.array([f"B{i % 9:02d}".encode() for i in range(N)])
    obs = {
        "_index": w.data(cells, (64,)), "Metadata_Well": w.data(wells), "n": w.data(np.arange(N), (50,), (1,)), "ok": w.data(np.arange(N) % 3 == 0), "depth": w.data(np.where(np.arange(N) % 5, np.arange(N) * 0.5, np.nan)),
        "treat": w.group({"codes": w.data(codes), "categories": w.data(["ctrl", "drug"])}, {"encoding-type": "categorical"}), "count": w.group({"values": w.data(np.arange(N)), "mask": w.data(np.arange(N) % 4 == 0)}, {"encoding-type": "nullable-integer"}),
    }
    names = ["Area", "Mean", "depth", "v3", "v4", "v5", "v6"]
    pca = rng.normal(size=(N, 3))
    root = w.group({
        "X": matrix, "obs": w.group(obs, {"_index": "_index", "column-order": ["Metadata_Well", "treat", "n", "ok", "depth", "count"]}), "var": w.group({"name": w.data(names)}, {"_index": "name"}),
        "obsm": w.group({"X_pca": w.data(pca, (100, 2))}), "uns": w.group({"empty": w.data(np.zeros(0))}),
    }, {"encoding-type": "anndata"})
    return w.save(path, root), x, codes, pca


@pytest.mark.parametrize("sparse", [False, True])
def test_file_is_read_whole(spark, tmp_path, sparse):
    path, x, codes, pca = build(tmp_path / "a.h5ad", sparse)
    p = h5ad.read_h5ad(spark, path, partition_numbers=64 * P)
    assert p.features == ["Area", "Mean", "depth_var", "v3", "v4", "v5", "v6"] and p.reps == ["X_pca"] and p.row_id == "_index"
    assert p.df.columns[:7] == ["_index", "Metadata_Well", "treat", "n", "ok", "depth", "count"] and p.df.rdd.getNumPartitions() == 4
    rows = sorted(p.df.collect(), key=lambda r: r.n)
    assert [r["_index"] for r in rows] == [f"cell-{i}é" for i in range(N)] and [r.Metadata_Well for r in rows] == [f"B{i % 9:02d}" for i in range(N)]
    assert [r.treat for r in rows] == [None if c < 0 else ["ctrl", "drug"][c] for c in codes]
    assert [r.ok for r in rows] == [i % 3 == 0 for i in range(N)] and [r.depth for r in rows] == [i * 0.5 if i % 5 else None for i in range(N)]
    assert [r["count"] for r in rows] == [i if i % 4 else None for i in range(N)]
    for j, f in enumerate(p.features):
        assert [r[f] for r in rows] == [float(v) if np.isfinite(v) else None for v in x[:, j]]
    assert np.allclose([r.X_pca for r in rows], pca)


def test_only_the_columns_of_the_schema_are_read(spark, tmp_path, monkeypatch):
    path, x, *_ = build(tmp_path / "a.h5ad")
    p = h5ad.read_h5ad(spark, path, "Area double, Metadata_Well string")
    assert p.df.columns == ["Area", "Metadata_Well"] and p.features == ["Area"]
    got = p.df.groupBy("Metadata_Well").agg(F.sum("Area").alias("s")).collect()
    assert sum(r.s for r in got) == pytest.approx(float(x[:, 0].astype(float).sum()))
    seen = []
    rows = hdf5.Node.rows
    monkeypatch.setattr(hdf5.Node, "rows", lambda self, *a: seen.append(self.shape) or rows(self, *a))
    reader = h5ad.H5adReader(path, p.df.select("Metadata_Well").schema, 1000)
    seen.clear()
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == N and (N, P) not in seen
    with pytest.raises(ValueError, match="no column"):
        h5ad.H5adReader(path, spark.createDataFrame([], "other double").schema, 1000)


def test_a_range_reads_only_its_chunks(tmp_path):
    path, x, *_ = build(tmp_path / "a.h5ad")
    with hdf5.File(path) as f:
        node, read = f["X"], []
        chunk = node._chunk
        node._chunk = lambda at, wide: read.append(at) or chunk(at, wide)
        assert np.array_equal(node.rows(70, 90), x[70:90], equal_nan=True) and {a[0] for a in read} == {64}
        assert node.rows(250, 300).shape == (0, P) and f["uns/empty"].rows().shape == (0,) and "obs" in f and f.root.attrs["encoding-type"] == "anndata"
    (tmp_path / "b").write_bytes(b"no such thing" * 20)
    with pytest.raises(ValueError, match="not an HDF5 file"):
        hdf5.File(str(tmp_path / "b"))
