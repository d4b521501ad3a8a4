"""Reading of HDF5 files: what annotated matrices use of the public format, in numpy.

Groups (symbol tables and compact links), attributes, and data sets of whole numbers, floats, booleans and strings, stored whole,
compact or in chunks with shuffle, deflate and checksum filters. A range of rows reads only the chunks that hold it. What else the
format has (dense links, compound types, newer chunk indexes) fails with its name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import product

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"


def _uint(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "little")


class Kind:
    """A datatype message: a numpy dtype, or text of fixed or variable length."""

    def __init__(self, data: bytes):
        kind, bits, self.size = data[0] & 15, data[1], _uint(data, 4, 4)
        order = ">" if bits & 1 else "<"
        self.text = self.heap = self.truth = False
        if kind == 0:
            self.dtype = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}")
        elif kind == 1:
            self.dtype = np.dtype(f"{order}f{self.size}")
        elif kind == 3:
            self.dtype, self.text = np.dtype(f"S{self.size}"), True
        elif kind == 8:  # names of numbers; of one byte: booleans
            self.dtype = Kind(data[8:]).dtype
            self.truth = self.dtype.itemsize == 1
        elif kind == 9 and bits & 15 == 1:
            self.dtype, self.text, self.heap = np.dtype([("n", "<u4"), ("at", "<u8"), ("index", "<u4")]), True, True
        else:
            raise NotImplementedError(f"HDF5 datatype of class {kind}")


def _space(data: bytes) -> tuple[int, ...]:
    at = 8 if data[0] == 1 else 4
    return tuple(_uint(data, at + 8 * i, 8) for i in range(data[1]))


class Node:
    """A group or a data set."""

    def __init__(self, file: File, address: int):
        self.file = file
        self.messages = list(file.messages(address))

    def _first(self, kind: int) -> bytes | None:
        return next((d for k, d in self.messages if k == kind), None)

    @cached_property
    def attrs(self) -> dict[str, object]:
        out = {}
        for kind, d in self.messages:
            if kind != 12:
                continue
            n, t, s = (_uint(d, 2 + 2 * i, 2) for i in range(3))
            at, pad = (8, 8) if d[0] == 1 else (8, 1) if d[0] == 2 else (9, 1)
            step = lambda k, pad=pad: -(-k // pad) * pad
            name = d[at : at + n].split(b"\0")[0].decode()
            at += step(n)
            where = d[at : at + t]
            at += step(t)
            shape = _space(d[at : at + s]) if d[at + 1] else ()
            at += step(s)
            try:
                one = Kind(where)
            except NotImplementedError:
                continue
            values = self.file.values(d[at : at + one.size * int(np.prod(shape, dtype=int))], one)
            out[name] = values.reshape(shape) if shape else values[0]
        return out

    @cached_property
    def children(self) -> dict[str, int]:
        out: dict[str, int] = {}
        table = self._first(17)
        if table is not None:
            tree, heap = _uint(table, 0, 8), _uint(table, 8, 8)
            names = self.file.at(_uint(self.file.at(heap, 32), 24, 8), _uint(self.file.at(heap, 32), 8, 8))
            for _, leaf in self.file.tree(tree, 8):
                head = self.file.at(leaf, 8)
                entries = self.file.at(leaf + 8, 40 * _uint(head, 6, 2))
                for i in range(0, len(entries), 40):
                    name = names[_uint(entries, i, 8) :].split(b"\0", 1)[0].decode()
                    out[name] = _uint(entries, i + 8, 8)
        for kind, d in self.messages:
            if kind == 2 and _uint(d, 2 + (8 if d[1] & 1 else 0), 8) != (1 << 64) - 1:
                raise NotImplementedError("HDF5 group with densely stored links")
            if kind == 6:
                flags, at = d[1], 2
                hard = not flags & 8 or d[at] == 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                wide = 1 << (flags & 3)
                n = _uint(d, at, wide)
                if hard:
                    out[d[at + wide : at + wide + n].decode()] = _uint(d, at + wide + n, 8)
        return out

    def __contains__(self, name: str) -> bool:
        return name in self.children

    def __getitem__(self, name: str) -> Node:
        node = self
        for part in name.strip("/").split("/"):
            node = Node(self.file, node.children[part])
        return node

    @property
    def is_group(self) -> bool:
        return self._first(8) is None

    @cached_property
    def shape(self) -> tuple[int, ...]:
        return _space(self._first(1))

    @cached_property
    def kind(self) -> Kind:
        return Kind(self._first(3))

    @cached_property
    def _filters(self) -> list[tuple[int, list[int]]]:
        d = self._first(11)
        if d is None:
            return []
        out, at = [], 8 if d[0] == 1 else 2
        for _ in range(d[1]):
            number = _uint(d, at, 2)
            named = d[0] == 1 or number >= 256
            size = _uint(d, at + 2, 2) if named else 0
            n = _uint(d, at + (6 if named else 4), 2)
            at += (8 if named else 6) + (-(-size // 8) * 8 if d[0] == 1 else size)
            out.append((number, [_uint(d, at + 4 * i, 4) for i in range(n)]))
            at += 4 * n + (4 if d[0] == 1 and n % 2 else 0)
        return out

    @cached_property
    def layout(self) -> tuple[int, int, int, tuple[int, ...]]:
        """(0 compact, 1 whole, 2 chunks; address; size; shape of a chunk)."""
        d = self._first(8)
        if d[0] != 3:
            raise NotImplementedError(f"HDF5 layout of version {d[0]}")
        if d[1] == 0:
            return 0, 0, _uint(d, 2, 2), ()
        if d[1] == 1:
            return 1, _uint(d, 2, 8), _uint(d, 10, 8), ()
        return 2, _uint(d, 3, 8), 0, tuple(_uint(d, 11 + 4 * i, 4) for i in range(d[2] - 1))

    @cached_property
    def _chunks(self) -> dict[tuple[int, ...], tuple[int, int, int]]:
        """Place of a chunk: (address, bytes, filters that were left out)."""
        rank = len(self.shape)
        out = {}
        if self.layout[1] != (1 << 64) - 1:
            for key, child in self.file.tree(self.layout[1], 8 + 8 * (rank + 1)):
                out[tuple(_uint(key, 8 + 8 * i, 8) for i in range(rank))] = (child, _uint(key, 0, 4), _uint(key, 4, 4))
        return out

    def _chunk(self, at: tuple[int, ...], wide: tuple[int, ...]) -> np.ndarray:
        address, size, skipped = self._chunks[at]
        data = self.file.at(address, size)
        for i, (number, values) in reversed(list(enumerate(self._filters))):
            if skipped >> i & 1:
                continue
            if number == 1:
                data = zlib.decompress(data)
            elif number == 2:
                width = values[0] if values else self.kind.size
                whole = len(data) // width * width
                data = np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]
            elif number == 3:
                data = data[:-4]
            else:
                raise NotImplementedError(f"HDF5 filter {number}")
        return np.frombuffer(data, self.kind.dtype, int(np.prod(wide))).reshape(wide)

    def rows(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Rows begin to end of the data set (all of it if it has no dimensions)."""
        shape = self.shape or (1,)
        end = shape[0] if end is None else min(end, shape[0])
        begin = min(begin, end)
        one = int(np.prod(shape[1:], dtype=int)) * self.kind.size
        form, address, _, wide = self.layout
        if form == 0:
            raw = np.frombuffer(self._first(8)[4 + begin * one : 4 + end * one], self.kind.dtype)
        elif form == 1:
            raw = np.frombuffer(self.file.at(address + begin * one, (end - begin) * one), self.kind.dtype) if address != (1 << 64) - 1 else np.zeros((end - begin) * one // self.kind.size, self.kind.dtype)
        else:
            raw = np.zeros((end - begin, *shape[1:]), self.kind.dtype)
            first = begin // wide[0] * wide[0]
            for at in product(range(first, end, wide[0]), *[range(0, n, w) for n, w in zip(shape[1:], wide[1:], strict=True)]):
                if at not in self._chunks:
                    continue  # never written: zeros
                low, high = max(at[0], begin), min(at[0] + wide[0], end)
                ends = [min(a + w, n) for a, w, n in zip(at[1:], wide[1:], shape[1:], strict=True)]
                part = self._chunk(at, wide)[(slice(low - at[0], high - at[0]), *[slice(0, z - a) for a, z in zip(at[1:], ends, strict=True)])]
                raw[(slice(low - begin, high - begin), *[slice(a, z) for a, z in zip(at[1:], ends, strict=True)])] = part
        return self.file.decoded(raw.ravel(), self.kind).reshape(end - begin, *shape[1:])


class File:
    """An open file; close() or `with`."""

    def __init__(self, path: str):
        self._f = open(path, "rb")  # noqa: SIM115
        self._heaps: dict[int, dict[int, bytes]] = {}
        head = self.at(0, 128)
        if head[:8] != SIGNATURE:
            raise ValueError(f"{path}: not an HDF5 file")
        if head[8] in (0, 1):
            if (head[13], head[14]) != (8, 8):
                raise NotImplementedError("HDF5 addresses of other than eight bytes")
            root = _uint(head, (24 if head[8] == 0 else 28) + 40, 8)
        else:
            root = _uint(head, 36, 8)
        self.root = Node(self, root)

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._f.close()

    def __getitem__(self, name: str) -> Node:
        return self.root[name]

    def __contains__(self, name: str) -> bool:
        return name in self.root

    def at(self, address: int, size: int) -> bytes:
        self._f.seek(address)
        return self._f.read(size)

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """(kind, data) of an object's header, with what it continues as."""
        head = self.at(address, 32)
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            wide = 1 << (flags & 3)
            blocks = [(address + at + wide, _uint(head, at, wide))]
            step = 4 + (2 if flags & 4 else 0)
        else:
            blocks, step = [(address + 16, _uint(head, 8, 4))], 8
        while blocks:
            begin, size = blocks.pop(0)
            block, at = self.at(begin, size), 0
            if step < 8 and block[:4] == b"OCHK":
                at, block = 4, block[:-4]
            while at + step <= len(block):
                kind, n = (_uint(block, at, 2), _uint(block, at + 2, 2)) if step == 8 else (block[at], _uint(block, at + 1, 2))
                data = block[at + step : at + step + n]
                at += step + n
                if kind == 16:
                    blocks.append((_uint(data, 0, 8), _uint(data, 8, 8)))
                elif kind:
                    yield kind, data

    def tree(self, address: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, child) of the leaves of a tree."""
        head = self.at(address, 24)
        n, level = _uint(head, 6, 2), head[5]
        data = self.at(address + 24, n * (key + 8) + key)
        for i in range(n):
            at = i * (key + 8)
            child = _uint(data, at + key, 8)
            if level:
                yield from self.tree(child, key)
            else:
                yield data[at : at + key], child

    def heap(self, address: int) -> dict[int, bytes]:
        """The objects of a collection of variable-length values."""
        if address not in self._heaps:
            if len(self._heaps) > 64:
                self._heaps.clear()
            size = _uint(self.at(address, 16), 8, 8)
            data, at, out = self.at(address, size), 16, {}
            while at + 16 <= size:
                index, n = _uint(data, at, 2), _uint(data, at + 8, 8)
                if not index:
                    break
                out[index] = data[at + 16 : at + 16 + n]
                at += 16 + -(-n // 8) * 8
            self._heaps[address] = out
        return self._heaps[address]

    def decoded(self, raw: np.ndarray, kind: Kind) -> np.ndarray:
        """Numbers in the machine's order, booleans, or texts as objects."""
        if kind.heap:
            return np.array([self.heap(int(r["at"]))[int(r["index"])][: int(r["n"])].decode() if r["n"] else "" for r in raw], object)
        if kind.text:
            return np.array([x.split(b"\0")[0].decode() for x in raw.tolist()], object)
        return raw.astype(bool) if kind.truth else raw.astype(raw.dtype.newbyteorder("="))

    def values(self, data: bytes, kind: Kind) -> np.ndarray:
        return self.decoded(np.frombuffer(data, kind.dtype), kind)


def pack(*parts: tuple[str, object]) -> bytes:
    """Little-endian fields after each other: (struct code, value)."""
    return b"".join(struct.pack("<" + code, value) for code, value in parts)
