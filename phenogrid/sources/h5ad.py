"""Annotated matrices in HDF5 (h5ad) as a Spark data source.

    spark.dataSource.register(H5adSource)
    spark.read.format("h5ad").load("/shared/plate.h5ad")

Columns: the index of the observations, their annotations, one column for each variable (double), one array for each representation in
obsm. A range of rows is a partition, cut at the borders of the matrix's chunks; a task opens the file and reads the chunks of its rows.
Only the columns of the given schema are read: `.schema("cell string, Area double")` prunes the others. The file must lie
where all executors can open it.

Matrices are dense or in compressed rows. Categories are decoded; code -1, NaN and infinities are NULL. A variable whose name an annotation
has already gets `_var` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from phenogrid.profile import Profile
from phenogrid.sources.hdf5 import File, Node

#: Numbers of the matrix in a partition, about.
PARTITION_NUMBERS = 4_000_000


def _index(group: Node) -> str:
    return str(group.attrs.get("_index", "_index"))


def _columns(group: Node) -> list[str]:
    order = group.attrs.get("column-order")
    return [str(c) for c in (order if order is not None else [])] or [c for c in group.children if c not in (_index(group), "__categories")]


def _type(node: Node) -> T.DataType:
    if node.is_group:
        node = node["categories"] if "categories" in node else node["values"]
    kind = node.kind
    return T.StringType() if kind.text else T.BooleanType() if kind.truth or kind.dtype.kind == "b" else T.DoubleType() if kind.dtype.kind == "f" else T.LongType()


@dataclass
class Layout:
    """What a file holds: rows, index and annotations with types, variables and their columns, representations."""

    rows: int
    index: str
    obs: dict[str, T.DataType]
    variables: dict[str, int]
    reps: list[str]
    rows_of_chunk: int

    @classmethod
    def of(cls, path: str) -> Layout:
        with File(path) as f:
            obs, var, x = f["obs"], f["var"], f["X"]
            index = _index(obs)
            names = [str(v) for v in var[_index(var)].rows()]
            kinds = {index: T.StringType() if obs[index].kind.text else T.LongType(), **{c: _type(obs[c]) for c in _columns(obs)}}
            taken = {c.lower() for c in kinds}
            columns = {n + "_var" if n.lower() in taken else n: i for i, n in enumerate(names)}
            reps = [r for r in (f["obsm"].children if "obsm" in f else ()) if not f["obsm"][r].is_group]
            step = x.layout[3][0] if not x.is_group and x.layout[0] == 2 else 1
            return cls(obs[index].shape[0], index, kinds, columns, reps, step)

    def schema(self) -> T.StructType:
        number = T.DoubleType()
        return T.StructType([*[T.StructField(c, k) for c, k in self.obs.items()], *[T.StructField(c, number) for c in self.variables], *[T.StructField(r, T.ArrayType(number)) for r in self.reps]])


def _numbers(x: np.ndarray) -> pa.Array:
    x = x.astype(float)
    return pa.array(x, mask=~np.isfinite(x))


def _annotation(node: Node, begin: int, end: int, kind: T.DataType) -> pa.Array:
    if node.is_group and "categories" in node:
        labels = node["categories"].rows().tolist()
        return pa.array([labels[c] if c >= 0 else None for c in node["codes"].rows(begin, end).tolist()])
    gone = None
    if node.is_group:  # nullable: values and mask
        gone, node = node["mask"].rows(begin, end).astype(bool), node["values"]
    values = node.rows(begin, end)
    if isinstance(kind, T.DoubleType):
        return _numbers(np.where(gone, np.nan, values) if gone is not None else values)
    return pa.array(values.tolist() if values.dtype == object else values, mask=gone)


def matrix(x: Node, begin: int, end: int, wide: int) -> np.ndarray:
    """Rows of a dense matrix or of one in compressed rows."""
    if not x.is_group:
        return x.rows(begin, end).astype(float)
    if str(x.attrs.get("encoding-type", "csr_matrix")) != "csr_matrix":
        raise NotImplementedError("matrices in compressed columns")
    edges = x["indptr"].rows(begin, end + 1).astype(np.int64)
    out = np.zeros((end - begin, wide))
    if edges[-1] > edges[0]:
        row = np.repeat(np.arange(end - begin), np.diff(edges))
        out[row, x["indices"].rows(int(edges[0]), int(edges[-1]))] = x["data"].rows(int(edges[0]), int(edges[-1]))
    return out


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))


class H5adReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, numbers: int):
        self.path, self.wanted, self.numbers = path, schema, numbers
        self.layout = Layout.of(path)
        unknown = [f.name for f in schema if f.name not in self.layout.obs and f.name not in self.layout.variables and f.name not in self.layout.reps]
        if unknown:
            raise ValueError(f"{path}: no column {', '.join(unknown)}")

    def partitions(self) -> list[InputPartition]:
        chunk = self.layout.rows_of_chunk
        step = max(1, self.numbers // max(1, len(self.layout.variables)) // chunk) * chunk
        return [Rows(i, min(i + step, self.layout.rows)) for i in range(0, self.layout.rows, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        begin, end = partition.value
        arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        with File(self.path) as f:
            step = max(1, min(end - begin, 2_000_000 // max(1, len(self.wanted))))
            for a in range(begin, end, step):
                z = min(a + step, end)
                x = matrix(f["X"], a, z, len(self.layout.variables)) if any(c.name in self.layout.variables for c in self.wanted) else None
                out = []
                for c in self.wanted:
                    if c.name in self.layout.variables:
                        out.append(_numbers(x[:, self.layout.variables[c.name]]))
                    elif c.name in self.layout.obs:
                        out.append(_annotation(f["obs"][c.name], a, z, c.dataType).cast(arrow[c.dataType.simpleString()]))
                    else:
                        r = f["obsm"][c.name].rows(a, z).astype(float)
                        out.append(pa.FixedSizeListArray.from_arrays(_numbers(r.ravel()), r.shape[1]).cast(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(out, [c.name for c in self.wanted])


class H5adSource(DataSource):
    """Options: partition_numbers, how many numbers of the matrix a partition holds."""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> T.StructType:
        return Layout.of(self.options["path"].removeprefix("file://").removeprefix("file:")).schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return H5adReader(self.options["path"].removeprefix("file://").removeprefix("file:"), schema, int(self.options.get("partition_numbers", PARTITION_NUMBERS)))


def read_h5ad(spark: SparkSession, path: str, schema: T.StructType | str | None = None, partition_numbers: int = PARTITION_NUMBERS) -> Profile:
    """The file as a profile; with a schema, only its columns."""
    spark.dataSource.register(H5adSource)
    reader = spark.read.format("h5ad").option("partition_numbers", partition_numbers)
    df: DataFrame = (reader if schema is None else reader.schema(schema)).load(path)
    held = Layout.of(path.removeprefix("file://").removeprefix("file:"))
    return Profile(df, [c for c in df.columns if c in held.variables], [c for c in df.columns if c in held.reps], held.index)
