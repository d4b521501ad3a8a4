"""Sources and sinks: object tables of plates, their layout, catalogues of image files, and profile stores.

A plate is a folder with one delimited text file for each kind of object. Tables are merged by object (same keys) or by
relation (a child names its parent), annotated with the plate's layout, and split into annotations and features by name.
Batches are read in one plan: the folder's place in the path gives batch and plate.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.operators.clean import standard_well
from phenogrid.profile import Profile

#: Parts of names that make a column an annotation; case is ignored.
OBSERVATION_PARTS = ("ImageNumber", "ObjectNumber", "Metadata", "Location", "Parent")
KEYS = ("ImageNumber", "ObjectNumber", "Metadata_Well")


def read_objects(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", required: Sequence[str] = KEYS, schema: str | None = None) -> DataFrame:
    """A delimited object table with a header. Fails if a key column is missing. Give the schema to spare the pass that infers it."""
    reader = spark.read.option("header", True).option("sep", delimiter)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df


def prefix(df: DataFrame, name: str, keys: Sequence[str] = KEYS, plain: Sequence[str] = ("Metadata",)) -> DataFrame:
    """Features and locations get the table's name in front; keys and metadata keep theirs."""
    return df.select(*[F.col(c) if c in keys or any(p.lower() in c.lower() for p in plain) else F.col(c).alias(f"{name}_{c}") for c in df.columns])


def merge_objects(tables: Mapping[str, DataFrame], keys: Sequence[str] = KEYS, plain: Sequence[str] = ("Metadata",)) -> DataFrame:
    """Inner join of all tables on the object keys; metadata comes from the first."""
    out: DataFrame | None = None
    for name, df in tables.items():
        df = prefix(df, name, keys, plain)
        if out is None:
            out = df
        else:
            out = out.join(df.select(*[c for c in df.columns if c in keys or c not in out.columns]), list(keys))
    assert out is not None
    return out


def parent_chain(parents: Mapping[str, Sequence[str]]) -> list[str]:
    """The longest path child -> parent -> ... without a cycle; the first in order of names on ties."""
    best: list[str] = []

    def walk(path: list[str]) -> None:
        nonlocal best
        if len(path) > len(best):
            best = path
        for p in sorted(parents.get(path[-1], ())):
            if p in parents and p not in path:
                walk([*path, p])

    for start in sorted(parents):
        walk([start])
    return best


def merge_relations(tables: Mapping[str, DataFrame], parents: Mapping[str, Sequence[str]], parent_of, keys: Sequence[str] = ("ImageNumber", "Metadata_Well"), number: str = "ObjectNumber") -> DataFrame:
    """Join along the chain of parents, from the outermost child to its ancestors. parent_of(child, parent) names the child's column with
    the parent's number. Columns of the tables must differ but for the keys and the number, which stays the outermost child's."""
    chain = parent_chain(parents)
    out = tables[chain[0]]
    for child, parent in zip(chain, chain[1:], strict=False):
        up = tables[parent].withColumnRenamed(number, f"_{parent}")
        link = parent_of(child, parent)
        shared = [k for k in keys if k in out.columns and k in up.columns]
        cond = F.col(link) == F.col(f"_{parent}")
        for k in shared:
            up = up.withColumnRenamed(k, f"_{parent}_{k}")
            cond = cond & (F.col(k) == F.col(f"_{parent}_{k}"))
        out = out.join(up, cond).drop(f"_{parent}", *[f"_{parent}_{k}" for k in shared])
    return out


def annotate_layout(df: DataFrame, layout: DataFrame, well: str = "Metadata_Well", layout_well: str = "well", name: str = "Metadata_") -> DataFrame:
    """Join a plate's layout on the canonical well; wells that the layout lacks go. A layout has at most a row for each well of a plate: it is broadcast by its size."""
    side = layout.select(standard_well(layout_well).alias(well), *[F.col(c).alias(name + c) for c in layout.columns if c != layout_well])
    return df.withColumn(well, standard_well(well)).join(side, well)


def split_columns(columns: Sequence[str], parts: Sequence[str] = OBSERVATION_PARTS) -> tuple[list[str], list[str]]:
    """(annotations, features) by parts of names, case ignored."""
    obs = [c for c in columns if any(p.lower() in c.lower() for p in parts)]
    return obs, [c for c in columns if c not in obs]


def with_batch(df: DataFrame, path: Column | None = None) -> DataFrame:
    """BatchNumber and PlateNumber from the file path .../batch/plate/file: places of the sorted names, from 1. Names are few: they are ranked apart and joined."""
    path = F.input_file_name() if path is None else path
    parts = F.split(path, "/")
    df = df.withColumn("_batch", F.element_at(parts, -3)).withColumn("_plate", F.element_at(parts, -2))
    names = df.select("_batch", "_plate").distinct()
    numbers = names.select("_batch", "_plate", F.dense_rank().over(Window.orderBy("_batch")).alias("BatchNumber"), F.dense_rank().over(Window.partitionBy("_batch").orderBy("_plate")).alias("PlateNumber"))
    return df.join(numbers, ["_batch", "_plate"]).drop("_batch", "_plate")


def load_plates(spark: SparkSession, root: str, names: Sequence[str], suffix: str = ".csv", delimiter: str = ",", layout: str | None = None, schemas: Mapping[str, str] | None = None) -> Profile:
    """All plates under root/batch/plate as one profile: each table is one scan over all plates, with batch and plate in the join keys."""
    tables = {}
    for name in names:
        df = read_objects(spark, f"{root}/*/*/{name}{suffix}", delimiter, schema=(schemas or {}).get(name))
        tables[name] = with_batch(df)
    keys = ("BatchNumber", "PlateNumber", *KEYS)
    out = merge_objects(tables, keys)
    if layout:
        out = annotate_layout(out, spark.read.option("header", True).option("inferSchema", True).csv(layout))
    obs, feats = split_columns(out.columns, (*OBSERVATION_PARTS, "BatchNumber", "PlateNumber"))
    row_id = F.concat_ws("-", *[F.lpad(F.col(k).cast("string"), 10, "0") for k in keys])
    return Profile(X.ingest(out, feats).withColumn("row_id", row_id), feats)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns that all have."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    out = frames[0].select(*shared)
    for f in frames[1:]:
        out = out.unionByName(f.select(*shared))
    return out


def write_profile(p: Profile, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """A profile store: rows as Parquet, and what is not rows as one JSON text file beside."""
    p.df.write.mode(mode).partitionBy(*partition_by).parquet(f"{path}/rows")
    note = json.dumps({"features": p.features, "reps": p.reps, "row_id": p.row_id, "meta": p.meta})
    p.df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/profile")


def read_profile(spark: SparkSession, path: str) -> Profile:
    """A profile store, or an annotated matrix in one .h5ad file."""
    if path.endswith(".h5ad"):
        from phenogrid.sources.h5ad import read_h5ad

        return read_h5ad(spark, path)
    note = json.loads(spark.read.text(f"{path}/profile").first()[0])
    return Profile(spark.read.parquet(f"{path}/rows"), note["features"], note["reps"], note["row_id"], note["meta"])


def catalogue(paths: DataFrame, pattern: str, channels: Mapping[str, str], path: str = "path") -> DataFrame:
    """Image files by their name: the pattern's groups Row, Column and Field, the well, and the first channel whose mark the name holds; others go."""
    import re

    groups = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<[^>]*>", "(", pattern)
    name = F.element_at(F.split(path, "/"), -1)
    found = paths.withColumns({g: F.regexp_extract(name, plain, i) for g, i in groups.items()})
    channel = F.coalesce(*[F.when(F.contains(name, F.lit(mark)), F.lit(c)) for c, mark in channels.items()])
    found = found.withColumn("channel", channel).filter(F.col("channel").isNotNull() & (F.col("Row") != "") & (F.col("Column") != ""))
    return found.withColumn("Metadata_Well", standard_well(F.concat("Row", "Column"))).withColumn("Metadata_Field", F.col("Field").cast("int"))


def image_files(spark: SparkSession, root: str, suffix: str = ".tif") -> DataFrame:
    """Paths below root, without reading the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")


def patches(df: DataFrame, files: DataFrame, group: str, x: str, y: str, equal: Mapping[str, object] | None = None, most: int = 30, size: tuple[int, int] = (300, 300), image: tuple[int, int] = (2048, 2048), row_id: str = "row_id") -> DataFrame:
    """Windows to cut: the first `most` rows of each group whose (well, field) has images, numbered, with bounds that stay inside the image."""
    from phenogrid.operators.clean import query

    df = query(df, **(equal or {})).join(files.select("Metadata_Well", "Metadata_Field").distinct(), ["Metadata_Well", "Metadata_Field"], "left_semi")
    w = Window.partitionBy(group).orderBy(row_id)
    df = df.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= most).withColumn("number", F.col("number") - 1)

    def bound(c: str, length: int, whole: int) -> tuple[Column, Column]:
        low = F.greatest(F.lit(0), F.least(F.col(c).cast("int") - length // 2, F.lit(whole - length)))
        return low, low + length

    (x0, x1), (y0, y1) = bound(x, size[0], image[0]), bound(y, size[1], image[1])
    return df.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1})
