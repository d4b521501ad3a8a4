"""What the operators of this subpackage share: scratch tables, word rules, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions.scratch import scratch_dir

#: The white space that ends a word, as a Java / RE2 character class, and the words between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_scratch: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    _scratch.discard(path)
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder goes with the cluster's own clean-up
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared scratch folder and read it back: cuts the lineage, survives lost executors.

    The table goes when the session's Python process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/phenogrid-{uuid.uuid4().hex[:12]}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.add(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(table: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    for path in table.inputFiles()[:1]:
        _remove(table.sparkSession, path.rsplit("/", 1)[0])


def task_count(df: DataFrame) -> int:
    """Partitions of df as the planner lays them out (no job runs)."""
    return df.rdd.getNumPartitions()


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32(id as text) mod `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def frequent(counts: DataFrame, most: int) -> tuple[Column, int]:
    """(level, least): rows of `counts` (column c) whose level is at least that are the most frequent, at most `most` rows, never some of equal ones.

    A cut on the counts' scale instead of a top-k, whose candidates would all meet in one task; at most a few thousand levels."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    held, least = 0, 1 << 30
    for at, n in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        held += n
        if held > most:
            break
        least = at
    return level, least


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as make it differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Where to cut the texts, null as empty, into parts of about `size` bytes; a longer text comes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, end
        at = end


def sliced(texts: pa.Array, size: int) -> Iterator[list[str]]:
    """The texts, null as empty, about `size` bytes at a time; a longer text comes alone."""
    for a, b in spans(texts, size):
        yield [x or "" for x in texts.slice(a, b - a).to_pylist()]


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives freed memory back to the system: it stays, idle or not, beside the next stages' workers."""

    def go(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return go


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, the same in every process; remembers up to `keep` words between batches."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        value = self[word] = hash64(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.keep:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hash64(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def crc32_text(value: object) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; base is odd."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    step = np.uint64(base)  # base ** filled
    with np.errstate(over="ignore"):
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
            step = step * step
    return out[:n]


#: Fixed odd multipliers of the two rolling hashes (2**64 divided by the golden ratio; the 64-bit finaliser constant of a public mixer).
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def rolling(hashes: np.ndarray, width: int, base: int = BASE_A) -> np.ndarray:
    """Hash of every `width` consecutive values: sum of h[i+j] * base**(width-1-j) modulo 2**64, mixed at the end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out, size, acc, offset = None, 1, hashes, 0
        # doubling: a window of width w is built from the powers of two in w
        rest, mult = width, np.uint64(base)
        while rest:
            if rest & 1:
                part = acc[offset : offset + n]
                out = part.copy() if out is None else out * mult + part
                offset += size
            rest >>= 1
            if rest:
                acc = acc[:-size] * mult + acc[size:]
                size *= 2
                mult = mult * mult
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
