"""What the operators of this folder share: tables, lineage cuts, connected groups, tokens as numpy arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 21
M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local session without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spanloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        path = _own[app]
    return path


_own: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; Spark removes the files with the DataFrame if so configured."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder, smaller than a checkpoint, which goes when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed(df.sparkSession, path, at_exit=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder that was written here, at once or when the application ends."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        system.deleteOnExit(own)
    else:
        system.delete(own, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def semi(df: DataFrame, key: str, others: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of df on key with the first column of others; no column of df can clash."""
    name = fresh(df, "__key")
    return df.join(others.toDF(name), df[key] == F.col(name), how)


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots; root is the least node of the connected group.

    Alternates large-star and small-star steps, each of them two shuffles of the remaining edges, until nothing
    changes; the number of rounds grows with the logarithm of a group's diameter. No step gathers a group in one row.
    """
    e = checkpoint(edges.toDF("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct())
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        pairs = large.join(down, large.a == down.u)
        small = pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("u", "m")).where("a <> b").distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.toDF("node", "root")
        seen = now


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes of text each; a longer text has a range of its own."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), n])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens between white space: (code of each token, offsets of each text's tokens, the distinct tokens)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    enc = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(enc.indices).astype(np.int64), offsets - offsets[0], enc.dictionary


def listed(column: pa.Array) -> list:
    """The values of a string or binary column as a list, by way of numpy: several times as fast as to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def plain(distinct: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Lower case, letters and digits only: (index of each token's plain form, -1 if that is empty; the plain forms)."""
    enc = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\pL\pN]+", "").dictionary_encode()
    forms, of = listed(enc.dictionary), np.asarray(enc.indices).astype(np.int64)
    if "" in forms:
        gap = forms.index("")
        forms.pop(gap)
        of = np.where(of == gap, -1, of - (of > gap))
    return of, forms


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted arrays."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along the first axis; 0 where that is empty."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have width bytes, as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]) if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, start).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


class Memo:
    """Rows of numbers kept by token, within a Python worker; emptied when it holds `most` tokens, which changes no result."""

    def __init__(self, width: int, compute, most: int = 400_000):
        self.compute, self.most, self.width = compute, most, width
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def of(self, distinct: pa.Array) -> np.ndarray:
        """A row for each of the distinct tokens."""
        if len(self.place) > self.most:
            self.clear()
        tokens = listed(distinct)
        new = [t for t in tokens if t not in self.place]
        if new:
            lo = len(self.place)
            self.place.update(zip(new, range(lo, lo + len(new))))
            if len(self.place) > len(self.rows):
                rows = np.zeros((max(2 * len(self.rows), len(self.place)), self.width))
                rows[:lo] = self.rows[:lo]
                self.rows = rows
            self.rows[lo : lo + len(new)] = self.compute(pa.array(new, pa.string()))
        return self.rows[np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))]


class Hashed:
    """Open addressing over 64-bit keys: indices of many keys at once, -1 for those that aren't there."""

    def __init__(self, keys: np.ndarray, load: int = 8):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * load))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        self.depth = 0
        while len(left):
            self.depth += 1
            free = self.at[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        at = self.at[slot]
        out = np.where((at >= 0) & (self.keys[slot] == keys), at, -1)
        for step in range(1, self.depth):
            todo = np.flatnonzero((out < 0) & (at >= 0))
            if not len(todo):
                break
            s = (slot[todo] + step) & ((1 << self.bits) - 1)
            hit = (self.at[s] >= 0) & (self.keys[s] == keys[todo])
            out[todo[hit]] = self.at[s[hit]]
        return out


def codepoints(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all code points, offsets of each string's)."""
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(np.fromiter(map(len, forms), np.int64, len(forms)))]).astype(np.int64)
