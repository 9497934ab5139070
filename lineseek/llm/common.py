"""Tables, scratch tables and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.plans.session import scratch_path

#: Bytes of text that a vectorised step takes at a time; one longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Bytes of rows that Python workers get at a time, unless the session says otherwise: whole texts differ too much in size to be counted in rows.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written once to the shared folder of the cluster and read back.

    A written table survives lost executors and is computed once however often
    it is read. ``drop`` gives a table's space back when nothing reads it any more.
    ``by_bytes``: Python workers get the session's rows by ``BATCH_BYTES``.
    """

    def __init__(self, spark: SparkSession, label: str, by_bytes: bool = False) -> None:
        self.spark, self.label, self.paths = spark, label, {}
        if by_bytes and spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def keep(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, name: str, df: DataFrame) -> DataFrame:
        """Keeps a table that ends the work and drops all others."""
        df = self.keep(name, df)
        self.drop(*(other for other in self.paths if other != name))
        return df


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that matter, whatever else the table carries; null text counts as empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns, and each row of ``docs`` as one struct ``row``, whatever its columns are called."""
    return docs.select(*columns, F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row``, some of them replaced."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``CHUNK_BYTES``: first row, last row (exclusive), bytes, offsets in these bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SOLID = ~SPACE
PLACE = numbers(1024, 11)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, inside: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: 64-bit hashes, first byte, end byte, and the first word of each text (with the total last).

    A word is a run of bytes other than space and U+0009 to U+000D, or of those
    that ``inside`` marks; ``lower`` folds A-Z. The hash is multilinear over the bytes: one fixed multiplier a place.
    """
    solid = inside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = solid[inner]
    at = np.flatnonzero(solid)
    begin = np.flatnonzero(first[at])  # in the compressed bytes
    if not len(begin):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    sizes = np.diff(begin, append=len(at))
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    longest = int(sizes.max())
    table = PLACE if longest <= len(PLACE) else numbers(longest, 11)
    code = (LOWER[data[at]] if lower else data[at]).astype(np.uint64)
    code += np.uint64(1)
    code *= table[place]
    hashes = mix(np.add.reduceat(code, begin) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    starts = at[begin]
    return hashes, starts, starts + sizes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, in order, and the first run of each text.

    With ``whole``, a text of fewer words gives its whole sequence as its only run.
    """
    counts = np.diff(bounds)
    runs = np.maximum(counts - size + 1, 0)
    factors = numbers(size, 23)
    n = max(len(hashes) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * factors[j]
    total = mix(total)
    begin = np.concatenate([[0], np.cumsum(runs)])
    keep = np.arange(begin[-1]) - np.repeat(begin[:-1], runs) + np.repeat(bounds[:-1], runs)
    out = total[keep]
    short = np.flatnonzero((counts > 0) & (counts < size)) if whole else ()
    if len(short):
        runs = runs.copy()
        runs[short] = 1
        extra = [mix((hashes[bounds[i] : bounds[i + 1]] * factors[: counts[i]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(counts[i]))[0] for i in short]
        out = np.insert(out, begin[short], np.array(extra, np.uint64))
        begin = np.concatenate([[0], np.cumsum(runs)])
    return out, begin


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
