"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from contrapair.session import scratch_path

#: Words of the contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 31)) / F.lit(float(1 << 31))


def crc_fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)


def proper_vector(vec: Column) -> Column:
    """True for a vector that has components, all of them finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & finite, F.lit(False))


def stack(values) -> np.ndarray:
    """Equal-length sequences of an Arrow batch as one matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def publish(spark: SparkSession, name: str, content: bytes) -> str:
    """Put a small file into the shared folder and hand it to the executors; returns its name for SparkFiles.

    Written through Hadoop's file system, so the folder may be in any store; an executor started
    later fetches the file again, so lost executors cost nothing.
    """
    unique = f"{uuid.uuid4().hex}-{name}"
    target = f"{scratch_path(spark, 'file')}/{unique}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(conf).create(path, True)
    try:
        for at in range(0, len(content), 1 << 20):
            out.write(bytearray(content[at:at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.getFileSystem(conf).makeQualified(path).toString())
    return unique


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
         "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def release() -> None:
    """Give memory that earlier tasks no longer need back to the system, since Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library has it
    if trim:
        trim(0)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to the session's Python workers in batches of about BATCH_BYTES, unless it has a smaller bound.

    Spark's own bound is 10,000 rows, and these hold 20 MB and more where they are whole texts, in the executor and in each worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, rows: int, size: int, column: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose string column (the last) holds about ``size`` bytes; a longer text is a run of its own."""
    column = batch.num_columns - 1 if column is None else column
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = max(at + 1, min(at + rows, past))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, text_col: str, carry: list[str], fields: dict[str, str], start: Callable[[], Callable[[list], dict]],
              *, rows: int = 512, size: int = 8 << 20) -> DataFrame:
    """The columns ``carry`` beside new ones computed from whole texts, a slice of an Arrow batch at a time.

    ``start`` is called once in each task and returns what turns a list of texts (None for null) into a list for each field.
    A string column that is also carried goes to the tasks once.
    """
    narrow = df.select(*[F.col(f"`{c}`") for c in carry])
    carried = narrow.schema
    if text_col in carry and carried[text_col].dataType == StringType():
        at = carry.index(text_col)
    else:
        inner, at = "text", len(carry)
        while inner in carry:
            inner += "_"
        narrow = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias(inner))
    new = StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in fields.items()))
    kinds = [ARROW[k] for k in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        work = start()
        for batch in batches:
            for part in slices(batch, rows, size, at):
                made = work(part.column(at).to_pylist())
                arrays = [pa.array(made[n], type=kind) for n, kind in zip(fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(carry)], *arrays], names=[*carry, *fields])
        del work
        release()

    return narrow.mapInArrow(run, StructType([*carried.fields, *new.fields]))


class Index:
    """Finds whole numbers in a fixed set, many at once (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        waiting, step = np.arange(len(keys)), 0
        while len(waiting):
            at = self._slot(self.keys[waiting], step)
            free = self.slots[at] < 0
            taken, first = np.unique(at[free], return_index=True)
            placed = waiting[free][first]
            self.slots[taken] = placed
            waiting, step = np.setdiff1d(waiting, placed), step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (h.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each number in the set, -1 if it isn't there."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        live, step = None, 0
        while live is None or len(live):
            asked = keys if live is None else keys[live]
            got = self.slots[self._slot(asked, step)]
            hit = (got >= 0) & (self.keys[got] == asked)
            more = (got >= 0) & ~hit
            if live is None:
                out[hit] = got[hit]
                live = np.flatnonzero(more)
            else:
                out[live[hit]] = got[hit]
                live = live[more]
            step += 1
        return out
