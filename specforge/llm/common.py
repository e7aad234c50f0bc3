"""Shared storage, distributed prefix sums and Arrow text access for the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays from so many bytes on are mapped on their own, so that a Python worker, which Spark keeps for later stages, gives their memory back when they are freed.
MAPPED_BYTES = 1 << 18


def _give_memory_back() -> None:
    """Where the C library has mallopt (glibc): a fixed threshold for mapping, two arenas; and Arrow's buffers by the same allocator."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        for option, value in ((-3, MAPPED_BYTES), (-8, 2)):  # M_MMAP_THRESHOLD, M_ARENA_MAX
            mallopt(option, value)


_give_memory_back()

#: Words are runs of anything but the ASCII blanks; Java regex form.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that Python code handles at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="specforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    free_shuffles(spark)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that are read no more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark._jvm.System.gc()


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], tag: str) -> DataFrame:
    """df with `idx` (its 0-based place in the order) and, for each long column s of sums, `before_s` (the sum of s over all earlier rows).

    Rows are dealt into ranges and sorted; each range sums its own rows and only one total per range meets on the
    driver, so no task or driver holds more than a range. `order` must end with a unique column for a fixed result.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("idx", T.LongType()), *[T.StructField(f"before_{s}", T.LongType()) for s in sums]])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen, carry = TaskContext.get().partitionId(), 0, {s: 0 for s in sums}
        for b in batches:
            n = b.num_rows
            cols = [*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(seen, seen + n))]
            for s in sums:
                v = b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                c = np.cumsum(v) + carry[s]
                cols.append(pa.array(c - v))
                carry[s] = int(c[-1]) if n else carry[s]
            seen += n
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    spark = df.sparkSession
    df = materialize(df, f"{tag}-read")  # ranges are sampled and rows dealt from this, so that what df reads is read once
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(within, schema), tag)
    drop(df)
    totals = parts.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"t_{s}") for s in sums]).orderBy("pid").collect()
    offsets, n, acc = [], 0, [0] * len(sums)
    for r in totals:
        offsets.append((r["pid"], n, *acc))
        n, acc = n + r["n"], [a + r[f"t_{s}"] for a, s in zip(acc, sums)]
    table = spark.createDataFrame(offsets or [(-1, 0, *acc)], "pid int, o_idx long" + "".join(f", o_{s} long" for s in sums))
    out = parts.join(F.broadcast(table), "pid")  # one row per range
    return out.select(*df.columns, (F.col("idx") + F.col("o_idx")).alias("idx"), *[(F.col(f"before_{s}") + F.col(f"o_{s}")).alias(f"before_{s}") for s in sums])


def fresh(taken: Sequence[str], *wanted: str) -> list[str]:
    """Each wanted name, with underscores before it until no taken name equals it, in any case."""
    used, out = {k.lower() for k in taken}, []
    for k in wanted:
        while k.lower() in used:
            k = f"_{k}"
        used.add(k.lower())
        out.append(k)
    return out


#: Bits that tell which values are needed: at most a 64th as many rows of 16 bytes are broadcast, whatever the input.
SLOTS = 1 << 24


def _slot(value: Column) -> tuple[Column, Column]:
    slot = F.pmod(F.xxhash64(value), F.lit(SLOTS))
    return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(values: DataFrame) -> DataFrame:
    """SLOTS bits, 64 a row, one set for each value of the only column."""
    word, bit = _slot(F.col(values.columns[0]))
    return values.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def among(df: DataFrame, column: str, bits: DataFrame, negate: bool = False) -> DataFrame:
    """The rows of df whose value of `column` has its bit set (or, negated, all others): those with one of the bitmap's values, and few more. No row is shuffled."""
    word, bits_of = fresh(df.columns, "word", "bits")
    at, bit = _slot(F.col(f"`{column}`"))
    joined = df.join(F.broadcast(bits.toDF(word, bits_of)), at == F.col(word), "left")
    has = F.coalesce(F.col(bits_of).bitwiseAND(bit) != 0, F.lit(False))
    return joined.filter(~has if negate else has).drop(word, bits_of)


def plainly(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with every column but those kept renamed to c0, c1..., so that a stage's own columns cannot clash; toDF(*docs.columns) undoes it."""
    return docs.toDF(*[k if k in keep else f"c{i}" for i, k in enumerate(docs.columns)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()).cast(pa.large_binary())
    large = pc.fill_null(large, b"")
    bufs = large.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str | int, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `most` bytes of text: the rows, their bytes and offsets."""
    for b in batches:
        data, offs = utf8(b.column(column if isinstance(column, int) else b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            j = min(j, b.num_rows)
            yield b.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
