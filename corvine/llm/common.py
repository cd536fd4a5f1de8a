"""Shared storage, Arrow access and vectorised word hashing for the operators here."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.sources.shared import shared_dir  # noqa: F401

#: Bytes of text that the vectorised kernels take at once; a longer text is taken alone.
SLICE = 2 << 20

def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fenced(column: Column) -> Column:
    """The same values behind a fence for the optimizer.

    A filter on a projected column is pushed below the projection with the column's
    expression put in its place, again inside every lambda that names it; what was linear
    in a text's length then is quadratic. Optimizer rules stop at expressions that they
    take for random, as they do a partition's number.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column without decoding; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return [b""] * len(column)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data)
    valid = column.is_valid().to_pylist() if column.null_count else None
    return [bytes(view[a:b]) if valid is None or valid[i] else b"" for i, (a, b) in enumerate(zip(at, at[1:]))]


def slices(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about ``size`` bytes, with the index of the first."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, texts[first:]


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """``slices(raw_texts(column))`` with only one run of texts in memory at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield first, raw_texts(column.slice(first, last - first))
        first = last


#: Bytes of text in a chunk; a longer text is one alone.
CHUNK = 2 << 20


def chunks_of(documents: DataFrame) -> DataFrame:
    """chunk (a random id), size (bytes of the column text) and data: rows of all columns as a compressed Arrow stream.

    To be written before use, so that ids stay. A chunk's rows keep their order, so that
    answers on them need no key of a document.
    """

    def pack(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends, first = np.cumsum(lengths), 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(first, last - first))
                ids, sizes = [uuid.uuid4().int >> 65], [int(ends[last - 1]) - before]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "size", "data"])
                first = last

    return documents.mapInArrow(pack, "chunk long, size long, data binary")


def stored_chunks(documents: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """``chunks_of`` as a table, and the bytes of text in it; a small one is dealt to all cores, whatever the number of its files."""
    spark = documents.sparkSession
    chunks = written(chunks_of(documents), folder, "packed")
    size, cores = chunks.agg(F.sum("size")).first()[0] or 0, spark.sparkContext.defaultParallelism
    if size < cores * CHUNK * 16:
        chunks = written(chunks.repartition(cores, "chunk"), folder, "chunks")
        dropped(spark, folder, "packed")
    return chunks, size


def chunk_batch(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def with_answers(chunks: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """chunk, data and answers: the rows (kind, bucket, data) for that chunk."""
    found = answers.groupBy(F.col("chunk").alias("__chunk")).agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("answers"))
    return chunks.select("chunk", "data").join(found, F.col("chunk") == F.col("__chunk"), how).drop("__chunk")


def separators(kept) -> np.ndarray:
    """256 flags: true for bytes that end a word."""
    return np.array([not kept(b) for b in range(256)])


#: Words are runs of what is not one of space, \t, \n, \v, \f, \r.
BLANK = separators(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: Words are runs of digits, lower-case letters and whatever is not ASCII.
PUNCT = separators(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words longer than this are hashed one by one.
LONG_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time are added and mixed in by a bijection, so unlike words of one size up to eight bytes never meet."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (eight[starts] & _FIRST[np.minimum(sizes, 8)]))
    some = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    done = 8
    while len(some):
        at = starts[some] + done
        out[some] = mixed(out[some] + (eight[at] & _FIRST[np.minimum(sizes[some] - done, 8)]))
        done += 8
        some = some[sizes[some] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


class Words:
    """The words of some texts: a 64-bit hash of each, where it is, and where each text's words begin.

    ``hashes[first[i]:first[i + 1]]`` are text i's words in order. ``data`` is the
    folded bytes of all texts with one separator after each.
    """

    def __init__(self, texts: list[bytes], ends_word: np.ndarray, fold: np.ndarray | None = LOWER):
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.data = data = fold.take(joined) if fold is not None else joined
        inside = ~ends_word.take(data)
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate(([0], change))
        self.starts, self.ends = starts, ends = change[0::2], change[1::2]
        self.hashes = word_hashes(data, starts, ends)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(starts, self.text_starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mixed(out)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
