"""Vector files: ``fvecs`` and ``bvecs`` as data sources for reading and writing.

A record is a little-endian 32-bit length and as many float32 (fvecs) or uint8
(bvecs). All records of a file are as long as its first, so files are read in
independent ranges. The data sources take paths that are local or mounted on all
machines; ``from_store`` reads files of any size from any store that Spark reads,
in splits, and ``from_binary_files`` small ones as wholes.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "vec_id bigint, embedding array<float>"
KINDS = {"fvecs": np.dtype("<f4"), "bvecs": np.dtype("u1")}
RANGE_BYTES = 32 << 20


def decode(data: bytes, kind: str) -> np.ndarray:
    """Vectors ``[n, D]`` as float32."""
    if not data:
        return np.empty((0, 0), np.float32)
    width = KINDS[kind]
    dim = int(np.frombuffer(data[:4], "<i4")[0])
    size = 4 + dim * width.itemsize
    if dim < 1 or len(data) % size:
        raise ValueError("not a whole number of records")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    if (np.ascontiguousarray(raw[:, :4]).view("<i4") != dim).any():
        raise ValueError("records have different lengths")
    return np.ascontiguousarray(raw[:, 4:]).view(width).astype(np.float32)


def encode(vectors: np.ndarray, kind: str) -> bytes:
    if not len(vectors):
        return b""
    body = np.ascontiguousarray(vectors.astype(KINDS[kind])).view(np.uint8).reshape(len(vectors), -1)
    head = np.full((len(vectors), 1), vectors.shape[1], "<i4").view(np.uint8)
    return np.concatenate([head, body], axis=1).tobytes()


def batch_of(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    starts = np.arange(len(vectors) + 1, dtype=np.int32) * (vectors.shape[1] if len(vectors) else 0)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(starts), pa.array(vectors.reshape(-1), pa.float32()))], names=["vec_id", "embedding"])


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, size: int, first: int):
        self.path, self.begin, self.size, self.first = path, begin, size, first


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options):
        self.kind, self.path = kind, options["path"]
        self.limit = int(options.get("limit", -1))

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, f"*.{self.kind}"))) if os.path.isdir(self.path) else [self.path]
        out, first = [], 0
        for path in files:
            total = os.path.getsize(path)
            if not total:
                continue
            with open(path, "rb") as f:
                dim = int(np.frombuffer(f.read(4), "<i4")[0])
            record = 4 + dim * KINDS[self.kind].itemsize
            rows = total // record
            if self.limit >= 0:
                rows = min(rows, max(0, self.limit - first))
            step = max(1, RANGE_BYTES // record)
            out += [_Range(path, at * record, min(step, rows - at) * record, first + at) for at in range(0, rows, step)]
            first += rows
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(partition.begin)
            vectors = decode(f.read(partition.size), self.kind)
        yield batch_of(np.arange(partition.first, partition.first + len(vectors)), vectors)


class _Message(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, kind: str, options, overwrite: bool):
        self.kind, self.path, self.overwrite = kind, options["path"], overwrite

    def write(self, rows) -> _Message:
        from pyspark import TaskContext

        own = [(r[0], r[1]) for r in rows]
        if not own:
            return _Message(None)
        own.sort(key=lambda x: x[0])
        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        path = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        with open(path, "wb") as f:
            f.write(encode(np.array([v for _, v in own], np.float32), self.kind))
        return _Message(path)

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, f"*.{self.kind}")):
                os.remove(old)
        for m in messages:
            if m and m.path:
                name = os.path.basename(m.path)[1:].rsplit("-", 1)[0]
                os.rename(m.path, os.path.join(self.path, f"{name}.{self.kind}"))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path:
                os.remove(m.path)


class FvecsSource(DataSource):
    KIND = "fvecs"

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.KIND, self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.KIND, self.options, overwrite)


class BvecsSource(FvecsSource):
    KIND = "bvecs"


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("fvecs")`` and ``"bvecs"`` known."""
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(BvecsSource)


def read_vectors(spark: SparkSession, path: str, kind: str | None = None, top: int = -1) -> DataFrame:
    """``(vec_id, embedding)`` of the first ``top`` vectors (-1: all); the kind by default from the file's ending.

    A path with a scheme (``hdfs://``, ``s3a://``, ...) is read through Spark's file systems.
    """
    kind = kind or path.rsplit(".", 1)[-1]
    if kind not in KINDS:
        raise ValueError(f"unknown kind of vector file: {kind}")
    if "://" in path:
        return take_first(from_store(spark, path, kind), top)
    register(spark)
    return spark.read.format(kind).option("limit", top).load(path)


def from_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(vec_id, embedding)`` of one file in any store that Spark reads, by splits at record bounds; ids are the places in the file.

    The length of the first record is read from the store; the records go through Spark's reader of fixed lengths.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    total = store.getFileStatus(place).getLen()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    stream = store.open(place)
    try:
        dim = int.from_bytes(bytes(stream.read() & 255 for _ in range(4)), "little", signed=True)
    finally:
        stream.close()
    record = 4 + dim * KINDS[kind].itemsize
    if dim < 1 or total % record:
        raise ValueError("not a whole number of records")
    name = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    rows = spark.sparkContext.newAPIHadoopFile(path, name, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{name}.recordLength": str(record)})
    frame = spark.createDataFrame(rows.map(lambda x: (x[0], bytes(x[1]))), "vec_id bigint, record binary", verifySchema=False)

    def run(batches):
        for batch in batches:
            data = b"".join(x.as_buffer() for x in batch.column(1))
            yield batch_of(batch.column(0).to_numpy(), decode(data, kind))

    return frame.mapInArrow(run, SCHEMA)


def from_binary_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(file, vec_id, embedding)`` of files in any store that Spark reads, whole files at a time; ids count within a file."""
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = batch_of(np.arange(len(v := decode(data.as_buffer().to_pybytes(), kind))), v)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), *own.columns], names=["file", "vec_id", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, {SCHEMA}")


def take_first(vectors: DataFrame, n: int) -> DataFrame:
    """The first n vectors by id; all for -1. The filter reaches the scan."""
    return vectors if n < 0 else vectors.where(F.col("vec_id") < n)
