"""Fixed-width float32 corpora as a Spark data source.

``spark.read.format("f32corpus")`` reads a folder of ``*.bin`` files whose records are
``inputs + outputs`` little-endian 32-bit floats without a header. A partition is a run
of chunks of one file, so tasks seek to their bytes and no file is read whole.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_RECORDS = 2048
SCHEMA = "record_id long, chunk_id long, file string, inputs array<float>, outputs array<float>"


@dataclass
class Run(InputPartition):
    """Records of one file: from ``start`` in it, whose first has the id ``record_id``."""

    file: str
    start: int
    records: int
    record_id: int


def spans(folder: str, width: int, most: int | None = None) -> list[tuple[str, int, int]]:
    """[S1] (file, first record id, records) in order of name; a file that isn't a whole
    number of records is an error, an empty one is skipped, and ``most`` ends the list."""
    out, start = [], 0
    for path in sorted(glob.glob(os.path.join(folder, "*.bin"))):
        size = os.path.getsize(path)
        if size % (4 * width):
            raise ValueError(f"{path}: {size} bytes aren't records of {width} floats")
        n = size // (4 * width)
        if most is not None:
            n = min(n, most - start)
        if n > 0:
            out.append((path, start, n))
            start += n
    return out


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.inputs, self.outputs = int(options["inputs"]), int(options["outputs"])
        most = options.get("max_records")
        self.most = int(most) if most else None
        self.run_records = CHUNK_RECORDS * int(options.get("chunks_per_partition", "64"))

    def partitions(self) -> list[Run]:
        runs = []
        for file, first, n in spans(self.folder, self.inputs + self.outputs, self.most):
            runs += [Run(file, at, min(self.run_records, n - at), first + at) for at in range(0, n, self.run_records)]
        return runs

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        width = self.inputs + self.outputs
        with open(partition.file, "rb") as f:
            f.seek(4 * width * partition.start)
            for at in range(0, partition.records, CHUNK_RECORDS):
                n = min(CHUNK_RECORDS, partition.records - at)
                rows = np.frombuffer(f.read(4 * width * n), "<f4").reshape(n, width)
                ids = partition.record_id + at + np.arange(n)
                lists = lambda part, k: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(part).ravel()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(ids // CHUNK_RECORDS), pa.array([partition.file] * n), lists(rows[:, : self.inputs], self.inputs), lists(rows[:, self.inputs :], self.outputs)],
                    ["record_id", "chunk_id", "file", "inputs", "outputs"],
                )


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "f32corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)


def read_corpus(spark: SparkSession, folder: str, inputs: int, outputs: int, max_records: int | None = None) -> DataFrame:
    """[S2, S3, S5] All records, in chunks of 2,048 [S4]."""
    spark.dataSource.register(CorpusSource)
    reader = spark.read.format("f32corpus").option("inputs", inputs).option("outputs", outputs)
    if max_records is not None:
        reader = reader.option("max_records", max_records)
    return reader.load(folder)


def write_corpus(df: DataFrame, folder: str, columns: list[str]) -> None:
    """One ``.bin`` file a partition, written by executors that share the folder."""

    def write(rows) -> None:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = os.path.join(folder, f"{part:05d}.bin")
        with open(f"{path}.tmp", "wb") as f:
            for row in rows:
                f.write(np.array([row[c] for c in columns], "<f4").tobytes())
        os.replace(f"{path}.tmp", path)

    os.makedirs(folder, exist_ok=True)
    df.select(columns).foreachPartition(write)


def prefix(df: DataFrame, records: int = 25_000) -> DataFrame:
    """[S6] The first records, by id: a filter, so it is the same every time."""
    return df.where(F.col("record_id") < records)


def phase_sample(df: DataFrame, rate: float, phase: int) -> DataFrame:
    """[S7] Every stride-th record from ``phase`` on; phases take turns over all records."""
    stride = max(1, round(1 / rate))
    return df.where(F.pmod(F.col("record_id") - phase, F.lit(stride)) == 0)


def identity(folder: str, inputs: int, outputs: int) -> str:
    """[S11] A 64-bit FNV-1a hash of widths, names, sizes and the ends of each file."""
    value = 0xCBF29CE484222325
    for part in [f"{inputs}/{outputs}".encode(), *(p for f in sorted(glob.glob(os.path.join(folder, "*.bin"))) for p in _ends(f))]:
        for byte in part:
            value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return f"{value:016x}"


def _ends(path: str) -> list[bytes]:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(64)
        f.seek(max(0, size - 64))
        return [os.path.basename(path).encode(), str(size).encode(), head, f.read(64)]


def corpus_key(spark: SparkSession, folder: str) -> DataFrame:
    """[S12, S13] Hash, bytes and files of a listing; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length", "modificationTime")
    return files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("key"), F.sum("length").alias("bytes"), F.count("*").alias("files"))
