"""Streams of fixed-size records (packets, raw lines) as tables: a Python data source that splits files into ranges, and a writer.

Registered under the name `packets`. Options: path (a file or a folder, in any store pyarrow knows), size (bytes of a record),
skip (bytes before the first), step (read one record in so many: the sampled scan), split (records of a partition).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concord.plans.work import ship

#: Bytes of a packet by file suffix.
SIZES = {".t42": 42, ".t34": 34, ".t33": 33}
SPLIT = 200_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, file: str, first: int, count: int):
        self.file, self.first, self.count = file, first, count


class PacketReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("size", 0))
        self.skip, self.step, self.split = int(options.get("skip", 0)), int(options.get("step", 1)), int(options.get("split", SPLIT))

    def size_of(self, file: str) -> int:
        size = self.size or next((n for s, n in SIZES.items() if file.lower().endswith(s)), 0)
        if size <= 0:
            raise ValueError(f"{file}: no packet size")
        return size

    def partitions(self) -> list[Range]:
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            n = max(0, f.size - self.skip) // self.size_of(f.path)  # a cut-off record at the end isn't one
            out += [Range(f.path, k, min(self.split, n - k)) for k in range(0, n, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        size = self.size_of(partition.file)
        with store.open_input_file(partition.file) as f:
            f.seek(self.skip + partition.first * size)
            at, left = partition.first, partition.count
            while left > 0:
                n = min(left, 20_000)
                raw = f.read(n * size)
                keep = [k for k in range(n) if (at + k) % self.step == 0]
                yield pa.RecordBatch.from_pydict({"recording": [partition.file] * len(keep), "seq": [at + k for k in keep], "packet": [raw[k * size : (k + 1) * size] for k in keep]}, schema=pa.schema([("recording", pa.string()), ("seq", pa.int64()), ("packet", pa.binary())]))
                at, left = at + n, left - n


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return "recording string, seq long, packet binary"

    def reader(self, schema) -> PacketReader:
        return PacketReader(self.options)


def read_packets(spark: SparkSession, path: str, size: int = 0, **options) -> DataFrame:
    """recording, seq, packet of every record of a file or folder."""
    ship(spark)
    spark.dataSource.register(PacketSource)
    return spark.read.format("packets").options(path=path, size=size, **options).load()


def layouts_that_fit(layouts: DataFrame, file_bytes: int, frame_bytes: str = "frame_bytes") -> DataFrame:
    """The capture layouts (one row each) whose frames divide a file of so many bytes."""
    return layouts.filter((F.col(frame_bytes) > 0) & (F.lit(file_bytes) % F.col(frame_bytes) == 0))


def frames(lines: DataFrame, lines_a_frame: int) -> DataFrame:
    """recording, frame, line, samples: raw lines numbered within frames."""
    return lines.select("recording", F.floor(F.col("seq") / lines_a_frame).alias("frame"), (F.col("seq") % lines_a_frame).cast("int").alias("line"), F.col("packet").alias("samples"))


def write_packets(packets: DataFrame, folder: str, suffix: str = ".t42") -> list[str]:
    """Write packets (seq, packet) in order of seq into files of a folder, whose names are in that order; the names of the files that count."""
    ship(packets.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        name, out = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}{suffix}", None
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(name)
            for x in batch.column("packet").to_pylist():
                out.write(x or b"")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    ordered = packets.select("seq", "packet").repartitionByRange("seq").sortWithinPartitions("seq")
    return sorted(r.file for r in ordered.mapInArrow(write, "file string").collect())
