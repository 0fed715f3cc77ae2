"""16-bit PCM WAV folders as a Spark data source, and as a sink.

A folder is read in ranges of bytes: a long recording is many tasks, many short ones are one. Every range reads the header of
its file, and then only the samples of the pieces that begin in it. Without samples, headers are all that is read.
"""

from __future__ import annotations

import io
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.pieces import SIZE

HEADER = pa.schema([("name", pa.string()), ("rate", pa.int32()), ("frames", pa.int64()), ("channels", pa.int32()), ("bits", pa.int32())])
PIECE = pa.schema([("name", pa.string()), ("rate", pa.int32()), ("piece", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("x", pa.list_(pa.float64()))])
#: Bytes of a task; what opening a file counts for; files of a task that reads headers.
TASK, OPEN, HEADERS = 1 << 25, 1 << 17, 256


@dataclass
class Range(InputPartition):
    """Bytes lo .. hi of some files: (path, size, lo, hi)."""

    files: list[tuple[str, int, int, int]]


def read_header(f, size: int) -> tuple[int, int, int, int, int]:
    """rate, channels, bits, frames, first byte of the samples. Reads 44 bytes where the samples follow at once."""
    head = f.read(44)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while True:
        while len(head) < at + 8 or (head[at : at + 4] == b"fmt " and len(head) < at + 24):
            more = f.read(4096)
            if not more:
                raise ValueError("a WAV file without samples")
            head += more
        name, length = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            kind = (rate, channels, bits)
        if name == b"data":
            if kind is None:
                raise ValueError("a WAV file without format")
            frame = kind[1] * kind[2] // 8
            return *kind, min(length, size - at - 8) // frame, at + 8
        at += 8 + length + length % 2


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.samples = options["path"], options.get("samples", "true") == "true"
        self.size, self.halo = int(options.get("size", SIZE)), int(options.get("halo", 0))
        self.task = int(options.get("bytes", TASK))

    def partitions(self):
        store, path = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=False))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name.lower().endswith(".wav"))
        out, now, total = [], [], 0
        for name, size in files:
            # Headers alone are counted by file.
            parts = [(name, size, lo, min(size, lo + self.task)) for lo in range(0, size, self.task)] if self.samples else [(name, size, 0, 0)]
            for part in parts:
                now.append(part)
                total += part[3] - part[2] + (OPEN if self.task > OPEN else 0) if self.samples else self.task // HEADERS
                if total >= self.task:
                    out.append(Range(now))
                    now, total = [], 0
        return out + [Range(now)] if now or not out else out

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path, size, lo, hi in partition.files:
            name = path.rsplit("/", 1)[-1]
            with store.open_input_file(path) as f:
                rate, channels, bits, frames, first = read_header(f, size)
                if not self.samples:
                    rows.append((name, rate, frames, channels, bits))
                    continue
                if bits != 16:
                    raise ValueError(f"{name}: only 16-bit PCM is read")
                frame = 2 * channels
                piece = max(0, -(-(lo - first) // (self.size * frame)))
                while piece * self.size < frames and first + piece * self.size * frame < hi:
                    begin = piece * self.size
                    count = min(self.size + self.halo, frames - begin)
                    x = np.frombuffer(f.read_at(count * frame, first + begin * frame), "<i2").reshape(-1, channels).mean(1) / 32768
                    rows.append((name, rate, piece, begin, frames, x))
                    held += count
                    piece += 1
                    if held > 1 << 20:
                        yield _batch(rows, PIECE)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, PIECE if self.samples else HEADER)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class WavSource(DataSource):
    """Options: path; samples (false: headers only); size and halo of pieces; bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        if self.options.get("samples", "true") == "true":
            return "name string, rate int, piece long, begin long, n long, x array<double>"
        return "name string, rate int, frames long, channels int, bits int"

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").options(path=path, **options).load()


def headers(spark: SparkSession, path: str) -> DataFrame:
    """name, rate, frames, channels, bits of every WAV file of a folder."""
    return read(spark, path, samples="false")


def pieces(spark: SparkSession, path: str, size: int = SIZE, halo: int = 0) -> DataFrame:
    """name, rate, piece, begin, n, x (mean of the channels) of every WAV file of a folder."""
    return read(spark, path, size=size, halo=halo)


def header_bytes(frames: int, rate: int) -> bytes:
    """Header of a mono file."""
    return b"RIFF" + struct.pack("<I", 36 + 2 * frames) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", 2 * frames)


def write(rows: DataFrame, name: str, path: str, rate: int = 44100) -> DataFrame:
    """One mono file for each signal of pieces or blocks (name, start or begin, n, x), clamped to -1 .. 1: file, frames, sha256.

    A file is written piece by piece under another name, and then moved, so a task that is tried again does no harm. A piece that
    is missing or there twice is an error.
    """
    begin = "start" if "start" in rows.columns else "begin"

    def run(batches):
        import hashlib

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        now, out, at, n, digest, hidden, done = None, None, 0, 0, None, None, []

        def finish():
            out.close()
            if at != n:
                raise ValueError(f"{now}: {at} of {n} samples")
            store.move(hidden, f"{root}/{now}")
            done.append((now, n, digest.hexdigest()))

        for b in batches:
            for file, first, total, x in zip(*(b.column(c).to_pylist() for c in ("file", "begin", "n", "x")), strict=True):
                if file != now:
                    if out is not None:
                        finish()
                    now, n, at, digest = file, total, 0, hashlib.sha256()
                    hidden = f"{root}/.{uuid.uuid4().hex}"
                    out = io.BufferedWriter(store.open_output_stream(hidden), 1 << 20)
                    head = header_bytes(n, rate)
                    out.write(head)
                    digest.update(head)
                if first != at:
                    raise ValueError(f"{file}: samples {at} to {first} are missing or there twice")
                data = np.rint(np.clip(np.array(x, float), -1, 1) * 32767).astype("<i2").tobytes()
                out.write(data)
                digest.update(data)
                at += len(x)
        if out is not None:
            finish()
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "frames", "sha256"])

    ordered = rows.select(F.col(name).cast("string").alias("file"), F.col(begin).cast("long").alias("begin"), F.col("n").cast("long").alias("n"), "x")
    return ordered.repartition("file").sortWithinPartitions("file", "begin").mapInArrow(run, "file string, frames long, sha256 string")
