"""Uncompressed video: Y4M files as a table of frames, and back.

``spark.read.format("y4m").load(path)`` reads a file or the ``.y4m`` files of a folder. All frames
of a file have one size in bytes, so the driver reads headers only and cuts each file into
ranges of whole frames (option ``splitBytes``), which tasks read side by side: a range each up to
``TASKS`` ranges, then runs of them, so that many small files or ranges are no task each. Where the file's length
does not fit (frame headers with parameters, or an incomplete last frame) the file is one range,
walked from frame to frame; an incomplete last frame is left out. Frames are numbered from 1.
Chroma is as stored: halved (C420...), halved in width (C422), whole (C444) or none (Cmono, null planes).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqforge.operators import render
from seqforge.sources import shared_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, frame_no int, width int, height int, chroma_width int, chroma_height int, y array<int>, u array<int>, v array<int>"
FRAME = b"FRAME\n"
#: Bytes of a file that one task reads, of an Arrow batch, and of the longest header.
SPLIT_BYTES, BATCH_BYTES, HEADER_BYTES = 64 << 20, 2 << 20, 4096
#: Tasks for whose sake ranges are not put together; more are made where these would read more than SPLIT_BYTES each.
TASKS = 256


@dataclass(frozen=True)
class Layout:
    """Sizes in a file: bytes of its header, and the planes of a frame."""

    head: int
    width: int
    height: int
    chroma_width: int
    chroma_height: int

    @property
    def planes(self) -> list[int]:
        luma, chroma = self.width * self.height, self.chroma_width * self.chroma_height
        return [luma, chroma, chroma] if chroma else [luma]


def layout(start: bytes) -> Layout:
    """What the first bytes of a file say."""
    line, end, _ = start.partition(b"\n")
    words = line.split(b" ")
    if words[0] != b"YUV4MPEG2" or not end:
        raise ValueError("not a Y4M file")
    tags = {w[:1]: w[1:].decode() for w in words[1:] if w}
    w, h, chroma = int(tags[b"W"]), int(tags[b"H"]), tags.get(b"C", "420jpeg")
    if re.search(r"p\d+$", chroma):
        raise ValueError(f"samples of more than 8 bits: {chroma}")
    if chroma == "mono":
        halves = 0, 0
    elif chroma == "444":
        halves = w, h
    elif chroma == "422":
        halves = (w + 1) // 2, h
    elif chroma.startswith("420"):
        halves = (w + 1) // 2, (h + 1) // 2
    else:
        raise ValueError(f"unknown chroma {chroma}")
    return Layout(len(line) + 1, w, h, *halves)


@dataclass(frozen=True)
class Range:
    """Frames ``first``.. of a file from a byte on; ``count`` is None where the frames are to be walked to the end."""

    path: str
    layout: Layout
    offset: int
    first: int
    count: int | None
    size: int


@dataclass(frozen=True)
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]


def together(ranges: list[Range]) -> list[Ranges]:
    """Consecutive ranges by equal shares of bytes, or one each if they are few."""
    ends = np.cumsum([r.size for r in ranges])
    n = max(TASKS, -(-int(ends[-1]) // SPLIT_BYTES)) if ranges else 0
    if len(ranges) <= n:
        return [Ranges([r]) for r in ranges]
    share = (ends - 1) * n // ends[-1]
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(ranges)]
    return [Ranges(ranges[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _batch(path: str, made: Layout, first: int, frames: list[list[bytes]]) -> pa.RecordBatch:
    n = len(frames)
    columns = [pa.array([path] * n), pa.array(range(first, first + n), pa.int32())]
    columns += [pa.array([v] * n, pa.int32()) for v in (made.width, made.height, made.chroma_width, made.chroma_height)]
    for k in range(3):
        if k >= len(made.planes):
            columns.append(pa.nulls(n, pa.list_(pa.int32())))
            continue
        values = np.frombuffer(b"".join(f[k] for f in frames), np.uint8).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * made.planes[k]), pa.array(values)))
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class Y4mReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Ranges]:
        where, name = shared_files.located(self.path)
        info = where.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else where.get_file_info(fs.FileSelector(name, recursive=True))
        ranges = []
        for file in sorted((f for f in files if f.is_file and (f is info or f.path.lower().endswith(".y4m"))), key=lambda f: f.path):
            with where.open_input_file(file.path) as data:
                made = layout(data.read_at(min(HEADER_BYTES, file.size), 0))
                whole = len(FRAME) + sum(made.planes)
                n, rest = divmod(file.size - made.head, whole)
                if rest or (n and data.read_at(len(FRAME), made.head) != FRAME):
                    ranges.append(Range(file.path, made, made.head, 1, None, file.size))
                    continue
            each = max(1, self.split_bytes // whole)
            ranges += [Range(file.path, made, made.head + at * whole, at + 1, min(each, n - at), min(each, n - at) * whole) for at in range(0, n, each)]
        return together(ranges)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, _ = shared_files.located(self.path)
        made, number, frames = partition.layout, partition.first, []
        size = sum(made.planes)
        with where.open_input_stream(partition.path) if partition.count is None else where.open_input_file(partition.path) as data:
            if partition.count is None:
                data.read(partition.offset)
            else:
                data.seek(partition.offset)
            left = partition.count
            while left is None or left:
                head = self._head(data)
                pixels = data.read(size) if head else b""
                if len(pixels) < size:
                    if left is not None:
                        raise ValueError(f"{partition.path} ends inside frame {number}")
                    break
                ends = np.cumsum([0, *made.planes])
                frames.append([pixels[a:b] for a, b in zip(ends, ends[1:], strict=False)])
                left = left - 1 if left is not None else None
                if len(frames) * size >= BATCH_BYTES:
                    yield _batch(partition.path, made, number, frames)
                    number, frames = number + len(frames), []
        if frames:
            yield _batch(partition.path, made, number, frames)

    @staticmethod
    def _head(data: pa.NativeFile) -> bytes:
        """A frame's header, with its end; nothing at the end of the file."""
        head = data.read(len(FRAME))
        while head and not head.endswith(b"\n"):
            more = data.read(1)
            if not more or len(head) > HEADER_BYTES:
                return b""
            head += more
        if head and not head.startswith(FRAME[:-1]):
            raise ValueError("a frame does not begin where it should: its file mixes frame headers of different lengths")
        return head


class Y4mSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Y4mReader:
        return Y4mReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(Y4mSource)
    return spark.read.format("y4m").option("splitBytes", split_bytes).load(path)


def write(frames: DataFrame, folder: str, rate: str = "25:1") -> None:
    """One file for each recording, named by its video_id: frames (video_id, frame_no, width, height, y, u, v with halved chroma) in order.

    All frames of a recording have the size of its first; numbers are not stored, so gaps close.
    """

    @F.pandas_udf("binary")
    def content(first: pd.Series, w: pd.Series, h: pd.Series, *planes: pd.Series) -> pd.Series:
        out = []
        for k in range(len(first)):
            head = f"YUV4MPEG2 W{w.iloc[k]} H{h.iloc[k]} F{rate} Ip A1:1 C420jpeg\n".encode() if first.iloc[k] else b""
            out.append(head + FRAME + b"".join(np.asarray(p.iloc[k], dtype=np.uint8).tobytes() for p in planes))
        return pd.Series(out)

    first = F.row_number().over(render.order()) == 1
    rows = frames.withColumn("_first", first).select(F.concat(F.col("video_id").cast("string"), F.lit(".y4m")).alias("name"), content("_first", "width", "height", "y", "u", "v").alias("content"))
    shared_files.write_files(rows, folder)
