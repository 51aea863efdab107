"""Files as tables: listings and decoded images."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import names, pixels, png
from seqforge.sources import kept, shared_files
from seqforge.sources.config import ConfigError

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folders that one task lists, and names in a batch of what it finds.
FOLDERS, NAMES = 16, 10_000
#: Files and bytes that one task reads, and bytes of pixels in an Arrow batch.
FILES, SPLIT_BYTES, BATCH_BYTES = 2000, 64 << 20, 2 << 20


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None, recursive: bool = False) -> DataFrame:
    """path, length of the files, without reading them; extensions in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    return files if extensions is None else files.where(names.has_extension(F.col("path"), extensions))


def listing_in_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the files at any depth below a folder; what a leading dot or underscore hides, as the sink's open attempts, is left out.

    Folders are listed in tasks, level by level, and what they hold is kept: the driver gets the number of folders only.
    """
    located = shared_files.located

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = located(folder)
        for path in (path for batch in batches for path in batch.column("path").to_pylist()):
            found = [f for f in where.get_file_info(fs.FileSelector(path)) if not f.base_name.startswith((".", "_"))]
            for k in range(0, len(found), NAMES):
                some = found[k : k + NAMES]
                columns = [pa.array([f.path for f in some]), pa.array([f.size if f.is_file else 0 for f in some], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in some])]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "size", "folder"])

    level, n, files = spark.createDataFrame([(located(folder)[1],)], "path string"), 1, []
    while n:
        below = kept.stored(level.repartition(-(-n // FOLDERS)).mapInArrow(entries, "path string, size long, folder boolean"))
        files.append(below.where("NOT folder").select("path", "size"))
        level = below.where("folder").select("path")
        n = level.count()
    return reduce(DataFrame.unionAll, files)


def relative(files: DataFrame, folder: str) -> DataFrame:
    """rel_path of the files below ``folder``, each once."""
    return files.select(F.expr(f"substring(path, instr(path, '{folder}') + {len(folder.rstrip('/')) + 1})").alias("rel_path")).distinct()


def gray_frames(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Frames of the images of a folder: seq and frame_no from the file name, size, gray pixels. Unreadable files are left out."""
    images = spark.read.format("image").options(dropInvalid=True, recursiveFileLookup=recursive).load(folder).select("image.*")
    stem = names.basename(F.col("origin"))
    channel = lambda p, c: F.conv(F.hex(F.substring("data", p * F.col("nChannels") + c + 1, 1)), 16, 10).cast("int")  # noqa: E731  bytes are blue, green, red
    gray = F.transform(
        pixels.span(F.col("width") * F.col("height")),
        lambda p: F.when(F.col("nChannels") == 1, channel(p, 0)).otherwise(pixels.gray(channel(p, 0), channel(p, 1), channel(p, 2))),
    )
    return images.select(
        names.parsed(stem, names.SEQUENCE_NAME, 1).alias("seq"),
        names.parsed(stem, names.SEQUENCE_NAME, 2).cast("int").alias("frame_no"),
        "width",
        "height",
        gray.alias("pixels"),
    )


def _batch(rows: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    paths, widths, heights, values = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    columns = [pa.array(paths), pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "width", "height", "pixels"])


def png_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Like ``gray_frames``, with path: the ``.png`` files at any depth below a folder. They must be of the kind that the sinks write, another kind is an error.

    For many small files: Spark's image source lists all of them in the driver, makes a task for each 32 and takes
    some milliseconds a file. Here they are listed in tasks and dealt by path, some ``FILES`` to a task.
    """
    files = listing_in_tasks(spark, folder).where(names.has_extension(F.col("path"), ("png",)))
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    located, decoded = shared_files.located, png.decoded

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = located(folder)
        rows, held = [], 0
        for path in (path for batch in batches for path in batch.column("path").to_pylist()):
            with where.open_input_stream(path) as data:
                content = data.read()
            try:
                image = decoded(content)
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error
            flat = image.reshape(-1).astype(np.int32) if image.ndim == 2 else (image.reshape(-1, 3) @ np.array([9798, 19235, 3735], np.int32) + 16384) >> 15
            rows.append((path, image.shape[1], image.shape[0], flat))
            held += flat.nbytes
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    parts = max(1, -(-n // FILES), -(-size // SPLIT_BYTES))
    images = files.select("path").repartition(parts, "path").mapInArrow(read, "path string, width int, height int, pixels array<int>")
    name = names.basename(F.col("path"))
    return images.select(
        "path",
        names.parsed(name, names.SEQUENCE_NAME, 1).alias("seq"),
        names.parsed(name, names.SEQUENCE_NAME, 2).cast("int").alias("frame_no"),
        "width",
        "height",
        "pixels",
    )


def inputs(spark: SparkSession, path: str, extensions: tuple[str, ...] = names.VIDEO_EXTENSIONS) -> DataFrame:
    """path, length of a single file, whatever its name, or of a folder's files with the extensions, in order of path."""
    return listing(spark, path, extensions if is_folder(spark, path) else None).orderBy("path")


def is_folder(spark: SparkSession, path: str) -> bool:
    """What the path's file system says; a path that is not there is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise ConfigError(f"no such file or folder: {path}")
    return files.getFileStatus(place).isDirectory()


def existing_chunks(spark: SparkSession, high: str, low: str) -> DataFrame:
    """hr_path, lr_path of the chunks of a folder; a folder without one is an error."""
    files = listing(spark, high, ("mkv", "mp4")).select("path")
    if files.isEmpty():
        raise ConfigError(f"no chunks in {high}")
    return files.select(F.col("path").alias("hr_path"), F.concat(F.lit(low.rstrip("/") + "/"), names.basename(F.col("path"))).alias("lr_path"))


def tile_naming(files: DataFrame, filename: str = "filename") -> DataFrame:
    """One row: prefix and digits of the first frame file by name, which tiles are named after; nulls if there is none."""
    name = F.col(filename)
    fits = files.where(name.rlike(names.TILE_NAME) & name.rlike(names.TILE_EXTENSIONS))
    part = lambda group: F.min_by(F.regexp_extract(name, names.TILE_NAME, group), name)
    return fits.agg(part(1).alias("prefix"), F.length(part(2)).alias("digits"))
