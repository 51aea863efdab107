"""Names of files: making, parsing, extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of frame file names.
TILE_NAME = r"^(.*?)(\d+)_[fF]rame(\d+)\.[A-Za-z]+$"
SEQUENCE_NAME = r"^(.+)_Frame(\d+)\.(png|jpg|jpeg)$"
TILE_EXTENSIONS = r"(?i)\.(png|jpg|jpeg|bmp|tiff)$"
FILTER_EXTENSIONS = r"\.(png|jpg|jpeg)$"
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "webm", "flv")


def stem(path: Column) -> Column:
    """The last part of a path without its extension; a leading dot is part of the stem."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def has_extension(path: Column, extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(extensions)})$")


def chunk_name(number: Column, extension: str = "mkv") -> Column:
    return F.format_string(f"chunk_%04d.{extension}", number)


def frame_name(sequence: Column, frame: Column, extension: str = "png") -> Column:
    return F.format_string(f"show%05d_Frame%05d.{extension}", sequence, frame)


def chunk_number(name: Column) -> Column:
    """The number between the first underscore and the dot after it; null if there is none."""
    return F.regexp_extract(name, r"^[^_]*_(\d+)\.", 1).try_cast("long")


def parsed(name: Column, pattern: str, group: int) -> Column:
    """A group of a pattern; null instead of '' where the pattern does not match."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group))
