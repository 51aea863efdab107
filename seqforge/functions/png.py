"""Images as bytes: lossless PNG of 8-bit gray or colour planes, and back."""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(image: np.ndarray) -> bytes:
    """A PNG of rows x columns (gray) or rows x columns x 3 (red, green, blue) bytes; each row is stored as its difference to the row above."""
    rows = image.reshape(image.shape[0], -1).astype(np.uint8)
    up = rows - np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])
    lines = np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], axis=1)
    kind = 2 if image.ndim == 3 else 0
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decoded(data: bytes) -> np.ndarray:
    """The image of a PNG of the kind that ``png`` makes: 8 bits, gray or colour, not interlaced, rows as they are or as differences to the left or above.

    A file of another kind or with a wrong check sum is an error.
    """
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, kind, head, packed = len(SIGNATURE), b"", b"", []
    while kind != b"IEND":
        if len(data) < at + 12:
            raise ValueError("a PNG that breaks off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if check != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a PNG with a wrong check sum")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if len(head) != 13:
        raise ValueError("a PNG without its header")
    width, height, bits, colour, *rest = struct.unpack(">IIBBBBB", head)
    if bits != 8 or colour not in (0, 2) or any(rest):
        raise ValueError(f"a PNG of another kind: {bits} bits, colour type {colour}, method {rest}")
    n = 3 if colour else 1
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    except zlib.error as error:
        raise ValueError(f"a PNG whose rows do not unpack: {error}") from error
    made, rows = lines[:, 0].tolist(), lines[:, 1:]
    if max(made) > 2:
        raise ValueError("a PNG of another kind: rows made from two neighbours")
    if min(made) == 2:
        rows = np.cumsum(rows, axis=0, dtype=np.uint8)
    else:
        rows = rows.copy()
        for k, how in enumerate(made):
            if how == 1:
                rows[k] = np.cumsum(rows[k].reshape(width, n), axis=0, dtype=np.uint8).reshape(-1)
            elif how and k:
                rows[k] += rows[k - 1]
    return rows.reshape(height, width, 3) if colour else rows


def encoded(width: Column, height: Column, *planes: Column) -> Column:
    """PNG bytes of one plane (gray) or three (red, green, blue); null or incomplete planes and sizes below 1 give null."""

    @F.pandas_udf("binary")
    def task(w: pd.Series, h: pd.Series, *px: pd.Series) -> pd.Series:
        out = []
        for across, down, *parts in zip(w, h, *px, strict=True):
            n = 0 if pd.isna(across) or pd.isna(down) else int(across) * int(down)
            if n < 1 or across < 1 or any(p is None or len(p) < n for p in parts):
                out.append(None)
                continue
            shape = int(down), int(across)
            stacked = [np.asarray(p[:n], dtype=np.uint8).reshape(shape) for p in parts]
            out.append(png(np.stack(stacked, -1) if len(stacked) == 3 else stacked[0]))
        return pd.Series(out, dtype=object)

    return task(width, height, *planes)
