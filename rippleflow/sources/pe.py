"""Content hashes of portable executables, blind to what a rebuild of the same source changes."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked(data: bytes) -> bytes:
    """The file with timestamp, checksum, debug directory and debug data zeroed; other files as they are."""
    if len(data) < 64 or data[:2] != b"MZ":
        return data
    at = struct.unpack_from("<I", data, 60)[0]
    if at + 24 > len(data) or data[at : at + 4] != b"PE\0\0":
        return data
    out = bytearray(data)
    coff = at + 4
    sections, optional_size = struct.unpack_from("<H", data, coff + 2)[0], struct.unpack_from("<H", data, coff + 16)[0]

    def zero(a: int, n: int) -> None:
        out[a : a + n] = bytes(max(0, min(n, len(out) - a)))

    zero(coff + 4, 4)
    optional = coff + 20
    if optional_size >= 68:
        zero(optional + 64, 4)
    magic = struct.unpack_from("<H", data, optional)[0] if optional + 2 <= len(data) else 0
    entry = optional + (112 if magic == 0x20B else 96) + 6 * 8
    table = optional + optional_size
    if entry + 8 <= min(len(data), table):
        rva, size = struct.unpack_from("<II", data, entry)
        for i in range(sections):
            s = table + 40 * i
            if s + 40 > len(data):
                break
            v_size, v_at, raw_size, raw_at = struct.unpack_from("<IIII", data, s + 8)
            if rva and v_at <= rva < v_at + max(v_size, raw_size):
                start = raw_at + rva - v_at
                for d in range(start, min(start + size, len(data) - 27), 28):
                    n, p = struct.unpack_from("<I", data, d + 16)[0], struct.unpack_from("<I", data, d + 24)[0]
                    if p + n <= len(data):
                        zero(p, n)
                zero(start, size)
                break
    return bytes(out)


def content_hash(data: bytes, mvid: bytes = b"") -> str:
    """SHA-256 in upper-case hex of the masked file; the first occurrence of the mvid is zeroed too."""
    out = masked(data)
    if mvid:
        at = out.find(mvid)
        if at >= 0:
            out = out[:at] + bytes(len(mvid)) + out[at + len(mvid) :]
    return hashlib.sha256(out).hexdigest().upper()


def mvid_bytes(mvid: str | None) -> bytes:
    """A module's version id as it stands in the file; nothing if it is none."""
    try:
        return uuid.UUID(mvid).bytes_le if mvid else b""
    except ValueError:
        return b""


def hashed(files: DataFrame) -> DataFrame:
    """(path, content_hash) of files (path, content and, where it is known, mvid), blind to their mvids; one file at a time in a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content_hash": [content_hash(bytes(c), mvid_bytes(m)) if c is not None else "" for c, m in zip(b["content"], b["mvid"])]})

    mvid = F.coalesce("mvid", F.lit("")) if "mvid" in files.columns else F.lit("")
    return files.select("path", "content", mvid.alias("mvid")).mapInPandas(run, "path string, content_hash string")
