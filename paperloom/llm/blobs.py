"""Number columns as one compressed value, so that millions of small rows move as a few."""

from __future__ import annotations

import contextlib
import ctypes
import struct

import numpy as np
import pyarrow as pa
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """The columns' bytes in planes (all first bytes, all second bytes, ...), which lets the empty planes vanish."""
    head = [struct.pack("<H", len(columns))]
    body = []
    for c in columns:
        c = np.ascontiguousarray(c)
        head.append(struct.pack("<2sQ", c.dtype.str[1:].encode(), len(c)))
        body.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() if len(c) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<H", raw)[0]
    at, kinds = 2, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, at)
        kinds.append((np.dtype("<" + kind.decode()), size))
        at += 10
    out = []
    for kind, size in kinds:
        planes = np.frombuffer(raw, np.uint8, kind.itemsize * size, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if size else np.empty(0, kind))
        at += kind.itemsize * size
    return out


def ascending(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which `np.cumsum` undoes."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def release() -> None:
    """Gives memory that a worker has freed back to its machine; workers live on and would keep their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
