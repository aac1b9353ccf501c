"""Numpy arrays in the shared folder: written by tasks under new names, memory-mapped by workers."""

from __future__ import annotations

import io
import mmap
import os
import sys
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np


def _filesystem(uri: str):
    """File system and path of a URI, or None and the path where it is local."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return None, parsed.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    system, path = _filesystem(uri)
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    else:
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as f:
            f.write(data)


def read_range(uri: str, offset: int, length: int) -> bytes:
    """``length`` bytes from ``offset``; nothing else of the file is read."""
    system, path = _filesystem(uri)
    if system is None:
        with open(path, "rb", buffering=0) as f:
            f.seek(offset)
            return f.read(length)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def write_array(folder: str, name: str, values: np.ndarray) -> str:
    """The array's URI: a new name each time, so that a task that runs twice leaves two whole files and no torn one."""
    buffer = io.BytesIO()
    np.save(buffer, np.ascontiguousarray(values))
    uri = f"{folder}/{name}-{uuid.uuid4().hex}.npy"
    write_bytes(uri, buffer.getvalue())
    return uri


def _mapped(path: str) -> np.ndarray:
    """The array in a file, memory-mapped; the file itself is closed again, so a worker may hold thousands."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, dtype = header(f)
        size, at = os.fstat(f.fileno()).st_size, f.tell()
        if size == at:
            return np.empty(shape, dtype=dtype)
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    return np.frombuffer(view, dtype=dtype, offset=at).reshape(shape)


@lru_cache(maxsize=4096)
def open_array(uri: str) -> np.ndarray:
    """The array, memory-mapped. A file in a remote store is copied to the worker's own disk once, for that worker only."""
    system, path = _filesystem(uri)
    if system is not None:
        with system.open_input_stream(path) as f, tempfile.NamedTemporaryFile(prefix="arborix-", suffix=".npy", delete=False) as local:
            while chunk := f.read(1 << 22):
                local.write(chunk)
        mapped = _mapped(local.name)
        os.unlink(local.name)  # the mapping stays
        return mapped
    return _mapped(path)
