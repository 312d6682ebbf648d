"""Files in the folder that driver and executors share, from inside tasks."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(path: str) -> str | None:
    """The path in the file system, if the shared folder is a mounted one."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def put(folder: str, data: bytes, suffix: str) -> str:
    """Write a new file under a name of its own (a task that is run again leaves only an unused file); returns its path."""
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    if at := local_path(path):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(f"{at}.part", "wb") as f:
            f.write(data)
        os.replace(f"{at}.part", at)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(at))
        with store.open_output_stream(at) as f:
            f.write(data)
    return path


def get(path: str) -> bytes:
    if at := local_path(path):
        with open(at, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def mapped(path: str, dtype, count: int, offset: int = 0) -> np.ndarray:
    """count values of a file, memory-mapped where the shared folder is mounted."""
    if not count:
        return np.empty(0, dtype)
    if at := local_path(path):
        return np.memmap(at, dtype, "r", offset, (count,))
    return np.frombuffer(get(path), dtype, count, offset)
