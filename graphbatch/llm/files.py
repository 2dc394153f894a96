"""Files that tasks write and read in the shared folder, by URI: local paths, file://, hdfs://, s3:// or gs://."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow.fs as pafs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_atomic(uri: str, fill: Callable) -> int:
    """Write through ``fill(stream)`` under a name of this task attempt, then move it to its place.

    A task that runs twice, at the same time or after a lost executor, leaves one whole file.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 'driver'}.{os.getpid()}.part"
    with fs.open_output_stream(own, compression=None) as out:
        fill(out)
        size = out.tell()
    fs.move(own, path)
    return size


def memory_map(uri: str, dtype: str) -> np.ndarray:
    """A read-only array over a file. A file that is not on a mounted disk is fetched once into an unnamed temporary file of this process."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.TemporaryFile() as local:  # has no name, so the system frees it with the last map
        with fs.open_input_stream(path, compression=None) as source:
            while block := source.read(1 << 20):
                local.write(block)
        local.flush()
        return np.memmap(local, dtype, "r") if local.tell() else np.zeros(0, dtype)
