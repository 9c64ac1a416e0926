"""Binary files in the shared folder, written and read inside tasks.

A task never reuses a name: a repeated attempt writes another file, and only the
names in the committed manifest table are read. So a lost executor leaves at most
an unlisted file behind, never a half-written one that counts.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def fresh_name(folder: str, suffix: str) -> str:
    part = TaskContext.get().partitionId()
    return f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writing(uri: str):
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as stream:
        yield stream


@contextmanager
def reading(uri: str):
    system, path = _open(uri)
    with system.open_input_file(path) as stream:
        yield stream
