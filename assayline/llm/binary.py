"""Whole binary files in the shared folder, written by tasks.

A task writes under a name of its own and then moves the file to a name that depends on
its partition only. A task that runs again, on another executor too, replaces the file
by an equal one, so tasks must get their rows in a fixed order. Names that start with
an underscore are skipped by Spark's readers.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_whole(folder: str, name: str, parts: list[bytes]) -> int:
    """Writes parts as one file; returns its size."""
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    held = f"{path}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(held) as out:
        for p in parts:
            out.write(p)
    files.move(held, f"{path}/{name}")
    return sum(map(len, parts))
