"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyarrow import fs
from pyspark import TaskContext


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file that all machines see."""
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: Iterable[bytes]) -> None:
    """Write a file under a name of this attempt and move it into place, so that
    a task that is run again, or twice at once, leaves one whole file."""
    system, path = place(uri)
    context = TaskContext.get()
    attempt = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    system.move(attempt, path)


def read_whole(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_stream(path, compression=None) as src:
        return src.read()


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
