"""Files in the shared folder, read and written by tasks."""

from __future__ import annotations

import uuid


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: list[bytes]) -> None:
    """Write a file under a name of its own, then rename: a lost task leaves no half file, a repeated one the same file."""
    system, path = _open(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    mine = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(mine) as out:
        for p in parts:
            out.write(p)
    try:
        system.move(mine, path)
    except OSError:
        if system.get_file_info(path).size != sum(map(len, parts)):
            raise
        # another attempt was first, where rename doesn't replace
        system.delete_file(mine)


def read_whole(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def size_of(uri: str) -> int:
    system, path = _open(uri)
    return system.get_file_info(path).size


class RangeReader:
    """Random reads of one file."""

    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()
