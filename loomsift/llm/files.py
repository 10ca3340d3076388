"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(as_uri(path))


def make_dir(path: str) -> str:
    system, name = filesystem(path)
    system.create_dir(name, recursive=True)
    return as_uri(path)


def store(path: str, data: bytes) -> None:
    """Whole or not at all: written aside, then renamed."""
    system, name = filesystem(path)
    part = f"{name}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


def fetch(path: str) -> pa.Buffer:
    system, name = filesystem(path)
    with system.open_input_file(name) as f:
        return f.read_buffer()
