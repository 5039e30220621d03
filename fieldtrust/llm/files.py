"""Reading and writing files of the shared folder inside tasks, wherever the folder is."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_file(path: str, payload: bytes) -> None:
    """The file appears whole or not at all, also when a task is run twice."""
    system, name = place(path)
    folder = name.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(payload)
    system.move(draft, name)


def read_file(path: str) -> bytes:
    system, name = place(path)
    with system.open_input_file(name) as file:
        return file.read()
