"""Files in the shared folder, written and read inside tasks."""

from __future__ import annotations

from pyarrow import fs


def _place(uri: str):
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = _place(uri)
    store.create_dir(path, recursive=True)


def write_stream(uri: str):
    store, path = _place(uri)
    return store.open_output_stream(path)


def read_file(uri: str):
    """A file that can be read at any offset."""
    store, path = _place(uri)
    return store.open_input_file(path)


def read_all(uri: str) -> bytes:
    with read_file(uri) as file:
        return file.read()
