"""Files that tasks write to, and read from, the shared folder by its own scheme."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (file, hdfs, s3, gs, ...) and the path within it."""
    return fs.FileSystem.from_uri(path)


def new_file(path: str):
    """A binary stream to a new file; its folder is made where the store has folders."""
    store, name = opened(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name, compression=None)


def random_file(path: str):
    """A binary file to read from, with positions."""
    store, name = opened(path)
    return store.open_input_file(name)
