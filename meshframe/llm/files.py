"""Files that executors write under temporary names in a folder all of them share, and commit by renaming."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def open_fs(uri: str):
    """The file system of a folder's URI (file, hdfs, s3, ... by pyarrow) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def committed(folder: str, name: str):
    """A stream to write ``name``; it has that name only once it is complete.

    A task that runs again writes under another temporary name and renames over equal bytes, so a lost executor leaves
    at most an unlisted temporary file.
    """
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(draft, compression=None) as out:
            yield out
        fs.move(draft, f"{base}/{name}")
    except BaseException:
        if fs.get_file_info(draft).is_file:
            fs.delete_file(draft)
        raise
