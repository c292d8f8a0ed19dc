"""Binary files in the shared folder, written and read by executors.

A file becomes visible by one rename, under a name of its own task attempt. Readers open the files that a stored
manifest names, that is those of the attempts that succeeded; what a lost attempt left is never read, and no folder
is listed.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from .common import local_path


def attempt_name(place: int, nth: int, suffix: str) -> str:
    """A file name that sorts by place and number and that no other attempt has."""
    return f"part-{place:06d}-{nth:05d}-{uuid.uuid4().hex[:8]}.{suffix}"


@contextmanager
def new_file(folder: str, name: str) -> Iterator:
    """A file to write to, seen under its name when the block ends."""
    own = f".{name}.{uuid.uuid4().hex}"
    if (base := local_path(folder)) is not None:
        os.makedirs(base, exist_ok=True)
        with open(f"{base}/{own}", "wb") as f:
            yield f
        os.replace(f"{base}/{own}", f"{base}/{name}")
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{own}") as f:
        yield f
    store.move(f"{base}/{own}", f"{base}/{name}")


def write_file(folder: str, name: str, chunks) -> None:
    """Write the byte strings of `chunks` to `folder`/`name`."""
    with new_file(folder, name) as f:
        for chunk in chunks:
            f.write(chunk)


def read_file(path: str):
    """A file's bytes, mapped where executors share the folder as files."""
    if (plain := local_path(path)) is not None:
        with open(plain, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(base) as f:
        return f.read()


def exists(path: str) -> bool:
    if (plain := local_path(path)) is not None:
        return os.path.exists(plain)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    return store.get_file_info(base).type == fs.FileType.File
