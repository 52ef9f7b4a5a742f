"""Files that tasks write to and read from the shared folder, whichever store holds it."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> str:
    """Write a whole file under a name no other attempt uses; only names in a committed manifest are ever read."""
    final = f"{uri}-{uuid.uuid4().hex}"
    store, path = opened(final)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)
    return final


def get(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path) as f:
        return f.read()
