"""Files in the shared folder, by any address that names it, from inside tasks."""

from __future__ import annotations

import os

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or of an address such as ``file:`` or ``hdfs:``."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class Written:
    """A file that appears under its name only when it is whole.

    A task that runs twice, or on two executors at once, writes the same bytes
    under a name of its own and moves them into place.
    """

    def __init__(self, uri: str, token: str):
        self.store, self.path = at(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{token}.part"
        self.out = self.store.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, body: bytes) -> None:
        self.out.write(body)
        self.size += len(body)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)
