"""Arrays in files under a folder that the driver and all executors share."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs as pafs


class Store:
    """Files of arrays under a folder that all workers share."""

    def __init__(self, folder: str):
        self.folder = folder

    def _place(self, name: str) -> tuple[pafs.FileSystem, str]:
        url = urlparse(self.folder)
        if url.scheme in ("", "file"):
            return pafs.LocalFileSystem(), f"{url.path}/{name}"
        where, path = pafs.FileSystem.from_uri(self.folder)
        return where, f"{path}/{name}"

    def save(self, name: str, array: np.ndarray) -> None:
        """A repeated task writes the same bytes under the same name; readers see whole files only."""
        where, path = self._place(name)
        where.create_dir(os.path.dirname(path), recursive=True)
        own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with where.open_output_stream(own) as f:
            f.write(np.ascontiguousarray(array).tobytes())
        try:
            where.move(own, path)
        except OSError:
            # some stores do not rename onto a file that an earlier attempt of this task has left
            if where.get_file_info(path).type != pafs.FileType.File:
                raise
            where.delete_file(own)

    def load(self, name: str, dtype) -> np.ndarray:
        """The array, mapped where the shared folder is a path; from other stores it is read into memory."""
        where, path = self._place(name)
        if isinstance(where, pafs.LocalFileSystem):
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        with where.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)
