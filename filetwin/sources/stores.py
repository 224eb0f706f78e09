"""File-system handles that tasks list and read through: local paths, and the store that a URI names."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

from pyarrow import fs


class Entry(NamedTuple):
    """A name in a folder; `stat` gives its size in bytes and its time in whole seconds."""

    name: str
    path: str
    is_folder: bool
    stat: Callable[[], tuple[int | None, int | None]]


class LocalStore:
    """Paths that the machine of the task sees. Links are files. Names come one by one, sizes only when asked for."""

    def entries(self, folder: str) -> Iterator[Entry]:
        def stat_of(entry: os.DirEntry) -> tuple[int, int]:
            info = entry.stat(follow_symlinks=False)
            return info.st_size, int(info.st_mtime)

        with os.scandir(folder) as found:
            for entry in found:
                yield Entry(entry.name, entry.path, entry.is_dir(follow_symlinks=False), lambda e=entry: stat_of(e))

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb", buffering=0)

    def write(self, path: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(content)


class ArrowStore:
    """Any store that pyarrow has a handle for. `prefix` is what a row's path has before the store's own path."""

    def __init__(self, store: fs.FileSystem, prefix: str = "") -> None:
        self.store, self.prefix = store, prefix

    def _own(self, path: str) -> str:
        return path[len(self.prefix) :]

    def entries(self, folder: str) -> Iterator[Entry]:
        for info in self.store.get_file_info(fs.FileSelector(self._own(folder))):
            seconds = None if info.mtime_ns is None else info.mtime_ns // 1_000_000_000
            told = (info.size, seconds)
            yield Entry(
                info.base_name, self.prefix + info.path, info.type == fs.FileType.Directory, lambda told=told: told
            )

    def open(self, path: str) -> BinaryIO:
        return self.store.open_input_stream(self._own(path))

    def write(self, path: str, content: bytes) -> None:
        own = self._own(path)
        self.store.create_dir(own.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(own) as out:
            out.write(content)


def is_uri(path: str) -> bool:
    return "://" in path


def store_of(path: str):
    """The handle for a path. Tasks call this where they run: a handle is never sent."""
    if not is_uri(path):
        return LocalStore()
    store, own = fs.FileSystem.from_uri(path)
    return ArrowStore(store, path.removesuffix(own))


def plain_path(path: str) -> str:
    """A path as rows hold it: local ones without scheme, none with a slash at its end."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if is_uri(path):
        return path.rstrip("/")
    return os.path.normpath(path)
