"""Files of any file system that pyarrow knows: plain paths and file: are local, others go by their scheme."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_binary(path: str):
    system, inner = system_of(path)
    return system.open_input_file(inner)


def list_files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The path itself, or a folder's files with these endings in name order."""
    system, inner = system_of(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.is_file)
    return [f"{path.rstrip('/')}/{n}" for n in names if n.lower().endswith(endings) and not n.startswith(("_", "."))]


def write_whole(path: str, *parts: bytes) -> None:
    """Write beside and move into place, so that a file is there whole or not at all."""
    system, inner = system_of(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner + ".tmp") as f:
        for p in parts:
            f.write(p)
    system.move(inner + ".tmp", inner)


class Spool:
    """A file whose head is known only after its body: the body goes to a file beside it, and is copied behind the head in the end."""

    PIECE = 8 << 20

    def __init__(self, path: str):
        self.path = path
        self.system, self.inner = system_of(path)
        self.system.create_dir(self.inner.rsplit("/", 1)[0], recursive=True)
        self.body = self.system.open_output_stream(self.inner + ".body")

    def write(self, data: bytes) -> None:
        self.body.write(data)

    def finish(self, head: bytes) -> None:
        self.body.close()
        with self.system.open_input_stream(self.inner + ".body") as f:
            self._copy(head, iter(lambda: f.read(self.PIECE), b""))
        self.system.delete_file(self.inner + ".body")

    def _copy(self, head: bytes, pieces: Iterable[bytes]) -> None:
        with self.system.open_output_stream(self.inner + ".tmp") as f:
            f.write(head)
            for piece in pieces:
                f.write(piece)
        self.system.move(self.inner + ".tmp", self.inner)


def each(read: Callable, paths: list[str], at_once: int = 64) -> list:
    """read(path) of every path, many at a time: heads of files are small reads that wait for the store."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(read, paths))


def make_folder(path: str) -> None:
    system, inner = system_of(path)
    system.create_dir(inner, recursive=True)


def move(source: str, target: str) -> None:
    """Rename within a file system, over what is there."""
    system, inner = system_of(source)
    system.move(inner, system_of(target)[1])


def remove(path: str) -> None:
    system, inner = system_of(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        system.delete_file(inner)
