"""Bytes of local and remote files, for code that runs outside the JVM."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import pyarrow.fs as fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(url.path) if url.scheme else path)
    return fs.FileSystem.from_uri(path)


def _is_table(name: str) -> bool:
    return not name.startswith((".", "_"))


def expand(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of the files meant: files, folders and local patterns; hidden files and folders are left out."""
    import glob

    out: list[tuple[str, int]] = []
    for path in paths:
        system, at = _at(path)
        prefix = path[: len(path) - len(at)] if path.endswith(at) and urlparse(path).scheme not in ("", "file") else ""
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(at, recursive=True))
            out += sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and all(map(_is_table, f.path[len(at) :].strip("/").split("/"))))
        elif info.type == fs.FileType.File:
            out.append((prefix + at, info.size))
        elif isinstance(system, fs.LocalFileSystem) and (matched := sorted(glob.glob(at))):
            out += expand(matched)
        else:
            raise FileNotFoundError(f"no such file: {path}")
    return out


@contextmanager
def opened(path: str) -> Iterator[tuple[Callable[[int, int], bytes], int]]:
    """(read_at(offset, length), size) of a file."""
    system, at = _at(path)
    with system.open_input_file(at) as f:

        def read_at(offset: int, length: int) -> bytes:
            f.seek(offset)
            return f.read(length)

        yield read_at, f.size()


class PendingFile:
    """A file written under a temporary name; ``publish`` gives it its own, ``discard`` removes it."""

    def __init__(self, folder: str, name: str) -> None:
        system, at = _at(folder)
        system.create_dir(at, recursive=True)
        self.folder, self.name, self.hidden = folder, name, f".{name}.{uuid.uuid4().hex}.tmp"
        self.stream = system.open_output_stream(f"{at}/{self.hidden}")

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> tuple[str, str, str]:
        self.stream.close()
        return self.folder, self.hidden, self.name


def publish(folder: str, hidden: str, name: str) -> None:
    system, at = _at(folder)
    if system.get_file_info(f"{at}/{name}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder}/{name} is there already")
    system.move(f"{at}/{hidden}", f"{at}/{name}")


def discard(folder: str, hidden: str) -> None:
    system, at = _at(folder)
    try:
        system.delete_file(f"{at}/{hidden}")
    except FileNotFoundError:
        pass


def tables_in(folder: str) -> list[tuple[fs.FileSystem, str]]:
    """The table files that stand in a folder."""
    system, at = _at(folder)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return []
    return [(system, f.path) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and _is_table(f.base_name)]


def remove_folder(folder: str) -> None:
    """Removes a folder and all that it holds, if it is there."""
    system, at = _at(folder)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def remove(files: list[tuple[fs.FileSystem, str]]) -> None:
    for system, path in files:
        system.delete_file(path)
