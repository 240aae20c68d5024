"""Files by path or URI, on any file system that pyarrow knows or that is registered here.

File systems are looked up where they are used; :func:`resolver` gives tasks those registered in the driver.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Callable

from pyarrow import fs

SCHEMES: dict[str, fs.FileSystem] = {}  # further file systems by scheme; their paths are what follows "://"

Locate = Callable[[str], tuple[fs.FileSystem, str]]


def _locate(path: str, schemes: dict[str, fs.FileSystem]) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = path.partition("://")
    if not colon:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    if scheme in schemes:
        return schemes[scheme], rest
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)


def resolver() -> Locate:
    """A function, fit for tasks, from path to file system and the path in it."""
    schemes = dict(SCHEMES)
    return lambda path: _locate(path, schemes)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return _locate(path, SCHEMES)


def is_registered(path: str) -> bool:
    """Whether only this package, and not Spark, can read the path."""
    return path.partition("://")[0] in SCHEMES


def join(root: str, *parts: str) -> str:
    return posixpath.join(root, *parts)


def exists(path: str) -> bool:
    system, place = locate(path)
    return system.get_file_info(place).type != fs.FileType.NotFound


def is_file(path: str) -> bool:
    system, place = locate(path)
    return system.get_file_info(place).type == fs.FileType.File


def is_folder(path: str) -> bool:
    system, place = locate(path)
    return system.get_file_info(place).type == fs.FileType.Directory


def read_bytes(path: str, at: Locate = locate) -> bytes:
    system, place = at(path)
    with system.open_input_stream(place) as f:
        return f.read()


def make_folder(path: str, at: Locate = locate) -> None:
    system, place = at(path)
    system.create_dir(place, recursive=True)


def remove_folder(path: str) -> None:
    system, place = locate(path)
    if system.get_file_info(place).type == fs.FileType.Directory:
        system.delete_dir(place)


def files_in(folder: str) -> list[str]:
    """Names of the files right in a folder, sorted."""
    system, place = locate(folder)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.type == fs.FileType.File)


def move(old: str, new: str, at: Locate = locate) -> None:
    """Rename within a file system; what ``new`` was is replaced."""
    system, place = at(old)
    system.move(place, at(new)[1])


def create(path: str, data: bytes) -> bool:
    """A new file that appears as a whole, unless ``path`` is there already: then nothing changes and the result is False.

    On local and mounted file systems no other writer can come between; elsewhere the move decides.
    """
    make_folder(posixpath.dirname(path))
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    system, place = locate(temporary)
    with system.open_output_stream(place) as f:
        f.write(data)
    target = locate(path)[1]
    if isinstance(system, fs.LocalFileSystem):
        try:
            os.link(place, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(place)
    if system.get_file_info(target).type != fs.FileType.NotFound:
        system.delete_file(place)
        return False
    try:
        system.move(place, target)
    except OSError:
        if system.get_file_info(target).type == fs.FileType.NotFound:
            raise
        return False
    return True
