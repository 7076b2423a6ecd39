"""Files by path, on a mounted folder or behind a URI (``s3://``, ``gs://``, ``abfss://``, ``hdfs://``, ``file://``).

Plain paths go to the operating system, URIs to Arrow's file systems, whose credentials come from the workers' environment.
Every function raises OSError for what cannot be read or written.
"""

from __future__ import annotations

import contextlib
import datetime
import os
import posixpath
import stat
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs

#: Permissions of files whose storage has none.
NO_MODE = 0o644


@dataclass
class About:
    size: int
    mtime: datetime.datetime | None
    mode: int


def _found(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system and path of a URI; None for a plain path."""
    if "://" not in path:
        return None
    try:
        return fs.FileSystem.from_uri(path)
    except ValueError as problem:
        raise OSError(f"no storage for {path}") from problem


def reading(path: str) -> BinaryIO:
    """An open file that can be read and moved in."""
    found = _found(path)
    return found[0].open_input_file(found[1]) if found else open(path, "rb")


def writing(path: str) -> BinaryIO:
    found = _found(path)
    return found[0].open_output_stream(found[1]) if found else open(path, "wb")


def about(path: str) -> About:
    found = _found(path)
    if found is None:
        told = os.stat(path)
        if stat.S_ISDIR(told.st_mode):
            raise IsADirectoryError(path)
        return About(told.st_size, datetime.datetime.fromtimestamp(told.st_mtime, datetime.UTC), stat.S_IMODE(told.st_mode))
    info = found[0].get_file_info(found[1])
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return About(info.size, info.mtime, NO_MODE)


def size(path: str) -> int:
    return about(path).size


def is_folder(path: str) -> bool:
    found = _found(path)
    return found[0].get_file_info(found[1]).type == fs.FileType.Directory if found else os.path.isdir(path)


def make_folder(path: str) -> None:
    found = _found(path)
    if found:
        found[0].create_dir(found[1], recursive=True)
    else:
        os.makedirs(path, mode=0o755, exist_ok=True)


def names(folder: str) -> list[str]:
    """Names of what stands in a folder, sorted."""
    found = _found(folder)
    return sorted(i.base_name for i in found[0].get_file_info(fs.FileSelector(found[1]))) if found else sorted(os.listdir(folder))


def join(folder: str, name: str) -> str:
    return posixpath.join(folder, name) if "://" in folder else os.path.join(folder, name)


def move(path: str, to: str) -> None:
    """Give a file another name, in place of a file that has it."""
    found = _found(path)
    if found:
        found[0].move(found[1], _found(to)[1])
    else:
        os.replace(path, to)


def remove(path: str) -> None:
    """Remove a file, if it is there."""
    found = _found(path)
    with contextlib.suppress(FileNotFoundError):
        if found:
            found[0].delete_file(found[1])
        else:
            os.remove(path)


def remove_folder(path: str) -> None:
    """Remove a folder with all that is in it, if it is there."""
    system, inner = _found(path) or (fs.LocalFileSystem(), path)
    with contextlib.suppress(FileNotFoundError):
        system.delete_dir(inner)


def set_mode(path: str, mode: int) -> None:
    """Set permissions, where the storage has them."""
    if "://" not in path:
        os.chmod(path, mode & 0o777)
