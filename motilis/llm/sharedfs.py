"""Files in shared folders, for Python workers: local paths, file: URIs, and whatever pyarrow opens by URI (hdfs, s3, ...)."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if (p := urlparse(uri)).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(p.path) if p.scheme else uri
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks) -> int:
    """Write chunks under another name and rename, so that a file is whole or absent and attempts of a task don't mix."""
    where, path = resolve(uri)
    folder, name = os.path.split(path)
    where.create_dir(folder, recursive=True)
    part, n = f"{folder}/_{name}.{uuid.uuid4().hex[:8]}", 0
    with where.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    where.move(part, path)
    return n


def remove(uri: str) -> None:
    where, path = resolve(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)
    elif where.get_file_info(path).type == fs.FileType.File:
        where.delete_file(path)
