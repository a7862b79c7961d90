"""Flat files of token ids in a folder that all executors reach: opening, sizes, atomic writes.

Paths are URIs that pyarrow's file systems know (``file://``, ``hdfs://``, ``s3://``, ``gs://``). A file is written under a
name of its own and then renamed, so a repeated or speculative task replaces a file by an equal one and a
lost executor never leaves half a file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def make_folder(uri: str) -> None:
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)


def write_file(uri: str, parts) -> int:
    """Write the byte strings ``parts`` as one file; returns its size."""
    system, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    draft, size = f"{folder}/_{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(draft, path)
    return size


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = resolve(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)


def read_file(uri: str) -> bytes:
    system, path = resolve(uri)
    with system.open_input_file(path) as file:
        return file.read()


def file_sizes(uri: str, suffix: str = ".bin") -> list[tuple[str, int]]:
    """(URI, bytes) of the finished files in a folder, by name."""
    system, path = resolve(uri)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((f"{uri}/{i.base_name}", i.size) for i in found if i.is_file and i.base_name.endswith(suffix) and not i.base_name.startswith("_"))
