"""Files by URI from inside tasks, and commits of files that many tasks wrote.

Paths go through Arrow's file systems, so tasks reach every store that Arrow knows (local and mounted folders, HDFS, object stores).
A writer puts its files below one hidden folder per job; only the commit, which the driver runs once, moves the files of the attempts
that Spark accepted into place.  What failed or repeated attempts left goes with the hidden folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

DONE = "_SUCCESS"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    local = re.fullmatch(r"(?:file:(?://(?=/))?)?(/.*)", uri)
    if local:
        return fs.LocalFileSystem(), local[1].rstrip("/") or "/"
    return fs.FileSystem.from_uri(uri.rstrip("/"))


def files(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """Path and size of the files below a folder, or of one file; hidden ones and those in hidden folders are left out."""
    store, root = filesystem(uri)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)
                  and not any(part.startswith(("_", ".")) for part in f.path[len(root):].strip("/").split("/")))


@dataclass
class Written(WriterCommitMessage):
    """Files of one accepted task attempt, as paths below the job's hidden folder and their names in the output."""

    names: list[tuple[str, str]]


def staging(uri: str, job: str) -> str:
    return f"{uri.rstrip('/')}/_temporary-{job}"


def publish(uri: str, job: str, messages: Iterable[Written | None], overwrite: bool = False) -> None:
    """Move the accepted files into place; with ``overwrite`` the folder's earlier files go first."""
    store, root = filesystem(uri)
    _, hidden = filesystem(staging(uri, job))
    store.create_dir(root, recursive=True)
    if overwrite:
        for path, _ in files(uri):
            store.delete_file(path)
    folders = set()
    for m in messages:
        for temporary, name in m.names if m else ():
            target = f"{root}/{name}"
            parent = target.rsplit("/", 1)[0]
            if parent not in folders:
                store.create_dir(parent, recursive=True)
                folders.add(parent)
            store.move(f"{hidden}/{temporary}", target)
    discard(uri, job)
    with store.open_output_stream(f"{root}/{DONE}"):
        pass


def discard(uri: str, job: str) -> None:
    """Remove what a job has staged."""
    store, hidden = filesystem(staging(uri, job))
    if store.get_file_info(hidden).type != fs.FileType.NotFound:
        store.delete_dir(hidden)
