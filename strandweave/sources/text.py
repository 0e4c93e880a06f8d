"""Shared parts of the file sources: finding files, plain or gzip, local or remote."""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator
from typing import IO
from urllib.parse import urlparse
from urllib.request import urlopen

#: Fixed value: how a gzip file begins.
MAGIC = b"\x1f\x8b"


def is_remote(path: str) -> bool:
    """Whether the path is a URL."""
    return bool(urlparse(path).scheme)


def is_gzip(path: str) -> bool:
    """Whether the file begins like a gzip file; for a file that isn't there, whether it is named like one."""
    if is_remote(path):
        with urlopen(path) as f:
            return f.read(2) == MAGIC
    if not os.path.exists(path):
        return path.endswith(".gz")
    with open(path, "rb") as f:
        return f.read(2) == MAGIC


def open_bytes(path: str) -> IO[bytes]:
    """The file's bytes, unpacked if it is a gzip file, whatever its name."""
    raw = io.BufferedReader(urlopen(path)) if is_remote(path) else open(path, "rb")
    return gzip.open(raw, "rb") if raw.peek(2)[:2] == MAGIC else raw


def lines_of(path: str) -> Iterator[str]:
    """The file's lines without their ends."""
    with open_bytes(path) as f:
        for line in io.TextIOWrapper(f, encoding="utf-8", newline=None):
            yield line.rstrip("\n")


def files_of(path: str) -> list[str]:
    """The files that a path, a pattern or a directory names, in order."""
    if is_remote(path) and not path.startswith("file:"):
        return [path]
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for f in os.listdir(path) if not f.startswith(("_", ".")) and os.path.isfile(p := os.path.join(path, f)))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found
