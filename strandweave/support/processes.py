"""Retries, subprocesses and silence."""

from __future__ import annotations

import functools
import os
import queue
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from strandweave.support.log import logger


def retry(function: Callable, retries: int, args: tuple = (), kwargs: dict | None = None, retry_every: float | None = None, backoff: bool = False, exceptions: tuple = (Exception,)) -> Any:
    """The function's result; it is called up to ``retries`` times, at least once, and the last failure is raised.

    Between calls ``retry_every`` seconds pass, doubling each time with ``backoff``.
    """
    calls = max(1, retries)
    for attempt in range(calls):
        try:
            return function(*args, **(kwargs or {}))
        except exceptions:
            if attempt == calls - 1:
                raise
            if retry_every:
                time.sleep(retry_every * (2**attempt if backoff else 1))


def retry_decorator(retries: int, **options: Any) -> Callable:
    """``retry`` for every call of a function."""

    def decorate(function: Callable) -> Callable:
        @functools.wraps(function)
        def tried(*args: Any, **kwargs: Any) -> Any:
            return retry(function, retries, args, kwargs, **options)

        return tried

    return decorate


def run_executable(
    command: list, stdin: Any = None, stdout: Any = subprocess.PIPE, stderr: Any = subprocess.PIPE, wait: bool = True, stream: bool = True, quiet: bool = False, returncode: int = 0, alias: bool = True
) -> tuple[subprocess.Popen, str, str] | subprocess.Popen:
    """Run a command, by default until it ends; its process, output and errors, or the process alone without ``wait``.

    ``stdin``, ``stdout`` and ``stderr`` are as for a process; what doesn't come through a pipe is given as empty. Lines
    are logged as they come with ``stream``, the command by its program's name with ``alias``, by its path without. A
    return code other than ``returncode`` is an error. ``quiet`` logs nothing and accepts any return code.
    """
    command = list(map(str, command))
    if not quiet:
        logger.debug(" ".join([os.path.basename(command[0]) if alias else command[0], *command[1:]]))
    process = subprocess.Popen(command, stdin=stdin, stdout=stdout, stderr=stderr, text=wait, bufsize=1 if wait else -1)
    if not wait:
        return process
    said: dict[str, list[str]] = {"stdout": [], "stderr": []}
    lines: queue.Queue = queue.Queue()

    def read(name: str) -> None:
        for line in getattr(process, name):
            lines.put((name, line))
        lines.put((name, None))

    readers = [threading.Thread(target=read, args=(name,), daemon=True) for name in said if getattr(process, name) is not None]
    for r in readers:
        r.start()
    open_ = len(readers)
    while open_:
        name, line = lines.get()
        if line is None:
            open_ -= 1
            continue
        said[name].append(line)
        if stream and not quiet:
            logger.debug(line.rstrip("\n"))
    process.wait()
    out, err = ("".join(said[n]) for n in ("stdout", "stderr"))
    if not quiet and process.returncode != returncode:
        raise subprocess.CalledProcessError(process.returncode, command, out, err)
    return process, out, err


@contextmanager
def suppress_output() -> Iterator[None]:
    """Nothing is written to the process's standard output and error, by libraries either."""
    saved, null = [os.dup(1), os.dup(2)], os.open(os.devnull, os.O_WRONLY)
    try:
        os.dup2(null, 1)
        os.dup2(null, 2)
        yield
    finally:
        for fd, old in enumerate(saved, 1):
            os.dup2(old, fd)
            os.close(old)
        os.close(null)
