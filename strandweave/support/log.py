"""A logger with namespaces."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

FORMAT = "[%(asctime)s] %(levelname)7s %(message)s"


class Logger:
    """Messages carry the namespace they are logged in."""

    def __init__(self, name: str = "strandweave") -> None:
        self.namespace = ""
        self.logger = logging.getLogger(name)
        if not self.logger.handlers:
            handler = logging.StreamHandler()
            handler.setFormatter(logging.Formatter(FORMAT))
            self.logger.addHandler(handler)
        self.logger.propagate = False

    def _say(self, level: int, message: object, *args: object, **kwargs: object) -> None:
        self.logger.log(level, f"[{self.namespace}] {message}" if self.namespace else message, *args, **kwargs)

    def __getattr__(self, name: str) -> Callable:
        level = getattr(logging, name.upper(), None)
        if not isinstance(level, int):
            raise AttributeError(name)
        return functools.partial(self._say, level)

    def setLevel(self, level: int | str) -> None:  # noqa: N802
        self.logger.setLevel(level)

    @contextmanager
    def namespaced_context(self, namespace: str) -> Iterator[None]:
        """Messages within are of the namespace; the one before is back afterwards, whatever happens."""
        before, self.namespace = self.namespace, namespace
        try:
            yield
        finally:
            self.namespace = before

    def namespaced(self, namespace: str) -> Callable:
        """A function whose messages are of the namespace."""

        def decorate(function: Callable) -> Callable:
            @functools.wraps(function)
            def inner(*args: object, **kwargs: object) -> object:
                with self.namespaced_context(namespace):
                    return function(*args, **kwargs)

            return inner

        return decorate


logger = Logger()


def silence_logger(name: str) -> None:
    """Nothing of the named logger is heard."""
    quiet = logging.getLogger(name)
    quiet.handlers, quiet.propagate = [logging.NullHandler()], False
    quiet.setLevel(logging.CRITICAL + 10)


def set_logger(other: logging.Logger) -> None:
    """Messages go to another logger; modules that hold ``logger`` follow."""
    logger.logger = other
