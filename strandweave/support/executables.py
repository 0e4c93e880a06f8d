"""External programs with named, validated arguments."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from strandweave.errors import ArgumentError, BinaryError
from strandweave.support.files import set_executable
from strandweave.support.processes import run_executable


@dataclass(frozen=True)
class Validator:
    """A predicate with a name; combined with ``&``, ``|`` and ``~``."""

    test: Callable[[Any], bool]
    name: str

    def __call__(self, value: Any) -> bool:
        return bool(self.test(value))

    def __and__(self, other: Validator) -> Validator:
        return Validator(lambda v: self(v) and other(v), f"({self} AND {other})")

    def __or__(self, other: Validator) -> Validator:
        return Validator(lambda v: self(v) or other(v), f"({self} OR {other})")

    def __invert__(self) -> Validator:
        return Validator(lambda v: not self(v), f"(NOT {self})")

    def __str__(self) -> str:
        return self.name


def _number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _whole(value: Any) -> bool:
    n = _number(value)
    return n is not None and n == n and abs(n) != float("inf") and int(n) == n


ANY = Validator(lambda v: True, "Any")
IS_INTEGER = Validator(_whole, "IsInteger")
IS_FLOAT = Validator(lambda v: _number(v) is not None and not _whole(v), "IsFloat")
IS_POSITIVE = Validator(lambda v: (_number(v) or 0) > 0, "IsPositive")
IS_FILE = Validator(lambda v: os.path.isfile(v), "IsFile")
IS_DIR = Validator(lambda v: os.path.isdir(v), "IsDir")


def constant(value: Any) -> Validator:
    return Validator(lambda v: v == value, f"Is({value})")


@dataclass
class Argument:
    """An argument: positional, or a constant without a value, or named with a value."""

    name: str | None = None
    value: bool = True
    required: bool = False
    before: Validator = ANY
    after: Validator = ANY

    @classmethod
    def positional(cls, **options: Any) -> Argument:
        return cls(None, **options)

    @classmethod
    def constant(cls, name: str, **options: Any) -> Argument:
        return cls(name, value=False, **options)

    @classmethod
    def named(cls, name: str, **options: Any) -> Argument:
        return cls(name, **options)

    def _check(self, validator: Validator, value: Any) -> None:
        if not validator(value):
            raise ArgumentError(f"{value} is not {validator}")

    def pre_execute(self, value: Any) -> None:
        self._check(self.before, value)

    def post_execute(self, value: Any) -> None:
        self._check(self.after, value)

    def render(self, value: Any = None) -> list[str]:
        return [*([self.name] if self.name else []), *([str(value)] if self.value else [])]


@dataclass(frozen=True)
class BinaryResult:
    command: list[str]
    stdout: str
    stderr: str


class Binary:
    """A program, by path or by name; made executable if it is a file that isn't."""

    def __init__(self, path: str) -> None:
        found = os.path.abspath(path) if os.path.isfile(path) else shutil.which(path)
        if not found:
            raise BinaryError(f"{path} isn't a program")
        if not os.access(found, os.X_OK):
            set_executable(found)
        self.path = found

    def pre_execute(self, command: list[str], *args: Any, **kwargs: Any) -> None:
        """Called before the program runs."""

    def post_execute(self, command: list[str], result: BinaryResult, *args: Any, **kwargs: Any) -> None:
        """Called after the program ran."""

    def __call__(self, command: list[str], *args: Any, **kwargs: Any) -> BinaryResult:
        whole = [self.path, *map(str, command)]
        self.pre_execute(whole, *args, **kwargs)
        _, out, err = run_executable(whole, stream=False)
        result = BinaryResult(whole, out, err)
        self.post_execute(whole, result, *args, **kwargs)
        return result


@dataclass
class BinaryExecutor:
    """Runs a program with arguments given by key, in the order of the values."""

    binary: Binary
    arguments: dict[str, Argument] = field(default_factory=dict)

    def __call__(self, values: dict[str, Any], *args: Any, **kwargs: Any) -> BinaryResult:
        unknown = [k for k in values if k not in self.arguments]
        missing = [k for k, a in self.arguments.items() if a.required and k not in values]
        if unknown or missing:
            raise BinaryError(f"unknown arguments {unknown}, missing arguments {missing}")
        for k, v in values.items():
            self.arguments[k].pre_execute(v)
        result = self.binary([x for k, v in values.items() for x in self.arguments[k].render(v)], *args, **kwargs)
        for k, v in values.items():
            self.arguments[k].post_execute(v)
        return result
