"""Nested dictionaries and iterables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import add
from typing import Any


def flatten_dictionary(d: dict, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    """(keys, value) of every leaf."""
    for k, v in d.items():
        if isinstance(v, dict):
            yield from flatten_dictionary(v, (*path, k))
        else:
            yield (*path, k), v


def flatten_iter(values: Any) -> Iterator[Any]:
    """The elements of nested iterables; strings, bytes and what can't be iterated are elements."""
    if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
        yield values
        return
    for v in values:
        yield from flatten_iter(v)


def merge_dictionaries(a: dict, b: dict, f: Callable = add, default: Any = 0) -> dict:
    """All key paths of both, sorted, with ``f`` of the two values; ``default`` stands for a missing one."""
    x, y = dict(flatten_dictionary(a)), dict(flatten_dictionary(b))
    out: dict = {}
    for keys in sorted({*x, *y}):
        at = out
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        missing = default() if callable(default) else default
        at[keys[-1]] = f(x.get(keys, missing), y.get(keys, missing))
    return out


def flatten_dict_values(d: dict) -> list:
    """The leaves' values."""
    return [v for _, v in flatten_dictionary(d)]
