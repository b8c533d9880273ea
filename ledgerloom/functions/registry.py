"""The registry of formula functions. A function builds a value from values; it never sees rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ledgerloom.errors import ArgumentError
from ledgerloom.expr.values import Val


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable[..., Val]
    least: int = 0
    most: int | None = None
    family: str = ""
    keywords: tuple[str, ...] = ()

    def __call__(self, args: list[Val], keywords: dict[str, Val] | None = None) -> Val:
        if len(args) < self.least or (self.most is not None and len(args) > self.most):
            wanted = f"{self.least}" if self.least == self.most else f"{self.least} to {self.most if self.most is not None else 'any number of'}"
            raise ArgumentError(f"{self.name} takes {wanted} arguments, not {len(args)}")
        for k in keywords or {}:
            if k not in self.keywords:
                raise ArgumentError(f"{self.name} has no argument {k!r}")
        return self.build(*args, **(keywords or {}))


REGISTRY: dict[str, Function] = {}
CONSTANTS: dict[str, object] = {}


def register(*names: str, least: int = 0, most: int | None = None, family: str = "", keywords: tuple[str, ...] = ()):
    """Register a builder under one or more names. most=None: any number of arguments."""

    def keep(build: Callable[..., Val]) -> Callable[..., Val]:
        for name in names:
            REGISTRY[name] = Function(name, build, least, most, family, keywords)
        return build

    return keep


def spellings(registry: dict[str, Function]) -> dict[str, str]:
    """Lower-case name to registered name, for calls in any case."""
    constants = {name.lower(): name for name, value in CONSTANTS.items() if not isinstance(value, dict)}  # pi() is pi
    return constants | {name.lower(): name for name in registry} | {name: name for name in registry}


def load() -> dict[str, Function]:
    """The built-in functions."""
    from ledgerloom.functions import aggregates, dates, graphs, logic, lookup, math, text, time  # noqa: F401

    return REGISTRY
