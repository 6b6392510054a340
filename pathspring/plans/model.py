"""Path models: constructs, paths and settings, checked when they are made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


class ModelError(ValueError):
    """A model that cannot be estimated, with the reason."""


@dataclass(frozen=True)
class Construct:
    """A composite with its indicators; mode A (reflective) or B (formative)."""

    name: str
    indicators: tuple[str, ...]
    mode: str = "A"

    def __post_init__(self):
        if not self.indicators or self.mode not in ("A", "B"):
            raise ModelError(f"construct {self.name}: indicators and a mode A or B are needed")


@dataclass(frozen=True)
class PathModel:
    """Constructs and directed paths between them; the paths have no cycle."""

    constructs: tuple[Construct, ...]
    paths: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        names = [c.name for c in self.constructs]
        used = [i for c in self.constructs for i in c.indicators]
        if len({*names}) < len(names) or len({*used}) < len(used):
            raise ModelError("names of constructs and indicators must not repeat")
        for a, b in self.paths:
            if a not in names or b not in names or a == b:
                raise ModelError(f"path {a} -> {b} does not join two constructs")
        if len({*self.paths}) < len(self.paths):
            raise ModelError("paths must not repeat")
        left, done = {n: {a for a, b in self.paths if b == n} for n in names}, []
        while left:
            free = [n for n in names if n in left and left[n] <= {*done}]
            if not free:
                raise ModelError("the paths have a cycle")
            done += free
            for n in free:
                del left[n]
        object.__setattr__(self, "order", tuple(done))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.constructs]

    @property
    def indicators(self) -> list[str]:
        return [i for c in self.constructs for i in c.indicators]

    def block(self, name: str) -> list[int]:
        at = 0
        for c in self.constructs:
            if c.name == name:
                return list(range(at, at + len(c.indicators)))
            at += len(c.indicators)
        raise KeyError(name)

    def adjacency(self) -> np.ndarray:
        """a[i, j]: a path from i to j."""
        a = np.zeros((len(self.constructs),) * 2, dtype=bool)
        for x, y in self.paths:
            a[self.names.index(x), self.names.index(y)] = True
        return a

    def routes(self, source: str, target: str) -> list[tuple[str, ...]]:
        """All directed paths from source to target, in a fixed order."""
        out, stack = [], [(source,)]
        while stack:
            route = stack.pop()
            for a, b in sorted(self.paths, reverse=True):
                if a == route[-1]:
                    (out if b == target else stack).append(route + (b,))
                    if b == target:
                        continue
        return sorted(out)


def model(blocks: dict[str, Sequence[str]], paths: Sequence[tuple[str, str]], formative: Sequence[str] = ()) -> PathModel:
    return PathModel(tuple(Construct(n, tuple(i), "B" if n in formative else "A") for n, i in blocks.items()), tuple(paths))
