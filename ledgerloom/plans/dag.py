"""The dependency graph of a set of formulas. Small: it lives on the driver."""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass

from ledgerloom.errors import CircularReferenceError


@dataclass(frozen=True)
class Dag:
    """needs: for every node, the nodes that it reads."""

    needs: dict[str, frozenset[str]]

    @property
    def used_by(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {n: set() for n in self.needs}
        for n, ns in self.needs.items():
            for m in ns:
                out[m].add(n)
        return out

    def order(self) -> list[str]:
        """Topological order; among free nodes, that of definition. Raises with a cycle's path."""
        place = {n: k for k, n in enumerate(self.needs)}
        open_ = {n: len(ns) for n, ns in self.needs.items()}
        free, used, out = [(place[n], n) for n, k in open_.items() if not k], self.used_by, []
        heapq.heapify(free)
        while free:
            _, n = heapq.heappop(free)
            out.append(n)
            for m in used[n]:
                open_[m] -= 1
                if not open_[m]:
                    heapq.heappush(free, (place[m], m))
        if len(out) < len(self.needs):
            raise CircularReferenceError("circular reference: " + " -> ".join(self.cycle()))
        return out

    def cycle(self) -> list[str]:
        done: set[str] = set()
        for start in self.needs:
            path: list[str] = []
            n = start
            while n not in done:
                if n in path:
                    return [*path[path.index(n) :], n]
                path.append(n)
                ahead = [m for m in sorted(self.needs[n]) if m not in done and self._on_cycle(m)]
                if not ahead:
                    break
                n = ahead[0]
            done |= set(path)
        return []

    def _on_cycle(self, n: str) -> bool:
        return n in self.ancestors(n)

    def ancestors(self, *nodes: str) -> set[str]:
        return _reach(nodes, self.needs)

    def affected(self, *nodes: str) -> set[str]:
        return _reach(nodes, self.used_by)

    def levels(self) -> list[list[str]]:
        depth: dict[str, int] = {}
        for n in self.order():
            depth[n] = 1 + max((depth[m] for m in self.needs[n]), default=-1)
        out: list[list[str]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
        for n, d in depth.items():
            out[d].append(n)
        return out


def _reach(nodes, step) -> set[str]:
    seen, queue = set(), deque(m for n in nodes for m in step.get(n, ()))
    while queue:
        n = queue.popleft()
        if n not in seen:
            seen.add(n)
            queue.extend(step.get(n, ()))
    return seen
