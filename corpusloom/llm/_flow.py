"""Minimum-cost flow by successive shortest paths, for the small aggregate graphs of mixing and resharding."""

from __future__ import annotations

from collections.abc import Hashable
from heapq import heappop, heappush


class Flow:
    """A directed graph with integer capacities and costs of at least 0 between hashable nodes."""

    def __init__(self) -> None:
        self.ends: list[Hashable] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: dict[Hashable, list[int]] = {}

    def add(self, a: Hashable, b: Hashable, capacity: int, cost: int = 0) -> int:
        """Add an arc and its reverse; returns the arc's number."""
        number = len(self.ends)
        for tail, head, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(tail, []).append(len(self.ends))
            self.out.setdefault(head, [])
            self.ends.append(head)
            self.left.append(room)
            self.cost.append(price)
        return number

    def sent(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def _distances(self, source: Hashable, potential: dict[Hashable, int]) -> dict[Hashable, int]:
        """Shortest distances by reduced costs, with a heap."""
        done: dict[Hashable, int] = {}
        best, heap, order = {source: 0}, [(0, 0, source)], 0
        while heap:
            d, _, a = heappop(heap)
            if a in done:
                continue
            done[a] = d
            for arc in self.out.get(a, ()):
                b = self.ends[arc]
                if self.left[arc] > 0 and b not in done:
                    to = d + self.cost[arc] + potential.get(a, 0) - potential.get(b, 0)
                    if to < best.get(b, to + 1):
                        best[b] = to
                        order += 1
                        heappush(heap, (to, order, b))
        return done

    def _push(self, source: Hashable, sink: Hashable, potential: dict[Hashable, int]) -> int:
        """Send what fits through arcs of reduced cost 0, each of which is given up once nothing more goes through it."""
        total, at, path, on = 0, {a: 0 for a in self.out}, [], {source}
        node = source
        while True:
            if node == sink:
                step = min(self.left[arc] for arc in path)
                for arc in path:
                    self.left[arc] -= step
                    self.left[arc ^ 1] += step
                total += step
                path, on, node = [], {source}, source
                continue
            arcs = self.out[node]
            while at[node] < len(arcs):
                arc = arcs[at[node]]
                b = self.ends[arc]
                if self.left[arc] > 0 and b in potential and b not in on and self.cost[arc] + potential[node] == potential[b]:
                    break
                at[node] += 1
            else:
                if not path:
                    return total
                on.discard(node)
                arc = path.pop()
                node = self.ends[arc ^ 1]
                at[node] += 1
                continue
            path.append(arc)
            on.add(b)
            node = b

    def run(self, source: Hashable, sink: Hashable) -> tuple[int, int]:
        """Send as much as possible as cheaply as possible; returns the amount and its cost.

        Each search settles the distances of all nodes; all shortest paths of one length are then filled at once, so
        that there are as many searches as different path costs and not as paths.
        """
        amount = price = 0
        potential: dict[Hashable, int] = {}
        while True:
            far = self._distances(source, potential)
            if sink not in far:
                return amount, price
            potential = {a: potential.get(a, 0) + min(d, far[sink]) for a, d in far.items()}
            step = self._push(source, sink, potential)
            amount, price = amount + step, price + step * potential[sink]
