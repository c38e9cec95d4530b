"""Min-cost flow in whole numbers by the primal-dual method: shortest distances by cost, then blocking flows along them.

For networks of bounded size, on the driver. Costs are small whole numbers, so few distances occur, and each is settled by
blocking flows over all its shortest paths at once rather than path by path.
"""

from __future__ import annotations

import heapq


class Network:
    def __init__(self, nodes: int) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int = 0) -> int:
        """An arc from a to b; its number, by which flow() tells what it carries. Its reverse has the next number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc + 1]

    def _distances(self, source: int, held: list[int]) -> list[int | None]:
        """Least costs from source over arcs with room, less what held already says."""
        far: list[int | None] = [None] * len(self.arcs)
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if far[x] is not None:
                continue
            far[x] = d
            for e in self.arcs[x]:
                if self.room[e] and far[self.to[e]] is None:
                    heapq.heappush(heap, (d + self.cost[e] + held[x] - held[self.to[e]], self.to[e]))
        return far

    def _blocking(self, source: int, sink: int, held: list[int]) -> int:
        """A blocking flow over arcs of no reduced cost, in layers."""
        layer = {source: 0}
        queue = [source]
        for x in queue:
            for e in self.arcs[x]:
                y = self.to[e]
                if self.room[e] and y not in layer and self.cost[e] + held[x] - held[y] == 0:
                    layer[y] = layer[x] + 1
                    queue.append(y)
        if sink not in layer:
            return 0
        at, sent, path = dict.fromkeys(layer, 0), 0, []
        x = source
        while True:
            if x == sink:
                least = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= least
                    self.room[e ^ 1] += least
                sent += least
                cut = next(k for k, e in enumerate(path) if not self.room[e])
                x = self.to[path[cut] ^ 1]
                path = path[:cut]
            arcs = self.arcs[x]
            while at[x] < len(arcs):
                e = arcs[at[x]]
                y = self.to[e]
                if self.room[e] and layer.get(y) == layer[x] + 1 and self.cost[e] + held[x] - held[y] == 0:
                    break
                at[x] += 1
            if at[x] < len(arcs):
                path.append(arcs[at[x]])
                x = y
            elif path:
                x = self.to[path.pop() ^ 1]
                at[x] += 1
            else:
                return sent

    def solve(self, source: int, sink: int) -> int:
        """The largest flow, at the least cost. Arcs must not have negative costs, but for reverses."""
        held, sent = [0] * len(self.arcs), 0
        while True:
            far = self._distances(source, held)
            if far[sink] is None:
                return sent
            top = far[sink]
            held = [h + (top if d is None else min(d, top)) for h, d in zip(held, far, strict=True)]
            while more := self._blocking(source, sink, held):
                sent += more
