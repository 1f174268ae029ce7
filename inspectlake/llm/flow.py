"""Minimum-cost flow over small graphs of totals, solved on the driver.

Nodes stand for aggregates (membership patterns, sources, shards), never for
documents; callers bound their number.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Hashable

Node = Hashable


def min_cost_flow(
    arcs: list[tuple[Node, Node, int, int]], source: Node, sink: Node
) -> tuple[list[int], int]:
    """The flow on each arc (tail, head, capacity, cost) of a cheapest largest flow, and its cost.

    Costs must not be negative.  Shortest augmenting paths with node
    potentials; ties go to the earlier arc, so equal input gives equal flow.
    """
    head, room, price = [], [], []
    out: dict[Node, list[int]] = defaultdict(list)
    for a, b, capacity, cost in arcs:
        for tail, to, cap, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[tail].append(len(head))
            head.append(to)
            room.append(cap)
            price.append(c)
    potential: dict[Node, int] = defaultdict(int)
    while True:
        far, came, done, heap, tick = {source: 0}, {}, set(), [(0, 0, source)], 0
        while heap:
            d, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for e in out[node]:
                to = head[e]
                if room[e] <= 0 or to in done:
                    continue
                reach = d + price[e] + potential[node] - potential[to]
                if to not in far or reach < far[to]:
                    far[to], came[to] = reach, e
                    tick += 1
                    heapq.heappush(heap, (reach, tick, to))
        if sink not in far:
            break
        most = max(far.values())
        for node in out:
            potential[node] += far.get(node, most)
        path, node = [], sink
        while node != source:
            path.append(came[node])
            node = head[came[node] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    flows = [room[2 * i + 1] for i in range(len(arcs))]
    return flows, sum(f * arc[3] for f, arc in zip(flows, arcs, strict=True))
