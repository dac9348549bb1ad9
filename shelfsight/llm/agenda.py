"""Lightest derivations over a weighted hypergraph by Knuth's agenda."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable


def lightest(
    axioms: Iterable[tuple[Hashable, tuple]],
    conclusions: Callable[[Hashable, tuple], Iterable[tuple[Hashable, tuple]]],
    goals: list[set],
) -> dict[Hashable, tuple]:
    """The least weight of every item finalised until all items of one of the ``goals`` are.

    ``conclusions(item, weight)`` lists (item, weight) deduced from a finalised item and, where a deduction has more
    antecedents, from axioms whose weight is known. Its weights must be superior: no less than the item's, and no less
    for a greater one. Then the least item of the agenda is final when it is popped.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, tuple] = {}
    waiting = [set(goal) for goal in goals]
    while agenda and all(waiting):
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        for goal in waiting:
            goal.discard(item)
        for head, value in conclusions(item, weight):
            if head not in final:
                heapq.heappush(agenda, (value, head))
    return final
