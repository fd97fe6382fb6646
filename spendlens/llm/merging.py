"""Byte-pair merging with a heap over a doubly linked list of symbols."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush


def merge(symbols: Sequence, ranks: dict[tuple, tuple]) -> list:
    """The symbols left after all merges, lowest rank first and leftmost first among equal ranks.

    ``ranks`` gives ``(rank, merged symbol)`` for the pairs that merge. Each merge is one heap pop; an entry is stale
    when a symbol at its place has been merged since it was pushed, and is skipped.
    """
    get, n = ranks.get, len(symbols)
    shift = n.bit_length()
    heap = [found[0] << shift | i for i, found in enumerate(map(get, zip(symbols, symbols[1:]))) if found]
    symbols = list(symbols)
    if not heap:
        return symbols
    heapify(heap)
    after, before, place = list(range(1, n + 1)), list(range(-1, n)), (1 << shift) - 1
    symbols.append(None)  # behind the last symbol; pairs with nothing
    while heap:
        entry = heappop(heap)
        i = entry & place
        j = after[i]
        found = get((symbols[i], symbols[j]))
        if found is None or found[0] != entry >> shift:
            continue
        symbols[i] = merged = found[1]
        symbols[j] = None
        k = after[i] = after[j]
        before[k] = i
        if found := get((merged, symbols[k])):
            heappush(heap, found[0] << shift | i)
        h = before[i]
        if h >= 0 and (found := get((symbols[h], merged))):
            heappush(heap, found[0] << shift | h)
    return [s for s in symbols if s is not None]
