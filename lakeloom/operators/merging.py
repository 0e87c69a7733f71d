"""Merges on one sequence of token ids."""

from __future__ import annotations

import heapq

BYTES = 256
#: Ids from which the queue is quicker than looking through all pairs for each merge.
LONG = 64


def merge_word(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """The present pair of lowest rank is merged, from left to right, until none is left; the pair of rank k makes id 256 + k, which only pairs of
    higher rank hold."""
    if len(ids) >= LONG:
        return _merge_long(ids, ranks)
    while len(ids) > 1:
        best = min(zip(ids, ids[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        new, out, i = BYTES + ranks[best], [], 0
        while i < len(ids):
            if i + 1 < len(ids) and (ids[i], ids[i + 1]) == best:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def _merge_long(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """The same by a linked list of tokens and a queue of (rank, place): n log n."""
    n = len(ids)
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i) for i, r in enumerate(map(ranks.get, zip(ids, ids[1:], strict=False))) if r is not None]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or ranks.get((ids[i], ids[j])) != rank:
            continue  # what was queued is not there any more
        ids[i], ids[j] = BYTES + rank, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get((ids[i], ids[k]))
            if r is not None:
                heapq.heappush(queue, (r, i))
        h = before[i]
        if h >= 0:
            r = ranks.get((ids[h], ids[i]))
            if r is not None:
                heapq.heappush(queue, (r, h))
    return [x for x in ids if x >= 0]
