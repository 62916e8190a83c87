"""Bin completion on a histogram of sizes: pure Python, bounded by the number of distinct sizes.

A plan is a list of (filling, times): a filling is a descending tuple of sizes that share a bin, used that often.
"""

from __future__ import annotations

import bisect

Plan = list[tuple[tuple[int, ...], int]]
NODES, CHOICES, WIDTH = 6000, 6, 24


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by the total size, and by the sizes that can't share a bin (for several cuts)."""
    sizes = sorted(counts)
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for cut in {0, *(s for s in sizes if s <= capacity // 2)}:
        big = sum(n for s, n in counts.items() if s > capacity - cut)
        half = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - cut]
        small = sum(s * n for s, n in counts.items() if cut <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The incumbent: sizes descend and enter the fullest open bins with room; equal bins are held together."""
    room: list[int] = []  # sorted rooms of open bins
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(filling: tuple[int, ...], left: int, times: int) -> None:
        if left not in open_:
            bisect.insort(room, left)
            open_[left] = []
        open_[left].append((filling, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect.bisect_left(room, s)
            if i < len(room):
                left = room[i]
                filling, times = open_[left].pop()
                if not open_[left]:
                    del open_[left]
                    del room[i]
            else:
                filling, left, times = (), capacity, n
            fit = left // s
            whole = min(times, n // fit)
            if whole:
                put(filling + (s,) * fit, left - s * fit, whole)
                n -= whole * fit
                times -= whole
            if n and times and n < fit:
                put(filling + (s,) * n, left - s * n, 1)
                n, times = 0, times - 1
            if times and filling:
                put(filling, left, times)
    return [f for x in open_.values() for f in x]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's sizes can be dealt to a's so that none overflows: then b needs not be tried."""

    def deal(rest: tuple[int, ...], room: list[int]) -> bool:
        if not rest:
            return True
        seen = set()
        for i, r in enumerate(room):
            if r >= rest[0] and r not in seen:
                seen.add(r)
                room[i] -= rest[0]
                if deal(rest[1:], room):
                    return True
                room[i] += rest[0]
        return False

    return len(b) >= len(a) and sum(a) >= sum(b) and deal(b, list(a))


def completions(counts: dict[int, int], mask: int, room: int, most: int = CHOICES) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, those that waste least first; ``mask`` has a bit for each size at hand.

    The first one or two sizes are tried from the largest down, ``WIDTH`` of each; the rest is filled up with the
    largest size that fits, time and again. Three fillings without waste end the search.
    """
    found: dict[tuple[int, ...], int] = {}
    exact = 0

    def largest(limit: int) -> int:
        return (mask & ((2 << limit) - 1)).bit_length() - 1 if limit > 0 else -1

    def fill(chosen: list[int], left: int, top: int) -> None:
        nonlocal exact
        s = largest(min(left, top))
        while s > 0:
            k = min(left // s, counts[s] - chosen.count(s))
            chosen += [s] * k
            left -= s * k
            s = largest(min(left, s - 1))
        f = tuple(chosen)
        if f not in found:
            found[f] = left
            exact += left == 0

    a, i = largest(room), 0
    if a <= 0:
        return [()]
    while a > 0 and i < WIDTH and exact < 3:
        fill([a], room - a, a)
        b, j = largest(min(room - a, a)), 0
        while b > 0 and j < (WIDTH if i < 4 else 2) and exact < 3:
            if b < a or counts[a] > 1:
                fill([a, b], room - a - b, b)
                j += 1
            b = largest(b - 1)
        a, i = largest(a - 1), i + 1
    out: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f))):
        if len(f) > 8 or not any(dominates(o, f) for o in out[:4]):
            out.append(f)
            if len(out) >= most:
                break
    return out


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[Plan, int]:
    """A plan of as few bins as the search finds, and the lower bound.

    Depth first, the largest size at hand is completed in every undominated way, as often as the counts allow, the
    filling of least waste first. A branch ends when its waste leaves no better plan than the incumbent, which at
    first is best-fit-decreasing; the search ends at the lower bound or after ``nodes`` fillings.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return [], 0
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must be from 1 to the capacity")
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    best_n = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    left = dict(counts)
    mask = sum(1 << s for s in left)
    plan: Plan = []
    waste, used, spent = 0, 0, 0
    stack: list[list] = []  # [choices, next choice, how to undo]

    def take(filling: tuple[int, ...], times: int) -> None:
        nonlocal mask
        for s in filling:
            left[s] -= times
            if not left[s]:
                mask &= ~(1 << s)

    def give(filling: tuple[int, ...], times: int) -> None:
        nonlocal mask
        for s in filling:
            left[s] += times
            mask |= 1 << s

    def choices() -> list[tuple[int, ...]]:
        nonlocal mask
        s = mask.bit_length() - 1
        take((s,), 1)
        got = completions(left, mask, capacity - s)
        give((s,), 1)
        return [(s, *f) for f in got]

    while best_n > bound and spent < nodes:
        if mask:
            stack.append([choices(), 0, None])
        elif used < best_n:
            best, best_n = list(plan), used
        # down the next choice, or back to where there is one
        while stack:
            top = stack[-1]
            if top[2]:
                filling, times = top[2]
                give(filling, times)
                plan.pop()
                waste -= (capacity - sum(filling)) * times
                used -= times
                top[2] = None
            if top[1] == len(top[0]):
                stack.pop()
                continue
            filling = top[0][top[1]]
            top[1] += 1
            times = min(left[s] // filling.count(s) for s in set(filling))
            lost = (capacity - sum(filling)) * times
            if -(-(total + waste + lost) // capacity) >= best_n:
                continue
            take(filling, times)
            plan.append((filling, times))
            waste, used, spent = waste + lost, used + times, spent + 1
            top[2] = (filling, times)
            break
        if not stack:
            break
    if mask == 0 and used < best_n:
        best, best_n = list(plan), used
    return best, bound
