"""Cutting stock by column generation, over a histogram of lengths.

The master problem covers every length's demand with as few bins as possible; its columns
are patterns, multisets of lengths that fit a bin. A dynamic program over the bin's
capacity (an unbounded knapsack of the dual prices) finds the column to enter; the basis
inverse is updated in place. Everything here is bounded by the bin size, not the input.
"""

from __future__ import annotations

import numpy as np


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The dearest multiset of lengths (ascending) within the capacity: its price, and indices with repeats."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], usable[c]
        if k:
            values = best[c - lengths[:k]] + prices[:k]
            i = int(values.argmax())
            if values[i] > best[c] + 1e-12:
                best[c], taken[c] = values[i], i
    items, c = [], capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            items.append(int(taken[c]))
            c -= int(lengths[taken[c]])
    return float(best[capacity]), items


def falling_patterns(demand: dict[int, int], capacity: int, whole: bool) -> list[tuple[dict[int, int], float, list[int]]]:
    """Patterns that take the longest lengths that fit, each as often as its scarcest length allows, and the lengths each uses up.

    With ``whole`` that is a whole number, otherwise a fraction, so that every pattern
    uses up a length.
    """
    left: dict[int, float] = {k: v for k, v in demand.items() if v > 0}
    order = sorted(left, reverse=True)
    made = []
    while order:
        pattern, room = {}, capacity
        for length in order:
            if length <= room:
                n = min(room // length, max(1, int(left[length])))
                pattern[length] = n
                room -= n * length
                if not room:
                    break
        times = min(left[k] // n if whole else left[k] / n for k, n in pattern.items())
        gone = []
        for k, n in pattern.items():
            left[k] -= n * times
            if left[k] < 1e-9:
                gone.append(k)
        made.append((pattern, times, gone))
        if gone:
            order = [k for k in order if k not in set(gone)]
    return made


def generate_columns(demand: dict[int, int], capacity: int, gap: float = 0.002, steps: int = 1500) -> list[tuple[dict[int, int], float]]:
    """Patterns with their (fractional) use in the linear program's solution.

    Starts from the falling patterns, which form a triangular basis. Columns are priced
    halfway between the basis's duals and each length's share of a bin, which is where the
    duals tend, and by the duals alone once that finds none. Ends when no column prices
    out by more than ``gap``, when the bins hold no more than that share of air, or after
    ``steps`` pivots; the solution covers the demand exactly at any time.
    """
    lengths = np.array(sorted(k for k, v in demand.items() if v > 0))
    if not lengths.size:
        return []
    at = {int(k): i for i, k in enumerate(lengths)}
    columns: list[dict[int, int]] = []
    started: list[float] = []
    for pattern, times, gone in falling_patterns(demand, capacity, whole=False):
        columns.append({at[k]: n for k, n in pattern.items()})
        started.append(times)
        for k in gone[1:]:  # used up together: the others enter unused
            columns.append({at[k]: capacity // k})
            started.append(0.0)
    m = len(lengths)
    basis = np.zeros((m, m))
    for j, column in enumerate(columns):
        for i, n in column.items():
            basis[i, j] = n
    inverse, use = np.linalg.inv(basis), np.array(started)
    share = lengths / capacity
    least = share @ np.array([demand[int(k)] for k in lengths], float)
    pull = 0.5
    for _ in range(steps):
        if use.sum() <= least * (1 + gap):
            break
        prices = inverse.sum(0)
        _, items = knapsack(lengths, pull * share + (1 - pull) * prices, capacity)
        if prices[items].sum() <= 1 + 1e-9:
            value, items = knapsack(lengths, prices, capacity)
            pull = max(0.0, pull - 0.1)
            if value <= 1 + gap:
                break
        rows, counts = np.unique(items, return_counts=True)
        change = inverse[:, rows] @ counts
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = use[up] / change[up]
        row = int(ratio.argmin())
        step = max(0.0, ratio[row])
        use = np.maximum(use - step * change, 0.0)
        use[row] = step
        pivot = inverse[row] / change[row]
        inverse -= np.outer(change, pivot)
        inverse[row] = pivot
        columns[row] = dict(zip(rows.tolist(), counts.tolist()))
    return [({int(lengths[i]): n for i, n in column.items()}, float(u)) for column, u in zip(columns, use)]


def plan(demand: dict[int, int], capacity: int, slack: int) -> list[tuple[dict[int, int], int]]:
    """Integer patterns and how often to fill them; together they never exceed the demand.

    Fractional uses are rounded down and the rest is packed first-fit falling. Patterns
    that would leave more than ``slack`` empty are left out: their documents are cut.
    Rounding leaves little of fine fractions, so pivots are in proportion to the documents.
    """
    steps = min(1500, 20 + sum(demand.values()) // 20)
    rounded = [(p, int(u + 1e-9)) for p, u in generate_columns(demand, capacity, steps=steps)]
    left = dict(demand)
    kept = []
    for pattern, times in rounded:
        times = min([times, *(left.get(k, 0) // n for k, n in pattern.items())])
        if times > 0 and capacity - sum(k * n for k, n in pattern.items()) <= slack:
            kept.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= n * times
    for pattern, times, _ in falling_patterns(left, capacity, whole=True):
        if capacity - sum(k * n for k, n in pattern.items()) <= slack:
            kept.append((pattern, int(times)))
    return kept
