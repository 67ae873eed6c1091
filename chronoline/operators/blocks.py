"""Matching blocks of two sequences, as the standard library's matcher finds them without its popularity heuristic, by suffix automata or by bits.

The longest common block of two spans comes from one walk of the first over the automaton of the second, so a repeated word costs nothing; the library's own
search meets every pair of equal elements. Of short sequences all pairs of equal elements are the bits of one whole number instead, a row an element of the first:
a shift by a row and a place keeps the ends of blocks that are one longer. Ties are the same: the earliest block of the first span, then of the second.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: Up to so many pairs of elements bits are quicker.
FEW_PAIRS = 65536


def longest_block(a: Sequence[Hashable], b: Sequence[Hashable], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """(i, j, n) of the longest n with a[i:i+n] == b[j:j+n] inside the spans; n is 0 where nothing is equal."""
    # a state stands for the substrings of b that end at the same places; it keeps its longest one, the first such end and the state of the next shorter ends
    step: list[dict] = [{}]
    length, shorter, first = [0], [-1], [-1]
    last = 0
    for place in range(b0, b1):
        item = b[place]
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        first.append(place)
        shorter.append(0)
        at = last
        while at >= 0 and item not in step[at]:
            step[at][item] = new
            at = shorter[at]
        if at >= 0:
            to = step[at][item]
            if length[to] == length[at] + 1:
                shorter[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                first.append(first[to])
                shorter.append(shorter[to])
                while at >= 0 and step[at].get(item) == to:
                    step[at][item] = twin
                    at = shorter[at]
                shorter[to] = shorter[new] = twin
        last = new
    best = (a0, b0, 0)
    state = n = 0
    for place in range(a0, a1):
        item = a[place]
        while state > 0 and item not in step[state]:
            state = shorter[state]
            n = length[state]
        if item in step[state]:
            state, n = step[state][item], n + 1
        if n > best[2]:
            best = (place + 1 - n, first[state] + 1 - n, n)
    return best


def _blocks_by_bits(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """The blocks that longest_block finds one after the other, unordered."""
    size = len(b) // 8 + 1  # bytes a row, of which the last bit is never set
    width = 8 * size
    places: dict[Hashable, int] = {}
    for j, item in enumerate(b):
        places[item] = places.get(item, 0) | 1 << j
    equal = int.from_bytes(b"".join([places.get(item, 0).to_bytes(size, "little") for item in a]), "little")
    if not equal:
        return []
    every = int.from_bytes((b"\1" + bytes(size - 1)) * len(a), "little")  # the first bit of all rows
    found, open_ = [], [(0, len(a), 0, len(b), equal)]
    while open_:
        a0, a1, b0, b1, pairs = open_.pop()
        n, longer = 0, pairs
        while longer:
            ends, n = longer, n + 1
            longer = (longer << width + 1) & pairs
        i, j = divmod((ends & -ends).bit_length() - 1, width)
        i, j = a0 + i + 1 - n, j + 1 - n
        found.append((i, j, n))
        for x0, x1, y0, y1 in ((a0, i, b0, j), (i + n, a1, j + n, b1)):
            if x0 < x1 and y0 < y1:
                rows = (1 << (x1 - x0) * width) - 1
                inside = pairs >> (x0 - a0) * width & (every & rows) * ((1 << y1) - (1 << y0))
                if inside:
                    open_.append((x0, x1, y0, y1, inside))
    return found


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """All blocks in order: the longest one, and those of the spans before and behind it; touching ones joined."""
    few = len(a) * len(b) <= FEW_PAIRS
    found, open_ = (_blocks_by_bits(a, b), []) if few else ([], [(0, len(a), 0, len(b))])
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = longest_block(a, b, a0, a1, b0, b1)
        if n:
            found.append((i, j, n))
            open_ += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    joined: list[list[int]] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1][2] += n
        else:
            joined.append([i, j, n])
    return [tuple(x) for x in joined]


def opcodes(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """(tag, i0, i1, j0, j1) of equal, replaced, deleted and inserted spans, in order."""
    n = min(len(a), len(b))
    if n and a[:n] == b[:n]:  # the shorter one is the longest block, as early as can be
        rest = [("delete", n, len(a), n, n)] if len(a) > n else [("insert", n, n, n, len(b))] if len(b) > n else []
        return [("equal", 0, n, 0, n), *rest]
    out, i, j = [], 0, 0
    kinds = {(True, True): "replace", (True, False): "delete", (False, True): "insert"}
    for i1, j1, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if (gap := (i < i1, j < j1)) != (False, False):
            out.append((kinds[gap], i, i1, j, j1))
        if n:
            out.append(("equal", i1, i1 + n, j1, j1 + n))
        i, j = i1 + n, j1 + n
    return out
