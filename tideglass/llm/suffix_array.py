"""Two-stage suffix sorting in NumPy, and the repeated windows that adjacent common prefixes show."""

from __future__ import annotations

import numpy as np

_STEP = 7  # symbols of nine bits (byte, type) in one 63-bit key


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it sorts before the suffix one byte on; the last does not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    rises = np.append(text[change] < text[change + 1], False)
    return np.repeat(rises, np.diff(ends, prepend=-1))


def _keys(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    key = np.zeros(len(at), np.int64)
    for j in range(_STEP):
        key = (key << 9) | symbols[at + j]
    return key


def _sort_smaller(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that are smaller than their successors, in order (to depth bytes; ties stay in any order).

    Ranks by the first symbols are refined by doubling along jumps: equal keys of bytes with their types have
    their smaller suffixes at equal offsets, so the rank at the last of these stands for all that follows it.
    """
    n = len(text)
    at = np.flatnonzero(small)
    m = len(at)
    if not m:
        return at
    symbols = np.concatenate(((text.astype(np.int64) << 1) | small, np.zeros(_STEP * (depth // _STEP + 3), np.int64)))
    key = _keys(symbols, at)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    slots = np.arange(m)
    head = np.maximum.accumulate(np.where(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])), slots, 0))
    name = np.empty(m + 1, np.int64)
    name[order] = head
    name[m] = -1
    count_to = np.cumsum(small)  # smaller suffixes at or before each byte
    seen = np.full(m, _STEP)  # symbols compared so far
    following = np.append(at[1:], n + depth)

    def refine(open_slots: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Sort the members of still equal groups by a second key; returns the slots still open."""
        who = order[open_slots]
        by = np.lexsort((second, name[who]))
        who, second = who[by], second[by]
        old = name[who]
        fresh = np.concatenate(([True], (old[1:] != old[:-1]) | (second[1:] != second[:-1])))
        order[open_slots] = who
        name[who] = open_slots[np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        return open_slots[~alone]

    def still_open() -> np.ndarray:
        heads = name[order]
        first = heads == slots
        return np.flatnonzero(~(first & np.append(first[1:], True)))

    todo = still_open()
    while len(todo):  # groups whose key has met no further smaller suffix yet
        who = order[todo]
        far = (following[who] >= at[who] + seen[who]) & (seen[who] < depth + _STEP)
        todo = todo[far]
        if not len(todo):
            break
        who = order[todo]
        second = _keys(symbols, np.minimum(at[who] + seen[who], n))
        seen[who] += _STEP
        todo = refine(todo, second)
    last = np.minimum(at + seen - 1, n - 1)
    jump = count_to[last] - 1
    jump = np.append(np.where(jump > np.arange(m), jump, m), m)
    place = np.append(at, n + 4 * depth)
    todo = still_open()
    while True:
        who = order[todo]
        todo = todo[place[jump[who]] - at[who] < depth]
        if not len(todo):
            return at[order]
        todo = refine(todo, name[jump[order[todo]]])
        jump = jump[jump]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first depth bytes at least.

    Only suffixes smaller than their successors are sorted directly. The others follow from one scan over the
    buckets of first bytes, each bucket's suffixes putting those one byte before them into a later bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    direct = _sort_smaller(text, smaller_than_successor(text), depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = waiting[c]
        level = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        induced = [level]
        while len(level):  # runs of one byte induce inside their own bucket
            level = level[level > 0] - 1
            level = level[text[level] == c]
            induced.append(level)
        bucket = np.concatenate((*induced, direct[cut[c] : cut[c + 1]]))
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        before = before[np.argsort(first, kind="stable")]
        sizes = np.bincount(first, minlength=256)
        for b, piece in zip(np.flatnonzero(sizes), np.split(before, np.cumsum(sizes[sizes > 0])[:-1]) if len(before) else ()):
            waiting[b].append(piece)
    return np.concatenate(out)


def adjacent_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order and the one before it, up to most; the first has 0."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    eight = np.ascontiguousarray(eight[: n + most]).view(">u8").ravel() if n < 1 << 16 else _eights(padded)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    done = 0
    while len(live) and done < most:
        x = eight[order[live] + done] ^ eight[order[live - 1] + done]
        differ = x != 0
        ended = live[differ]
        out[ended] = done + _leading_zero_bytes(x[differ])
        live = live[~differ]
        done += 8
    out[live] = most
    return np.minimum(out, np.minimum(most, n - np.maximum(order, np.concatenate((order[:1], order[:-1])))))


def _eights(padded: np.ndarray) -> np.ndarray:
    out = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : len(padded) - 7 + j]
    return out


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    out = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        empty = (x >> np.uint64(64 - shift)) == 0
        out[empty] += shift // 8
        x = np.where(empty, x << np.uint64(shift), x)
    return out


def repeated_starts(text: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Valid starts whose width bytes also begin at another valid start (each has that many bytes left)."""
    order = suffix_array(text, width)
    order = order[valid[order]]
    match = adjacent_common_prefixes(text, order, width) >= width
    match[:1] = False
    return order[match | np.append(match[1:], False)] if len(order) else order
