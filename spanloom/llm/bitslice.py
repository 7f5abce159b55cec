"""Bit-sliced Hamming comparison of 64-bit fingerprints inside blocks."""

from __future__ import annotations

import numpy as np

LANES = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def planes_of(fingerprints: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertical bit planes of consecutive blocks.

    Every block is padded to whole words of 64 lanes. Gives the planes (64 x words), the mask of
    the lanes in use, and the first word of each block (with the total at the end).
    """
    sizes = np.diff(np.append(starts, len(fingerprints)))
    words = (sizes + LANES - 1) // LANES
    first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    block = np.repeat(np.arange(len(starts)), sizes)
    slot = np.arange(len(fingerprints)) - starts[block] + first[block] * LANES
    flat = np.zeros(first[-1] * LANES, np.uint64)
    flat[slot] = fingerprints
    used = np.zeros(first[-1] * LANES, np.uint8)
    used[slot] = 1
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane x bit
    planes = np.packbits(bits.reshape(-1, LANES, 64).transpose(2, 0, 1), axis=2, bitorder="little")
    return (np.ascontiguousarray(planes).view(np.uint64)[:, :, 0],
            np.packbits(used.reshape(-1, LANES), axis=1, bitorder="little").view(np.uint64)[:, 0], first)


def near(queries: np.ndarray, word: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int = 3,
         step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """For each (query, word) the lanes of the word within `radius` bits of the query.

    A carry-save counter of as many bit planes as the radius has digits, and an overflow plane, count 64 distances at
    once, one plane of the fingerprints at a time; after every 8 planes the words in which every lane has
    passed the radius are abandoned. Gives the indices of the words left and their lane masks.
    """
    digits = max(1, int(radius).bit_length())
    found_at, found = [], []
    for low in range(0, len(queries), step):
        at = np.arange(low, min(low + step, len(queries)))
        q, w = queries[at], word[at]
        counts = [np.zeros(len(at), np.uint64) for _ in range(digits)]
        over = ~used[w]
        for k in range(64):
            carry = planes[k][w] ^ (np.uint64(0) - ((q >> np.uint64(k)) & _ONE))
            for d in range(digits):
                counts[d], carry = counts[d] ^ carry, counts[d] & carry
            over |= carry
            if k % 8 == 7:
                live = (over | beyond(counts, radius)) != _ALL
                if not live.all():
                    at, q, w, over = (v[live] for v in (at, q, w, over))
                    counts = [c[live] for c in counts]
                    if not len(at):
                        break
        lanes = ~(over | beyond(counts, radius))
        found_at.append(at[lanes != 0])
        found.append(lanes[lanes != 0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_at), np.concatenate(found)


def beyond(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, one bit plane for each digit, is over the radius."""
    more, same = np.zeros_like(counts[0]), np.full_like(counts[0], _ALL)
    for d in range(len(counts) - 1, -1, -1):
        if radius >> d & 1:
            same = same & counts[d]
        else:
            more |= same & counts[d]
            same = same & ~counts[d]
    return more


def crossing(first: np.ndarray, second: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of first, j of second) whose fingerprints are within the radius."""
    planes, used, words = planes_of(second, np.array([0]))
    query, word = np.repeat(np.arange(len(first)), words[-1]), np.tile(np.arange(words[-1]), len(first))
    at, lanes = near(first[query], word, planes, used, radius)
    hit = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(hit)
    return query[at][row], word[at][row] * LANES + lane


def linked(fingerprints: np.ndarray, starts: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each block, as a spanning forest: index pairs (member, root of its tree).

    Members of one tree are joined by chains of pairs within the radius; a block of m fingerprints
    gives m - 1 links at most, however many of its pairs are close.
    """
    planes, used, first = planes_of(fingerprints, starts)
    sizes = np.diff(np.append(starts, len(fingerprints)))
    words = np.diff(first)
    block = np.repeat(np.arange(len(starts)), sizes)
    query = np.repeat(np.arange(len(fingerprints)), words[block])
    offset = np.arange(len(query)) - np.repeat(np.cumsum(words[block]) - words[block], words[block])
    word = first[block[query]] + offset
    at, lanes = near(fingerprints[query], word, planes, used, radius)
    q, base = query[at], (word[at] - first[block[query[at]]]) * LANES
    self_bit = (q - starts[block[q]]) - base
    own = (self_bit >= 0) & (self_bit < LANES)
    lanes[own] &= ~(_ONE << self_bit[own].astype(np.uint64))
    keep = lanes != 0
    q, base, lanes = q[keep], base[keep], lanes[keep]
    members, roots = [], []
    order = np.argsort(q, kind="stable")
    q, base, lanes = q[order], base[order], lanes[order]
    for b in np.unique(block[q]):
        lo, hi = np.searchsorted(q, [starts[b], starts[b] + sizes[b]])
        links = np.zeros((sizes[b], words[b]), np.uint64)
        links[q[lo:hi] - starts[b], base[lo:hi] // LANES] = lanes[lo:hi]
        left = np.ones(sizes[b], bool)
        for root in np.unique(q[lo:hi] - starts[b]):
            if not left[root]:
                continue
            left[root] = False
            front = np.array([root])
            while len(front):
                reach = np.bitwise_or.reduce(links[front], axis=0)
                hit = np.unpackbits(reach.view(np.uint8), bitorder="little")[: sizes[b]].astype(bool) & left
                front = np.flatnonzero(hit)
                left[front] = False
                members.append(front + starts[b])
                roots.append(np.full(len(front), root + starts[b]))
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)
