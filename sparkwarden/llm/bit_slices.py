"""Distances of many 64-bit fingerprints at once, from vertical bit planes.

Plane k holds bit k of every fingerprint, 64 fingerprints to a word. Comparing each
fingerprint with the one ``shift`` places on is then an exclusive or of a plane with
its shifted self; carry-save counters add the 64 difference planes for all lanes
together. Words whose lanes all exceed the radius leave the count early.
"""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
CHECK_EVERY = 8  # planes between two looks at what can be abandoned


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) planes; lane i is bit i % 64 of word i // 64, the last word is padded."""
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _shifted(planes: np.ndarray, shift: int) -> np.ndarray:
    """Planes whose lane i is the old lane i + shift."""
    words, bits = divmod(shift, 64)
    moved = np.zeros_like(planes)
    if words < planes.shape[1]:
        moved[:, : planes.shape[1] - words] = planes[:, words:]
    if bits:
        upper = np.zeros_like(moved)
        upper[:, :-1] = moved[:, 1:] << np.uint64(64 - bits)
        moved = (moved >> np.uint64(bits)) | upper
    return moved


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``."""
    greater, equal = over.copy(), np.full_like(over, ALL)
    for bit in reversed(range(len(counters))):
        if radius >> bit & 1:
            equal &= counters[bit]
        else:
            greater |= equal & counters[bit]
            equal &= ~counters[bit]
    return greater


def within(planes: np.ndarray, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i (of the ``wanted`` bit mask) with distance(i, i + shift) <= radius."""
    live = np.flatnonzero(wanted)
    if not len(live):
        return live
    differ = (planes ^ _shifted(planes, shift))[:, live]
    counters = [np.zeros(len(live), dtype="<u8") for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(live), dtype="<u8")
    mask = wanted[live]
    for k in range(64):
        carry = differ[k]
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        over |= carry
        if k % CHECK_EVERY == CHECK_EVERY - 1:
            mask = mask & ~_exceeds(counters, over, radius)
            stay = mask != 0
            if not stay.all():
                live, mask, over = live[stay], mask[stay], over[stay]
                counters = [c[stay] for c in counters]
                differ = differ[:, stay]
                if not len(live):
                    return live
    bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(bits)
    return live[word] * 64 + lane


def linked_roots(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of its root: fingerprints of one group (``groups``
    is sorted) that are connected by steps of at most ``radius`` bits share it."""
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent
    planes = bit_planes(values)
    words = planes.shape[1]
    _, sizes = np.unique(groups, return_counts=True)
    for shift in range(1, int(sizes.max())):
        together = np.zeros(words * 64, dtype=np.uint8)
        together[: n - shift] = groups[shift:] == groups[: n - shift]
        wanted = np.packbits(together, bitorder="little").view("<u8")
        lanes = within(planes, shift, wanted, radius)
        lanes = lanes[parent[lanes] != parent[lanes + shift]]
        if not len(lanes):
            continue
        for lane in lanes.tolist():
            a, b = lane, lane + shift
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    return parent
