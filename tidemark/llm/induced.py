"""Suffix sorting of a block by induction, with queues that spill to disk.

The suffixes that rise to their right and fall to their left (LMS) are a third of all or fewer. Their stretches up to the
next one are named in order, and the names are sorted as a text of their own (the recursion; it ends at once,
by doubling in memory, as a block's names fit). From their order all other suffixes follow: a scan in ascending
order puts each falling suffix into the queue of its first byte, one in descending order each rising one. A queue entry carries
the suffix and the length of its common prefix with the entry before it, which is one more than the least
common prefix met by the scan since then. Entries of a byte come out in the order they went in, so a queue per byte is the
priority queue; whole runs of it are handled at a time. What exceeds ``MEMORY`` lies in an unnamed file until it is asked for.

Common prefixes are counted up to ``cap`` bytes only: suffixes that share so many are neighbours in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries of the queues that stay in memory.
MEMORY = 8 << 20


class Queues:
    """For each byte a queue of (suffix, common prefix with the one before), in order of arrival."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file = memory, 0, None
        self.runs: list[list] = [[] for _ in range(256)]  # arrays, or (place in the file, entries)

    def push(self, byte: int, suffixes: np.ndarray, shared: np.ndarray) -> None:
        self.runs[byte].append((suffixes, shared))
        self.held += len(suffixes)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # the task's own; it has no name and goes with the task
        self.file.seek(0, 2)
        for runs in self.runs:
            for k, (a, b) in enumerate(runs):
                if not isinstance(a, int):
                    at = self.file.tell()
                    self.file.write(a.astype(np.int64).tobytes() + b.astype(np.int16).tobytes())
                    runs[k] = (at, len(a))
        self.held = 0

    def take(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a byte's queue, which is empty then."""
        parts = []
        for a, b in self.runs[byte]:
            if isinstance(a, int):
                self.file.seek(a)
                data = self.file.read(10 * b)
                a, b = np.frombuffer(data, np.int64, b), np.frombuffer(data, np.int16, b, 8 * b)
            else:
                self.held -= len(a)
            parts.append((a, b))
        self.runs[byte] = []
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int16)
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def rising(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one behind it; the last suffix is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    place = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0  # equal bytes are as what follows them


def _names(text: np.ndarray, up: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Numbers of the stretches from each LMS suffix to the next, in their order, equal ones alike."""
    ends = np.append(lms[1:], len(text) - 1)
    sizes = ends - lms + 1
    signs = text.astype(np.uint64) * np.uint64(2) + up + np.uint64(1)  # nine bits and a bit; 0 is beyond the end
    name = np.zeros(len(lms), np.int64)
    for at in range(0, int(sizes.max()), 6):
        word = np.zeros(len(lms), np.uint64)
        for j in range(at, at + 6):
            inside = sizes > j
            word = word << np.uint64(10) | np.where(inside, signs[np.minimum(lms + j, len(text) - 1)], np.uint64(0))
        longer = sizes > at  # the others' words are all zero, and their names stay apart as they ended before
        if at and not longer.any():
            break
        order = np.lexsort((word, name))
        new = np.concatenate([[True], (np.diff(name[order]) != 0) | (np.diff(word[order].view(np.int64)) != 0)])
        fresh = np.empty(len(lms), np.int64)
        fresh[order] = np.cumsum(new) - 1
        name = fresh
        if name.max() == len(lms) - 1:
            break
    return name


def _sorted_names(name: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes of the text of names, as far as ``cap`` bytes tell: a name stands for two bytes at least."""
    rank, step = name, 1
    while rank.max() < len(rank) - 1 and 2 * step < cap + 2:
        behind = np.append(rank[step:], np.full(min(step, len(rank)), -1))[: len(rank)]
        key = rank * (len(rank) + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
    return np.argsort(rank, kind="stable")


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes, up to ``cap``."""
    n, out = len(text), np.full(len(a), cap, np.int16)
    left = np.arange(len(a))
    for at in range(cap):
        x, y = a[left] + at, b[left] + at
        inside = np.maximum(x, y) < n
        same = inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        out[left[~same]] = at
        left = left[same]
        if not len(left):
            break
    return out


class _Scan:
    """Sends suffixes on as they are scanned, with the common prefixes that their queues need."""

    def __init__(self, text: np.ndarray, sent: np.ndarray, queues: Queues, cap: int):
        self.text, self.sent, self.queues, self.cap = text, sent, queues, cap
        self.least = np.full(256, -1, np.int64)  # since each byte's last entry; -1: it has none

    def run(self, suffixes: np.ndarray, shared: np.ndarray) -> None:
        """Scan suffixes in order; ``shared`` is each one's common prefix with that scanned before it."""
        if not len(suffixes):
            return
        shared = shared.astype(np.int64)
        at = np.flatnonzero((suffixes > 0) & self.sent[suffixes - 1])
        before = suffixes[at] - 1
        byte = self.text[before]
        order = np.argsort(byte, kind="stable")
        at, before, byte = at[order], before[order], byte[order]
        whole = np.append(shared, self.cap)
        new = np.concatenate([[True], byte[1:] != byte[:-1]]) if len(byte) else np.empty(0, bool)
        begin = np.where(new, 0, np.append(0, at[:-1] + 1)) if len(at) else at
        least = np.minimum.reduceat(whole, np.stack([begin, at + 1], axis=1).ravel())[::2] if len(at) else at
        first = np.flatnonzero(new)
        least[first] = np.minimum(least[first], self.least[byte[first]])
        self.least = np.where(self.least < 0, self.least, np.minimum(self.least, shared.min()))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
            d, last = int(byte[a]), int(at[b - 1])
            self.queues.push(d, before[a:b], np.minimum(least[a:b] + 1, self.cap).astype(np.int16))
            self.least[d] = whole[last + 1 :].min()


def suffix_order(text: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common prefix of each with the one before) of a text of bytes, ordered by their first ``cap`` bytes at least."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int16)
    up = rising(text)
    lms = np.flatnonzero(up & ~np.concatenate([[True], up[:-1]]))
    seeds, seed_shared = lms, np.zeros(len(lms), np.int16)
    if len(lms):
        seeds = lms[_sorted_names(_names(text, up, lms), cap)]
        seed_shared = np.concatenate([np.zeros(1, np.int16), _common(text, seeds[:-1], seeds[1:], cap)])
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    equal = np.minimum(np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n), cap)  # bytes alike from here on
    seam = lambda a, b: np.minimum(equal[a], equal[b])  # noqa: E731 - falling and rising suffixes of a byte part where their runs of it end
    seed_cut = np.searchsorted(text[seeds], np.arange(257))

    falling, scan_in = Queues(memory), Queues(memory)
    scan = _Scan(text, ~up, scan_in, cap)
    scan_in.push(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.int16))
    scan.least[text[n - 1]] = 0  # nothing is shared with what comes before a byte's second entry's source here
    for c in range(256):
        last = None
        while True:
            suffixes, shared = scan_in.take(c)
            if not len(suffixes):
                break
            scan.run(suffixes, shared)
            falling.push(c, suffixes, shared)
            last = int(suffixes[-1])
        a, b = seed_cut[c], seed_cut[c + 1]
        if a < b:
            shared = seed_shared[a:b].copy()
            shared[0] = 0 if last is None else seam(last, seeds[a])
            scan.run(seeds[a:b], shared)
    rise_in = Queues(memory)
    scan = _Scan(text, up, rise_in, cap)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(255, -1, -1):
        rose, last = [], None
        while True:
            suffixes, shared = rise_in.take(c)
            if not len(suffixes):
                break
            scan.run(suffixes, shared)
            rose.append((suffixes, shared))
            last = int(suffixes[-1])
        suffixes, shared = falling.take(c)
        fell = suffixes[::-1]
        if len(fell):
            scan.run(fell, np.concatenate([[0 if last is None else seam(last, fell[0])], shared[1:][::-1]]))
        if rose:
            s, d = np.concatenate([x for x, _ in rose])[::-1], np.concatenate([x for _, x in rose])
            d = np.append(d[1:], 0)[::-1].copy()  # towards the smaller neighbour
            d[0] = seam(suffixes[-1], s[0]) if len(suffixes) else 0
            out.append((s, d))
        out.append((suffixes, shared))
    out.reverse()
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]).astype(np.int16)


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int, memory: int = MEMORY) -> np.ndarray:
    """Those of the starts whose ``length`` bytes equal another's; each start has so many bytes behind it."""
    order, shared = suffix_order(text, length, memory)
    wanted = np.zeros(len(text) + 1, bool)
    wanted[starts] = True
    group = np.cumsum(shared < length)
    own = wanted[order]
    company = np.bincount(group[own], minlength=group[-1] + 1 if len(group) else 1) > 1
    return order[own & company[group]]
