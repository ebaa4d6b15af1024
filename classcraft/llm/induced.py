"""Suffix order and common prefixes of one shard by external induced sorting.

The order of all suffixes is induced from the order of the few that start a left-most S-run (LMS), whose own
order comes from the same procedure on the shortened text of their names, recursively, until that text fits
in memory. Two scans induce the rest: ascending for the L-suffixes, descending for the S-suffixes. A scan
takes the tuples (position, common prefix with the one before) in rank order from a priority queue with
one first-in-first-out lane for each leading character, and puts each preceding suffix at the end of its
own lane. Tuples of one lane come in rank order, so the lanes stay sorted and the queue needs no comparison. Beyond
``memory`` tuples the lanes' contents go to an unnamed scratch file that the system drops with the task, as
Spark's own sorters spill. Only the lanes do: the text, the LMS order, the names and the caller's shard stay in memory, so
a shard must fit there.

Common prefixes ride along: a suffix induced from the source at rank r shares one character more with its
neighbour than the least value among the sources since the neighbour's. Only the seam of L- and S-suffixes in a
lane and neighbouring LMS suffixes are compared in the text, up to ``limit`` characters.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

ITEM = np.dtype([("pos", "<i8"), ("lcp", "<i4")])
FAR = np.int32(1 << 30)
CHUNK = 1 << 18
PAIR_BYTES = 1 << 19  # characters of pairs compared at once


class Lanes:
    """A priority queue by character: lanes of tuples in rank order, on disk beyond ``memory`` tuples."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: dict[int, list] = {}   # lane -> arrays, or (offset, length) in the file
        self.read: dict[int, int] = {}     # lane -> parts taken so far
        self.heap: list[int] = []

    def push(self, lane: int, items: np.ndarray, order: int = 1) -> None:
        if lane not in self.parts:
            self.parts[lane], self.read[lane] = [], 0
            heapq.heappush(self.heap, lane * order)
        self.parts[lane].append(items)
        self.held += len(items)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    at = self.file.tell()
                    self.file.write(part.tobytes())
                    parts[i] = (at, len(part))
        self.held = 0

    def _load(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(part[1] * ITEM.itemsize), ITEM)

    def take(self, lane: int) -> np.ndarray | None:
        """The next tuples of a lane, at most about CHUNK; they stay stored for `lane_forward` and `lane_backward`."""
        parts, at = self.parts.get(lane, []), self.read.get(lane, 0)
        found, size = [], 0
        while at < len(parts) and size < CHUNK:
            found.append(self._load(parts[at]))
            size += len(found[-1])
            at += 1
        self.read[lane] = at
        return (found[0] if len(found) == 1 else np.concatenate(found)) if found else None

    def _gather(self, parts) -> Iterator[np.ndarray]:
        found, size = [], 0
        for part in parts:
            found.append(self._load(part))
            size += len(found[-1])
            if size >= CHUNK:
                yield np.concatenate(found)
                found, size = [], 0
        if found:
            yield np.concatenate(found)

    def lane_forward(self, lane: int) -> Iterator[np.ndarray]:
        return self._gather(self.parts.get(lane, []))

    def last(self, lane: int):
        return self._load(self.parts[lane][-1])[-1]

    def lane_backward(self, lane: int) -> Iterator[np.ndarray]:
        """Tuples in falling rank; each common prefix is then the one with the tuple yielded before (the first: 0)."""
        carry = np.int32(0)
        parts, group, size = self.parts.get(lane, []), [], 0

        def turned(group):
            nonlocal carry
            items = np.concatenate([self._load(x) for x in reversed(group)])
            out = items[::-1].copy()
            out["lcp"][1:] = items["lcp"][:0:-1]
            out["lcp"][0] = carry
            carry = items["lcp"][0]
            return out

        for part in reversed(parts):
            group.append(part)
            size += len(part) if isinstance(part, np.ndarray) else part[1]
            if size >= CHUNK:
                yield turned(group)
                group, size = [], 0
        if group:
            yield turned(group)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True for S-suffixes (smaller than the next suffix); block by block from the right."""
    n = len(text)
    out = np.zeros(n, bool)
    after_char, after_type = -1, False
    for stop in range(n, 0, -(CHUNK * 4)):
        start = max(0, stop - CHUNK * 4)
        block = text[start:stop].astype(np.int64)
        following = np.append(block[1:], after_char)
        differs = block != following
        if stop == n:
            differs[-1] = True
        index = np.where(differs, np.arange(len(block)), len(block))
        index = np.minimum.accumulate(index[::-1])[::-1]
        smaller = np.append(block < following, after_type)
        out[start:stop] = smaller[index]
        after_char, after_type = int(block[0]), bool(out[start])
    return out


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix length of the suffixes at a and b, at most ``limit``; steps double while pairs agree."""
    n, out = len(text), np.zeros(len(a), np.int32)
    alive = np.arange(len(a))
    step = 8
    while len(alive) and limit > 0:
        grid = np.arange(step)
        still = []
        for part in np.array_split(alive, max(1, len(alive) * step // PAIR_BYTES)):
            x, y = a[part][:, None] + out[part][:, None] + grid, b[part][:, None] + out[part][:, None] + grid
            same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (x < n) & (y < n)
            run = np.where(same.all(axis=1), step, np.argmin(same, axis=1)).astype(np.int32)
            out[part] += run
            still.append(part[(run == step) & (out[part] < limit)])
        alive = np.concatenate(still)
        step = min(step * 2, 64)
    return np.minimum(out, limit)


class _Induction:
    """One ascending and one descending scan over ``text``."""

    def __init__(self, text, stype, memory, limit):
        self.text, self.stype, self.memory, self.limit = text, stype, memory, limit
        self.bytes = text.dtype == np.uint8

    def _induce(self, lanes, items, is_l: bool, lane: int, low: dict, order: int, with_lcp: bool) -> None:
        """Push the preceding suffixes of ``items``: L-suffixes in the ascending scan (order 1), S-suffixes in the other."""
        pos, lcp = items["pos"], items["lcp"]
        before = self.text[np.maximum(pos - 1, 0)].astype(np.int64)
        if order == 1:
            go = (before > lane) | ((before == lane) & is_l)
        else:
            go = (before < lane) | ((before == lane) & (not is_l))
        at = np.flatnonzero(go & (pos > 0))
        least = int(lcp.min()) if with_lcp and len(lcp) else 0
        targets = before[at]
        # Lanes that get nothing from these sources still remember the least value they passed.
        if len(at) == 0:
            if with_lcp:
                for c in low:
                    low[c] = min(low[c], least)
            return
        sort = np.argsort(targets.astype(np.uint8) if self.bytes else targets, kind="stable")
        at, targets = at[sort], targets[sort]
        cuts = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        ends = np.append(cuts[1:], len(at))
        touched = set()
        for s, e in zip(cuts.tolist(), ends.tolist()):
            c, mine = int(targets[s]), at[s:e]
            new = np.empty(e - s, ITEM)
            new["pos"] = pos[mine] - 1
            if with_lcp:
                touched.add(c)
                starts = np.concatenate([[0], mine + 1])
                open_end = starts[-1] < len(lcp)
                mins = np.minimum.reduceat(lcp, starts if open_end else starts[:-1])
                first = min(int(mins[0]), low[c]) + 1 if c in low else 0
                new["lcp"] = np.minimum(mins[:e - s] + 1, self.limit)
                new["lcp"][0] = min(first, self.limit)
                low[c] = int(mins[-1]) if open_end else int(FAR)
            else:
                new["lcp"] = 0
            lanes.push(c, new, order)
        if with_lcp:
            for c in low:
                if c not in touched:
                    low[c] = min(low[c], least)

    def _seam(self, a: int, b: int) -> int:
        return int(shared_prefix(self.text, np.array([a]), np.array([b]), self.limit)[0])

    def run(self, seeds: Lanes, with_lcp: bool) -> Iterator[np.ndarray]:
        """Yield all suffixes in falling order, each with the common prefix with the one yielded before."""
        n = len(self.text)
        up, low = Lanes(self.memory), {}
        up.push(int(self.text[n - 1]), np.array([(n - 1, 0)], ITEM))
        if with_lcp:
            low[int(self.text[n - 1])] = int(FAR)
        lanes_left = sorted(seeds.parts, reverse=True)
        while up.heap or lanes_left:
            lane = min(up.heap[0] if up.heap else lanes_left[-1], lanes_left[-1] if lanes_left else up.heap[0])
            if up.heap and up.heap[0] == lane:
                heapq.heappop(up.heap)
            fresh = True
            while (items := up.take(lane)) is not None:
                if fresh and with_lcp:
                    items = items.copy()
                    items["lcp"][0] = 0
                    fresh = False
                self._induce(up, items, True, lane, low, 1, with_lcp)
            if lanes_left and lanes_left[-1] == lane:
                lanes_left.pop()
                first = True
                for items in seeds.lane_forward(lane):
                    if first and with_lcp:
                        items = items.copy()
                        items["lcp"][0] = self._seam(int(up.last(lane)["pos"]), int(items["pos"][0])) if lane in up.parts else 0
                    first = False
                    self._induce(up, items, False, lane, low, 1, with_lcp)
        down, low = Lanes(self.memory), {}
        l_left = sorted(up.parts)
        while down.heap or l_left:
            lane = max(-down.heap[0] if down.heap else l_left[-1], l_left[-1] if l_left else -down.heap[0])
            had = False
            if down.heap and -down.heap[0] == lane:
                heapq.heappop(down.heap)
                while (items := down.take(lane)) is not None:
                    if not had:
                        items = items.copy()
                        items["lcp"][0] = 0
                        had = True
                    self._induce(down, items, False, lane, low, -1, with_lcp)
                    yield items
            if l_left and l_left[-1] == lane:
                l_left.pop()
                first = True
                for items in up.lane_backward(lane):
                    if first:
                        items["lcp"][0] = (self._seam(int(down.last(lane)["pos"]), int(items["pos"][0]))
                                           if had and with_lcp else 0)
                        first = False
                    self._induce(down, items, True, lane, low, -1, with_lcp)
                    yield items
        up.close()
        down.close()


def _seed_lanes(text, ordered: np.ndarray, lcp: np.ndarray | None, memory: int) -> Lanes:
    """LMS positions in the given order, dealt to lanes by their first character."""
    seeds = Lanes(memory)
    for at in range(0, len(ordered), CHUNK):
        pos = ordered[at:at + CHUNK]
        chars = text[pos]
        sort = np.argsort(chars, kind="stable")
        items = np.zeros(len(pos), ITEM)
        items["pos"] = pos[sort]
        if lcp is not None:
            items["lcp"] = lcp[at:at + CHUNK][sort]
        chars = chars[sort]
        cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]])).tolist() + [len(pos)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            seeds.push(int(chars[s]), items[s:e])
    return seeds


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a text that fits in memory: prefix doubling, sorting only what is still tied."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    fresh = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    width = 1
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # places in the order
    while len(tied):
        pos = order[tied]
        ahead = pos + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[pos]
        sort = np.lexsort((second, group))
        pos, second, group = pos[sort], second[sort], group[sort]
        order[tied] = pos  # groups keep their places, which are in rising order
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        new_rank = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[pos] = new_rank
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


def _lms(stype: np.ndarray) -> np.ndarray:
    return np.flatnonzero(stype[1:] & ~stype[:-1]) + 1


def _sorted_lms(text: np.ndarray, stype: np.ndarray, lms: np.ndarray, memory: int) -> np.ndarray:
    """LMS positions in suffix order: sort their substrings by induction, name them, solve the named text."""
    if len(lms) < 2:
        return lms
    rising = []
    for items in _Induction(text, stype, memory, 0).run(_seed_lanes(text, lms, None, memory), False):
        pos = items["pos"]
        rising.append(pos[stype[pos] & (pos > 0) & ~stype[np.maximum(pos - 1, 0)]])
    ordered = np.concatenate(rising)[::-1]
    del rising
    length = np.empty(len(lms), np.int64)  # of the substring up to the next LMS position, included
    length[:-1] = lms[1:] - lms[:-1] + 1
    length[-1] = len(text) - lms[-1] + 1
    index = np.searchsorted(lms, ordered)
    a, b, size = ordered[:-1], ordered[1:], length[index]
    same_size = size[:-1] == size[1:]
    same = np.zeros(len(a), bool)
    # The last substring ends with the text, so equal lengths of it and another are not equal substrings.
    check = np.flatnonzero(same_size & (index[:-1] != len(lms) - 1) & (index[1:] != len(lms) - 1))
    for part in np.array_split(check, max(1, len(check) // CHUNK)):
        if len(part):
            same[part] = shared_prefix(text, a[part], b[part], int(size[part].max())) >= size[part]
    names = np.empty(len(lms), np.int64)
    names[index] = np.concatenate([[0], np.cumsum(~same)])
    if same.any():
        return lms[suffix_order(names, memory)]
    return ordered


def suffix_order(text: np.ndarray, memory: int) -> np.ndarray:
    """Order of all suffixes of an integer text; in memory if it fits, else induced from its LMS suffixes."""
    if len(text) <= memory:
        return _doubled(text)
    stype = _types(text)
    lms = _lms(stype)
    seeds = _seed_lanes(text, _sorted_lms(text, stype, lms, memory), None, memory)
    return np.concatenate([x["pos"] for x in _Induction(text, stype, memory, 0).run(seeds, False)])[::-1]


def falling_suffixes(text: np.ndarray, limit: int, memory: int) -> Iterator[np.ndarray]:
    """Chunks of (pos, lcp) over all suffixes of a byte text, in falling order.

    ``lcp`` is the common prefix with the suffix yielded before, at most ``limit``.
    """
    if not len(text):
        return
    stype = _types(text)
    ordered = _sorted_lms(text, stype, _lms(stype), memory)
    lcp = np.zeros(len(ordered), np.int32)
    for at in range(1, len(ordered), CHUNK):
        stop = min(at + CHUNK, len(ordered))
        lcp[at:stop] = shared_prefix(text, ordered[at - 1:stop - 1], ordered[at:stop], limit)
    yield from _Induction(text, stype, memory, limit).run(_seed_lanes(text, ordered, lcp, memory), True)
