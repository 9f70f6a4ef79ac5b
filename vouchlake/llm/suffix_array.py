"""External induced sorting of the suffixes of a shard with their common prefixes, up to a depth.

Suffixes are typed S or L; the leftmost-S (LMS) substrings are sorted and named by one induction, the reduced
text of names is sorted by recursion, and a second induction orders all suffixes and carries common prefixes along.
Queues hold tuples (position, common prefix with the entry before) and go to disk above a memory bound, as do the
text and its types. Over bytes there is a queue for each byte: entries come in the order of their ranks, so first in,
first out is the priority (byte, rank). Over names the queue is a heap with sorted runs on disk. A reduced text that
fits into the bound ends the recursion; it is sorted by doubling in memory.

Scratch files belong to one task: they lie where Spark spills, have no name and end with the task.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that are worked on at once, and that queues, text and names keep in memory each.
STEP, MEMORY = 1 << 18, 1 << 21
#: Tuples of a batch that are taken one by one.
FEW = 12


def _scratch():
    """An unnamed file in the first folder in which Spark spills, if it names one."""
    return tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)


def _kept(values: np.ndarray, memory: int) -> np.ndarray:
    """The values, on disk if there are more than ``memory`` of them."""
    if len(values) <= memory:
        return values
    file = _scratch()
    out = np.memmap(file, values.dtype, "w+", shape=values.shape)
    for a in range(0, len(values), STEP):
        out[a : a + STEP] = values[a : a + STEP]
    return out


class _Queues:
    """A first-in-first-out queue of tuples (position, common prefix) for each of 256 bytes, on disk where memory is full."""

    def __init__(self, memory: int):
        self.parts: list[list] = [[] for _ in range(256)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, byte: int, positions: np.ndarray, common: np.ndarray) -> None:
        if self.held + len(positions) > self.memory:
            self.file = self.file or _scratch()
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes() + common.tobytes())
            self.parts[byte].append((at, len(positions)))
        else:
            self.held += len(positions)
            self.parts[byte].append((positions, common))

    def read(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(part[1] * 8), np.int64), np.frombuffer(self.file.read(part[1]), np.uint8)

    @staticmethod
    def size(part) -> int:
        return len(part[0]) if isinstance(part[0], np.ndarray) else part[1]

    def drain(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Everything in a queue in order, also what comes in meanwhile; small parts are joined."""
        i, parts = 0, self.parts[byte]
        while i < len(parts):
            held, size = [], 0
            while i < len(parts) and (not held or size + self.size(parts[i]) <= STEP):
                size += self.size(parts[i])
                held.append(self.read(parts[i]))
                i += 1
            whole = [np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held, strict=True)]
            for a in range(0, size, STEP):
                yield whole[0][a : a + STEP], whole[1][a : a + STEP]

    def backwards(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A queue from its end."""
        for part in reversed(self.parts[byte]):
            positions, common = self.read(part)
            for a in range(len(positions), 0, -STEP):
                yield positions[max(0, a - STEP) : a][::-1], common[max(0, a - STEP) : a][::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Heap:
    """The priority queue of (key, rank, position): a heap, and sorted runs on disk where memory is full."""

    def __init__(self, memory: int):
        self.memory, self.heap, self.file, self.heads = max(memory, 2), [], None, []

    def push(self, item: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self.file = self.file or _scratch()
            at, n = self.file.seek(0, 2), len(self.heap)
            self.file.write(np.array(sorted(self.heap), np.int64).tobytes())
            self.heap.clear()
            run = self._run(at, n)
            heapq.heappush(self.heads, (next(run), len(self.heads), run))

    def _run(self, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        for k in range(0, n, 4096):
            self.file.seek(at + 24 * k)
            yield from map(tuple, np.frombuffer(self.file.read(24 * min(4096, n - k)), np.int64).reshape(-1, 3).tolist())

    def least(self) -> tuple[int, int, int] | None:
        best = self.heap[0] if self.heap else None
        return self.heads[0][0] if self.heads and (best is None or self.heads[0][0] < best) else best

    def pop(self) -> tuple[int, int, int]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, k, run = self.heads[0]
            after = next(run, None)
            if after is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (after, k, run))
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type S). The end of the text is smaller than any sign."""
    out, small = np.zeros(len(text), bool), False
    for b in range(len(text) - 1, 0, -STEP):  # from the end: places a to b - 1 are compared with the next ones
        a = max(0, b - STEP)
        here, nxt = text[a:b], text[a + 1 : b + 1]
        decided, less = here != nxt, here < nxt
        at = np.where(decided, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[a:b] = np.where(at < b - a, less[np.minimum(at, b - a - 1)], small)
        small = bool(out[a])
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of suffixes a and b, ``depth`` at most."""
    out, near = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(depth):
        near = near[np.maximum(a[near], b[near]) + k < len(text)]
        near = near[text[a[near] + k] == text[b[near] + k]]
        if not len(near):
            break
        out[near] = k + 1
    return out.astype(np.uint8)


class _Carry:
    """Common prefixes of induced tuples: one more than the least among the tuples scanned since the bucket's last entry."""

    def __init__(self, depth: int):
        self.depth, self.since = depth, np.full(256, -1)  # -1: the bucket is empty

    def one(self, common: int, bucket: int | None) -> int:
        """As :meth:`take`, for one tuple that is scanned, and the bucket of what it induces, if it does."""
        np.minimum(self.since, common, out=self.since)  # an empty bucket's -1 stays
        if bucket is None:
            return 0
        before, self.since[bucket] = int(self.since[bucket]), self.depth
        return 0 if before < 0 else min(before + 1, self.depth)

    def take(self, common: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """For a batch of scanned tuples, of which those ``at`` induce one in ``bucket``: the common prefixes of these."""
        rows, k = [common], 1
        while 2 * k <= len(common):
            rows.append(np.minimum(rows[-1][:-k], rows[-1][k:]))
            k *= 2

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The least of places a to b, both included."""
            level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            out = np.zeros(len(a), np.int64)
            for r in np.unique(level).tolist():
                i = np.flatnonzero(level == r)
                out[i] = np.minimum(rows[r][a[i]], rows[r][b[i] - (1 << r) + 1])
            return out

        order = np.argsort(bucket, kind="stable")
        place, own = at[order], bucket[order]
        first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
        new = np.zeros(len(own), np.int64)
        again = np.flatnonzero(~first)
        new[again] = least(place[again - 1] + 1, place[again]) + 1
        head = np.flatnonzero(first)
        from_start = least(np.zeros(len(head), np.int64), place[head])
        new[head] = np.where(self.since[own[head]] < 0, 0, np.minimum(self.since[own[head]], from_start) + 1)
        whole = int(common.min())
        np.minimum(self.since, whole, out=self.since)
        last = np.r_[head[1:] - 1, len(own) - 1] if len(head) else head
        behind = place[last] + 1 < len(common)
        self.since[own[last]] = self.depth
        self.since[own[last[behind]]] = least(place[last[behind]] + 1, np.full(behind.sum(), len(common) - 1))
        out = np.zeros(len(own), np.int64)
        out[order] = np.minimum(new, self.depth)
        return out.astype(np.uint8)


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, memory: int, depth: int = 0, seed_common: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order, in batches, from LMS suffixes ``seeds`` in order (up to the depth to which these are sorted); with the seeds' common prefixes, also those of all, up to ``depth``."""
    n, carry = len(text), seed_common is not None
    first = text[seeds]
    order = np.argsort(first, kind="stable")
    seeds, first = seeds[order], first[order]
    common = seed_common[order].copy() if carry else np.zeros(len(seeds), np.uint8)
    seed_cuts = np.searchsorted(first, np.arange(257))
    larger, starts = _Queues(memory), _Queues(memory)
    one = lambda a, b: _common(text, np.array([a]), np.array([b]), depth)[0] if carry and a is not None else np.uint8(0)

    def pull(p: np.ndarray, c: np.ndarray, queue: _Queues, kind: bool, carried: _Carry) -> None:
        if len(p) <= FEW:  # runs of one byte come in many small batches
            for place, lcp in zip(p.tolist(), c.tolist(), strict=True):
                fits = place > 0 and small[place - 1] == kind
                byte = int(text[place - 1]) if fits else None
                new = carried.one(lcp, byte) if carry else 0
                if fits:
                    queue.push(byte, np.array([place - 1]), np.array([new], np.uint8))
            return
        at = np.flatnonzero(p > 0)
        q = p[at] - 1
        fits = small[q] == kind
        at, q = at[fits], q[fits]
        byte = text[q].astype(np.int64)
        new = carried.take(c, at, byte) if carry else np.zeros(len(q), np.uint8)
        order = np.argsort(byte, kind="stable")
        byte, q, new = byte[order], q[order], new[order]
        cuts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else np.zeros(0, int)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(byte)], strict=False):
            queue.push(int(byte[a]), q[a:b], new[a:b])

    # L suffixes, from the smallest byte up; the last suffix follows the (empty) smallest one
    carried = _Carry(depth)
    if n:
        pull(np.array([n]), np.zeros(1, np.uint8), larger, False, carried)
    for c in range(256):
        last = None
        for p, lcp in larger.drain(c):
            pull(p, lcp, larger, False, carried)
            last = int(p[-1])
        mine = slice(seed_cuts[c], seed_cuts[c + 1])
        if seed_cuts[c] < seed_cuts[c + 1]:
            own = common[mine]
            own[0] = one(last, int(seeds[mine][0]))
            for a in range(0, len(own), STEP):
                pull(seeds[mine][a : a + STEP], own[a : a + STEP], larger, False, carried)
    # S suffixes, from the largest byte down: a tuple's common prefix is the one with the tuple scanned before
    carried = _Carry(depth)
    for c in range(255, -1, -1):
        last, before = None, np.uint8(0)
        for p, lcp in starts.drain(c):
            pull(p, lcp, starts, True, carried)
            last = int(p[-1])
        for k, (p, lcp) in enumerate(larger.backwards(c)):
            scanned = np.r_[one(last, int(p[0])) if k == 0 else before, lcp[:-1]].astype(np.uint8)
            pull(p, scanned, starts, True, carried)
            before = lcp[-1]
    for c in range(256):
        last = before = None
        for p, lcp in larger.drain(c):
            yield p, lcp
            last = int(p[-1])
        for p, lcp in starts.backwards(c):  # the largest came first; each knows its common prefix with the next larger one
            yield p, np.r_[one(last, int(p[0])) if before is None else before, lcp[:-1]].astype(np.uint8)
            before = lcp[-1]
    larger.close()
    starts.close()


def _induce_names(text: np.ndarray, small: np.ndarray, seeds: Iterator[int], memory: int) -> Iterator[int]:
    """As :func:`_induce`, over names: tuple by tuple through heaps."""
    larger, queue, rank = _Queues(memory), _Heap(memory), 1
    done: list[int] = []

    def flush() -> None:
        if done:
            larger.push(0, np.array(done, np.int64), np.zeros(len(done), np.uint8))
            done.clear()

    n = len(text)
    if n and not small[n - 1]:
        queue.push((int(text[n - 1]), 0, n - 1))
    seed = next(seeds, None)
    while seed is not None or queue.least() is not None:
        head = queue.least()
        if head is not None and (seed is None or head[0] <= text[seed]):
            p = queue.pop()[2]
            done.append(p)
            if len(done) >= 4096:
                flush()
        else:
            p, seed = seed, next(seeds, None)
        if p and not small[p - 1]:
            queue.push((int(text[p - 1]), rank, p - 1))
            rank += 1
    flush()
    queue.close()
    starts, queue, rank, done = _Queues(memory), _Heap(memory), 0, []
    behind = (int(p) for batch, _ in larger.backwards(0) for p in batch)
    nxt = next(behind, None)
    while nxt is not None or queue.least() is not None:
        head = queue.least()
        if head is not None and (nxt is None or -head[0] >= text[nxt]):
            p = queue.pop()[2]
            starts.push(0, np.array([p], np.int64), np.zeros(1, np.uint8))
        else:
            p, nxt = nxt, next(behind, None)
        if p and small[p - 1]:
            queue.push((-int(text[p - 1]), rank, p - 1))
            rank += 1
    queue.close()
    rising = (int(p) for batch, _ in starts.backwards(0) for p in batch)
    s = next(rising, None)
    for batch, _ in larger.drain(0):
        for p in batch.tolist():
            while s is not None and text[s] < text[p]:
                yield s
                s = next(rising, None)
            yield p
    while s is not None:
        yield s
        s = next(rising, None)
    larger.close()
    starts.close()


def _lms(small: np.ndarray) -> np.ndarray:
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _named(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A name for each LMS substring, by their places in order: equal length and equal signs get one name."""
    index = np.full(len(text), -1, np.int64)
    index[lms] = np.arange(len(lms))
    length = np.diff(np.r_[lms, len(text) - 1]) + 1
    ids = index[order]
    same = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((length[ids[:-1]] == length[ids[1:]]) & (ids[1:] != len(lms) - 1) & (ids[:-1] != len(lms) - 1))
    k = 0
    while len(near):  # sign by sign, while they are equal
        done = length[ids[near]] <= k
        same[near[done] + 1] = True
        near = near[~done]
        near = near[text[a[near] + k] == text[b[near] + k]]
        k += 1
    name = np.empty(len(lms), np.int64)
    name[ids] = np.cumsum(~same)
    return name


def _sort_names(names: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The places of a text of names, ordered by the suffixes that begin there, up to ``depth`` names at least."""
    m = len(names)
    if m <= memory or m < 4:
        name, reach = names, 1
        while reach < depth and reach < m and name.max(initial=0) < m:
            nxt = np.zeros(m, np.int64)
            nxt[:-reach] = name[reach:]
            name = np.unique(name * (m + 1) + nxt, return_inverse=True)[1] + 1
            reach *= 2
        return np.argsort(name, kind="stable")
    names = _kept(names, memory)
    small = _kept(_types(names), memory)
    lms = _lms(small)
    is_lms = np.zeros(m, bool)
    is_lms[lms] = True
    by_sign = lms[np.argsort(names[lms], kind="stable")]
    order = np.fromiter((p for p in _induce_names(names, small, iter(by_sign.tolist()), memory) if is_lms[p]), np.int64)
    if len(lms):
        lms = lms[_sort_names(_named(names, lms, order), depth, memory)]
    return np.fromiter(_induce_names(names, small, iter(lms.tolist()), memory), np.int64, m)


def sort_suffixes(text: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes at least (ties in any order), and each one's common prefix with the one before, ``depth`` (255 at most) at most; in batches.

    Beside ``memory`` tuples a queue, what stays in memory is what is known of the LMS suffixes: two or three numbers for each, a third of the suffixes or fewer.
    """
    text = _kept(text, memory)
    small = _kept(_types(text), memory)
    lms = _lms(small)
    if len(lms):
        order = np.concatenate([p[small[p] & (p > 0) & ~small[p - 1]] for p, _ in _induce(text, small, lms, memory)])
        # two bytes at least lie between the LMS suffixes that names stand for
        lms = lms[_sort_names(_named(text, lms, order), depth // 2 + 2, memory)]
    common = np.r_[np.uint8(0), _common(text, lms[:-1], lms[1:], depth)].astype(np.uint8) if len(lms) else np.zeros(0, np.uint8)
    yield from _induce(text, small, lms, memory, depth, common)
