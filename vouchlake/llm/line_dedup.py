"""Fuzzy line deduplication.

Lines are normalised (lower case, white space collapsed) and equal ones counted as one class. A class has a
64-bit SimHash of its runs of four letters, of which a small edit moves few. Two hashes that differ in at most 3 bits
agree in at least 2 of 5 blocks, so the classes meet on every pair of blocks (10 keys of 25 or 26 bits). A class is sent
once for each of the four blocks that can be a pair's first; the second blocks are told apart where it arrives. Pairs that meet
are linked if their hashes differ in at most 7 bits, a short sketch of their runs of eight letters and their lengths
don't tell them apart, and the edit similarity of the normalised lines is high enough. Of each connected group of lines
the first occurrence (smallest document, then line) stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, checkpointed, connected_components, numbered_texts, small_batches, table, with_least
from .minhash_dedup import _forest

SIMILARITY = 0.8
#: All pairs within so many bits meet in a key; pairs that meet are followed up to REACH bits, SKETCH of 32 bits of the second hash, and BOTH together.
DISTANCE, BLOCKS = 3, 5
REACH, SKETCH, BOTH = 7, 8, 12
#: Letters of a run that counts as one feature of a line: of the SimHash, and of the sketch.
GRAM, LONG = 4, 8
#: Lengths of one class differ by less than this share.
LENGTHS = 0.12
#: Members of a key of which all near pairs are followed; of larger keys those that span them.
SMALL = 16
#: Bits of a block by which classes are dealt out: one worker holds at a time those that agree in them (a 256th of all, 24 bytes each). So many classes are dealt at once.
SLICE, DEALT = 8, 200_000
#: So many candidate lines at most are broadcast when their texts are fetched; more are joined by shuffle.
BROADCAST_LINES = 500_000
#: Letters of normalised lines that are hashed at once.
CHUNK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP2 = np.uint64(0x9E3779B97F4A7C15**2 % 2**64)


def normalise(line: str) -> str:
    """Lower case, white space collapsed. (Of white space only the space is printable.)"""
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line.lower()
    return " ".join(line.lower().split())


#: The lowest bit of each byte: eight counters that are added at once.
_ONES = np.uint64(0x0101010101010101)


def simhashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each normalised line (0 for an empty one) and its sketch.

    A bit of the SimHash is the majority of that bit in the hashes of the line's runs of GRAM letters (half of them, chosen
    by their hashes; all, if that is none); on a tie, the bit of the first. A shorter line is one run. The sketch has 32 such
    bits of the runs of LONG letters that begin with the same, and above them the class of the line's length.
    """
    sim, sketch = np.zeros(len(lines), np.uint64), np.zeros(len(lines), np.int64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    ends, i = np.cumsum(size + LONG), 0
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK)))
        own = lines[i:j]
        # a line above CHUNK alone comes in pieces; each run begins in one piece
        pieces = [own] if j > i + 1 or len(own[0]) <= CHUNK else [[own[0][k : k + CHUNK + LONG - 1]] for k in range(0, len(own[0]), CHUNK)]
        a, b = _tally(pieces)
        some = size[i:j] > 0
        sim[i:j][some] = a.view(np.uint64).ravel()
        sketch[i:j][some] = b.view(np.uint32).ravel()
        i = j
    return sim, sketch | np.floor(np.log(np.maximum(size, 1).astype(np.float64)) / np.log1p(LENGTHS)).astype(np.int64) << 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _tally(pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The majorities of both kinds of runs, packed, for each line that isn't empty; of one line, if it comes in pieces."""
    found, whole = [], []
    for k, lines in enumerate(pieces):
        c = np.frombuffer(("\n" * LONG).join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(x) for x in lines])
        start = np.r_[0, np.cumsum(size + LONG)[:-1]]
        start, size = start[size > 0], size[size > 0]
        if not len(size) or k and size[0] < GRAM:  # no run begins in the rest
            continue
        two = c[:-1] * _STEP
        two += c[1:]
        four = two[:-2] * _STEP2
        four += two[2:]  # what follows a line is line ends
        runs = np.minimum(np.maximum(size - GRAM + 1, 1), CHUNK if len(pieces) > 1 else 1 << 62)
        inside = np.zeros(len(four), np.int8)
        inside[start], inside[start + runs] = 1, -1
        inside = np.cumsum(inside, dtype=np.int8).view(bool)
        h = _mixed(four)
        keep = h.view(np.int64) >= 0
        keep &= inside
        at = np.flatnonzero(keep)
        kept = np.diff(np.searchsorted(at, start), append=len(at))
        if len(pieces) == 1:
            if not kept.all():
                none = runs * (kept == 0)
                keep[_within(start, none)] = True
                at, kept = np.flatnonzero(keep), kept + none
            found.append(_count(h, four, at, kept))
        else:  # whether any run is chosen shows at the end
            found += [_count(h, four, at, kept)] if kept[0] else []
            whole.append(_count(h, four, np.flatnonzero(inside), runs))
    found = found or whole
    if not found:
        return np.zeros((0, 8), np.uint8), np.zeros((0, 4), np.uint8)
    votes, runs = sum(f[0] for f in found), sum(f[1] for f in found)
    out = np.packbits(2 * votes + found[0][2] > runs[:, None], axis=1)
    return np.ascontiguousarray(out[:, :8]), np.ascontiguousarray(out[:, 8:])


def _within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _count(h: np.ndarray, four: np.ndarray, at: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line, of which ``runs`` of the places ``at`` are (one at least), how many have each of 64 bits of ``h`` and 32 of the long runs' hashes; their number; the bits of its first."""
    long = four.take(at)
    long *= _STEP
    long += four.take(at + GRAM)  # the line ends behind the last line are enough
    hashes = (h.take(at), 8), (_mixed(long), 4)
    # seven runs in a column, short of which are zeros: three numbers say how many of them have a bit
    columns = -(-runs // SEVEN)
    n, first = int(columns.sum()), np.cumsum(columns) - columns
    own = np.cumsum(runs) - runs
    parts = -(-columns // 36)  # counters of one byte: parts of 36 columns at most
    part = _within(np.zeros(len(parts), np.int64), parts) * 36 + np.repeat(first, parts)
    to = np.repeat(first * SEVEN - own, runs) + np.arange(len(at))
    votes, bits = [], []
    for x, planes in hashes:
        cells = np.zeros(SEVEN * n, np.uint64)
        cells[to] = x
        ones, twos, fours = _added(*np.ascontiguousarray(cells.reshape(n, SEVEN).T))
        for k in range(planes):
            k = np.uint64(k)
            votes.append(np.add.reduceat((ones >> k & _ONES) + ((twos >> k & _ONES) << np.uint64(1)) + ((fours >> k & _ONES) << np.uint64(2)), part))
            bits.append(x[own] >> k & _ONES)
    votes = np.stack(votes, axis=1).view(np.uint8)
    whole = np.add.reduceat(votes, np.cumsum(parts) - parts, axis=0, dtype=np.int64) if len(part) > len(runs) else votes.astype(np.int64)
    return whole, runs, np.stack(bits, axis=1).view(np.uint8)


#: Numbers that three bits can count.
SEVEN = 7


def _added(a, b, c, d, e, f, g):  # noqa: ANN001, ANN202
    """The three bits of how many of seven arrays have each bit."""

    def full(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = x ^ y
        return odd ^ z, x & y | odd & z

    (s, i), (t, j) = full(a, b, c), full(d, e, f)
    ones, k = full(s, t, g)
    return ones, *full(i, j, k)


def _keep_freed() -> None:
    """Has this process keep up to 60 MB of what it frees: else each round of arrays is given back and comes anew, page by page, a third of the time. (glibc raises its limits to the size of the largest block freed, which is never touched; others may ignore it.)"""
    np.empty(30 << 20, np.uint8)


def line_features(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, h1, h2, sim, sketch)`` for every line of ``docs(doc_id, text)`` whose normalised form is not empty; h1 and h2 are its 128-bit hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _keep_freed()
        for pdf in batches:
            ids, nos, lines, size = [], [], [], 0
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                for k, line in enumerate(t.split("\n")):
                    norm = normalise(line)
                    if norm:
                        ids.append(d)
                        nos.append(k)
                        lines.append(norm)
                        size += len(norm)
                    if size > 16 * CHUNK:
                        yield frame(ids, nos, lines)
                        ids, nos, lines, size = [], [], [], 0
            if ids:
                yield frame(ids, nos, lines)

    def frame(ids: list, nos: list, lines: list) -> pd.DataFrame:
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), np.int64).reshape(-1, 2)
        sim, sketch = simhashes(lines)
        return pd.DataFrame({"doc_id": ids, "line_no": np.array(nos, np.int32), "h1": h[:, 0], "h2": h[:, 1], "sim": sim.view(np.int64), "sketch": sketch})

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, line_no int, h1 long, h2 long, sim long, sketch long")


def _edges(blocks: int) -> list[int]:
    return [round(64 * i / blocks) for i in range(blocks + 1)]


def _masks(distance: int, blocks: int) -> list[list[np.uint64]]:
    """The bits of each choice of ``blocks - distance`` blocks, by its first block."""
    edges, out = _edges(blocks), [[] for _ in range(distance + 1)]
    for choice in combinations(range(blocks), blocks - distance):
        out[choice[0]].append(np.uint64(sum((1 << edges[c + 1]) - (1 << edges[c]) for c in choice)))
    return out


def _dealt(classes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``(key, cells)``: each class once for each block that can be the first of a choice. The key is the block's number and its first SLICE bits;
    many classes of one key are one row of packed numbers (sim, sketch, h1), which Spark moves and sorts at no cost for each."""
    edges = _edges(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _keep_freed()
        held, n = [], 0
        for pdf in batches:
            held.append(np.stack([pdf[c].to_numpy() for c in ("sim", "sketch", "h1")]))
            n += len(pdf)
            if n >= DEALT:
                yield frame(np.concatenate(held, axis=1))
                held, n = [], 0
        if n:
            yield frame(np.concatenate(held, axis=1))

    def frame(rows: np.ndarray) -> pd.DataFrame:
        keys, cells = [], []
        for i in range(distance + 1):
            own = (rows[0].view(np.uint64) >> np.uint64(edges[i]) & np.uint64((1 << min(SLICE, edges[i + 1] - edges[i])) - 1)).astype(np.int16)
            order = np.argsort(own, kind="stable")
            own, laid = own[order], rows[:, order]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            keys += (own[cut] + (i << SLICE)).tolist()
            cells += [laid[:, a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True)]
        return pd.DataFrame({"key": np.array(keys, np.int64), "cells": cells})

    return classes.select("sim", "sketch", "h1").mapInPandas(run, "key long, cells binary")


def _near(sim: np.ndarray, sketch: np.ndarray, sim2: np.ndarray, sketch2: np.ndarray, reach: int, classes: int) -> np.ndarray:
    """Whether hashes, sketches and lengths let the lines be similar."""
    a, b = np.bitwise_count(sim ^ sim2), np.bitwise_count((sketch ^ sketch2) & np.int64(0xFFFFFFFF))
    return (a <= reach) & (b <= SKETCH) & (a + b <= BOTH) & (np.abs((sketch >> 32) - (sketch2 >> 32)) <= classes)


def _apart(similarity: float) -> int:
    """By how many classes of length lines of this similarity can differ."""
    return int(np.ceil(-np.log(similarity) / np.log1p(LENGTHS)))


def _met(sim: np.ndarray, sketch: np.ndarray, reach: int, classes: int, step: int = 1024) -> np.ndarray:
    """Which members of a key have another one near."""
    out = np.zeros(len(sim), bool)
    for i in range(0, len(sim), step):
        for j in range(i, len(sim), step):
            a, b = slice(i, i + step), slice(j, j + step)
            hit = _near(sim[a, None], sketch[a, None], sim[b], sketch[b], reach, classes)
            if i == j:
                np.fill_diagonal(hit, False)
            out[a] |= hit.any(axis=1)
            out[b] |= hit.any(axis=0)
    return np.flatnonzero(out)


def _spanning(sim: np.ndarray, sketch: np.ndarray, norm: list[str], reach: int, similarity: float) -> list[tuple[int, int]]:
    """Links that span what the members of a key have near and similar enough."""
    classes = _apart(similarity)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        hit = _near(sim[i], sketch[i], sim[others], sketch[others], reach, classes)
        hit[hit] = [similar(norm[i], norm[j], similarity) for j in others[hit].tolist()]
        return hit

    return _forest(linked, len(sim))


def near_links(classes: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE, blocks: int = BLOCKS, reach: int = REACH) -> DataFrame:
    """``(a, b, key, sim, sketch)``: the pairs of ``classes(h1, sim, sketch)`` that are near (see :func:`_near`) in a key of up to SMALL members (key 0);
    and of larger keys the members that have another one near, as (a, a, key, ...): all pairs of these would be too many. Their
    key is a hash of the members, so that a group that meets in several keys is one.

    Pairs that differ in at most ``distance`` bits meet in a key for sure; more ``blocks`` make longer keys, with fewer
    chance meetings (for larger corpora). Streams over partitions sorted by bits of the
    first block; keys in which nothing is near, nearly all, are passed over without a loop.
    """
    apart = _apart(similarity)
    masks = _masks(distance, blocks)
    names = ["a", "b", "key", "sim", "sketch"]

    def meet(k: np.ndarray, s: np.ndarray, t: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[cut, len(k)])
        own, at, out = np.repeat(size, size), np.arange(len(k)) - np.repeat(cut, size), []
        few = np.flatnonzero(own <= SMALL)
        for off in range(1, SMALL):  # all pairs of small keys, by how far they are apart
            few = few[at[few] + off < own[few]]
            if not len(few):
                break
            i = few[_near(s[few], t[few], s[few + off], t[few + off], reach, apart)]
            none = np.zeros(len(i), np.int64)
            out.append(np.stack([np.minimum(n[i], n[i + off]), np.maximum(n[i], n[i + off]), none, none, none], axis=1))
        for i, m in zip(cut[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            some = i + _met(s[i : i + m], t[i : i + m], reach, apart)
            some = some[np.argsort(n[some], kind="stable")]
            group = np.full(len(some), xxhash.xxh3_64_intdigest(n[some].tobytes()), np.uint64).view(np.int64)
            out.append(np.stack([n[some], n[some], group, s[some].view(np.int64), t[some]], axis=1))
        return out

    def work(block: int, held: list[np.ndarray]) -> list[np.ndarray]:
        """Of each choice that begins with the block, the classes of a key that meet."""
        s, t, n = np.concatenate(held, axis=1)
        s, out = s.view(np.uint64), []
        for mask in masks[block]:
            bits = s & mask
            order = np.argsort(bits)
            bits = bits[order]
            same = bits[1:] == bits[:-1]
            met = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
            if len(met):
                at = order[met]
                out += meet(bits[met], s[at], t[at], n[at])
        return [x for x in out if len(x)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _keep_freed()
        held: list[np.ndarray] = []
        last = None
        for pdf in batches:
            for key, cells in zip(pdf["key"].tolist(), pdf["cells"].tolist(), strict=True):
                if key != last and held:
                    got, held = work(last >> SLICE, held), []
                    if got:
                        yield pd.DataFrame(np.concatenate(got), columns=names)
                last = key
                held.append(np.frombuffer(cells, np.int64).reshape(3, -1))
        got = work(last >> SLICE, held) if held else []
        if got:
            yield pd.DataFrame(np.concatenate(got), columns=names)

    return _dealt(classes, distance, blocks).repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, key long, sim long, sketch long")


def _differing(a: str, b: str) -> tuple[str, str]:
    """What is left without the common ends."""

    def common(n: int, equal) -> int:
        if equal(n):
            return n
        low, high = 0, n  # equal at low, not at high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if equal(mid) else (low, mid)
        return low

    n = min(len(a), len(b))
    i = common(n, lambda k: a[:k] == b[:k])
    a, b, n = a[i:], b[i:], n - i
    j = common(n, lambda k: a[len(a) - k :] == b[len(b) - k :])
    return a[: len(a) - j], b[: len(b) - j]


def edits(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, bit-parallel over what differs between the common ends; any number above ``most``, if it is above."""
    a, b = _differing(a, b)
    if not a or not b:
        return len(a) + len(b)
    enough = len(a) + len(b) if most is None else most
    where, n, half = _where(a), len(b), 5 * enough // 2
    if half < n and (least := _alone(where, min(len(a), half + enough), b[:half])) > enough:
        return least
    full = (1 << len(a)) - 1
    up, down = full, 0  # where the column of distances rises and falls
    for done in range(0, n, 32):
        for c in b[done : done + 32]:
            same = where.get(c, 0)
            step = same | down
            across = (((same & up) + up) ^ up) | same
            plus = (down | ~(across | up) & full) << 1 | 1
            up, down = ((up & across) << 1 | ~(step | plus)) & full, plus & step & full
        now = min(done + 32, n)
        score = now + up.bit_count() - down.bit_count()
        if score - (n - now) > enough:  # each letter that is left saves one at most
            return score
        if enough < now < n and done & 32 and (least := _least(up, down, len(a), now, n)) > enough:
            return least
    return score


def _where(a: str) -> dict[str, int]:
    """The places of each letter as bits."""
    where: dict[str, int] = {}
    if len(a) < 128:
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        return where
    c = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.unique(c)
    step = max(1, (1 << 18) // len(c))
    for i in range(0, len(own), step):
        rows = np.packbits(c == own[i : i + step, None], axis=1, bitorder="little")
        where |= {chr(x): int.from_bytes(row.tobytes(), "little") for x, row in zip(own[i : i + step].tolist(), rows, strict=True)}
    return where


def _alone(where: dict[str, int], size: int, b: str) -> int:
    """How many letters of ``b`` have no partner in the longest common subsequence with the first ``size`` letters of the other line: each is an edit. Four steps a letter, where the distance takes many."""
    full = free = (1 << size) - 1
    for c in b:
        same = free & where.get(c, 0)
        free = free + same | free - same
    return len(b) - size + (free & full).bit_count()


def _least(up: int, down: int, m: int, now: int, n: int) -> int:
    """No more edits than any way through a column of distances costs: the distance there, and by how much what is left of one line is longer."""
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(m + 7 >> 3, "little"), np.uint8), count=m, bitorder="little").view(np.int8)
    column = np.zeros(m + 1, np.int64)
    np.cumsum(bits(up) - bits(down), out=column[1:])
    return now + int((column + np.abs(np.arange(m - n + now, now - n - 1, -1))).min())


def _bound(x: str, y: str, most: int) -> int:
    """No fewer edits than turn one line into the other: from each difference on, the next place where eight letters agree again, found after a short skip; what is skipped counts in full. Ends early above ``most``."""
    i = j = cost = 0
    m, n = len(x), len(y)
    while i < m and j < n:
        step = 16
        while x[i : i + step] == y[j : j + step] and i < m and j < n:
            i, j, step = min(i + step, m), min(j + step, n), 2 * step
        while step > 1:  # the difference is within the next step letters
            step //= 2
            if x[i : i + step] == y[j : j + step]:
                i, j = min(i + step, m), min(j + step, n)
        if i >= m or j >= n:
            break
        for skip in (1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90):
            probe = x[i + skip : i + skip + 8]
            at = y.find(probe, j, j + 2 * skip + 16) if len(probe) == 8 else -1
            if at >= 0:
                cost, i, j = cost + max(skip, at - j), i + skip, at
                break
        else:
            break
        if cost > most:
            break
    return cost + max(m - i, n - j)


def similar(x: str, y: str, similarity: float) -> bool:
    """Whether 1 - edits / longer length is at least ``similarity``; the edits are counted only where a bound from above doesn't settle it."""
    most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    return abs(len(x) - len(y)) <= most and (_bound(x, y, most) <= most or edits(x, y, most) <= most)


def _norms(nodes: DataFrame, classes: DataFrame, docs: DataFrame, places: _Places) -> DataFrame:
    """``(h1, norm)`` of the classes named."""
    wanted = checkpointed(nodes.distinct().join(classes.select("h1", *places.back(F.col("first"))), "h1"))
    texts = _texts(wanted.select("doc_id", "line_no"), docs)
    with small_batches(docs.sparkSession):
        return checkpointed(wanted.join(texts, ["doc_id", "line_no"]).select("h1", "norm"))


def line_links(classes: DataFrame, docs: DataFrame, places: _Places, similarity: float, distance: int, blocks: int, reach: int) -> DataFrame:
    """``(a, b)``: links that connect what all links between ``classes(h1, sim, sketch, first)`` connect.

    Texts are fetched once, of the classes that have another one near. Pairs of small keys are compared one by one;
    a larger key's members meet with their texts and give the links that span their groups.
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[similar(x, y, similarity) for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)], ["a", "b"]]

    def span(g: pd.DataFrame) -> pd.DataFrame | None:
        node = g["a"].to_numpy()
        rows = _spanning(g["sim"].to_numpy().view(np.uint64), g["sketch"].to_numpy(), g["norm"].tolist(), reach, similarity)
        return pd.DataFrame({"a": node[[i for i, _ in rows]], "b": node[[j for _, j in rows]]}) if rows else None

    with small_batches(docs.sparkSession):
        found = checkpointed(near_links(classes, similarity, distance, blocks, reach))
    norms = _norms(found.select(F.explode(F.array("a", "b")).alias("h1")), classes, docs, places)
    pairs = found.where("a <> b").select("a", "b").distinct()
    pairs = pairs.join(norms.select(F.col("h1").alias("a"), F.col("norm").alias("x")), "a").join(norms.select(F.col("h1").alias("b"), F.col("norm").alias("y")), "b")
    members = found.where("a = b").distinct().join(norms.withColumnRenamed("h1", "a"), "a").select("key", "a", "sim", "sketch", "norm")
    with small_batches(docs.sparkSession):
        return checkpointed(pairs.mapInPandas(verify, "a long, b long").unionByName(by_runs(members, ["key"], span, "a long, b long")))


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, norm)`` for the ``wanted(doc_id, line_no)`` lines; each document is read once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, nos in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["nos"].tolist(), strict=True):
                lines = t.split("\n")
                out += [(d, n, normalise(lines[n])) for n in nos if n < len(lines)]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "norm"])

    nos = checkpointed(wanted.distinct().groupBy("doc_id").agg(F.collect_list("line_no").alias("nos")))
    few = nos.agg(F.coalesce(F.sum(F.size("nos")), F.lit(0))).first()[0] <= BROADCAST_LINES
    there = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(nos) if few else nos, "doc_id")
    return there.mapInPandas(run, "doc_id long, line_no int, norm string").dropDuplicates(["doc_id", "line_no"])


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE, blocks: int = BLOCKS, reach: int = REACH) -> DataFrame:
    """``(doc_id, line_no)`` of every line but the first of its connected group, and ``first_doc``, ``first_line``: the one that stays.

    Lines are linked if their normalised forms are equal, or if their SimHashes agree in ``blocks - distance`` blocks and
    differ in at most ``reach`` bits, their sketches are near and 1 - edits / longer length is at least ``similarity``. Lines without words are never duplicates; rows
    without doc_id or text have no lines. Rows that repeat a doc_id are one document.
    """
    lines, roots, places = _lines_and_roots(docs, similarity, distance, blocks, reach)
    first = places.back(F.col("root"))
    return _gone(lines, roots, places).select("doc_id", "line_no", first[0].alias("first_doc"), first[1].cast("int").alias("first_line")).distinct()


class _Places:
    """Document and line in one number, whose minimum is found by hashing (that of a struct needs a sort): a long where all ids and lines fit, else a decimal."""

    def __init__(self, lines: DataFrame):
        r = lines.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("line_no").alias("line")).first()
        self.bits = max(1, (r.line or 0).bit_length())
        self.long = (r.low or 0) >= 0 and (r.high or 0) < 1 << 62 - self.bits

    def of(self, doc: Column, line: Column) -> Column:
        if self.long:
            return F.call_function("shiftleft", doc, F.lit(self.bits)).bitwiseOR(line.cast("long"))
        return (doc.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + line.cast("decimal(10,0)")).cast("decimal(32,0)")

    def back(self, place: Column) -> tuple[Column, Column]:
        if self.long:
            return F.call_function("shiftright", place, F.lit(self.bits)).alias("doc_id"), place.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int").alias("line_no")
        line = F.pmod(place, F.lit(1 << 32).cast("decimal(10,0)"))
        return ((place - line) / F.lit(1 << 32).cast("decimal(10,0)")).cast("long").alias("doc_id"), line.cast("int").alias("line_no")


def _gone(lines: DataFrame, roots: DataFrame, places: _Places) -> DataFrame:
    """The lines that go, with the place of the one that stays; as often as their rows."""
    return lines.join(roots, ["h1", "h2"]).where(places.of(F.col("doc_id"), F.col("line_no")) != F.col("root"))


def _lines_and_roots(docs: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE, blocks: int = BLOCKS, reach: int = REACH) -> tuple[DataFrame, DataFrame, _Places]:
    """All lines; ``(h1, h2, root)`` for the classes of which a line goes: the place of the line that stays; how places are written."""
    with small_batches(docs.sparkSession):
        lines = checkpointed(line_features(docs))
    places = _Places(lines)
    classes = lines.groupBy("h1", "h2").agg(F.min(places.of(F.col("doc_id"), F.col("line_no"))).alias("first"), F.count("*").alias("n"), F.first("sim").alias("sim"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes)
    links = line_links(classes, docs, places, similarity, distance, blocks, reach)
    groups = connected_components(links).join(classes.select(F.col("h1").alias("id"), "first"), "id")
    groups = with_least(groups, "component", "first", "lowest").groupBy("first").agg(F.min("lowest").alias("component"))
    root = F.coalesce("component", "first")
    settled = classes.join(groups, "first", "left").where((F.col("n") > 1) | (root != F.col("first"))).select("h1", "h2", root.alias("root"))
    return lines, settled, places


def dedup_lines(docs: DataFrame, text: str = "text", prefix: str = "", **options) -> DataFrame:
    """``docs``, all columns, with ``text`` without the duplicate lines, and ``n_lines`` and ``n_removed`` (after ``prefix``).

    A text keeps its other lines in order. Null texts stay null (0 lines); an empty text is one empty line. Rows
    without a doc_id keep their text. Rows that agree in doc_id and text are one document, other rows of one doc_id follow
    each other in the order of a hash of their texts. Columns of the two names are replaced. An empty table gives an empty result.
    """
    names = numbered_texts(docs.select("doc_id", F.col(text).alias("text")))
    if names is None:
        return _dedup(docs, text, prefix, options)
    same = (F.col("__own") == F.col("__named")) & (F.col("__t") == F.col("__hash"))
    keyed = docs.withColumnRenamed("doc_id", "__own").withColumn("__t", F.xxhash64(text)).join(names.select(F.col("doc_id").alias("__named"), F.col("t").alias("__hash"), F.col("seq").alias("doc_id")), same, "left").drop("__t", "__hash", "__named")
    out = _dedup(keyed, text, prefix, options).drop("doc_id").withColumnRenamed("__own", "doc_id")
    return out.select(*docs.columns, *[c for c in (f"{prefix}n_lines", f"{prefix}n_removed") if c not in docs.columns])


def _dedup(docs: DataFrame, text: str, prefix: str, options: dict) -> DataFrame:
    gone = _gone(*_lines_and_roots(docs.select("doc_id", F.col(text).alias("text")), **options))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("line_no", F.lit(64)))
    words = gone.groupBy("doc_id", F.floor(F.col("line_no") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("x"))
    masks = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("__gone"), F.sum(F.bit_count("x")).alias("__removed")).withColumnRenamed("doc_id", "__doc")
    both = docs.join(masks.hint("shuffle_hash"), F.col("doc_id") == F.col("__doc"), "left")  # texts are not sorted; a partition's masks are small
    out = lambda i: F.call_function("shiftright", F.coalesce(F.try_element_at("__gone", F.floor(i / 64).cast("int")), F.lit(0).cast("bigint")), F.pmod(i, F.lit(64))).bitwiseAND(F.lit(1)) == 0
    lines = F.split(F.col(text), "\n", -1)  # for texts of which lines go; the others' are counted
    n_lines = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    kept = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: out(i)), "\n"))
    return both.withColumns({f"{prefix}n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n_lines).cast("long"), f"{prefix}n_removed": F.coalesce("__removed", F.lit(0)).cast("long"), text: kept}).drop("__doc", "__gone", "__removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
