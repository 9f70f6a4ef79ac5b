"""Removal of repeated byte spans by external suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts earlier in the corpus as well. Every such
window has an anchor: the window's ``GRAM``-byte gram of least hash. Equal windows have equal anchors at equal
places, so

1. each run of windows with one anchor is a segment; segments meet by their anchor's hash. An anchor that occurs
   once has no repeated window. Equal segments are one class, and all but its first are repeats as a whole;
2. the first segments of anchors with several classes are gathered into shards, each a text whose suffixes are
   sorted by external induced sorting, which carries their common prefixes; neighbours with one of ``length`` bytes
   are equal windows, and all but the first of them repeat;
3. documents meet what was found in them, and the repeated windows are cut out.

Rows between the steps are packed: arrays of many segments in one binary value, by hash bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, checkpointed, numbered_texts, runs, small_batches, table, whole_id
from .minhash_dedup import _mix
from .suffix_array import sort_suffixes

LENGTH, GRAM = 100, 32
#: Bytes that are hashed at once (at most 2**20), anchors that are packed at once, and text bytes of a bucket and of a shard, about.
CHUNK, PACK, BUCKET_BYTES, SHARD_BYTES = 1 << 18, 1 << 17, 4 << 20, 2 << 20
#: No UTF-8 text has this byte.
END = b"\xff"
_R = 0x9E3779B97F4A7C15
_POWERS: list = []
_FIELDS = (("anchor", np.uint64), ("segment", np.uint64), ("doc", np.int64), ("lo", np.int64), ("n", np.uint8), ("rel", np.uint8))


def _pack(values: dict[str, np.ndarray], names: tuple[str, ...]) -> bytes:
    """Columns of numbers, byte plane by byte plane (planes of equal bytes compress to nothing in a shuffle)."""
    out = [np.int64(len(values[names[0]])).tobytes()]
    for name, kind in _FIELDS:
        if name in names:
            x = np.ascontiguousarray(values[name].astype(kind, copy=False))
            out.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return b"".join(out)


def _unpack(blobs, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {n: [] for n in names}
    for blob in blobs:
        size, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for name, kind in _FIELDS:
            if name in names:
                width = np.dtype(kind).itemsize
                planes = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size)
                parts[name].append(np.ascontiguousarray(planes.T).view(kind).ravel())
                at += size * width
    return {n: np.concatenate(p) if p else np.zeros(0, dict(_FIELDS)[n]) for n, p in parts.items()}


_ALL = tuple(n for n, _ in _FIELDS)
_WINDOWS = ("doc", "lo", "n")
_SEGMENTS = ("anchor", "doc", "lo", "n")


def _segments(pieces: list[tuple[int, int, bytes]], length: int) -> dict[str, np.ndarray]:
    """The segments of pieces (document, offset, bytes) of texts."""
    data = b"".join(p[2] for p in pieces)
    b = np.frombuffer(data, np.uint8)
    if not _POWERS or len(_POWERS[0]) <= len(b):
        n = max(len(b), CHUNK + 4096)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(x))]) for x in (_R, pow(_R, -1, 1 << 64))]
    power, inverse = _POWERS
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), np.maximum(sizes - length + 1, 0))
    if not len(piece):
        return {n: np.zeros(0, k) for n, k in _FIELDS}
    first = (ends - sizes)[piece]
    run = np.arange(len(piece)) - np.r_[0, np.cumsum(np.maximum(sizes - length + 1, 0))][:-1][piece]
    s = first + run  # where each window starts in data
    width = length - GRAM + 1
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])]
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(b) - GRAM + 1])
    low = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: -(width - reach)], low[width - reach :])
    anchor = (low[s] & np.uint64(0xFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    n = np.diff(np.r_[cut, len(anchor)])
    at, a = s[cut], anchor[cut]
    with np.errstate(over="ignore"):
        segment = _mix((sums[at + n - 1 + length] - sums[at]) * inverse[at])
    docs, offsets = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    return {"anchor": grams[a], "segment": segment, "doc": docs[piece[cut]], "lo": offsets[piece[cut]] + run[cut], "n": n, "rel": a - at}


def _by(values: dict[str, np.ndarray], bucket: np.ndarray, names: tuple[str, ...]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=False):
        yield int(bucket[a]), _pack({n: values[n][order[a:b]] for n in names}, names)


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _ranked(v: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Segments in order of class and place; where anchors and classes begin, and which segments are later ones of their class."""
    order = np.lexsort((v["lo"], v["doc"], v["rel"], v["n"], v["segment"], v["anchor"]))
    v = {n: x[order] for n, x in v.items()}
    other = np.r_[True, v["anchor"][1:] != v["anchor"][:-1]]
    start = other | np.r_[True, (v["segment"][1:] != v["segment"][:-1]) | (v["n"][1:] != v["n"][:-1]) | (v["rel"][1:] != v["rel"][:-1])]
    head = np.flatnonzero(start)[np.cumsum(start) - 1]
    return v, other, start, (v["doc"] != v["doc"][head]) | (v["lo"] != v["lo"][head])


def _shared(anchor: np.ndarray) -> np.ndarray:
    """Which anchors occur more than once."""
    order = np.argsort(anchor, kind="stable")
    a, again = anchor[order], np.zeros(len(anchor), bool)
    again[1:] = a[1:] == a[:-1]
    again[:-1] |= again[1:]
    out = np.zeros(len(anchor), bool)
    out[order] = again
    return out


def _scan(docs: DataFrame, length: int, buckets: int, doc_buckets: int) -> DataFrame:
    """``(bucket, target, blob)``: all segments, by their anchor's hash (target null). Of a class that a task meets again only
    the first segment goes on as one; the later ones are repeated windows, addressed to their documents' bucket ``target``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0

        def flush() -> pd.DataFrame:
            values = {n: np.concatenate([h[n] for h in held]) for n in _ALL}
            held.clear()
            out, shared = [], _shared(values["anchor"])
            if shared.any():
                some, _, _, repeat = _ranked({n: x[shared] for n, x in values.items()})
                values = {n: np.concatenate([x[~shared], some[n][~repeat]]) for n, x in values.items()}
                part = {n: some[n][repeat] for n in _WINDOWS}
                out = [(b % buckets, b, blob) for b, blob in _by(part, part["doc"] % doc_buckets, _WINDOWS)]
            out += [(b, -1, blob) for b, blob in _by(values, (values["anchor"] % np.uint64(buckets)).astype(np.int64), _ALL)]
            return pd.DataFrame(out, columns=["bucket", "target", "blob"])

        def work(pieces: list) -> None:
            nonlocal count
            held.append(_segments(pieces, length))
            count += len(held[-1]["n"])

        for pdf in batches:
            pieces, size = [], 0
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                b = t.encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(b) - length + 1), CHUNK):
                    pieces.append((d, at, b[at : at + CHUNK + length - 1]))
                    size += len(pieces[-1][2])
                    if size >= CHUNK:
                        work(pieces)
                        pieces, size = [], 0
                        if count >= PACK:
                            yield flush()
                            count = 0
            if pieces:
                work(pieces)
            if held and count >= PACK:
                yield flush()
                count = 0
        if held:
            yield flush()

    return docs.where("doc_id is not null and text is not null").mapInPandas(run, "bucket int, target int, blob binary")


def _classes(blobs, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(document bucket, kind, blob): kind 0 are repeated windows, kind 1 the segments that have to be sorted."""
    v = _unpack(blobs, _ALL)
    shared = _shared(v["anchor"])
    if not shared.any():
        return
    v, other, start, repeat = _ranked({n: x[shared] for n, x in v.items()})
    group = np.cumsum(other) - 1
    several = np.bincount(group[start])[group] > 1
    for kind, which, names in ((0, repeat, _WINDOWS), (1, start & several, _SEGMENTS)):
        part = {n: v[n][which] for n in names}
        for bucket, blob in _by(part, part["doc"] % buckets, names):
            yield bucket, kind, blob


def _with_texts(docs: DataFrame, blobs: DataFrame, buckets: int) -> DataFrame:
    """Blobs ``(bucket, kind, blob)`` and documents, laid out so that a bucket's blobs come before its documents."""
    bucket = F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.lit(0)).cast("int")
    rows = docs.select(bucket.alias("bucket"), F.lit(9).alias("kind"), *whole_id("doc_id"), "text", F.lit(None).cast("binary").alias("blob"))
    rows = blobs.select("bucket", "kind", F.lit(0).cast("long").alias("doc_id"), F.lit(True).alias("no_id"), F.lit(None).cast("string").alias("text"), "blob").unionByName(rows)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def _streams(batches, names: tuple[str, ...]):
    """(values of a bucket's blobs sorted by document and place, an iterator over pieces of its documents) by bucket, in order of arrival."""
    bucket, held, values = None, [], None
    for pdf in batches:
        for b, kind, d, no_id, t, blob in zip(*[pdf[c].tolist() for c in ("bucket", "kind", "doc_id", "no_id", "text", "blob")], strict=True):
            if b != bucket:
                bucket, held, values = b, [], None
            if kind != 9:
                held.append(blob)
                continue
            if values is None:
                values = _unpack(held, names)
                order = np.lexsort((values["lo"], values["doc"]))
                values = {n: x[order] for n, x in values.items()}
                held = []
            yield values, None if no_id else d, t


def _own(values: dict[str, np.ndarray], doc: int | None) -> slice:
    return slice(0, 0) if doc is None else slice(*np.searchsorted(values["doc"], [doc, doc + 1]).tolist())


def _gather(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """``(shard, blob, body)``: segments with their bytes, by their anchor's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bodies, size = [], [], 0

        def flush() -> pd.DataFrame:
            v = {n: np.concatenate([h[n] for h in held]) for n in _SEGMENTS}
            shard = (_mix(v["anchor"]) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            out, cuts = [], np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                own = order[a:b]
                out.append((int(shard[own[0]]), _pack({n: v[n][own] for n in _SEGMENTS}, _SEGMENTS), b"".join(bodies[i] for i in own.tolist())))
            held.clear()
            bodies.clear()
            return pd.DataFrame(out, columns=["shard", "blob", "body"])

        for values, doc, text in _streams(batches, _SEGMENTS):
            own = _own(values, doc)
            if own.stop > own.start and text is not None:
                b = text.encode("utf-8", "surrogatepass")
                lo, n = values["lo"][own].tolist(), values["n"][own].tolist()
                held.append({x: values[x][own] for x in _SEGMENTS})
                bodies += [b[i : i + k - 1 + length] + END for i, k in zip(lo, n, strict=True)]
                size += sum(map(len, bodies[-len(lo) :]))
                if size >= SHARD_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInPandas(run, "shard int, blob binary, body binary")


def repeated_windows(v: dict[str, np.ndarray], body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, places) of the windows of a shard's segments that occur earlier in it; ``body`` holds the segments, each ended by END."""
    starts = np.r_[0, np.cumsum(v["n"].astype(np.int64) + length)]
    rest, found = np.zeros(0, np.int64), []

    def repeats(order: np.ndarray, same: np.ndarray) -> None:
        """The later windows of whole groups: runs of suffixes with a common prefix of ``length`` bytes."""
        held = same.copy()
        held[:-1] |= same[1:]
        order, same = order[held], same[held]
        segment = np.searchsorted(starts, order, "right") - 1
        into = order - starts[segment]
        window = into < v["n"][segment]
        group, doc, lo = np.cumsum(~same)[window], v["doc"][segment[window]], v["lo"][segment[window]] + into[window]
        rank = np.lexsort((lo, doc, group))
        group, doc, lo = group[rank], doc[rank], lo[rank]
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (doc != doc[head]) | (lo != lo[head])
        found.append((doc[later], lo[later]))

    for order, common in sort_suffixes(body, length):
        order, same = np.r_[rest, order], np.r_[np.zeros(min(len(rest), 1), bool), np.ones(max(len(rest) - 1, 0), bool), common >= length]
        open_ = int(np.flatnonzero(~same)[-1])  # the last group may go on in the next batch
        if open_:
            repeats(order[:open_], same[:open_])
        rest = order[open_:]
    if len(rest):
        repeats(rest, np.r_[False, np.ones(len(rest) - 1, bool)])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sort_shards(segments: DataFrame, length: int, buckets: int) -> DataFrame:
    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        body = np.frombuffer(b"".join(g["body"]), np.uint8)
        doc, lo = repeated_windows(_unpack(g["blob"], _SEGMENTS), body, length)
        if not len(doc):
            return None
        order = np.lexsort((lo, doc))
        doc, lo = doc[order], lo[order]
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + 1) | (np.arange(1, len(doc)) % 200 == 0)])
        part = {"doc": doc[cut], "lo": lo[cut], "n": lo[np.r_[cut[1:] - 1, len(lo) - 1]] - lo[cut] + 1}
        return pd.DataFrame([(b, 0, blob) for b, blob in _by(part, part["doc"] % buckets, _WINDOWS)], columns=["bucket", "kind", "blob"])

    return by_runs(segments, ["shard"], one, "bucket int, kind int, blob binary")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, int]:
    """``(bucket, kind, blob)``: all repeated windows, by document bucket; and the number of buckets."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()[0] or 0
    buckets = _prime(max(31, size // BUCKET_BYTES))
    segments = _scan(docs, length, max(16, size // (2 * BUCKET_BYTES)), buckets)

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["bucket"]):
            done = (g["target"] >= 0).to_numpy()
            got = [(b, 0, blob) for b, blob in zip(g["target"][done].tolist(), g["blob"][done].tolist(), strict=True)]
            got += _classes(g["blob"][~done], buckets)
            if got:
                yield pd.DataFrame(got, columns=["bucket", "kind", "blob"])

    found = checkpointed(segments.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(classes, "bucket int, kind int, blob binary"))
    open_ = found.where("kind = 1")
    todo = open_.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    windows = found.where("kind = 0")
    if todo:
        shards = max(8, todo // 25 * (length + 35) // SHARD_BYTES)  # a packed segment has 25 bytes
        gathered = _gather(_with_texts(docs, open_, buckets), length, shards)
        windows = windows.unionByName(checkpointed(_sort_shards(gathered, length, buckets)))
    return windows, buckets


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, spans)`` for each row of ``docs(doc_id, text)``: ``kept`` are the bytes that
    stay, ``spans`` the (start, end) of the maximal runs that go.

    A byte goes if a ``length``-byte string that covers it starts earlier too: in a document of smaller doc_id, or
    before in its own. Texts are whole UTF-8 bytes (null: empty); matches never cross documents, overlapping
    ones count, and all are judged on the input. Rows without a doc_id lose nothing and are compared with none;
    rows that agree in doc_id and text are one document, other rows of one doc_id follow each other in the order of a
    hash of their texts. An empty table gives an empty result. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = numbered_texts(docs)
    if names is not None:
        numbered = docs.withColumn("t", F.xxhash64("text")).join(names, ["doc_id", "t"], "left").select(F.col("seq").alias("doc_id"), "text")
        return _cut(numbered, length).withColumnRenamed("doc_id", "seq").join(names.select("seq", "doc_id"), "seq", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans")
    return _cut(docs, length)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    with small_batches(docs.sparkSession):
        windows, buckets = find_repeats(docs, length)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for values, doc, text in _streams(batches, _WINDOWS):
            b = (text or "").encode("utf-8", "surrogatepass")
            own, spans, kept = _own(values, doc), [], b
            if own.stop > own.start:
                lo = values["lo"][own]
                hi = np.maximum.accumulate(lo + values["n"][own].astype(np.int64) - 1 + length)
                first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                spans = list(zip(lo[first].tolist(), hi[np.r_[first[1:] - 1, len(lo) - 1]].tolist(), strict=True))
                at = [0, *[x for s in spans for x in s], len(b)]
                kept = b"".join(b[i:j] for i, j in zip(at[::2], at[1::2], strict=True))
            out.append((0 if doc is None else doc, doc is None, len(b), len(b) - len(kept), len(spans), kept, spans))
            size += len(b)
            if size >= SHARD_BYTES:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)

    def frame(out: list) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
        pdf["spans"] = [[{"start": a, "end": b} for a, b in s] for s in pdf["spans"]]
        return pdf

    done = _with_texts(docs, windows, buckets).mapInPandas(cut, "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")
    return done.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "spans")


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i : i + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM t WHERE octet_length(b) >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM later)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, z, lag(z) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM spans),
kept AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(hex(b), 2 * coalesce(before, 0) + 1, 2 * (a - 1 - coalesce(before, 0))), '' ORDER BY a) || string_agg(CASE WHEN after IS NULL THEN substr(hex(b), 2 * z + 1) ELSE '' END, '') AS h FROM cuts JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""
