import hashlib
import random

import numpy as np
import pytest

from vouchlake.llm import span_dedup as sd
from vouchlake.llm import suffix_array


def _brute(docs, length=100):
    seen, out = set(), {}
    for d in sorted(docs):
        b = docs[d].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def _docs():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 180, 700)]
    docs = {}
    for d in range(60):
        parts = [text(rng.randrange(0, 150)) for _ in range(4)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            k = rng.randrange(0, 60)
            parts.insert(rng.randrange(4), p[k:] if rng.random() < 0.5 else p)
        docs[d] = "".join(parts)
    docs |= {100: docs[5], 101: "a" * 500, 102: "ab" * 400, 103: "b" * 130 + docs[7], 104: "", 105: "日本語" * 80}
    return docs


@pytest.mark.parametrize("chunk", [1 << 18, 300])
def test_equals_brute_force(spark, monkeypatch, chunk):
    docs = _docs()
    monkeypatch.setattr(sd, "CHUNK", chunk)
    values = [sd._segments([(d, a, docs[d].encode()[a : a + chunk + 99]) for a in range(0, max(1, len(docs[d].encode()) - 99), chunk)], 100) for d in docs]
    assert sum(int(v["n"].sum()) for v in values) == sum(max(0, len(t.encode()) - 99) for t in docs.values())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.cut_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == _brute(docs)


def _common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_suffixes_are_sorted_to_the_depth_with_their_common_prefixes(monkeypatch):
    """Also with memory for a few tuples only: queues, text and heaps on disk, and recursion over names."""
    rng = random.Random(1)
    for trial in range(120):
        t = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(rng.randrange(1, 400)))
        t = (t[:40] * 10)[: len(t)] if trial % 3 == 0 else t + b"\xff" + t[:50] + b"\xff" if trial % 7 == 0 else t
        monkeypatch.setattr(suffix_array, "STEP", rng.choice([5, 64, 1 << 18]))
        monkeypatch.setattr(suffix_array, "FEW", rng.choice([0, 3, 12]))
        got = list(suffix_array.sort_suffixes(np.frombuffer(t, np.uint8), 100, memory=rng.choice([4, 16, 60, 1 << 20])))
        order, common = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
        assert sorted(order) == list(range(len(t)))
        heads = [t[i : i + 100] for i in order]
        assert heads == sorted(heads)
        assert common == [0, *[_common(a, b) for a, b in zip(heads[:-1], heads[1:], strict=True)]]


def test_shards_beyond_memory_give_the_same(monkeypatch):
    rng = random.Random(2)
    body, rows = b"", []
    for k in range(60):
        n = rng.randrange(1, 40)
        text = "".join(rng.choice("ab") for _ in range(8)) * 20
        body += text[: n + 99].encode() + sd.END
        rows.append((k // 3, 200 * (k % 3), min(n, 61)))
    rows = [(d, lo, len(seg) - 99) for (d, lo, _), seg in zip(rows, body.split(sd.END)[:-1], strict=True)]
    v = {"doc": np.array([r[0] for r in rows]), "lo": np.array([r[1] for r in rows]), "n": np.array([r[2] for r in rows])}
    text = np.frombuffer(body, np.uint8)
    plain = sorted(zip(*map(np.ndarray.tolist, sd.repeated_windows(v, text, 100)), strict=True))
    spilled = []
    whole = suffix_array._Queues.read
    monkeypatch.setattr(suffix_array._Queues, "read", lambda self, part: spilled.append(not isinstance(part[0], np.ndarray)) or whole(self, part))
    monkeypatch.setattr(sd, "sort_suffixes", lambda t, depth: suffix_array.sort_suffixes(t, depth, memory=100))
    assert sorted(zip(*map(np.ndarray.tolist, sd.repeated_windows(v, text, 100)), strict=True)) == plain and len(plain) > 100 and any(spilled)


def test_a_passage_in_all_documents_is_combined_before_it_meets(spark):
    """Equal segments of a task go on as one: the largest bucket has no more of them than tasks."""
    passage = "a line that stands in every one of the documents, with the same words in the same order, again and again"
    docs = spark.createDataFrame([(i, passage) for i in range(4000)], "doc_id long, text string").repartition(4)
    blobs = [(r.target, sd._unpack([r.blob], sd._ALL if r.target < 0 else sd._WINDOWS)) for r in sd._scan(docs, 100, 16, 31).collect()]
    assert sum(len(v["n"]) for t, v in blobs if t < 0) <= 4 * len(passage) and sum(len(v["n"]) for t, v in blobs if t >= 0) >= 3900
    assert sd.cut_repeats(docs).agg({"n_removed": "sum"}).first()[0] == 3999 * len(passage)


def test_nulls_repeats_and_other_columns(spark):
    rng = random.Random(3)
    p = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(1, p, "x"), (1, p, "x"), (2, "q" + p, None), (3, None, "z"), (None, p, "n"), (-5, p[:100], "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in sd.cut_repeats(df).collect()), key=str)
    assert got == sorted([(1, 150, 100, 1), (1, 150, 100, 1), (2, 151, 150, 1), (3, 0, 0, 0), (None, 150, 0, 0), (-5, 100, 0, 0)], key=str)
    spans = next(r for r in sd.cut_repeats(df).collect() if r.doc_id == 2)
    assert [(s.start, s.end) for s in spans.spans] == [(1, 151)] and bytes(spans.kept) == b"q"
    assert sd.cut_repeats(df.limit(0)).count() == 0
