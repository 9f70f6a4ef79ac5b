import random

import numpy as np
import pytest

from vouchlake.llm import minhash_dedup as md


def _set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _brute(docs, k, percent):
    ids, sets = sorted(docs), {d: _set(t, k) for d, t in docs.items()}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def _docs(n, copies, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    docs, d = {}, 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice([2, 40, 150]))]
        for _ in range(rng.choice(copies)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            docs[d] = rng.choice([" ", "\t", "\n"]).join(w)
            d += 1
    return docs


@pytest.mark.parametrize("k,percent,options", [(3, 85, {}), (5, 80, {}), (3, 85, {"node_limit": 6, "block": 8})])
def test_equals_brute_force(spark, k, percent, options):
    docs = _docs(25, [1, 1, 2, 5]) | {1000 + d: t for d, t in _docs(1, [40], seed=9).items()}
    got = md.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), k, percent, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _brute(docs, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_shingle_sets_equal_plain_ones(monkeypatch):
    texts = ["A b  c d", "a B c\td", "x", None, "", " \n ", "é É", "a\x0bb c", "w " * 3000]
    for chunk in (1 << 19, 4):
        monkeypatch.setattr(md, "CHUNK", chunk)
        sets = list(md.shingle_sets(texts, 3))
        assert [len(s) for s in sets] == [len(_set(t, 3)) for t in texts]
        assert (sets[0] == sets[1]).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sims = (md.signature(np.r_[both, a]) == md.signature(np.r_[both, b])).mean()
    assert abs(sims - 0.8) < 0.16


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, "one two three four", 1, "a"), (2, "ONE two three four", 2, "b"), (2, "ONE two three four", 2, "b"), (3, None, 3, "c"), (4, "", 4, None), (None, "one two three four", 5, "d"), (5, "one two", 6, "e"), (6, "w " * 200_000, 7, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int, component_id string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in md.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (0, 2, None, True), (5, 1, 5, True), (6, 1, 6, True)], key=str)
    kept = md.drop_near_duplicates(df, shingle=3, percent=85)
    assert kept.columns == df.columns and sorted(r.rep for r in kept.collect()) == [1, 3, 4, 5, 6, 7]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert md.near_duplicates(empty).count() == 0
