import numpy as np
from pyspark.sql import functions as F

from vouchlake.llm import vector_dedup as vd


def _vectors(n=900, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    return np.concatenate([base, base + rng.normal(size=base.shape) * 0.25, base * 2.0]).astype(np.float32)


def test_links_equal_brute_force_with_high_recall(spark):
    x = _vectors()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vd.near_vectors(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert 0.97 * link.sum() <= found <= link.sum() and link.sum() > 300
    assert all(r.n_links <= link[i].sum() for i, r in got.items())
    linked = [i for i in range(600, 900) if got[i].component_id == i - 600]
    assert len(linked) == 300  # doubled vectors have cosine 1 with theirs


def test_blocks_and_index_of_a_sample_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK", 40)
    monkeypatch.setattr(vd, "FIT_ROWS", 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_vectors(300))], "vec_id long, embedding array<double>")
    blocked = {(r.vec_id, r.n_links, r.component_id) for r in vd.near_vectors(df, probes=1000).collect()}
    monkeypatch.undo()
    assert blocked == {(r.vec_id, r.n_links, r.component_id) for r in vd.near_vectors(df, probes=1000).collect()}


def test_rows_that_repeat_an_id_keep_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.05, 0.0]), (3, [0.0, 1.0, 0.05]), (4, [0.0, 0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vd.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_pairs_of_a_dense_group_are_counted_not_written(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in vd.near_vectors(df).collect()} == {(299, 0)}
    found = vd.similar_pairs(df.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("v")), 16, 300)
    assert found.count() < 40 * 300 < 300 * 299 / 2


def test_estimates_keep_their_bound():
    x = vd._unit(_vectors().astype(float))
    index = vd.Index(x[:300], 12)
    lists = index.lists(x, 1)[:, 0]
    codes, rest = index.encode(x, lists)
    for at in range(12):
        own = np.flatnonzero(lists == at)
        assert (x[:50] @ x[own].T <= index.estimates(x[:50], at, codes[own]) + rest[own] + 1e-9).all()


def test_unsound_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (11, [1e300, 0.0]), (12, [1e-300, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, n string, rep int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vd.near_vectors(df).where("vec_id is not null").collect())
    assert got == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)], (9, 1, 9, True), (10, 1, 9, False), (11, 4, 1, False), (12, 4, 1, False)])
    null = vd.near_vectors(df).where("vec_id is null").first()
    assert (null.n_links, null.component_id, null.kept) == (0, None, True)
    assert vd.near_vectors(df.limit(0)).count() == 0
