import random

import pytest

from vouchlake.llm import mixing


def test_targets_are_filled_by_weight_up_to_the_cap():
    t = mixing.targets({"b": 100, "a": 1000, None: 50})
    total = 1.5 * 1150
    assert sum(t.values()) == pytest.approx(total) and t["b"] == 200 and t[None] == 100 and t["a"] == pytest.approx(total - 300)
    even = mixing.targets({"a": 300, "b": 300, "c": 300})
    assert even == pytest.approx({"a": 600, "b": 250, "c": 500})  # the first is at its cap, the rest goes 1 to 2
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}
    assert list(mixing.targets({"b": 5, "a": 5, "é": 5, None: 5}, weights=(1.0, 0.5), share=1.0)) is not None


def _docs(n=3000, seed=2):
    rng = random.Random(seed)
    sources = ["s1"] * 6 + ["s2", "s3", "s4", None]
    return [(i, " ".join(["w"] * (rng.randrange(1, 40) if rng.random() < 0.97 else 2000)), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("leaf,fan_in", [(4096, 256), (50, 4)])
def test_words_come_near_targets(spark, leaf, fan_in):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, leaf=leaf, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate))
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 2000 for t, n in by.values()) and len(by) == 5
    again = mixing.mix_sources(df.repartition(7), leaf=leaf, fan_in=fan_in).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}


def test_every_fraction_keeps_its_expectation():
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 30), rng.random()) for i in range(30)]
    n = [0] * 30
    for seed in range(3000):
        for r in mixing._pivot(rows, seed):
            n[r[0]] += r[1] if len(r) == 2 else r[2]
    assert all(abs(n[i] / 3000 - p) < 0.05 for i, _, p in rows)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, None, 2), (3, "", "x", 3), (None, "c d", None, 4), (4, "e " * 100_000, "y", 5)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    got = {(r.doc_id, r.source): r for r in out}
    assert len(out) == 6 and got[2, None].taken == 0 and got[3, "x"].taken == 0 and got[4, "y"].size == 100_000 and got[1, "x"].source_size == 4
    assert got[None, None].size == 2
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, size int"), max_sources=2)


def _plain_rounding(units, seed, last):
    """Sequential pivots by the definition: units (id, mass, p) in order of mass and id; {id: copies}, and what is left over."""
    out, held = {}, None
    for unit, mass, p in sorted(units, key=lambda u: (u[1], u[0])):
        if held is None:
            held = (unit, mass, p)
            continue
        a, wa, pa = held
        up, down = min(wa * (1 - pa), mass * p), min(wa * pa, mass * (1 - p))
        moved = up if mixing._draw(seed, a, unit) * (up + down) < down else -down
        pa, p, held = pa + moved / wa, p - moved / mass, None
        for x, w, q in ((a, wa, pa), (unit, mass, p)):
            if min(q, 1 - q) < 1e-9:
                out[x] = round(q)
            else:
                held = (x, w, q)
    if held is not None and last:
        out[held[0]], held = int(mixing._draw(seed, "last", held[0]) < held[2]), None
    return out, held


@pytest.mark.parametrize("leaf,fan_in", [(4096, 256), (20, 3)])
def test_copies_equal_plain_pivots_over_the_tree(spark, leaf, fan_in):
    from pyspark.sql import functions as F

    rows = [(i, f"w{i} " * (1 + i * 7 % 23), ["a", "b", None][i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    nodes = 1
    while nodes * leaf < len(rows):
        nodes *= fan_in
    unit = F.xxhash64("doc_id", F.lit(False), mixing._text_hash(), "source")
    units = df.select("doc_id", "source", unit.alias("unit"), F.pmod(F.xxhash64(unit, F.lit(17)), F.lit(nodes)).alias("node")).collect()
    size = {i: 1 + i * 7 % 23 for i, _, _ in rows}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in ("a", "b", None)}
    target, copies = mixing.targets(total), {}
    for s in total:
        rate = target[s] / total[s]
        whole = int(rate + 1e-12)
        groups, level, n = {}, 0, nodes
        for u in units:
            if u.source == s and rate - whole > 0:
                groups.setdefault(u.node, []).append((u.unit, size[u.doc_id], rate - whole))
        taken = {}
        while groups:
            nxt = {}
            for node, own in groups.items():
                done, left = _plain_rounding(own, 17 + level, n == 1)
                taken |= done
                if left is not None:
                    nxt.setdefault(node % max(1, n // fan_in), []).append(left)
            groups, n, level = nxt, max(1, n // fan_in), level + 1
        copies |= {u.doc_id: whole + taken.get(u.unit, 0) for u in units if u.source == s}
    assert {r.doc_id: r.copies for r in mixing.mix_sources(df, leaf=leaf, fan_in=fan_in).collect()} == copies
