import itertools
import random

import numpy as np

from vouchlake.llm import line_dedup as ld


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _brute(docs):
    """doc_id -> text that stays, from {doc_id: text}."""
    lines = [(d, n, ld.normalise(x)) for d in sorted(docs) for n, x in enumerate(docs[d].split("\n"))]
    lines = [x for x in lines if x[2]]
    sims, sketches = ld.simhashes([x[2] for x in lines])
    masks = [sum(((1 << e) - 1) << b for b, e in part) for part in itertools.combinations([(round(12.8 * k), round(12.8 * (k + 1)) - round(12.8 * k)) for k in range(5)], 2)]
    near = lambda i, j: any((int(sims[i]) ^ int(sims[j])) & m == 0 for m in masks) and _bits(sims[i] ^ sims[j]) <= ld.REACH and _bits((sketches[i] ^ sketches[j]) & 0xFFFFFFFF) <= min(ld.SKETCH, ld.BOTH - _bits(sims[i] ^ sims[j]))
    group = list(range(len(lines)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            a, b = lines[i][2], lines[j][2]
            if a == b or (near(i, j) and _edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    gone = {lines[i][:2] for i in range(len(lines)) if root(i) != i}
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in docs.items()}


def _docs():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa"]
    base = [" ".join(rng.choice(words) + rng.choice("xyz") for _ in range(rng.choice([1, 2, 12, 40]))) for _ in range(40)]
    docs = {}
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(base)
            if rng.random() < 0.4:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice(["", "Q", "  "]) + x[k + 1 :]
            lines.append(x.upper() if rng.random() < 0.2 else x)
        docs[d] = "\n".join([*lines, "", "Same Line in all"][: rng.randrange(1, 9)])
    docs[40] = docs[3]
    docs[41] = ""
    return docs


def test_equals_brute_force_over_all_pairs(spark):
    docs = _docs()
    got = ld.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == _brute(docs)
    assert sum(r.n_removed for r in got) > 30


def _plain_simhash(line):
    runs = [line[i : i + 4] for i in range(max(1, len(line) - 3))]
    step, full, bits = 0x9E3779B97F4A7C15, 2**64 - 1, []
    for r in runs:
        h = 0
        for c in r.ljust(4, "\n"):
            h = (h * step + ord(c)) & full
        h = ((h ^ h >> 32) * 0xBF58476D1CE4E5B9) & full
        bits.append(h ^ h >> 29)
    bits = [h for h in bits if not h >> 63] or bits
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in bits) + (bits[0] >> k & 1) > len(bits))


def _bits(x):
    return bin(int(x)).count("1")


def test_simhash_is_the_same_alone_and_in_a_batch(monkeypatch):
    lines = ["a b c", "one", "", "x", "été à Ü", "日本語のテキスト", "abcdefg " * 60, "a b c d e f g", "w" * 700]
    alone = [tuple(int(v[0]) for v in ld.simhashes([x])) for x in lines]
    batch = lambda: list(zip(*(map(int, v) for v in ld.simhashes(lines)), strict=True))
    assert batch() == alone
    assert alone[2] == (0, 0) and [_bits(a[0]) for a in alone] == [_bits(_plain_simhash(x)) if x else 0 for x in lines]
    for chunk in (100, 9, 3):
        monkeypatch.setattr(ld, "CHUNK", chunk)
        got = batch()
        assert got == alone


def test_lengths_that_can_be_similar_are_not_told_apart():
    sizes = list(range(1, 400))
    classes = ld.simhashes(["x" * n for n in sizes])[1] >> 32
    assert all(abs(int(classes[a - 1]) - int(classes[b - 1])) <= ld._apart(0.8) for a in sizes for b in sizes if a <= b and 10 * a >= 8 * b)


def test_small_edits_of_lines_mostly_meet():
    """The share that the README states, by length: one letter of a line is changed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    for low, n in ((0.35, 20), (0.6, 40), (0.85, 100)):
        lines = [" ".join(word() for _ in range(n)) for _ in range(200)]
        edited = []
        for x in lines:
            k = rng.randrange(len(x))
            edited.append(x[:k] + "q" + x[k + 1 :])
        (a, s), (b, t) = ld.simhashes(lines), ld.simhashes(edited)
        blocks = [(a ^ b) >> np.uint64(round(12.8 * k)) & np.uint64((1 << round(12.8 * (k + 1)) - round(12.8 * k)) - 1) for k in range(5)]
        met = (sum((x == 0).astype(int) for x in blocks) >= 2) & ld._near(a, s, b, t, ld.REACH, ld._apart(0.8))
        assert met.mean() > low, (n, met.mean())


def test_blocks_connect_every_pair_within_the_distance(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 30)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for x in base for k in (1, 3, 4)]
    near += [int(base[0]) ^ (1 << i) ^ (1 << (i + 9)) for i in range(30)]  # more than SMALL in a key
    values = sorted({*map(int, base), *near})
    want = [(i, j) for i, a in enumerate(values) for j in range(i + 1, len(values)) if ((a ^ values[j]) & (2**64 - 1)).bit_count() <= 3]

    def parts(links):
        root = list(range(len(values)))
        for i, j in links:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "h1 long, sim long, sketch long")
    for blocks in (4, 5, 6):
        rows = ld.near_links(frame, distance=3, blocks=blocks, reach=3).collect()
        got, keys = {(r.a, r.b) for r in rows if r.a != r.b}, {}
        for r in rows:
            if r.a == r.b:
                assert r.sim == values[r.a]
                keys.setdefault(r.key, []).append(r.a)
        got |= {(i, j) for own in keys.values() for i in own for j in own if i < j and (i, j) in want}
        assert keys or blocks > 5
        assert got <= set(want) and parts(got) == parts(want)


def test_links_that_fail_are_replaced(spark):
    """Many lines with one bag of words, some too far from one another: groups still are those of all pairs."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(8)]
    docs = {}
    for d in range(24):
        w = list(words)
        rng.shuffle(w) if d % 3 == 0 else None
        docs[d] = " ".join(w) + (" word1" * (d % 4))
    got = ld.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == _brute(docs)


def test_bounds_are_no_fewer_than_the_edits():
    rng = random.Random(6)
    for n in (25, 25, 25, 80):
        for _ in range(100):
            a = [rng.choice(["ab", "c", "def"]) + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(1, n))]
            b = [w if rng.random() < 0.9 else rng.choice(["zz", "ab", "q"]) for w in a if rng.random() < 0.95] or ["k"]
            x, y = " ".join(a), " ".join(b)
            true, most = _edits(x, y), int(0.2 * max(len(x), len(y)) + 1e-9)
            assert ld._bound(x, y, 10**9) >= true
            assert ld.similar(x, y, 0.8) == (true <= most)
            assert (ld.edits(x, y, most) <= most) == (true <= most)
    assert ld._bound("", "abc", 0) == 3 and ld._bound("same", "same", 0) == 0
    assert ld._bound("a line of some length here", "a line of sume length here", 9) == 1


def test_edits_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        b = "".join(c if rng.random() < 0.8 else rng.choice(["", "x", "ab"]) for c in a) if rng.random() < 0.7 else a[::-1]
        assert ld.edits(a, b) == _edits(a, b)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, "a line here\nb", 5, "x"), (1, "a line here\nb", 5, "x"), (2, "A  LINE here\n\nc", 6, None), (None, "a line here", 7, "y"), (3, None, 8, "z"), (4, "", 9, "z"), (5, "e" * 50_000 + "\n" + "e" * 50_000, 1, "")]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, first string"))
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed, r["first"]) for r in out.collect() if r.text is not None)
    assert got == [(0, "a line here", 1, 0, "y"), (1, "a line here\nb", 2, 0, "x"), (1, "a line here\nb", 2, 0, "x"), (2, "\nc", 3, 1, None), (4, "", 1, 0, "z"), (5, "e" * 50_000, 2, 1, "")]
    null = next(r for r in out.collect() if r.text is None)
    assert (null.n_lines, null.n_removed) == (0, 0)
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_class_is_sent_once_for_each_block_that_can_be_first(spark):
    """Not once for each choice of blocks (10 of two of five): what grows with the lines is sent four times."""
    frame = spark.createDataFrame([(i, (i * 0x9E3779B97F4A7C15) % 2**63 - 2**62, 0) for i in range(50)], "h1 long, sim long, sketch long")
    for blocks in (4, 5, 6):
        sent = [(r.key, n) for r in ld._dealt(frame, 3, blocks).collect() for n in np.frombuffer(r.cells, np.int64).reshape(3, -1)[2].tolist()]
        assert len(sent) == len(set(sent)) == 4 * 50


def test_keys_larger_than_a_batch_are_whole(spark, monkeypatch):
    """One first block holds all, in several batches, and pairs meet on its other blocks."""
    rng = random.Random(4)
    high = [rng.getrandbits(50) << 13 for _ in range(300)]
    frame = spark.createDataFrame([(2 * i + k, x ^ k << 30, 0) for i, x in enumerate(high) for k in (0, 1)], "h1 long, sim long, sketch long")
    monkeypatch.setattr(ld, "DEALT", 7)
    with ld.small_batches(spark, 7):
        got = {(r.a, r.b) for r in ld.near_links(frame, reach=1).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(300)}


def test_hopeless_pairs_are_given_up_early(monkeypatch):
    """Lines with no more than letters in common are told apart by part of them, without the distances of any column."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    lines = [" ".join(word() for _ in range(110)) for _ in range(40)]
    seen = []
    alone = ld._alone
    monkeypatch.setattr(ld, "_alone", lambda where, size, b: seen.append((alone(where, size, b), len(b))) or seen[-1][0])
    for x, y in zip(lines[::2], lines[1::2], strict=True):
        most = int(0.2 * max(len(x), len(y)))
        assert _edits(x, y) > most and ld.edits(x, y, most) > most
        assert seen[-1][0] <= _edits(x, y) and seen[-1][1] <= 0.6 * len(y)
    assert len(seen) == 20 and sum(least > 0.2 * 550 for least, _ in seen) >= 5


def test_bounds_of_a_column_and_of_letters_hold():
    rng = random.Random(10)
    for k in range(150):
        a = "".join(rng.choice("abcdefgh\u65e5" if k % 2 else "ab") for _ in range(rng.randrange(1, 400)))
        b = "".join(c if rng.random() < 0.7 else rng.choice(["", "x", "ab"]) for c in a) if k % 3 else a[::-1] + "ab"
        true = _edits(a, b)
        assert ld._where(a) == {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
        for most in {0, true // 3, true - 1, true, true + 5} - {-1}:
            assert (ld.edits(a, b, most) == true) if true <= most else ld.edits(a, b, most) > most
