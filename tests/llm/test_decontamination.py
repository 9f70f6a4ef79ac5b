import random

import regex

from vouchlake.llm import decontamination as dc

ITEM = "A train leaves the station at 9:30 with 120 passengers and travels 45 km to reach Springfield where Alice Brown waits with 120 flowers for the guests of Alice"


def _find(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in dc.find_contamination(d, b, **options).collect()}


def _swap(text, *pairs):
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def test_other_parameters_are_caught_if_slots_are_consistent(spark):
    other = _swap(ITEM, ("9:30", "7:15"), ("120", "88"), ("45 km", "300 miles"), ("Springfield", "Shelbyville"), ("Alice", "Marge"), ("Brown", "Green"))
    uneven = _swap(ITEM, ("120 passengers", "88 passengers"), ("120 flowers", "99 flowers"))
    shifted = ITEM.replace("with 120 passengers", "slowly with 120 passengers")
    clean = "The station where the train with many guests leaves is far from the house with flowers and it waits for all of us to come at once"
    docs = [(1, "Before it. " + ITEM.upper().lower() + " and after."), (2, f"Once {other} again"), (3, uneven), (4, clean), (5, shifted), (6, ITEM.replace(" ", "\n"))]
    got = _find(spark, docs, [(7, ITEM)])
    assert {d for d, _ in got} >= {2, 5, 6} and 3 not in {d for d, _ in got} and 4 not in {d for d, _ in got}


def test_exact_passages_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["tha", "en", "or", "ing", "st", "le"]) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 30)))) for i in range(15)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(5, 120))]
        if d % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(items)[1].split()
        docs.append((d, " ".join(w)))
    want = {(d, i) for d, t in docs for i, x in items if f" {x} " in f" {t} "}
    assert len(want) >= 20
    assert _find(spark, docs, items) == want
    assert _find(spark, docs, items, broadcast_rows=40) == want


def test_nulls_short_texts_ties_and_other_columns(spark):
    rows = [(1, ITEM, "x", 1), (1, ITEM, "x", 1), (None, ITEM, "y", 2), (2, None, "z", 3), (3, "", "z", 4), (4, "word " * 50_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, h int")
    bench = spark.createDataFrame([(9, ITEM, 1), (8, ITEM, 2), (7, None, 3), (6, "too short", 4), (None, ITEM, 5)], "item_id long, text string, doc_id int")
    assert {(r.doc_id, r.item_id) for r in dc.find_contamination(docs, bench).collect()} == {(1, 8)}
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.h for r in left.collect()) == [2, 3, 4, 5]
    assert dc.find_contamination(docs, bench.limit(0)).count() == 0 and dc.find_contamination(docs.limit(0), bench).count() == 0


def test_main_path_is_native(spark):
    docs, bench = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = dc.find_contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_items_that_share_windows_are_judged_each_by_itself(spark):
    first = "A farmer has 5 red apples and sells them for 5 green pears at the market before noon"
    second = first.replace("5 green", "7 green")
    short = "the quick brown fox jumps over lazy dogs"
    items = [(1, first), (2, second), (3, "long ago " + short + " that sleep all day beside an old stone wall"), (4, short)]
    docs = [(1, f"so {second} it goes"), (2, f"so {first} it goes"), (3, f"we saw {short} today"), (4, "nothing of that kind is in here at all you see")]
    assert _find(spark, docs, items) == {(1, 2), (2, 1), (2, 2), (3, 4)}
    assert _find(spark, docs, items, broadcast_rows=5) == {(1, 2), (2, 1), (2, 2), (3, 4)}


def test_names_that_start_sentences_are_slots(spark):
    item = "Tom has 3 apples. Sara has 5 pears. Tom buys 4 more. How many in all?"
    other = _swap(item, ("Tom", "Ben"), ("Sara", "Lily"), ("3", "6"), ("5", "8"), ("4", "9"))
    uneven = other.replace("Ben buys", "Max buys")
    docs = [(1, f"Here it is. {other} And so on."), (2, f"Here it is. {uneven} And so on."), (3, item), (4, "Tom has no apples and Sara has no pears. He buys more of them all. How many in the end?")]
    assert _find(spark, docs, [(1, item)]) == {(1, 1), (3, 1)}


def test_exact_copies_of_short_and_slot_dense_items(spark):
    items = [(1, "What is the capital of France?"), (2, "12 + 30 = 42, 7 + 8 = 15, 9 + 4 = 13"), (3, "Gone With The Wind And Other Old Stories Of The South"), (4, "Why do cats purr when they sleep at night?"), (5, "Photosynthesis")]
    docs = [
        (1, "Then he asked: what is the capital of France? Nobody knew."),
        (2, "see 12 + 30 = 42, 7 + 8 = 15, 9 + 4 = 13 there"),
        (3, "he read gone with the wind and other old stories of the south all day"),
        (4, "The question Why do cats purr when they sleep at night came up"),
        (5, "he wondered why do cats purr when they sleep at night"),
        (6, "plants live by photosynthesis"),
        (7, "What is the capital of Spain? 12 + 30 = 43, 7 + 9 = 15, 9 + 5 = 13. why do cats purr"),
        (8, "capital of France"),
    ]
    assert _find(spark, docs, items) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 5)}


def _plain_words(text):
    s = regex.sub(r"(?<=[^\s.!?:]\s)(\p{Lu}[\p{L}\p{M}'’-]*)", dc.NAME + r"\1", text)
    s = regex.sub(rf"(?<![\p{{L}}\p{{M}}\p{{N}}'’{dc.NAME}-])(\p{{Lu}}[\p{{L}}\p{{M}}'’-]*)", dc.FIRST + r"\1", s).lower()
    s = regex.sub(r"(\d+(?:[.,:/]\d+)*)", rf" {dc.NUMBER}\1 ", s)
    s = regex.sub(rf"({dc.NUMBER}\S+ ) ?({'|'.join(dc.UNITS)})\b", rf"\1{dc.UNIT}\2", s)
    return [w for w in regex.split(rf"(?:[^\p{{L}}\p{{M}}\p{{N}}{dc.NAME}-{dc.FIRST}.,:/]|(?<!\d)[.,:/]|[.,:/](?!\d))+", s) if w]


MARKS = (dc.NAME, dc.NUMBER, dc.UNIT, dc.FIRST)


def _bare(words):
    return [w[1:] if w[0] in MARKS else w for w in words]


def _form(words, names):
    return [(dc.NAME if names else "") + w[1:] if w[0] == dc.FIRST else w for w in words]


def _shapes(words):
    return [w[0] if w[0] in MARKS else w for w in words]


def _holds(doc, item):
    """Whether a document is contaminated by an item, by the definition: each form of the item against each form and shift of the document."""
    ours, theirs = _bare(doc), _bare(item)
    n, k = len(item), min(8, len(item))
    if k and any(ours[s : s + n] == theirs for s in range(len(ours) - n + 1)):
        return True
    if n < 8:
        return False
    for names in (False, True):
        own = _form(item, names)
        shape, many = _shapes(own), [w[0] in MARKS and own.count(w) > 1 for w in own]
        dense = [sum(w not in MARKS for w in shape[p : p + 8]) < 4 for p in range(n - 7)]
        for seen in (False, True):
            there = _shapes(_form(doc, seen))
            for shift in range(8 - n, len(doc) - 7):
                at, open_ = [], []
                for p in range(max(0, -shift), min(n - 7, len(doc) - shift - 7)):
                    a, b = slice(p, p + 8), slice(p + shift, p + shift + 8)
                    if ours[b] == (theirs[a] if dense[p] else shape[a]) or (not dense[p] and there[b] == shape[a]):
                        at.append(p)
                        open_ += [] if dense[p] else [p]
                most = dense.count(False)
                if len(at) >= min(3, len(dense)) or (most and len(open_) >= min(3, most)):
                    values = {}
                    for q in range(n):
                        if many[q] and any(p <= q < p + 8 for p in open_):
                            values.setdefault(own[q], set()).add(ours[q + shift])
                    if all(len(v) == 1 for v in values.values()):
                        return True
    return False


def test_templates_equal_brute_force(spark):
    """Items and documents with numbers, units and names: consistent and inconsistent copies, parts, twins, short items."""
    rng = random.Random(21)
    low = ["the", "farmer", "sells", "for", "at", "market", "and", "buys", "more", "with", "old", "green", "pears", "how", "many", "left"]
    names, units = ["Tom", "Sara", "Ben", "Lily"], ["km", "hours", "kg"]

    def words(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.15 else str(rng.randrange(2, 7)) if x < 0.3 else f"{rng.randrange(2, 5)} {rng.choice(units)}" if x < 0.35 else rng.choice(low) + rng.choice(["", "", "", ".", ","]))
        return " ".join(out)

    items = [(i, words(rng.choice([4, 8, 9, 12, 16]))) for i in range(24)]
    items += [(30 + i, _swap(items[i][1], ("2", "5"), ("Tom", "Ben"))) for i in range(6)]
    docs = []
    for d in range(120):
        x = rng.choice(items)[1]
        change = rng.sample([("2", "7"), ("3", "8"), ("Tom", "Max"), ("Sara", "Eve"), ("km", "miles"), ("5", "2")], rng.randrange(4))
        x = _swap(x, *change)
        if rng.random() < 0.3:  # one place of several
            x = x.replace(rng.choice(["3", "4", "Ben"]), "9", 1)
        if rng.random() < 0.2:
            x = " ".join(x.split()[2:])
        if rng.random() < 0.2:
            x = x.lower()
        docs.append((d, f"{words(rng.randrange(12))} {x if rng.random() < 0.8 else ''} {words(rng.randrange(12))}"))
    read = {i: _plain_words(t) for i, t in items}
    seen = {d: _plain_words(t) for d, t in docs}
    want = {(d, i) for d in seen for i in read if _holds(seen[d], read[i])}
    got = _find(spark, docs, items)
    assert len(want) > 60 and len({d for d, _ in want}) < 110
    assert got <= want and {d for d, _ in got} == {d for d, _ in want}
    assert all(any(e == d and j <= i for e, j in got) for d, i in want)  # of items that no document tells apart the first is named
    assert _find(spark, docs, items, broadcast_rows=50) == got
