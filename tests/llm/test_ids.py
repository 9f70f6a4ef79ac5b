"""Ids that doubles cannot hold, beside null ones; doc_ids with several texts; empty tables: every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from vouchlake.llm import chat, decontamination, langid, line_dedup, minhash_dedup, mixing, span_dedup, tokens, url_filter, vector_dedup

A, B, C = 2**60 + 1, 2**60 + 3, 2**60 + 5
DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, unit int, row int, node string"
#: Words that make distinct texts of one language.
WORDS = ["the", "and", "thing", "with", "house", "from", "would", "there", "seven", "river"]


def _text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", 1, 2, "y") for d, t, s in rows], DOCS)


def test_line_dedup_keeps_texts_of_one_id_apart(spark):
    x, y, z = _text(1), _text(2), _text(3)
    rows = [(A, f"{x}\n{y}", "s"), (B, f"{z}\n{x}", "s"), (B, f"{y}\n{z} tail of it", "s"), (None, x, "s"), (C, None, "s")]
    out = line_dedup.dedup_lines(_docs(spark, rows))
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (A, f"{x}\n{y}") in got and (None, x) in got and (C, None) in got
    left = [t for d, t in got if d == B]
    assert len(left) == 2 and all(x not in t and y not in t for t in left) and out.columns[:9] == _docs(spark, rows).columns


def test_minhash_dedup_compares_rows(spark):
    a, b = _text(4), _text(5)
    rows = [(A, a, "s"), (A, b, "s"), (B, a + " zz", "s"), (C, b + " zz", "s"), (None, a, "s")]
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(_docs(spark, rows), 3, 85).collect()), key=str)
    assert got == sorted([(A, A, True), (A, A, True), (B, A, False), (C, A, False), (0, None, True)], key=str)
    left = {(r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(_docs(spark, rows)).collect()}
    assert left == {(A, a), (A, b), (None, a)}
    # of a doc_id with two texts only the repeated one goes
    rows = [(A, a, "s"), (B, a + " zz", "s"), (B, b, "s")]
    assert {(r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(_docs(spark, rows)).collect()} == {(A, a), (B, b)}


def test_span_dedup_on_large_ids(spark):
    p, q = _text(6, 80), _text(7, 80)
    rows = [(A, p, "s"), (B, "xx" + p, "s"), (None, p, "s"), (C, q, "s"), (C, "yy" + q + p, "s")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in span_dedup.cut_repeats(_docs(spark, rows)).collect())
    n, m = len(p), len(q)
    either = [(C, m, 0), (C, 2 + m + n, m + n)], [(C, m, m), (C, 2 + m + n, n)]
    base = [(0, n, 0), (A, n, 0), (B, n + 2, n)]
    assert got in [sorted(base + e) for e in either]


def test_mixing_rounds_rows(spark):
    rows = [(A, _text(8, 40), "s"), (B, _text(9, 30), "s"), (B, _text(10, 20), "s"), (None, _text(11, 50), "s"), (None, _text(12, 10), "s"), (C, "a b c", None)]
    got = mixing.mix_sources(_docs(spark, rows)).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, A, B, B, C]
    one = [r for r in got if r.source == "s"]
    assert {r.source_size for r in one} == {150} and abs(sum(r.taken for r in one) - one[0].target) < 50
    copies = mixing.take_copies(_docs(spark, rows)).collect()
    assert len(copies) == sum(r.copies for r in got)


def test_repeated_rows_are_taken_each(spark):
    rows = [(A, "a b c d", "s")] * 3 + [(B, "e f", "s")]
    got = mixing.mix_sources(_docs(spark, rows)).collect()
    assert len(got) == 4 and len({(r.doc_id, r.copies) for r in got}) == 2 and {r.source_size for r in got} == {14}
    copies = mixing.take_copies(_docs(spark, rows)).collect()
    assert sum(len(r.text.split()) for r in copies) == sum(r.taken for r in got)


def test_chat_format_on_large_ids(spark):
    rows = [(A, 2**60 + 7, "user", "q"), (B, 2**60 + 9, "user", "r"), (None, None, "user", "n"), (A, 2**60 + 8, "assistant", "a")]
    got = {(r.conv_id, r.turn, r.inserted) for r in chat.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(A, 2**60 + 7, ""), (A, 2**60 + 8, ""), (B, 2**60 + 9, ">assistant"), (None, None, ">assistant")}


def test_the_others_on_large_ids(spark):
    item = "which of the seven old houses near the long river would still be standing there"
    rows = [(A, _text(13), "s"), (B, f"so {item} indeed", "s"), (B, _text(14), "s"), (None, item, "s"), (C, None, "s")]
    docs, bench = _docs(spark, rows), spark.createDataFrame([(A, item, "k")], "item_id long, text string, doc_id string")
    assert [tuple(r)[:2] for r in decontamination.find_contamination(docs, bench).collect()] == [(B, A)]
    for out in (langid.identify_languages(docs), tokens.count_tokens(docs, ["\u2581the", "\u2581", "t", "h", "e"])):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, A, B, B, C]
    vectors = spark.createDataFrame([(A, [1.0, 0.0]), (B, [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.component_id) for r in vector_dedup.near_vectors(vectors).collect() if r.vec_id) == [(A, A), (B, A)]
    pages = spark.createDataFrame([(A, "http://a.com/fr/"), (None, None), (B, "http://x.org/")], "page_id long, url string")
    judged = url_filter.judge_urls(pages, url_filter.RULES, spark.createDataFrame([], "key string"))
    assert {(r.page_id, r.rule) for r in judged.collect()} == {(A, "com/fr/"), (None, None), (B, "org/")}


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_odd_and_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, "which of the seven old houses near the long river would still be standing there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(A, _text(20), "s"), (A, _text(20), "s"), (B, _text(21), None), (B, _text(22), "s"), (None, _text(23), "s"), (None, None, None), (C, None, "s"), (C + 2, "", "s"), (C + 4, _text(24, 3000), "s")]
    docs = _docs(spark, rows)
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert {r.doc_id for r in got} <= {A, B, C, C + 2, C + 4, None} and {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}
    if name != "mixing":
        assert out.columns == docs.columns and {r.text for r in got} >= {_text(k) for k in (20, 21, 22, 23)} | {_text(24, 3000)}
    none = stage(spark, docs.where(F.lit(False)), str(tmp_path))
    assert none.count() == 0 and none.columns == out.columns
