import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from vouchlake.llm import minhash_dedup, mixing

from .test_line_dedup import _brute as lines_left
from .test_minhash_dedup import _brute as groups


def _corpus(tmp_path, spark):
    rng = random.Random(9)
    words = {"en": ["the", "and", "thing", "with", "house", "from", "would", "there"], "de": ["und", "der", "schön", "haus", "mit", "für", "nicht", "wenn"]}
    item = "Which of the seven old houses near the river would still be standing there after nine long winters"
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en", "ing"]) for _ in range(rng.randrange(10, 40))) for _ in range(rng.randrange(1, 5))]
        if i % 10 == 0:
            lines[0] = lines[0] + " " + item
        rows.append((i, "\n".join(lines), lang, rng.choice(["a", "b", None]), 0))
    rows += [(200, rows[3][1], "en", "a", 0), (201, "12 34 !!", "en", "a", 0), (202, None, "en", "b", 0), (203, rows[5][1].replace(" ", "  ") + " tail", "de", "b", 0)]
    rows = [(d, t, g, s, len(t or "")) for d, t, g, s, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return {r[0]: r[1] for r in rows}, item


def test_stages_equal_brute_force_and_run_chains_them(spark, tmp_path):
    texts, item = _corpus(tmp_path, spark)
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"out{k}"))
        if name != "mixing":
            columns = columns or before.columns
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        now = {r.doc_id: r.text for r in docs.collect()} if name != "mixing" else None
        if name == "language_id":
            assert set(texts) - set(now) == {201, 202}
        elif name == "line_dedup":
            left = lines_left(texts)
            assert now == {d: t for d, t in left.items() if t.strip()} and 200 not in now
        elif name == "minhash_dedup":
            assert set(now) == {d for d, (_, c) in groups(texts, 5, 80).items() if c == d}
        elif name == "decontamination":
            assert set(now) == {d for d, t in texts.items() if item not in t} and len(now) < len(texts)
        else:
            copies = {(r.doc_id, r.copies) for r in mixing.mix_sources(before).where("copies > 0").collect()}
            assert {(r.doc_id, r["count"]) for r in docs.groupBy("doc_id").count().collect()} == copies
            for source, target, taken in docs.groupBy("source").agg(F.first("target"), F.sum("size")).collect():
                assert abs(target - taken) < 200
            final = {(r.doc_id, r.text, r.copy) for r in docs.collect()}
        texts = now
    assert {(r.doc_id, r.text, r.copy) for r in cp.run(spark, str(tmp_path)).collect()} == final


def test_mixing_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, "k"), (2, "d e", None, 8, "l")], "doc_id long, text string, source string, copies int, whole string")
    out = cp.mix(spark, docs, "")
    assert {"copies", "whole", "copy", "size", "target"} <= set(out.columns) and {r.copies for r in out.collect()} <= {7, 8}
    assert minhash_dedup.drop_near_duplicates(docs).columns == docs.columns


def test_texts_in_no_learned_language_are_rejected(spark, tmp_path):
    rng = random.Random(4)
    texts, _ = _corpus(tmp_path, spark)
    rows = [(d, t, "en" if d % 2 else "de") for d, t in texts.items() if d < 200]
    russian = "она вошла в комнату где он уже сидел у окна и читал старую книгу о далёких странах".split()
    letters = {"cyrillic": None, "chinese": [chr(c) for c in range(0x4E00, 0x5E00)], "gibberish": "bcdfgjkmpqvxz"}
    for k, kind in enumerate(letters):
        for i in range(40):
            words = [rng.choice(russian) if kind == "cyrillic" else "".join(rng.choice(letters[kind]) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(10, 60))]
            rows.append((1000 + 100 * k + i, " ".join(words), None))
    rows.append((5000, "the house with the thing", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in cp.keep_known_languages(spark, docs, "").collect()}
    assert {d for d in texts if d < 200} | {5000} <= kept
    assert len([d for d in kept if 1000 <= d < 5000]) <= 1
