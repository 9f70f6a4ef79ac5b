import random

import numpy as np
from pyspark.sql import functions as F

from vouchlake.llm import langid


def _plain_bundle(text, dim=langid.DIM, seed=langid.SEED):
    vector = lambda c, turn: np.roll(langid.letter_vector(c, dim, seed), turn).astype(int)
    codes = [0, *[ord(c) if c.isalpha() else 0 for c in text.lower()], 0]
    out = np.zeros(dim)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            out += vector(a, 2) * vector(b, 1) * vector(c, 0)
    return out


def test_bundles_equal_plain_ones(monkeypatch):
    texts = ["Hello, wörld! 12 x", "", None, "İstanbul ǅ 日本 Привет Γειά", "a", "no\u00a0break " * 40, "12 34"]
    for chunk, table, kinds in ((400_000, 100, 8192), (37, 100, 3), (400_000, 2, 8192)):
        monkeypatch.setattr(langid, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(langid, "TABLE_LETTERS", table)
        monkeypatch.setattr(langid, "KINDS", kinds)
        got = np.concatenate([b for _, b in langid.bundles(texts, langid.DIM, langid.SEED)])
        for t, b in zip(texts, got, strict=True):
            assert np.allclose(b, _plain_bundle(t or "")), t


def _corpus():
    rng = random.Random(5)
    words = {"en": ["the", "and", "thing", "with", "house", "from"], "de": ["und", "der", "schön", "haus", "mit", "für"], "fr": ["les", "été", "maison", "avec", "pour", "où"]}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(4, 60))), lang) for i, lang in enumerate(rng.choices(sorted(words), k=400))]


def test_held_out_accuracy(spark):
    rows = _corpus()
    got = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 60 < len(held) < 140
    assert sum(got[d].lang_pred == lang for d, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_and_sources_do_not_matter(spark):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = df.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in langid.identify_languages(x).collect()} for x in (df, other))
    assert a == b


def test_nulls_repeats_and_other_columns(spark):
    rows = [*[(d, t, lang, 1) for d, t, lang in _corpus()[:80]], (1000, None, "en", 2), (1001, "", "en", 3), (1002, "12 34 !!", None, 4), (None, "the house and the thing", "zz", 5), (1003, "the house " * 60_000, None, 6), (1003, "the house " * 60_000, None, 6)]
    out = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"))
    got = {(r.doc_id, r.lang_pred) for r in out.where("doc_id >= 1000 or doc_id is null").collect()}
    assert got == {(1000, "und"), (1001, "und"), (1002, "und"), (1003, "en"), (None, "en")} and out.count() == 86
    assert not out.where("doc_id is null").first().held_out
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify_languages(none).collect()] == [("und", 0.0)]
    assert langid.identify_languages(none.limit(0)).count() == 0


def test_fit_reads_no_more_than_its_bound(spark):
    df = spark.createDataFrame(_corpus(), "doc_id long, text string, lang string")
    langs, protos = langid.fit_prototypes(df, F.lit(True), fit_rows=20)
    assert langs == ["de", "en", "fr"] and np.allclose(np.linalg.norm(protos, axis=1), 1, atol=1e-5)


def test_predictions_equal_plain_ones(spark):
    """Prototypes and cosines by the definition, over all rows."""
    rows = _corpus()[:150]
    got = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    bundle = {d: _plain_bundle(t) for d, t, _ in rows}
    protos = {lang: sum(bundle[d] for d, _, x in rows if x == lang and not got[d].held_out) for lang in ("de", "en", "fr")}
    for d, _, _ in rows:
        cos = {lang: float(bundle[d] @ p / np.linalg.norm(bundle[d]) / np.linalg.norm(p)) for lang, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[d].lang_pred == best and abs(got[d].score - max(cos[best], 0)) < 1e-4


def test_languages_of_one_script_that_is_not_latin(spark):
    rng = random.Random(6)
    words = {"ru": ["что", "это", "был", "как", "они", "ещё", "чтобы", "только"], "uk": ["що", "це", "був", "як", "вони", "ще", "щоб", "тільки"], "zh": ["我们", "他们", "的话", "什么", "因为"], "ja": ["です", "ます", "から", "それ", "日本"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 40))), lang) for i, lang in enumerate(rng.choices(sorted(words), k=300))]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {d: x for d, _, x in rows}
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
