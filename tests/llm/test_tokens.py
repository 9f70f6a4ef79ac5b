import os
import random

import pytest

from vouchlake.llm import tokens

M = tokens.MARK


def _greedy(word, pieces):
    word, i, n = M + word, 0, 0
    longest = max(map(len, pieces))
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces and (i == 0 or not word[i:j].startswith(M)):
                break
        else:
            return 0
        i, n = j, n + 1
    return n


def test_equals_greedy_longest_match():
    rng = random.Random(8)
    for _ in range(150):
        pieces = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        pieces |= {M + p for p in pieces if rng.random() < 0.6} | ({M} if rng.random() < 0.5 else set())
        auto = tokens.Automaton(pieces)
        for _ in range(60):
            w = "".join(rng.choice("abcéd") for _ in range(rng.randrange(1, 14)))
            assert auto.count(w.encode()) == _greedy(w, pieces), (w, pieces)


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary")
def test_public_vocabulary():
    pieces = tokens.load_pieces()
    auto, own = tokens.Automaton(pieces), set(pieces)
    for w in ["hello", "internationalization", "Über", "日本語", "x" * 500, "don't", "12345", "▁▁a"]:
        assert auto.count(w.encode()) == _greedy(w, own), w


def test_counts_of_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 2)
    pieces = [M + "ab", M + "a", "b", "c", M + "c"]
    rows = [(1, "ab abc\tzz  a", 9), (2, "", 9), (3, None, 9), (4, "a b", 9), (4, "a b", 9), (5, "a" + "bc" * 100_000, 9)]
    out = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), pieces)
    got = sorted((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in out.collect())
    assert got == [(1, 4, 5, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 2, 2, 1), (4, 2, 2, 1), (5, 1, 200_000, 0)]
    assert tokens.count_tokens(spark.createDataFrame([], "text string"), pieces).count() == 0
