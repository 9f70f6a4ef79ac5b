"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes; pieces that begin a word and pieces that continue one have
roots of their own. Each node has a failure link (where greedy longest match goes on when the trie has no
child for the next byte) and the number of pieces that this step pops, both computed once, breadth first.
A word is then counted in one pass over its bytes, without building any piece. A word that cannot be cut into
pieces is one unknown token, as in word-piece tokenization.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark with which a piece begins a word.
MARK = "▁"
#: Words up to this length are remembered, so many at a time.
MEMO_BYTES, MEMO_WORDS = 48, 200_000


def load_pieces(path: str = TOKENIZER) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces. Read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Automaton:
    """goto: (node << 8 | byte) -> node; fail: node or -1; pops: pieces popped when a failure link is taken."""

    START, CONTINUE = 0, 1

    def __init__(self, pieces: Iterable[str], mark: str = MARK):
        self.goto: dict[int, int] = {}
        ends, depth = [False, False], [[0, 1]]
        for p in sorted(set(pieces) - {""}):
            begins = p.startswith(mark)
            node = self.START if begins else self.CONTINUE
            for d, b in enumerate(p[len(mark) if begins else 0 :].encode()):
                key = node << 8 | b
                if key not in self.goto:
                    self.goto[key] = len(ends)
                    ends.append(False)
                    if len(depth) == d + 1:
                        depth.append([])
                    depth[d + 1].append((len(ends) - 1, node, b))
                node = self.goto[key]
            ends[node] = node > 1 or ends[node]
            self.bare = getattr(self, "bare", False) or p == mark
        # the bare mark is a piece of its own: a word may start with it and go on with continuing pieces
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        if self.bare:
            self.fail[self.START], self.pops[self.START] = self.CONTINUE, 1
        for level in depth[1:]:
            for node, parent, b in level:
                if ends[node]:
                    self.fail[node], self.pops[node] = self.CONTINUE, 1
                    continue
                z, n = self.fail[parent], self.pops[parent]
                while z >= 0 and (z << 8 | b) not in self.goto:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.pops[node] = self.goto[z << 8 | b], n

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it cannot be cut into pieces."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node, n = self.START, 0
        for b in word:
            to = goto.get(node << 8 | b)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
                to = goto.get(node << 8 | b)
            node = to
        while node != self.CONTINUE:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def token_counts(spark: SparkSession, text: Column, pieces: list[str]) -> Column:
    """A struct of ``n_words``, ``n_tokens`` and ``n_unknown`` (words that are one unknown token) for a column of texts; null counts as empty.

    Words are runs of bytes that are not ASCII white space. The automaton is broadcast: its size is the vocabulary's.
    """
    shared = spark.sparkContext.broadcast(Automaton(pieces))

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto, memo = shared.value, {}
        for s in texts:
            out = []
            for t in s.tolist():
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                tokens = unknown = 0
                for w in words:
                    n = memo.get(w)
                    if n is None:
                        n = auto.count(w)
                        if len(w) <= MEMO_BYTES:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            memo[w] = n
                    if n:
                        tokens += n
                    else:
                        unknown += 1
                out.append((len(words), tokens + unknown, unknown))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"])

    return count(text)


def count_tokens(docs: DataFrame, pieces: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the three counts of :func:`token_counts`; columns of these names are replaced."""
    name = "__tokens"
    out = docs.withColumn(name, token_counts(docs.sparkSession, F.col(text), pieces))
    return out.withColumns({c: F.col(f"{name}.{c}") for c in ("n_words", "n_tokens", "n_unknown")}).drop(name)


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, load_pieces(tokenizer)).drop("text")
