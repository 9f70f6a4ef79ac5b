"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is its letters' vectors, permuted (rotated) by their
place and bound (multiplied); a text is the bundle (sum) of its trigrams, and a language the bundle of its
texts. A text gets the language whose prototype has the highest cosine. A bundle is linear in trigram counts,
so each batch counts trigrams first and multiplies the counts with the vectors of the trigrams it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIM = 1024
SEED = 4242
#: The fit takes so many labelled rows of each language at most (about; chosen by a hash of the id).
FIT_ROWS = 10_000
MAX_LANGUAGES = 1_000
#: Bounds of what is worked on at once, in letters and documents; of letters whose trigrams are counted in a table; and of letter vectors that are kept.
CHUNK_CHARS, CHUNK_DOCS = 400_000, 256
TABLE_LETTERS, KEPT_VECTORS = 100, 20_000
#: Trigrams whose vectors are made at once.
KINDS = 8192


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point itself, if it is a letter, else 0: everything but letters is one sign."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int32)


_VECTORS: dict[tuple[int, int, int], np.ndarray] = {}


def letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    """The random vector of a letter: every letter of every script has its own, drawn from its code point."""
    key = (code, dim, seed)
    if key not in _VECTORS:
        if len(_VECTORS) >= KEPT_VECTORS:
            _VECTORS.clear()
        _VECTORS[key] = np.random.default_rng([seed, code]).choice(np.array([-1, 1], np.int8), dim)
    return _VECTORS[key]


def _vectors(grams: np.ndarray, alphabet: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The vectors of trigrams: numbers to the base of the alphabet's size."""
    n = len(alphabet)
    base = np.stack([letter_vector(int(c), dim, seed) for c in alphabet])
    out = np.roll(base, 2, axis=1)[grams // (n * n)] * np.roll(base, 1, axis=1)[grams // n % n]
    out *= base[grams % n]
    return out.astype(np.float32)


def _counts(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of the parts, the alphabet they are written in, and a row of their counts for each part. A part's first and last letter are no trigram's middle."""
    letters = _letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.array([len(p) for p in parts])
    doc = np.repeat(np.arange(len(parts)), sizes)
    inner = letters > 0
    inner[np.cumsum(sizes) - sizes] = inner[np.cumsum(sizes) - 1] = False
    there = np.bincount(letters) > 0
    there[0] = True
    alphabet, rank = np.flatnonzero(there), np.cumsum(there) - 1
    codes, n = rank[letters], len(alphabet)
    middle = np.flatnonzero(inner)
    gram = (codes[middle - 1] * n + codes[middle]) * n + codes[middle + 1]
    if n <= TABLE_LETTERS:
        seen = np.bincount(gram, minlength=n**3) > 0
        kinds = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1)[gram]
    else:
        kinds, place = np.unique(gram, return_inverse=True)
    return kinds, alphabet, np.bincount(doc[middle] * len(kinds) + place, minlength=len(parts) * len(kinds)).reshape(len(parts), len(kinds)).astype(np.float32)


def _pieces(text: str) -> list[str]:
    """The text in lower case with a space on either side; a very long one in parts that overlap, so that each trigram is counted once."""
    padded = f" {text.lower()} "
    return [padded[i : i + CHUNK_CHARS + 2] for i in range(0, len(padded) - 2, CHUNK_CHARS)]


def bundles(texts: list, dim: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first index, bundles) of runs of whole texts in order; null counts as empty."""
    at, start, held, owner = 0, 0, [], []

    def flush() -> np.ndarray:
        out = np.zeros((at - start, dim), np.float32)
        size, i = 0, 0
        while i < len(held):
            j, size = i, 0
            while j < len(held) and (j == i or size + len(held[j]) <= CHUNK_CHARS) and j - i < CHUNK_DOCS:
                size, j = size + len(held[j]), j + 1
            kinds, alphabet, n = _counts(held[i:j])
            for k in range(0, len(kinds), KINDS):
                np.add.at(out, np.array(owner[i:j]) - start, n[:, k : k + KINDS] @ _vectors(kinds[k : k + KINDS], alphabet, dim, seed))
            i = j
        return out

    size = 0
    for t in texts:
        for p in _pieces(t or ""):
            held.append(p)
            owner.append(at)
            size += len(p)
        at += 1
        if size >= CHUNK_CHARS or at - start >= CHUNK_DOCS:
            yield start, flush()
            start, held, owner, size = at, [], [], 0
    if at > start:
        yield start, flush()


def fit_prototypes(docs: DataFrame, labelled: Column, dim: int = DIM, seed: int = SEED, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit prototypes, from the rows of ``docs(doc_id, text, lang)`` where ``labelled`` holds.

    Null texts and null languages teach nothing. At most about ``fit_rows`` rows of a language are read,
    chosen by a hash of doc_id; sums are made on the executors, and the driver gets ``dim`` numbers a language.
    """
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, dim), np.float32)
    rate = F.create_map(*[F.lit(x) for s in langs for x in (s, min(1.0, fit_rows / sizes[s]))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for at, b in bundles(pdf["text"].tolist(), dim, seed):
                own = pdf["lang"].iloc[at : at + len(b)].to_numpy()
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0.0) + b[own == lang].sum(axis=0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [list(v) for v in sums.values()]})

    each = rows.select("text", "lang").mapInPandas(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    protos = np.zeros((len(langs), dim))
    for r in each.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        protos[langs.index(r.lang), r.i] = r.x
    return langs, (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def language_of(text: Column, langs: list[str], protos: np.ndarray, seed: int = SEED) -> Column:
    """A struct of ``lang_pred`` and ``score`` (the cosine, 0 at least) for a column of texts.

    A null text, one without a letter, and any text if no language was learned get ``und`` and 0. Ties go to
    the language that comes first in code point order.
    """
    dim = protos.shape[1]

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            pred, score = np.full(len(s), "und", object), np.zeros(len(s))
            for at, b in bundles(s.tolist(), dim, seed):
                norm = np.linalg.norm(b, axis=1)
                if langs:
                    cos = (b @ protos.T) / np.maximum(norm, 1e-9)[:, None]
                    best, known = cos.argmax(axis=1), norm > 0
                    where = at + np.flatnonzero(known)
                    pred[where] = np.array(langs, object)[best[known]]
                    score[where] = np.clip(cos.max(axis=1)[known], 0.0, 1.0)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return predict(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; learned from the rows that are not held out and have an id.

    Columns of these names are replaced. Repeated rows get equal results; an empty table gives an empty one.
    """
    langs, protos = fit_prototypes(docs, ~held_out() & F.col("doc_id").isNotNull(), dim, seed, fit_rows)
    name = "__language"
    return docs.withColumn(name, language_of(F.col("text"), langs, protos, seed)).withColumns({"held_out": held_out(), "lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")
