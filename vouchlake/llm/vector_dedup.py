"""Near-duplicate embeddings by product quantisation.

Unit vectors go to the coarse list of their nearest centroid; what is left of a vector after its centroid is
coded in subspaces. Every vector then visits the lists of its nearest centroids: table look-ups give its
approximate cosine with each member, and what may reach the threshold is compared exactly. A code's error is
bounded by the length of what it leaves, kept with it, so the look-up never loses a pair; only the choice of
visited lists can. Pairs are counted where they are found, and only those that span a list's groups are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, checkpointed, connected_components, table, with_least
from .minhash_dedup import _forest

THRESHOLD = 0.9
#: Lists that a vector visits, and lists at most (about the square root of the number of vectors).
PROBES, MAX_LISTS = 12, 4096
#: The index is fitted on so many vectors at most, and so many numbers.
FIT_ROWS, FIT_NUMBERS = 20_000, 4_000_000
SUBSPACES, CODES = 8, 256
#: Members and visitors of a list that meet in one task's work.
BLOCK = 2048
MAX_DIMENSIONS = 64


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for j in range(x.shape[1]):
            c[n > 0, j] = np.bincount(near, x[:, j], len(c))[n > 0] / n[n > 0]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 1024] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


def _thinned(c: np.ndarray, apart: float) -> np.ndarray:
    """Centroids without those that are nearer than ``apart`` to an earlier one: a dense group stays in one list instead of many, of which a visitor would see a few."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or ((c[kept] - c[i]) ** 2).sum(axis=1).min() >= apart**2:
            kept.append(i)
    return c[kept]


class Index:
    """Coarse centroids and the codebooks of residual subspaces. Its size is bounded by MAX_LISTS, CODES and the dimension."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7, apart: float = 0.0):
        rng = np.random.default_rng(seed)
        self.coarse = _thinned(_kmeans(sample, lists, rng), apart)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))]
        self.books = [_kmeans(rest[:, p], CODES, rng) for p in self.parts]

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each unit vector, nearest first; ties go to the lower number."""
        score = (self.coarse * self.coarse).sum(axis=1) / 2 - x @ self.coarse.T
        return np.argsort(score, axis=1, kind="stable")[:, :probes]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and what they leave (a length) of unit vectors in their lists."""
        rest = x - self.coarse[lists]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def estimates(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of unit vectors with coded members of list ``at``, by table look-up."""
        out = np.repeat((q @ self.coarse[at])[:, None], len(codes), axis=1)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (q[:, p] @ b.T)[:, codes[:, j]]
        return out


def _doubles(column: pd.Series) -> np.ndarray:
    """Vectors of doubles, each scaled by a power of two (which changes no cosine, not even its rounding), so that squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar_pairs(vectors: DataFrame, dimension: int, rows: int, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """``(a, b, n)`` from ``vectors(id, n, v)`` (valid, of one dimension, ids distinct and not negative; n rows each).

    Pairs with cosine >= ``threshold`` are those where one visits the other's list. Rows with b = -1 give a number of
    rows that ``a`` is linked with, to be added up; the others are links that span what the pairs connect.
    """
    spark = vectors.sparkSession
    bound = max(1, min(FIT_ROWS, FIT_NUMBERS // dimension))
    rate = min(1.0, bound / rows)
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < rate * 1_000_000).orderBy(F.xxhash64("id", F.lit(5)), "id").select("v").limit(bound).toPandas() if rate < 1 else vectors.orderBy("id").select("v").limit(bound).toPandas()
    if not len(sample):
        sample = vectors.orderBy("id").select("v").limit(bound).toPandas()
    shared = spark.sparkContext.broadcast(Index(_unit(_doubles(sample["v"])), max(1, min(MAX_LISTS, round(rows**0.5))), apart=(2 - 2 * threshold) ** 0.5))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                x = _doubles(part["v"])
                u = _unit(x)
                near = index.lists(u, probes).astype(np.int32)
                codes, rest = index.encode(u, near[:, 0])
                common = {"id": part["id"].to_numpy(), "n": part["n"].to_numpy(), "home": near[:, 0], "x": [r.tobytes() for r in x]}
                yield pd.DataFrame({"list": near[:, 0], **common, "member": True, "codes": [c.tobytes() for c in codes], "rest": rest, "probes": [p.tobytes() for p in near]})
                for j in range(near.shape[1]):
                    yield pd.DataFrame({"list": near[:, j], **common, "member": False, "codes": None, "rest": 0.0, "probes": None})

    placed = checkpointed(vectors.mapInPandas(place, "list int, id long, n long, home int, member boolean, x binary, codes binary, rest double, probes binary"))
    n = placed.groupBy("list").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    n = n.where("m > 0").select("list", blocks("m").alias("mb"), blocks("q").alias("qb"))
    dealt = placed.join(F.broadcast(n), "list")  # MAX_LISTS rows at most
    own = lambda c: F.array(F.pmod(F.xxhash64("id"), F.col(c)).cast("int"))
    all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = dealt.withColumn("mb", F.explode(F.when(F.col("member"), own("mb")).otherwise(all_of("mb")))).withColumn("qb", F.explode(F.when(F.col("member"), all_of("qb")).otherwise(own("qb"))))

    def meet(g: pd.DataFrame) -> pd.DataFrame | None:
        index, own = shared.value, g["member"].to_numpy()
        if not own.any() or own.all():
            return None
        members, visitors = g[own], g[~own]
        x = np.frombuffer(b"".join(members["x"]), np.float64).reshape(len(members), -1)
        codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
        asked = np.frombuffer(b"".join(members["probes"]), np.int32).reshape(len(members), -1)
        ids, rest, norms, rows = members["id"].to_numpy(), members["rest"].to_numpy(), np.linalg.norm(x, axis=1), members["n"].to_numpy()
        hits, others = np.zeros((len(visitors), len(members)), bool), np.zeros(len(members), np.int64)
        for lo in range(0, len(visitors), 256):
            part = visitors.iloc[lo : lo + 256]
            y = np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), -1)
            maybe = index.estimates(_unit(y), int(g["list"].iloc[0]), codes) + rest >= threshold - 1e-9
            maybe &= part["id"].to_numpy()[:, None] != ids
            q, m = np.nonzero(maybe)
            home, theirs = part["home"].to_numpy(), part["n"].to_numpy()
            for k in range(0, len(q), 20_000):
                a, b = q[k : k + 20_000], m[k : k + 20_000]
                hit = np.einsum("ij,ij->i", y[a], x[b]) / (np.linalg.norm(y[a], axis=1) * norms[b]) >= threshold
                a, b = a[hit], b[hit]
                hits[lo + a, b] = True
                unseen = ~(asked[b] == home[a][:, None]).any(axis=1)  # a member that visits the visitor's list counts the pair there
                np.add.at(others, b[unseen], theirs[a[unseen]])
        far, near = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
        if not len(far):
            return None
        hits, f = hits[np.ix_(far, near)], len(far)

        def linked(i: int, left: np.ndarray) -> np.ndarray:
            out = np.zeros(len(left), bool)
            side = left >= f if i < f else left < f
            out[side] = hits[i, left[side] - f] if i < f else hits[left[side], i - f]
            return out

        names = np.r_[visitors["id"].to_numpy()[far], ids[near]]
        edges = np.array(_forest(linked, len(names))).reshape(-1, 2)
        both = names[edges[:, 0]], names[edges[:, 1]]
        own = np.r_[names[:f], ids[others > 0]], np.r_[hits @ rows[near], others[others > 0]]
        return pd.DataFrame({"a": np.r_[both[0], own[0]], "b": np.r_[both[1], np.full(len(own[0]), -1)], "n": np.r_[np.zeros(len(edges), np.int64), own[1]]})

    return by_runs(dealt.select("list", "mb", "qb", "id", "n", "home", "member", "x", "codes", "rest", "probes"), ["list", "mb", "qb"], meet, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row: how many others it is linked with (cosine at least ``threshold``), the smallest id reachable, and whether that is its own.

    Equal vectors are one class, linked for sure and searched once. A vector that is null, zero, empty, or holds
    a null, NaN or infinity links with nothing, as does a row without an id (component null, kept). Vectors of
    different dimensions have no cosine; each dimension (``MAX_DIMENSIONS`` at most) has an index of its own.
    Rows that repeat an id count as rows, each with its own vector. Other columns are not read. An empty table gives an empty result.
    """
    v = F.col(embedding).cast("array<double>")
    sound = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    base = vectors.select(F.col(id).alias("id"), v.alias("v"))
    keys = base.select("id", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("h2"), "v")
    classes = keys.where("sound").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).limit(MAX_DIMENSIONS + 1).collect()
    if len(sizes) > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")
    found = None
    for r in sorted(sizes):
        got = similar_pairs(classes.where(F.size("v") == r.d).select(F.col("class").alias("id"), "n", "v"), r.d, r.n, threshold, probes)
        found = got if found is None else found.unionByName(got)
    found = checkpointed(found if found is not None else vectors.sparkSession.createDataFrame([], "a long, b long, n long"))
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("others"))
    groups = connected_components(found.where("b >= 0").select("a", "b")).join(classes.select(F.col("class").alias("id"), "rep"), "id")
    groups = with_least(groups, "component", "rep", "root").select(F.col("id").alias("c"), "root")
    facts = classes.select("h1", "h2", "class", "rep", "n").join(counts, F.col("class") == F.col("a"), "left").join(groups, F.col("class") == F.col("c"), "left")
    facts = facts.select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component"), F.lit(True).alias("sound"))
    out = keys.drop("v").join(facts, ["sound", "h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x), c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.m, v.vec_id), v.vec_id) AS component_id, coalesce(least(c.m, v.vec_id), v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.x LEFT JOIN c ON v.vec_id = c.x"""
