"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives every document of the source the same fractional number of copies. The
whole part is certain; the fractions are rounded in pairs: mass, counted in words, moves at random from one
document of the pair to the other until one fraction is 0 or 1, so the words taken stay equal to the target
while each fraction keeps its expectation. Documents are paired within hash leaves of a source; what a leaf
leaves over (one unit) goes up a reduction tree of fixed fan-in until a source has one left, which is
rounded alone. So a source's words miss its target by less than one unit: a document, or equal rows of one together.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, by_runs, checkpointed, table, whole_id

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Expected documents of a leaf, and leaves of a node of the reduction tree.
LEAF = 4096
FAN_IN = 256


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Target words by source: ``share`` of all words dealt by weight, none above ``cap`` times its source.

    Sources in code point order, null last, take the weights in turn. What lies above a cap is dealt again by
    weight among the others until none is above; if all are at their cap, the rest is not dealt.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _draw(*key) -> float:
    """A number in (0, 1) that depends on the key alone, so that reruns and retried tasks agree."""
    return (int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") + 0.5) / 2**64


def _pivot(rows, seed: int):
    """Round ``(unit, mass, p)`` of one source: yields (unit, taken fraction 0 or 1) and at last the one left over, as (unit, mass, p)."""
    held = None
    for doc, size, p in rows:
        if p <= 0.0 or p >= 1.0:
            yield doc, int(p >= 1.0)
        elif held is None:
            held = (doc, size, p)
        else:
            a, wa, pa = held
            up, down = min(wa * (1 - pa), size * p), min(wa * pa, size * (1 - p))  # words moved to a, or from it
            if _draw(seed, a, doc) * (up + down) < down:
                full, empty = wa * (1 - pa) <= size * p, size * p <= wa * (1 - pa)
                pa, p = (1.0 if full else pa + up / wa), (0.0 if empty else p - up / size)
            else:
                empty, full = wa * pa <= size * (1 - p), size * (1 - p) <= wa * pa
                pa, p = (0.0 if empty else pa - down / wa), (1.0 if full else p + down / size)
            held = None
            for x, w, q in ((a, wa, pa), (doc, size, p)):
                if q <= 1e-12 or q >= 1 - 1e-12:
                    yield x, int(q > 0.5)
                else:
                    held = (x, w, q)
    if held is not None:
        yield held


_OUT = "unit long, no_src boolean, src string, node long, mass long, p double, up int"


def _rounder(seed: int, last: bool):
    """Rounds a node: ``up`` is 0 or 1 for what is settled, -1 for the unit left over."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["mass", "unit"], kind="stable")
        out = []
        for r in _pivot(zip(g["unit"].tolist(), g["mass"].tolist(), g["p"].tolist(), strict=True), seed):
            if len(r) == 2:
                out.append((r[0], 0, 0.0, r[1]))
            elif last:
                out.append((r[0], 0, 0.0, int(_draw(seed, "last", r[0]) < r[2])))
            else:
                out.append((*r, -1))
        done = pd.DataFrame(out, columns=["unit", "mass", "p", "up"])
        return done.assign(**{c: g[c].iloc[0] for c in ("no_src", "src", "node")})[["unit", "no_src", "src", "node", "mass", "p", "up"]]

    return run


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17, leaf: int = LEAF, fan_in: int = FAN_IN, max_sources: int = 100_000) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for each row of ``docs(doc_id, text, source)``.

    ``size`` counts the words of the whole text (null text: 0); ``copies`` is between the whole part of target
    over source size and the next integer, so never above ``cap``; ``taken`` = copies * size. A null source is
    a source of its own. Documents without words get no copy. Rows that agree in doc_id, text and source are one unit,
    taken or left together (its mass is theirs together), so that no order among them matters; other rows of one
    doc_id, also a null one, are rounded each by itself. An empty table gives an empty result. Other columns are not read.
    The sources' totals (at most ``max_sources``, else ValueError) are the only rows that the driver gathers.
    """
    out = _units(docs, weights, share, cap, seed, leaf, fan_in, max_sources)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("__row")).drop("__row")


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """A row for each copy that the mixture takes: all columns of ``docs``, ``copy`` (from 1), ``size`` and its source's ``target``; columns of these names are replaced.

    Every row is taken as often as :func:`mix_sources` says, repeated rows each. Documents without a copy go.
    """
    taken = _units(docs, **options).where("copies > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("t").alias("__u"), F.col("size").alias("__size"), F.col("copies").alias("__copies"), F.col("target").alias("__target"))
    same = (F.col("__t") == F.col("__u")) & F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s"))
    both = docs.withColumn("__t", _text_hash()).join(taken, same)
    return both.select(*[F.col(c) for c in docs.columns if c not in ("copy", "size", "target")], F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("copy"), F.col("__size").alias("size"), F.col("__target").alias("target"))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").isNull(), "text")


def _units(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17, leaf: int = LEAF, fan_in: int = FAN_IN, max_sources: int = 100_000) -> DataFrame:
    """The rows of :func:`mix_sources`, one for each distinct (doc_id, text, source), with the text's hash ``t`` and ``rows``, how many there are."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(*whole_id("doc_id"), F.col("source").alias("src"), size.alias("size"), _text_hash().alias("t"))
    base = base.groupBy("doc_id", "no_id", "src", "size", "t").agg(F.count("*").alias("rows"))
    base = checkpointed(base.withColumns({"unit": F.xxhash64("doc_id", "no_id", "t", "src"), "mass": F.col("size") * F.col("rows")}))  # thin: some numbers and a name for each document
    got = base.groupBy("src").agg(F.sum("mass").alias("s"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r.src: r.s for r in got}
    t = targets(sizes, weights, share, cap)
    facts = spark.createDataFrame([(s, sizes[s], float(t[s])) for s in sizes], "s string, source_size long, target double")
    each = base.join(F.broadcast(facts), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    each = each.withColumns({"whole": F.when(F.col("size") > 0, whole).otherwise(0).cast("int"), "p": F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(0.0)})

    rows = sum(r.n for r in got)
    nodes = 1
    while nodes * leaf < rows:
        nodes *= fan_in
    open_ = each.where("p > 0").select("unit", F.col("src").isNull().alias("no_src"), F.coalesce("src", F.lit("")).alias("src"), F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(nodes)).alias("node"), "mass", "p")
    done, level = None, 0
    while True:
        out = checkpointed(by_runs(open_, ["no_src", "src", "node"], _rounder(seed + level, nodes == 1), _OUT))
        settled = out.where("up >= 0").select("unit", F.when(~F.col("no_src"), F.col("src")).alias("src"), "up")
        done = settled if done is None else done.unionByName(settled)
        if nodes == 1:
            break
        nodes, level = max(1, nodes // fan_in), level + 1
        open_ = out.where("up < 0").select("unit", "no_src", "src", F.pmod("node", F.lit(nodes)).alias("node"), "mass", "p")
    done = done.select(F.col("unit").alias("u"), F.col("src").alias("s"), "up").groupBy("u", "s").agg(F.max("up").alias("up"))
    both = each.join(done, (F.col("unit") == F.col("u")) & F.col("src").eqNullSafe(F.col("s")), "left")
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    own = F.when(~F.col("no_id"), F.col("doc_id"))
    return both.select(own.alias("doc_id"), F.col("src").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "t", "rows")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")
