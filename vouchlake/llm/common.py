"""What several corpus operators share: tables, checkpoints, connected components."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Jobs that run inside hand Python workers so many rows at a time at most, since texts can be long; the session's own setting holds again behind it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def whole_id(name: str) -> tuple[Column, Column]:
    """An id as a long that is never null, and whether it was, as ``no_id``: pandas turns longs beside nulls into doubles, which end at 2^53."""
    return F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name), F.col(name).cast("long").isNull().alias("no_id")


def numbered_texts(docs: DataFrame) -> DataFrame | None:
    """For ``docs(doc_id, text)`` in which a doc_id has several texts: ``(doc_id, t, seq)``, a number for each text (hash t) in the order of doc_id and hash. None if no doc_id has; that is one thin aggregation."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not named.groupBy("doc_id").count().where("count > 1").limit(1).count():  # reads the ids alone
        return None
    names = named.select("doc_id", F.xxhash64("text").alias("t"))
    if not names.groupBy("doc_id").agg((F.min("t") != F.max("t")).alias("several")).where("several").limit(1).count():
        return None
    # partitions by range, sorted, and written before they are numbered
    laid = checkpointed(names.distinct().repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t"))
    return checkpointed(laid.withColumn("seq", F.monotonically_increasing_id()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges of a task of a round of :func:`connected_components`, at least: rounds over few edges take few tasks and files.
ROUND_ROWS = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``: component is the smallest id reachable.

    Alternating large-star and small-star rounds: each is a grouped minimum (combined before the shuffle)
    and an equi-join that adaptive execution may split on a hub. Edges stay distributed; the driver sees a
    row count and a checksum per round. Nulls and self-loops are ignored; an empty input gives an empty result.
    """
    e = checkpointed(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, parts = None, max(1, -(-e.count() // ROUND_ROWS))
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(parts))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def with_least(rows: DataFrame, by: str, value: str, name: str, salts: int = 32) -> DataFrame:
    """``rows`` with ``name``: the least ``value`` of the rows that agree in ``by``. Minima are combined before their shuffle; the join deals a group over ``salts`` keys, since one group may hold a third of all rows."""
    least = rows.groupBy(by).agg(F.min(value).alias(name)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(least, [by, "__salt"]).drop("__salt")


def runs(batches, keys: list[str]):
    """Pandas frames of the runs of equal ``keys`` in a sorted stream of batches; only the open run is held. Keys are never null."""
    import numpy as np
    import pandas as pd

    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        at = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            at[1:] |= v[1:] != v[:-1]
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        cuts = [0, *np.flatnonzero(at).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = pdf.iloc[a:b]
            if b < len(pdf):
                yield pd.concat([*held, piece], ignore_index=True) if held else piece
                held = []
            else:
                held.append(piece)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def by_runs(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(frame)`` (a frame or None) for each group of equal ``keys``, streamed over partitions sorted by them: cheaper than a grouped map for many small groups."""
    import pandas as pd

    def run(batches):
        out, n = [], 0
        for group in runs(batches, keys):
            got = fn(group)
            if got is not None and len(got):
                out.append(got)
                n += len(got)
                if n >= 10_000:
                    yield pd.concat(out, ignore_index=True)
                    out, n = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
