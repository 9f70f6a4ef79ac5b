"""URL filters by a Bloom filter cascade, in DataFrame operations only.

A cascade holds a list exactly, relative to a known universe of keys: level 1 is a Bloom filter of the listed
keys, level 2 one of the universe's keys that level 1 takes for listed, level 3 one of the listed keys that
level 2 takes for false, and so on until no key is mistaken. A key is listed if the first level that rejects
it is an even one. Level 1 is sized by the ratio of universe to list, so that each later level has about as
many keys as the list or fewer: the whole cascade grows with the list and the logarithm of the corpus,
and its size is checked before it is put into the plan, one binary value a level. A list whose cascade would be larger
is split by a hash of the key, and its parts are judged one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Rules of the registered query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The registered query's list of blocked hosts: those whose MD5 starts with one of these digits.
LISTED_DIGITS = ("0", "1")


#: Bits of a cascade in a plan, at most, and words of a filter that come to the driver in one row.
MAX_BITS, ROW_WORDS = 1 << 26, 4096


@dataclass(frozen=True)
class Cascade:
    """Levels as (bytes of the filter, hash functions, seed)."""

    levels: list[tuple[bytes, int, int]] = field(default_factory=list)

    @property
    def bits(self) -> int:
        return sum(8 * len(filt) for filt, _, _ in self.levels)

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed. Null keys are not."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            found = F.when(_passes(key, *self.levels[k]), found).otherwise(F.lit(k % 2 == 1))
        return F.coalesce(key.isNotNull() & found, F.lit(False))


def _bit(key: Column, words: int, i: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(words * 64))


def _passes(key: Column, filt: bytes, hashes: int, seed: int) -> Column:
    """Whether all bits of a key are set; words are in order, each with its highest byte first."""
    out, whole = F.lit(True), F.lit(filt)
    for i in range(hashes):
        bit = _bit(key, len(filt) // 8, i, seed)
        at = F.floor(bit / 64) * 8 + 8 - F.floor(F.pmod(bit, F.lit(64)) / 8)
        byte = F.conv(F.hex(F.substring(whole, at.cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> tuple[bytes, int, int]:
    """A Bloom filter of ``keys(key)`` with ``n`` rows: grouped bit_or per 64-bit word, combined before the shuffle, and written out as hex, ROW_WORDS words a row."""
    hashes = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), words, i, seed) for i in range(hashes)])).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))
    got = bits.select(F.floor(F.col("bit") / 64).alias("w"), one.alias("x")).unionByName(keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("x")))
    got = got.groupBy("w").agg(F.bit_or("x").alias("x")).groupBy(F.floor(F.col("w") / ROW_WORDS).alias("r"))
    rows = got.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: F.lpad(F.hex(s["x"]), 16, "0")), "").alias("h")).collect()  # a row for ROW_WORDS words; build_cascade has checked their number
    return b"".join(bytes.fromhex(r.h) for r in sorted(rows, key=lambda r: r.r)), hashes, seed


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, max_levels: int = 40) -> Cascade:
    """A cascade for ``listed(key)``, exact on ``universe(key)`` and on the list itself.

    Nulls are ignored, repeated keys count once; an empty list gives a cascade that contains nothing.
    Raises ValueError before any filter larger than ``max_bits`` is gathered; :func:`listed_keys` splits such lists.
    """
    both = listed.select("key", F.lit(True).alias("l")).unionByName(universe.select("key", F.lit(False).alias("l")))
    both = checkpointed(both.where("key is not null").groupBy("key").agg(F.max("l").alias("l")))
    size = {r.l: r.n for r in both.groupBy("l").agg(F.count("*").alias("n")).collect()}
    r, s = size.get(True, 0), size.get(False, 0)
    out, turn = Cascade(), True
    while size.get(turn, 0):
        k = len(out.levels)
        if k == max_levels:
            raise RuntimeError("the cascade did not end")
        rate = min(0.5, r * math.sqrt(0.5) / max(s, 1)) if k == 0 else 0.5
        if out.bits - size[turn] * math.log(rate) / math.log(2) ** 2 > max_bits:
            raise ValueError(f"a cascade of {size[turn]} keys exceeds {max_bits} bits")
        level = _level(both.where(F.col("l") == turn), size[turn], rate, k + 1)
        out.levels.append(level)
        # the keys of this level stay as they are; of the others those that it takes for its own
        both = checkpointed(both.where((F.col("l") == turn) | _passes(F.col("key"), *level)))
        size = {x.l: x.n for x in both.groupBy("l").agg(F.count("*").alias("n")).collect()}
        turn = not turn
    return out


def listed_keys(rows: DataFrame, key: str, listed: DataFrame, name: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with a boolean ``name``: whether its ``key`` is in ``listed(key)``. One cascade, or as many as keep each below ``max_bits``, by a hash of the key; the rows are then written once for each."""
    universe = rows.select(F.col(key).alias("key"))
    r = listed.where("key is not null").distinct().count()
    s = universe.where("key is not null").distinct().count()
    # the first level by its rate, each later one of about as many keys as the list at a half
    bits = r * (max(1.0, math.log2(max(s, 1) / max(r, 1) + 1) + 0.5) + 4) / math.log(2)
    parts = max(1, math.ceil(2 * bits / max_bits)) if bits > max_bits / 2 else 1
    if parts == 1:
        return rows.withColumn(name, build_cascade(listed, universe, max_bits).contains(F.col(key)))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(77)), F.lit(parts))
    out = rows.withColumn(name, F.lit(False))
    for p in range(parts):
        mine = part(F.col("key")) == p
        cascade = build_cascade(listed.where(mine), universe.where(mine), max_bits)
        out = checkpointed(out.withColumn(name, F.when(part(F.col(key)) == p, cascade.contains(F.col(key))).otherwise(F.col(name))))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first ``://`` up to ``/ ? #``, A-Z lowered; path: from there up to ``? #``. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every rule key that could fit: the host and its parent domains, each with the path's prefixes of the rules' lengths."""
    labels = F.split(host, r"\.")
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))]), lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed_hosts: DataFrame, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Three cascades, each exact on all keys that the corpus has: the allow rules and the block rules (keys are
    host and path prefix), and ``listed_hosts(key)``. The longest rule of either list decides; a url that no
    rule fits is blocked if its host is listed, else allowed. A rule in both lists blocks.

    Null urls and urls without ``://``: empty host and path, no rule, allow. Repeated pages give repeated rows;
    an empty table an empty one. Columns of the input called like a result are replaced.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    lengths = [len(p) for _, _, p in rules]
    split = pages.withColumns({"host": host, "path": path})
    # hosts and path prefixes are deduplicated before the candidate keys are built
    prefix = F.substring("path", 1, max([0, *lengths]))
    parts = split.select("host", prefix.alias("p")).distinct()
    keys = parts.select(F.explode(candidates(F.col("host"), F.col("p"), lengths)).alias("key")).distinct() if rules else parts.select(F.col("host").alias("key")).limit(0)
    keys = checkpointed(keys)
    cascades = {}
    for verdict in ("allow", "block"):
        own = [h + p for v, h, p in rules if v == verdict]
        values = F.array(*[F.lit(x) for x in own]) if own else F.array().cast("array<string>")
        cascades[verdict] = build_cascade(spark.range(1).select(F.explode(values).alias("key")), keys, max_bits)
    split = listed_keys(split, "host", listed_hosts, "__listed", max_bits)
    tried = candidates(F.col("host"), F.col("path"), lengths) if rules else F.array().cast("array<string>")
    fits = F.filter(tried, lambda k: cascades["allow"].contains(k) | cascades["block"].contains(k))
    longest = F.aggregate(fits, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    judged = split.withColumn("rule", longest)
    blocked = F.when(F.col("rule").isNull(), F.col("__listed")).otherwise(cascades["block"].contains(F.col("rule")))
    return judged.withColumn("verdict", F.when(blocked, "block").otherwise("allow")).drop("__listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = split_url(F.col("url"))
    listed = pages.select(host.alias("key")).where((F.col("key") != "") & F.substring(F.md5("key"), 1, 1).isin(*LISTED_DIGITS)).distinct()
    return judge_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = [(h, p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    test = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {test(h, p)} THEN '{h}{p}'" for h, p, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {test(h, p)} THEN '{v}'" for h, p, v in fits)
    digits = ", ".join(f"'{d}'" for d in LISTED_DIGITS)
    return f"""
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM s)
SELECT page_id, host, path, {rule} AS rule,
  {verdict} WHEN host <> '' AND substr(md5(host), 1, 1) IN ({digits}) THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


ORACLE = _oracle()
