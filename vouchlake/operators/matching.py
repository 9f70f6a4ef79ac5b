"""Documents to delivery groups by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..tables import materialized, stored

TYPES = ("contract", "receipt", "reconciliation", "authorization")
#: Keys meet names by their last so many characters (all, if they have fewer); the whole key is compared then.
ANCHOR = 16
#: Keys are taken apart into characters by cuts of so many.
CUT = 4
#: So many characters are written out for a place of a key.
CLASS = 256


def normal_name(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit(" ")))


def _places(keys: DataFrame) -> tuple[list[str], bool]:
    """Patterns of the places where one of ``keys(anchor)`` may stand, one for each length: a class of characters for each of its characters; and whether a piece that equals an anchor settles the match (no anchor is cut, no class is open).

    Equal cuts of CUT characters are put together before their characters are collected, so that few of very many
    numbers are taken apart. At most ANCHOR lengths of ANCHOR characters come to the driver; where a character has more than CLASS values any will do.
    """
    cuts = F.array(*[F.substring("anchor", i, CUT) for i in range(1, ANCHOR + 1, CUT)])
    cut = keys.select(F.length("anchor").alias("n"), F.posexplode(cuts).alias("at", "cut")).where("cut <> ''").distinct()
    found = cut.groupBy("n", "at").agg(*[F.collect_set(F.substring("cut", i, 1)).alias(f"c{i}") for i in range(1, CUT + 1)]).collect()
    sets = {(r["n"], r["at"] * CUT + i): r[f"c{i}"] for r in found for i in range(1, CUT + 1)}
    classes = [[sets[n, i] for i in range(1, n + 1)] for n in sorted({r["n"] for r in found})]
    one = lambda c: "[" + "".join(f"\\x{{{ord(x):x}}}" for x in sorted(c)) + "]" if len(c) <= CLASS else r"[\s\S]"
    whole = all(len(cs) < ANCHOR and all(len(c) <= CLASS for c in cs) for cs in classes)
    return ["(?=(" + "".join(map(one, cs)) + "))" for cs in classes], whole


def _contains_join(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``files(file, hay)``, each once, with the ``keys(needle, ...)`` that they contain: an equi-join on the keys' last characters, of ANCHOR lengths at most, and a comparison of the whole key where it is longer.

    Of a name only those pieces meet keys that have a character of some key at each place.
    """
    keys = keys.where("needle <> ''").withColumn("anchor", F.right("needle", F.lit(ANCHOR)))
    patterns, whole = _places(keys)  # if whole, the names are left behind before they meet
    rest = [c for c in keys.columns if c != "anchor"]
    if not patterns:
        return files.select("file").crossJoin(keys.select(*rest)).limit(0)
    pieces = files.select("file", *([] if whole else ["hay"]), F.explode(F.array_distinct(F.concat(*[F.regexp_extract_all("hay", F.lit(p), F.lit(1)) for p in patterns]))).alias("anchor"))
    met = pieces.join(keys, "anchor")
    return (met if whole else met.where(F.contains("hay", F.col("needle")))).select("file", *rest)


def match_direct(files: DataFrame, groups: DataFrame) -> DataFrame:
    """``(file_name, delivery_no)``: names that contain the delivery number, in any case and without spaces."""
    hay = files.select(F.col("file_name").alias("file")).distinct().withColumn("hay", normal_name(F.col("file")))
    keys = groups.select("delivery_no", normal_name(F.col("delivery_no")).alias("needle")).distinct()
    return _contains_join(hay, keys).select(F.col("file").alias("file_name"), "delivery_no")


def match_direct_theta(files: DataFrame, groups: DataFrame) -> DataFrame:
    """As :func:`match_direct`, as the plain containment join. The smaller plan for a handful of groups; the oracle of the other in tests."""
    f, g = files.select("file_name").distinct(), groups.select("delivery_no").distinct()
    return f.join(g, F.contains(normal_name(F.col("file_name")), normal_name(F.col("delivery_no"))) & (normal_name(F.col("delivery_no")) != "")).select("file_name", "delivery_no")


def match_suffix(files: DataFrame, groups: DataFrame, direct: DataFrame) -> DataFrame:
    """For files without a direct match: names that contain the last six characters of a number of more than four, as they are."""
    rest = files.select("file_name").distinct().join(direct.select("file_name").distinct(), "file_name", "left_anti")
    hay = rest.select(F.col("file_name").alias("file"), F.col("file_name").alias("hay"))
    keys = groups.where(F.length("delivery_no") > 4).select("delivery_no", F.right("delivery_no", F.lit(6)).alias("needle")).distinct()
    return _contains_join(hay, keys).select(F.col("file").alias("file_name"), "delivery_no")


def match_documents(files: DataFrame, groups: DataFrame, longest_only: bool = False) -> DataFrame:
    """The bridge ``(file_name, delivery_no)``: direct matches, and suffix matches of the files that have none. The direct ones are written once, for both.

    ``longest_only`` keeps a file's longest direct numbers only, where one number is a prefix of another.
    """
    direct = materialized(match_direct(files, groups))
    suffix = match_suffix(files, groups, direct)
    if longest_only:
        most = F.max(F.length("delivery_no")).over(Window.partitionBy("file_name"))
        direct = direct.withColumn("__most", most).where(F.length("delivery_no") == F.col("__most")).drop("__most")
    return direct.unionByName(suffix)


def document_type(file_name: Column) -> Column:
    """By the first word of the keyword lists that the lower-cased name contains."""
    lower, out = F.lower(file_name), None
    for kind, words in CONFIG.type_keywords:
        test = F.lit(False)
        for w in words:
            # lower case neither makes nor changes characters without case, and costs more than the search
            test = test | F.contains(file_name if w.lower() == w.upper() else lower, F.lit(w))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def assign_first(groups: DataFrame, bridge: DataFrame, documents: DataFrame) -> DataFrame:
    """``groups`` with a struct column for each document type: the earliest matched document (by ``doc_seq``), else null.

    ``documents`` has ``file_name``, ``doc_type``, ``doc_seq`` and fields; unknown types are not assigned. One
    aggregation with the types as columns, so that a group's documents meet in one shuffle.
    """
    whole = documents.select("file_name", F.struct(*[F.col(c) for c in documents.columns]).alias("d"))
    mine = lambda t: F.col("d.doc_type") == t
    picks = [F.min_by(F.when(mine(t), F.col("d")), F.when(mine(t), F.col("d.doc_seq"))).alias(t) for t in TYPES]
    found = bridge.select("file_name", "delivery_no").distinct().join(whole, "file_name").groupBy("delivery_no").agg(*picks)
    return groups.join(found, "delivery_no", "left")


def assign_documents(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """What :func:`assign_first` gives over :func:`match_documents`, without the pairs of files and groups.

    Six last characters may be those of very many numbers, and a file that has them belongs to each. So documents meet
    the distinct needles, of which each keeps its earliest document of a type, and groups look up their two needles.
    """
    numbers = stored(groups.select("delivery_no").distinct())
    tails, names = F.right("delivery_no", F.lit(6)), documents.select(F.col("file_name").alias("file")).distinct()
    whole = numbers.select(normal_name(F.col("delivery_no")).alias("needle")).distinct()
    ends = numbers.where(F.length("delivery_no") > 4).select(tails.alias("needle")).distinct()
    direct = stored(_contains_join(names.withColumn("hay", normal_name(F.col("file"))), whole))
    rest = names.join(direct.select("file").distinct(), "file", "left_anti").withColumn("hay", F.col("file"))
    held = documents.where(F.col("doc_type").isin(*TYPES)).select(F.col("file_name").alias("file"), F.struct(*documents.columns).alias("d"))
    mine = lambda t: F.col("d.doc_type") == t
    picks = [F.min_by(F.when(mine(t), F.col("d")), F.when(mine(t), F.col("d.doc_seq"))).alias(t) for t in TYPES]
    found = lambda pairs, name: pairs.join(held, "file").groupBy("needle").agg(*picks).select(F.col("needle").alias(f"__{name}_key"), *[F.col(t).alias(f"__{name}_{t}") for t in TYPES])
    keyed = groups.withColumns({"__direct_key": normal_name(F.col("delivery_no")), "__suffix_key": F.when(F.length("delivery_no") > 4, tails)})
    both = keyed.join(found(direct, "direct"), "__direct_key", "left").join(found(_contains_join(rest, ends), "suffix"), "__suffix_key", "left")
    first = lambda t: F.when(F.coalesce(F.col(f"__suffix_{t}.doc_seq") < F.col(f"__direct_{t}.doc_seq"), F.col(f"__direct_{t}").isNull()), F.col(f"__suffix_{t}")).otherwise(F.col(f"__direct_{t}"))
    return both.select("delivery_no", *[c for c in groups.columns if c != "delivery_no"], *[first(t).alias(t) for t in TYPES])


def match_status(assigned: DataFrame) -> DataFrame:
    """``(delivery_no, files, status)`` as the match list shows them."""
    labels = dict(CONFIG.type_labels)
    parts = [F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{labels[t]}: "), F.col(f"{t}.file_name"))) for t in TYPES]
    files = F.concat_ws(" | ", *parts)
    return assigned.select("delivery_no", F.when(files == "", "❌ 未匹配").otherwise(files).alias("files"), F.when(files == "", "❌").otherwise("✅").alias("status"))
