"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, units after numbers and names (capitalised words; those that start a sentence in one of two forms) become typed placeholders, so
that a question with other parameters keeps its template. Windows of template words are hashed and joined with
those of the benchmark; matches along one alignment of a document and an item must then be consistent: equal
slots of the item hold equal values in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Words of a window, those of them that must not be placeholders, and windows of an alignment (all of the item's, if it has fewer).
WINDOW, LITERALS, MATCHES = 8, 4, 3
#: So many benchmark windows are broadcast at a time (24 bytes each); more are joined in further passes.
BROADCAST_ROWS = 1_000_000
NAME, NUMBER, UNIT, FIRST = "", "", "", ""
#: How words are read: capitalised words that start a sentence as they are, or as names; or all words as literals, for the item as a whole.
FORMS = ("written", "names", "literal")
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "inches", "inch", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "percent", "liters", "litres", "liter", "litre", "ml", "pounds", "pound", "grams", "gram", "meters", "metres", "meter", "metre", "degrees", "mph", "kmh")


def template_words(text: Column) -> Column:
    """The words of a text in lower case; names, numbers, units and other capitalised words carry a mark in front of their value. Null gives an empty array."""
    # the look-ahead comes first: it turns most places down at once
    s = F.regexp_replace(text, r"(?=\p{Lu})(?<=[^\s.!?:]\s)(\p{Lu}[\p{L}\p{M}'’-]*)", NAME + "$1")
    s = F.regexp_replace(s, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}'’{NAME}-])(\p{{Lu}}[\p{{L}}\p{{M}}'’-]*)", FIRST + "$1")
    s = F.regexp_replace(F.lower(s), r"(\d+(?:[.,:/]\d+)*)", f" {NUMBER}$1 ")
    s = F.regexp_replace(s, rf"({NUMBER}\S+ ) ?({'|'.join(UNITS)})\b", rf"$1{UNIT}$2")
    words = F.split(s, rf"(?:[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{FIRST}.,:/]|(?<!\d)[.,:/]|[.,:/](?!\d))+")
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def _is_slot(word: Column) -> Column:
    return (word >= NAME) & (word < "")


def _bare(word: Column) -> Column:
    return F.when((word >= NAME) & (word < ""), F.substring(word, 2, 1 << 30)).otherwise(word)


def _read(words: Column, form: str) -> Column:
    """The words as a form reads them: a capitalised word that starts a sentence is a literal or a name, or each word is a literal without its mark."""
    if form == "literal":
        return F.transform(words, _bare)
    return F.transform(words, lambda w: F.when((w >= FIRST) & (w < ""), F.concat(F.lit(NAME if form == "names" else ""), F.substring(w, 2, 1 << 30))).otherwise(w))


def _hashes(words: Column) -> Column:
    """A 64-bit hash of each word's template: of the mark alone for a slot."""
    return F.transform(words, lambda w: F.xxhash64(F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w)))


def _once(value: Column, use) -> Column:
    """``use(value)`` for an array-valued ``use``, with the value computed once a row: the optimizer would else copy its expression into lambdas."""
    return F.flatten(F.transform(F.array(value), use))


def _windows(words: Column, k) -> Column:
    """A hash of the templates of the ``k`` words from each word on; the last ones have fewer words and hash as such."""

    def windows(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, k)))).otherwise(F.array().cast("array<bigint>"))

    return _once(_hashes(words), windows)


def _spread(rows: DataFrame, k: int) -> DataFrame:
    """``(doc_id, t, form, place, h)``: the windows of ``k`` words of ``rows(doc_id, t, form, w)``, w the words' hashes."""
    places = F.explode(F.sequence(F.lit(0), F.size("w") - k))
    return rows.where(F.size("w") >= k).select("doc_id", "t", "form", "w", places.alias("place")).select("doc_id", "t", "form", "place", F.xxhash64(*[F.get("w", F.col("place") + j) for j in range(k)]).alias("h"))


def _variants(benchmark: DataFrame, k: int, literals: int) -> DataFrame:
    """``(v, item_id, form, words, k, windows, slots)``: the items in each form, those that judge every document alike (the same windows, kinds of slots and equal slots) as one.

    Of such items the smallest item_id stands for all. ``windows`` has ``(h, dense)`` for each place: the hash of the
    words themselves if fewer than ``literals`` of them are no slots (dense), else that of their templates. ``slots``
    has ``(at, c)`` for each slot whose value the item has more than once: c is the value's first place.
    """
    items = benchmark.where("item_id is not null").select("item_id", template_words(F.col("text")).alias("words"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), _read(F.col("words"), f).alias("words")) for f in FORMS])
    items = items.select("item_id", F.explode(forms).alias("f")).select("item_id", "f.*", F.least(F.lit(k), F.size("f.words")).alias("k"))
    items = items.where((F.size("words") >= k) | ((F.col("form") == "literal") & (F.size("words") > 0)))
    free = lambda i: F.size(F.filter(F.slice("words", i + 1, F.col("k")), lambda w: ~_is_slot(w)))
    both = F.arrays_zip(_windows(F.col("words"), F.col("k")).alias("t"), _windows(_read(F.col("words"), "literal"), F.col("k")).alias("w"))
    items = items.withColumn("windows", F.slice(both, 1, F.size("words") - F.col("k") + 1))
    items = items.withColumn("windows", F.transform("windows", lambda x, i: F.struct(F.when(free(i) < F.least(F.lit(literals), F.col("k")), x["w"]).otherwise(x["t"]).alias("h"), (free(i) < F.least(F.lit(literals), F.col("k"))).alias("dense"))))
    shape = F.transform("words", lambda w: F.when(_is_slot(w), F.concat(F.substring(w, 1, 1), F.array_position("words", w).cast("string"))).otherwise(w))
    whole = F.col("form") == "literal"
    items = items.groupBy(F.xxhash64(whole, shape, F.col("windows")).alias("v")).agg(F.min(F.struct("item_id", "form", "words", "k", "windows")).alias("x")).select("v", "x.*")
    many = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), F.array_position("words", w).alias("c"), (_is_slot(w) & (F.size(F.filter("words", lambda x: x == w)) > 1)).alias("many"))), lambda s: s["many"])
    return checkpointed(items.withColumn("slots", F.transform(many, lambda s: F.struct(s["at"].alias("at"), s["c"].alias("c")))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, literals: int = LITERALS, matches: int = MATCHES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(doc_id, item_id, n_windows)`` for each document that holds a passage of an item's template.

    A capitalised word that starts a sentence is read in two forms, as a literal and as a name; an item's alignment
    may hold in either. An alignment counts if at least ``matches`` windows of ``k`` words match along it (or all of
    the item's), and its slots are consistent. A window with fewer than ``literals`` words that are no slots matches
    only with its very words; templates alone, without such windows, suffice too. The third form is the whole item,
    word for word in any case: so exact copies of items of fewer than ``k`` words are found, which have no other form.
    Every item is judged with its own windows and slots; only items that no document can tell apart (see
    :func:`_variants`) are reported by the smallest item_id. Reads ``docs(doc_id, text)`` and
    ``benchmark(item_id, text)`` only.

    Null texts and texts without words match nothing, on either side; rows without a doc_id are not
    reported; repeated documents or items count once; empty tables give an empty result.
    """
    variants = _variants(benchmark, k, literals)
    windows = variants.select("v", F.posexplode("windows").alias("item_pos", "w")).select("w.h", "v", "item_pos", "w.dense")
    windows = checkpointed(windows)
    total = windows.count()
    if total == 0:
        return _empty(docs, benchmark)
    passes = -(-total // broadcast_rows)

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), template_words(F.col("text")).alias("words"))
    # hashes of words are made once a row, those of windows as the places are spread (columns that generated code reads, no lambdas); the words stay behind
    hashed = F.array(*[F.struct(F.lit(i).alias("form"), _hashes(_read(F.col("words"), f)).alias("w")) for i, f in enumerate(FORMS)])
    seen = _spread(texts.select("doc_id", "t", F.explode(hashed).alias("f")).select("doc_id", "t", "f.form", "f.w"), k)
    for n in sorted(r.k for r in variants.where(F.col("k") < k).select("k").distinct().collect()):
        seen = seen.unionByName(_spread(texts.select("doc_id", "t", F.lit(2).alias("form"), _hashes(_read(F.col("words"), "literal")).alias("w")), n))
    found = None
    for i in range(passes):
        part = windows.where(F.pmod("h", F.lit(passes)) == i)
        got = seen.join(F.broadcast(part), "h").select("doc_id", "t", "v", "form", (F.col("place") - F.col("item_pos")).alias("shift"), "item_pos", "dense")
        found = got if found is None else found.unionByName(got)
    # an alignment is judged in each form of the document; its literal windows belong to both
    found = found.withColumn("form", F.explode(F.when(F.col("form") < 2, F.array("form")).otherwise(F.array(F.lit(0), F.lit(1)))))
    runs = found.groupBy("doc_id", "t", "v", "form", "shift").agg(F.collect_set("item_pos").alias("at"), F.collect_set(F.when(~F.col("dense"), F.col("item_pos"))).alias("open"))
    known = variants.select("v", "item_id", F.col("form").alias("of"), "k", "slots", F.size("windows").alias("all"), F.size(F.filter("windows", lambda w: ~w["dense"])).alias("most"))
    enough = (F.size("at") >= F.least(F.lit(matches), F.col("all"))) | ((F.col("most") > 0) & (F.size("open") >= F.least(F.lit(matches), F.col("most"))))
    whole = F.col("of") == "literal"
    runs = runs.join(F.broadcast(known) if total <= broadcast_rows else known, "v").where(F.when(whole, F.size("at") >= F.col("all")).otherwise(enough))
    runs = checkpointed(runs.drop("all", "most", "of"))
    good = _consistent(runs, texts, broadcast_rows)
    return good.groupBy("doc_id", "item_id").agg(F.max(F.size("at")).cast("long").alias("n_windows"))


def _empty(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, n_windows bigint")


def _consistent(runs: DataFrame, texts: DataFrame, broadcast_rows: int) -> DataFrame:
    """``runs`` in which each of the item's slot values has one value in the document, over the windows whose templates match along the alignment (the others match word for word)."""
    covered = F.filter("slots", lambda s: F.exists("open", lambda p: (s["at"] >= p) & (s["at"] < p + F.col("k"))))
    asked = runs.select("doc_id", "t", "v", "form", "shift", F.explode(covered).alias("s")).select("doc_id", "t", "v", "form", "shift", "s.c", (F.col("shift") + F.col("s.at")).alias("place"))
    asked = checkpointed(asked)
    wanted = asked.select("doc_id", "t").distinct()
    n = wanted.count()
    if n == 0:
        return runs
    words = texts.join(F.broadcast(wanted) if n <= broadcast_rows else wanted, ["doc_id", "t"], "left_semi")
    words = words.select("doc_id", "t", F.posexplode(F.transform("words", _bare)).alias("place", "ours"))
    values = asked.join(words, ["doc_id", "t", "place"])
    bad = values.groupBy("doc_id", "t", "v", "form", "shift", "c").agg(F.count_distinct("ours").alias("n")).where("n > 1")
    return runs.join(bad, ["doc_id", "t", "v", "form", "shift"], "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the documents that :func:`find_contamination` reports; rows without a doc_id stay."""
    bad = find_contamination(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
