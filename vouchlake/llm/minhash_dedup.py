"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one class. Each class walks down several independent random trees: a
node picks one or two coordinates of the minwise signature (1/threshold on average) and hands the class on to
the child named by its token there, so that a pair at the threshold keeps about one common path at every depth.
Nodes that are small enough are compared exhaustively by signature; larger ones branch again. What a node finds
similar is one candidate cluster; clusters are then compared exactly, on full shingle sets, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, checkpointed, connected_components, table, whole_id, with_least

#: Signature length; trees; the first depth at which nodes are compared, the last at which they branch; the largest node that is compared at once.
SIGNATURE, TREES, FIRST_DEPTH, LAST_DEPTH, NODE = 64, 10, 3, 12, 2000
#: Signatures agree in this much less than the threshold at least, for a pair to become a candidate (four standard deviations).
SLACK = 0.2
#: Classes that are compared exactly at a time, and shingles that these have, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: So many classes at most are broadcast when their texts are fetched; more are joined by shuffle.
BROADCAST_ROWS = 200_000
CHUNK = 1 << 19
_R = 0x9E3779B97F4A7C15
_POWERS: list = []


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of ``data`` and where it starts."""
    b = np.frombuffer(data, np.uint8)
    if not _POWERS or len(_POWERS[0]) <= len(b):
        n = max(len(b), CHUNK + 4096)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(x))]) for x in (_R, pow(_R, -1, 1 << 64))]
    space = (b == 32) | ((b >= 9) & (b <= 13))
    before = np.r_[True, space[:-1]] if len(b) else space
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if len(ends) < len(starts):
        ends = np.r_[ends, len(b)]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(b)])]
        return _mix((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles (of the whole sequence, if it has fewer words; none without words)."""
    i = 0
    while i < len(texts):
        j, size, parts = i, 0, []
        while j < len(texts) and (j == i or size < CHUNK):
            parts.append((texts[j] or "").encode("utf-8", "surrogatepass").lower())
            size, j = size + len(parts[-1]) + 1, j + 1
        words, starts = _word_hashes(b" ".join(parts))
        cuts = np.r_[0, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))]
        with np.errstate(over="ignore"):
            grams = words[: max(0, len(words) - k + 1)].copy()
            for d in range(1, k):
                grams = _mix(grams * np.uint64(_R) + words[d : d + len(grams)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
        i = j


_RNG = np.random.default_rng(90210)
_XOR, _MUL = _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64), _RNG.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, 32 bits each."""
    out = np.full(SIGNATURE, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            out = np.minimum(out, ((hashes[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _features(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, h, sig = [], [], []
            for s in shingle_sets(pdf["text"].tolist(), k):
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append(signature(s).tobytes() if len(s) else None)
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "t": pdf["t"], "n_shingles": n, "h1": both[:, 0], "h2": both[:, 1], "sig": sig})

    rows = docs.select(*whole_id("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInPandas(run, "doc_id long, no_id boolean, t long, n_shingles long, h1 long, h2 long, sig binary")


def _chosen(node: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The coordinates that each node picks: (which nodes, coordinate) once for all, again for those that pick a second."""
    h = _mix(node)
    more = (h >> np.uint64(40)).astype(np.float64) / 2**24 < share - 1
    first = (h % np.uint64(SIGNATURE)).astype(np.int64)
    second = (first + 1 + (_mix(h) % np.uint64(SIGNATURE - 1)).astype(np.int64)) % SIGNATURE
    return [(np.arange(len(node)), first), (np.flatnonzero(more), second[more])]


def _descend(node: np.ndarray, row: np.ndarray, sigs: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    nodes, rows = [], []
    with np.errstate(over="ignore"):
        for at, coord in _chosen(node, share):
            token = sigs[row[at], coord].astype(np.uint64)
            nodes.append(_mix(node[at] * np.uint64(_R) + _mix(token + (coord.astype(np.uint64) << np.uint64(33)))))
            rows.append(row[at])
    return np.concatenate(nodes), np.concatenate(rows)


def _walk(classes: DataFrame, share: float, trees: int, depth: int) -> DataFrame:
    """``(node, rep)`` of all trees at ``depth``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, SIGNATURE)
            rep = pdf["rep"].to_numpy()
            for t in range(trees):
                node, row = np.full(len(rep), t + 1, np.uint64), np.arange(len(rep))
                for _ in range(depth):
                    node, row = _descend(node, row, sigs, share)
                yield pd.DataFrame({"node": node.view(np.int64), "rep": rep[row]})

    return classes.select("rep", "sig").mapInPandas(run, "node long, rep long")


def _deeper(rows: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, SIGNATURE)
            node, row = _descend(pdf["node"].to_numpy().view(np.uint64), np.arange(len(pdf)), sigs, share)
            yield pd.DataFrame({"node": node.view(np.int64), "rep": pdf["rep"].to_numpy()[row]})

    return rows.join(classes.select("rep", "sig"), "rep").select("node", "rep", "sig").mapInPandas(run, "node long, rep long")


def _forest(linked, n: int) -> list[tuple[int, int]]:
    """Edges that span the components of a graph whose rows ``linked(i, others)`` gives."""
    out, left = [], np.arange(n)
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = linked(i, left)
            out += [(i, j) for j in left[hit].tolist()]
            stack += left[hit].tolist()
            left = left[~hit]
    return out


def _untied(edges: list[tuple[int, int]], n: int) -> list[int]:
    """Which of ``n`` rows a forest (whose edges lead away from what was reached) doesn't tie to the first."""
    tied = {0}
    for a, b in edges:
        if a in tied:
            tied.add(b)
    return [i for i in range(n) if i not in tied]


def _compare_nodes(rows: DataFrame, classes: DataFrame, least: float, ratio: float, first: bool) -> DataFrame:
    """Spanning edges ``(node, block, a, b, loose)`` of what the members of ``rows(node, blocks, own, block, rep)`` have in common by signature and size.

    On the ``first`` meeting of a node of several blocks, what a block doesn't tie to the node's smallest member is named too (loose: a = b).
    """

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        g = g.sort_values("rep", kind="stable").drop_duplicates("rep")
        if len(g) < 2:
            return None
        sigs, n, rep = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(-1, SIGNATURE), g["n_shingles"].to_numpy(), g["rep"].to_numpy()

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            fits = np.minimum(n[others], n[i]) >= ratio * np.maximum(n[others], n[i])
            fits[fits] = (sigs[others[fits]] == sigs[i]).sum(axis=1) >= least * SIGNATURE
            return fits

        edges = _forest(linked, len(g))
        alone = _untied(edges, len(g)) if first and g["blocks"].iloc[0] > 1 else []
        a, b = [e[0] for e in edges] + alone, [e[1] for e in edges] + alone
        return pd.DataFrame({"node": g["node"].iloc[0], "block": g["block"].iloc[0], "a": rep[a], "b": rep[b], "loose": [False] * len(edges) + [True] * len(alone)}) if a else None

    both = rows.join(classes.select("rep", "sig", "n_shingles"), "rep").select("node", "blocks", "own", "block", "rep", "sig", "n_shingles")
    return by_runs(both, ["node", "own", "block"], compare, "node long, block int, a long, b long, loose boolean")


def candidate_edges(classes: DataFrame, threshold: float, trees: int = TREES, node_limit: int = NODE, first_depth: int = FIRST_DEPTH, last_depth: int = LAST_DEPTH) -> DataFrame:
    """``(a, b)``: edges that span the candidate clusters of ``classes(rep, n_shingles, sig)``.

    A node that is still above the limit at the last depth (its members agree almost everywhere) is dealt into
    blocks by a hash, its smallest member into each; what a block doesn't tie to that one meets all other blocks.
    """
    share, least = 1 / threshold, threshold - SLACK
    rows, leaves = checkpointed(_walk(classes, share, trees, first_depth)), []
    for depth in range(first_depth, last_depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
        if depth == last_depth:
            blocks = F.greatest(F.ceil(F.col("n") / node_limit), F.lit(1)).cast("int")
            big = rows.join(sizes.select("node", blocks.alias("blocks"), "low"), "node")
            mine = F.pmod(F.xxhash64("rep", "node"), F.col("blocks")).cast("int")
            leaves.append(big.select("node", "blocks", F.lit(0).alias("own"), F.explode(F.when(F.col("rep") == F.col("low"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))).alias("block"), "rep"))
            break
        leaves.append(rows.join(sizes.where(F.col("n") <= node_limit).select("node"), "node").select("node", F.lit(1).alias("blocks"), F.lit(0).alias("own"), F.lit(0).alias("block"), "rep"))
        over = sizes.where(F.col("n") > node_limit).select("node")
        big = checkpointed(rows.join(over, "node").select("node", "rep"))
        if not big.limit(1).count():
            break
        rows = checkpointed(_deeper(big, classes, share))
    all_leaves = leaves[0]
    for x in leaves[1:]:
        all_leaves = all_leaves.unionByName(x)
    if len(leaves) <= last_depth - first_depth:
        return _compare_nodes(all_leaves, classes, least, threshold, True).select("a", "b")
    found = checkpointed(_compare_nodes(all_leaves, classes, least, threshold, True))
    edges = found.where("not loose").select("a", "b")
    loose = found.where("loose").select("node", F.col("block").alias("own"), F.col("a").alias("rep"))
    if loose.limit(1).count():
        dealt = leaves[-1].where("blocks > 1").select("node", "blocks", "block", "rep").distinct()
        theirs = dealt.join(loose.select("node", "own").distinct(), "node").where("block <> own")
        ours = loose.join(dealt.select("node", "blocks").distinct(), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own")
        columns = ["node", "blocks", "own", "block", "rep"]
        edges = edges.unionByName(_compare_nodes(theirs.select(columns).unionByName(ours.select(columns)), classes, least, threshold, False).select("a", "b"))
    return edges


def _similar(sets: list[np.ndarray], percent: int):
    """A matrix of which pairs of sets have ``100 * common >= percent * union``, exactly."""
    m, n = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = 100 * common >= percent * (n[0] + n[1] - common)
        return np.array([[True, hit], [hit, True]])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common, width = np.zeros((m, m)), max(256, (1 << 22) // m)
    for lo in range(0, len(values), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        x = np.zeros((m, min(width, len(values) - lo)), np.float32)
        x[owner[a:b], at[a:b] - lo] = 1
        common += x @ x.T
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _link(g: pd.DataFrame, percent: int, across: bool) -> pd.DataFrame | None:
    g = g.sort_values("rep", kind="stable").drop_duplicates("rep")
    if len(g) < 2:
        return None
    hit = _similar([np.frombuffer(x, np.uint64) for x in g["members"]], percent)
    rep = g["rep"].to_numpy()
    edges = _forest(lambda i, others: hit[i, others], len(g))
    out = [(rep[a], rep[b], False) for a, b in edges]
    if not across and g["blocks"].iloc[0] > 1:  # who isn't tied to the cluster's smallest class within this block
        out += [(rep[i], rep[i], True) for i in _untied(edges, len(g))]
    return pd.DataFrame(out, columns=["a", "b", "loose"]) if out else None


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, node_limit: int = NODE, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Words are runs that are not ASCII white space, with A-Z lowered. Documents are linked if their sets of
    distinct ``shingle``-word shingles have ``100 * common >= percent * union``; fewer words make one shingle of the
    whole sequence, and a text without words is linked with nothing. ``component_id`` is the smallest doc_id
    reachable, ``kept`` whether that is the row's own. Equal sets are linked surely; other pairs are found with a
    probability that ``trees`` sets (about 0.99 at the threshold), and confirmed exactly.

    Rows without a doc_id are linked with nothing: component_id null, kept. Rows that repeat a doc_id are compared
    each by its own text. An empty table gives an empty result. Other columns are not read.
    """
    return _near_duplicates(docs, shingle, percent, trees, node_limit, block).drop("t")


def _near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, node_limit: int = NODE, block: int = BLOCK) -> DataFrame:
    """As :func:`near_duplicates`, with a hash ``t`` of the row's text."""
    threshold = percent / 100
    rows = checkpointed(_features(docs, shingle).withColumn("row", F.monotonically_increasing_id()))
    named = rows.where("not no_id and n_shingles > 0")
    classes = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row")).alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = checkpointed(classes.select("h1", "h2", F.col("low.row").alias("rep"), F.col("low.doc_id").alias("doc"), "n_shingles", "sig"))
    edges = candidate_edges(classes, threshold, trees, node_limit)
    clusters = checkpointed(connected_components(edges).withColumnRenamed("id", "rep").join(classes.select("rep", "doc", "h1", "h2", "n_shingles"), "rep"))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = clusters.groupBy("component").agg(blocks.alias("blocks"))
    place = clusters.join(sizes, "component").select("rep", "doc", "h1", "h2", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    place = checkpointed(place)
    few = place.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text is not null").join(F.broadcast(place) if few else place, "doc")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s.tobytes() for s in shingle_sets(pdf["text"].tolist(), shingle)]
            own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), np.int64).reshape(-1, 2)
            same = (own == pdf[["h1", "h2"]].to_numpy()).all(axis=1)  # another row may repeat the doc_id
            yield pd.DataFrame({"rep": pdf["rep"], "cluster": pdf["cluster"], "blocks": pdf["blocks"], "block": pdf["block"], "members": sets})[same]

    sets = checkpointed(texts.select("rep", "h1", "h2", "cluster", "blocks", "block", "text").mapInPandas(fetch, "rep long, cluster long, blocks int, block int, members binary"))
    everywhere = F.when(F.col("rep") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = sets.withColumn("block", F.explode(everywhere))
    found = checkpointed(by_runs(dealt, ["cluster", "block"], lambda g: _link(g, percent, False), "a long, b long, loose boolean"))
    links = found.where("not loose").select("a", "b")
    loose = found.where("loose").select(F.col("a").alias("rep")).distinct()
    if loose.limit(1).count():  # what a large cluster's blocks left loose meets all other blocks of the cluster
        ours = sets.join(loose, "rep").select("rep", "cluster", "blocks", "members", F.col("block").alias("own"))
        ours = ours.select("rep", "cluster", "blocks", "members", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        theirs = sets.join(loose.join(sets.select("rep", "cluster", "block"), "rep").select("cluster", F.col("block").alias("own")).distinct(), "cluster")
        both = ours.select("cluster", "own", "block", "rep", "blocks", "members").unionByName(theirs.select("cluster", "own", "block", "rep", "blocks", "members"))
        links = links.unionByName(by_runs(both, ["cluster", "own", "block"], lambda g: _link(g, percent, True), "a long, b long, loose boolean").select("a", "b"))
    groups = connected_components(links).withColumnRenamed("id", "rep").join(clusters.select("rep", "doc", "h1", "h2"), "rep")
    rooted = with_least(groups, "component", "doc", "root").select("h1", "h2", "root")
    settled = classes.select("h1", "h2", "doc").join(rooted, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("root", "doc").alias("component"), F.lit(False).alias("no_id"))
    out = rows.drop("sig").join(settled, ["h1", "h2", "no_id"], "left")
    own = F.when(~F.col("no_id"), F.col("doc_id"))
    component = F.when(~F.col("no_id"), F.coalesce("component", "doc_id"))
    return out.select(own.alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"), "t")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one document (the smallest doc_id) of each group of near-duplicates; rows without a doc_id stay, as do all copies of the row that stays."""
    gone = _near_duplicates(docs.select("doc_id", "text"), **options).where(~F.col("kept")).select("doc_id", F.col("t").alias("__t")).distinct()
    return docs.withColumn("__t", F.xxhash64("text")).join(gone, ["doc_id", "__t"], "left_anti").select(docs.columns)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g), u AS (SELECT doc_id, unnest(g) AS g FROM g),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(m, n.doc_id), n.doc_id) AS component_id, coalesce(least(m, n.doc_id), n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN c ON n.doc_id = c.x"""
