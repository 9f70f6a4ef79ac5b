import random

import pytest
from pyspark.sql import functions as F

from vouchlake.llm import url_filter as uf


def _judge(url, rules, listed):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return host, path, rule and rule[2], (rule[3] if rule else "block" if host in listed else "allow")


URLS = ["http://A.Example.org/es/1?q#f", "https://example.org/en/12", "http://example.org/en/2", "ftp://x.com/fr/", "x.com/fr/", None, "", "http://", "http://com/de/x", "http://notcom/de/x", "http://a.com?x=://b/de/", "http://É.org/", "http://bad.net/a", "http://a..b.org/x", "http://.org/", "a://b://c.org/d"]


def test_equals_plain_rules(spark):
    listed = {"bad.net", "a.com"}
    hosts = spark.createDataFrame([(h,) for h in [*listed, "not-in-corpus.net", None]], "key string")
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df, uf.RULES, hosts).collect()}
    assert got == {i: _judge(u, uf.RULES, listed) for i, u in enumerate(URLS)}
    none = uf.judge_urls(df, (), hosts.limit(0)).collect()
    assert all(r.rule is None and r.verdict == "allow" for r in none)
    assert uf.judge_urls(df.limit(0), uf.RULES, hosts).count() == 0


def test_cascade_is_exact(spark):
    rng = random.Random(3)
    universe = [f"k{i}" for i in range(4000)]
    listed = set(rng.sample(universe, 700)) | {"outside"}
    u = spark.createDataFrame([(k,) for k in universe * 2 + [None]], "key string")
    cascade = uf.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), u)
    got = {r.key for r in u.where(cascade.contains(F.col("key"))).collect()}
    assert got == listed - {"outside"} and len(cascade.levels) > 2
    assert cascade.bits < 16 * len(listed)
    with pytest.raises(ValueError):
        uf.build_cascade(u, u.limit(10), max_bits=1000)


def test_every_listed_and_no_listed(spark):
    u = spark.createDataFrame([("a",), ("b",)], "key string")
    for listed, want in ((u, {"a", "b"}), (u.limit(0), set())):
        cascade = uf.build_cascade(listed, u)
        assert {r.key for r in u.where(cascade.contains(F.col("key"))).collect()} == want


def test_plan_is_native_and_has_no_join(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    plan = uf.judge_urls(df, uf.RULES, spark.createDataFrame([("bad.net",)], "key string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_large_lists_are_split(spark):
    rng = random.Random(9)
    keys = [f"h{i}.net" for i in range(3000)]
    listed = set(rng.sample(keys, 900))
    rows = spark.createDataFrame([(i, k, "x") for i, k in enumerate([*keys, *keys[:50], None, "y" * 100_000])], "id long, host string, part string")
    hosts = spark.createDataFrame([(k,) for k in [*listed, "elsewhere.org"]], "key string")
    for max_bits in (1 << 26, 1 << 13, 1 << 12):
        got = uf.listed_keys(rows, "host", hosts, "found", max_bits).collect()
        assert len(got) == len(keys) + 52 and all(r.found == (r.host in listed) for r in got)


def test_repeated_pages_and_long_urls(spark):
    urls = ["http://bad.net/a", "http://bad.net/a", "http://example.org/es/" + "x" * 200_000, "http://" + "a." * 300 + "com/fr/"]
    df = spark.createDataFrame([(7, u) for u in urls], "page_id long, url string")
    got = [(r.host, r.rule, r.verdict) for r in uf.judge_urls(df, uf.RULES, spark.createDataFrame([("bad.net",)], "key string")).collect()]
    assert got == [(_judge(u, uf.RULES, {"bad.net"})[0], *_judge(u, uf.RULES, {"bad.net"})[2:]) for u in urls]
