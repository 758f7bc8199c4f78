import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.llm import url_filter as U


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for action, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1, -1, "", ""), (len(h) + len(p), len(h), h + p, action))
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/", "http://www.example.com/en/x", "http://a.b.example.com/en/1?x#y", "http://example.com/enx", "http://x.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://x.net/de/", "http://x.com", "http://x.com?q=/en/", "http://x.com#/",
    "http://ÉX.com/é", "http://com/", "http://com.", "ftp://a://b/c", "http://x.com:80/", "http://xcom/", "http://" + "a." * 200 + "com/" + "p" * 5000, "http://x.com/\nnew", "http://..com/x", "http://" + "a." * 20_000 + "net/fr/1",
]


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(spark, df, rules).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_the_rules(spark):
    check(spark, URLS + URLS, U.RULES)


def test_many_rules(spark, monkeypatch):
    rng = random.Random(6)
    hosts = [".".join(rng.choice(("a", "b", "c", "dd")) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rules = sorted({(h, rng.choice(["/", "/x", "/x/", "/xy/"])) for h in hosts[:150]})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"http://{h}{rng.choice(['', '/', '/x', '/x/y', '/xy/z', '/q'])}" for h in hosts for _ in range(3)]
    check(spark, urls, rules)
    monkeypatch.setattr(U, "MOST_BITS", 1)  # too many for a cascade: by join
    check(spark, urls, rules)


def test_empty(spark):
    assert U.filter_urls(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("n,listed", [(3000, 5), (3000, 1500), (200, 200), (50, 0)])
def test_a_cascade_is_exact_over_its_universe(spark, n, listed):
    keys = spark.range(n).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("second"), "id").alias("h2"), (F.col("id") < listed).alias("yes"))
    levels = U.build(spark, keys, F.col("yes"))
    rows = keys.collect()
    h1, h2 = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("h1", "h2"))
    with np.errstate(over="ignore"):
        assert (U.listed(levels, h1, h2) == np.array([r["yes"] for r in rows])).all()
