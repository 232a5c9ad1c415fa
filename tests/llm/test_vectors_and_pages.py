import random

import numpy as np
from pyspark.sql import functions as F

from phenoline.llm import host_reputation, projected_neighbours


def plain(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 6 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in ok:
        if q % 3 == 0:
            scored = sorted((-float(np.einsum("d,d", ok[q], x)), i) for i, x in ok.items() if i != q)[:k]
            out[q] = [i for _, i in scored]
    return out


def test_nearest(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.standard_normal(6) * (1 + i % 4)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)]  # ties
    rows += [(900, None), (903, [0.0] * 6), (906, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (909, [float("nan")] * 6), (912, [float("inf")] * 6), (915, [1.0]), (5, rows[5][1])]
    schema = "vec_id long, embedding array<double>, score string, cell string, v string, part string"
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], schema).repartition(4)
    got = {}
    for r in projected_neighbours.nearest(df, F.col("vec_id") % 3 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain(rows, 10)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.97
    assert projected_neighbours.nearest(df.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    few = df.filter("vec_id < 4")
    assert projected_neighbours.nearest(few, F.col("vec_id") % 3 == 0).count() == 6


def test_chi_square():
    rnd = np.random.default_rng(2)
    x = (rnd.standard_normal((200_000, projected_neighbours.PROJECTIONS)) ** 2).sum(1)
    for at in (2.0, 7.3, 15.5):
        assert abs((x <= at).mean() - projected_neighbours.chi_square(np.array([at]))[0]) < 0.005


def test_pages(spark):
    rnd = random.Random(1)
    outcomes = [("bad.example.com", rnd.random() < 0.05) for _ in range(200)] + [(f"h{i % 20}.example.com", rnd.random() < 0.95) for i in range(400)]
    outcomes += [("new.example.com", None), ("bad.co.uk", False), ("", None)]
    rules = [("org/", "block"), ("good.org/a", "allow")]
    urls = [
        ("http://BAD.example.com/x?y", "bad.example.com", "/x", None, "block"),
        ("https://h1.example.com", "h1.example.com", "", None, "allow"),
        ("https://good.org/ab#c", "good.org", "/ab", "good.org/a", "allow"),
        ("https://x.good.org/b", "x.good.org", "/b", "org/", "block"),
        ("https://notgood.org", "notgood.org", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://ÄB.example.com?/", "Äb.example.com", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "x", "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, n string, verdict string")
    labels = spark.createDataFrame(outcomes, "host string, good boolean")
    got = {r["page_id"]: r for r in host_reputation.judge(pages, labels, rules).collect()}
    assert len(got) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])
    assert host_reputation.judge(pages.limit(0), labels, rules).count() == 0
    assert host_reputation.judge(pages, labels.limit(0), rules).count() == len(urls)
    assert got[0]["n"] == "x"
