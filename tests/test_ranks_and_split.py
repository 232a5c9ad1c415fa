import random

import numpy as np
import pytest

from phenoline.operators import ranks, split
from phenoline.operators.ranks import exact_quantiles, select_ranks
from phenoline.operators.split import split_exact


@pytest.fixture(autouse=True, params=[2048, 1], ids=["read", "counted"])
def few(request, monkeypatch):
    """With ranges of few values that are read as they are, and with passes to the end."""
    monkeypatch.setattr(ranks, "FEW", request.param)
    monkeypatch.setattr(split, "FEW", request.param)


def named(spark, **lists):
    return spark.createDataFrame([(n, v) for n, vs in lists.items() for v in vs], "name string, value double")


def test_ranks_with_a_hot_value(spark):
    rng = random.Random(2)
    heavy = [7.25] * 700 + [rng.uniform(-1e6, 1e6) for _ in range(900)] + [1e-9 * i for i in range(500)]
    rng.shuffle(heavy)
    ordered = sorted(heavy)
    wanted = [0, 1, 500, 1050, 1400, 2098, 2099]
    found = select_ranks(named(spark, a=heavy, b=[3.0, 1.0]), {"a": wanted, "b": [1]})
    assert [found["a", r].value for r in wanted] == [ordered[r] for r in wanted]
    assert found["b", 1].value == 3.0
    hot = found["a", ordered.index(7.25) if ordered.index(7.25) in wanted else 1050]
    assert hot.ties == ordered.count(hot.value)


def test_quantiles(spark):
    rng = random.Random(3)
    a = [rng.choice([1.0, rng.gauss(0, 100)]) for _ in range(501)]
    df = named(spark, a=a, b=[2.0], c=[None, 1.0, 2.0])
    wanted = {"a": [0.05, 0.5, 0.95], "b": [0.05, 0.5], "c": [0.5]}
    got = exact_quantiles(df, wanted)
    assert [got["a", q] for q in wanted["a"]] == pytest.approx(list(np.quantile(a, wanted["a"])))
    assert got["b", 0.05] == 2.0 and got["c", 0.5] == 1.5


def test_quantiles_of_extreme_values(spark):
    inf, top = float("inf"), 1.7e308
    df = named(spark, far=[-top, 0.0, 1.0, 2.0, top], ends=[-inf, 1.0, 2.0, inf, inf], steep=[1100.0**k for k in range(60)], two=[-top, top])
    got = exact_quantiles(df, {"far": [0.25, 0.5, 1.0], "ends": [0.0, 0.25, 0.5, 0.9], "steep": [0.5], "two": [0.25]})
    assert [got["far", q] for q in (0.25, 0.5, 1.0)] == [0.0, 1.0, top]
    assert [got["ends", q] for q in (0.0, 0.25, 0.5, 0.9)] == [-inf, 1.0, 2.0, inf]
    assert got["steep", 0.5] == pytest.approx((1100.0**29 + 1100.0**30) / 2)
    assert got["two", 0.25] == pytest.approx(-top / 2)


def test_ranks_of_many_values_take_few_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(ranks, "_count_parts", lambda v, s, f=ranks._count_parts: passes.append(1) or f(v, s))
    df = spark.range(300_000).selectExpr("'a' AS name", "pow(1.002, id % 150000) AS value")
    found = select_ranks(df, {"a": [0, 150_001, 299_999]})
    assert [found["a", r].value for r in (0, 150_001, 299_999)] == pytest.approx([1.0, 1.002**75_000, 1.002**149_999])
    assert len(passes) <= 4


def test_split_sizes_and_disjointness(spark):
    for n, share in ((7, 0.8), (100, 0.8), (333, 0.5), (1, 0.8)):
        df = spark.range(n).withColumnRenamed("id", "k").selectExpr("k", "cast(k % 3 as string) AS s", "rand(1) AS x")
        train, test = split_exact(df, ["k", "s"], share, seed=4)
        a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
        assert len(a) == int(share * n) and a.isdisjoint(b) and len(a | b) == n


def test_split_depends_on_seed_only(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    picks = []
    for seed, parts in ((1, 1), (1, 17), (2, 4)):
        picks.append({r.k for r in split_exact(df.repartition(parts), ["k"], 0.5, seed, unique=True)[0].collect()})
    assert picks[0] == picks[1] != picks[2]


def test_rows_of_one_key_stay_together(spark):
    df = spark.range(300).selectExpr("id % 30 AS k", "id AS i")
    train, test = split_exact(df, ["k"], 0.8)
    assert train.select("k").distinct().count() == 24 and train.count() == 240 and test.count() == 60


def test_colliding_hashes_are_split_exactly(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(split, "_place", lambda keys, seed: F.pmod(F.col(keys[0]), F.lit(3)).cast("double"))
    df = spark.range(30).withColumnRenamed("id", "k")
    train, test = split_exact(df, ["k"], 0.5, unique=True)
    a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
    assert len(a) == 15 and len(b) == 15 and a.isdisjoint(b)


def test_share_is_checked(spark):
    for share in (0, 1, 1.5):
        with pytest.raises(ValueError):
            split_exact(spark.range(3), ["id"], share)
