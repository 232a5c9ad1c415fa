import math

import pytest
from pyspark.sql import functions as F

from phenoline.functions import arrays


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lits(*values):
    return F.array(*[F.lit(v) for v in values])


def test_clean_number(spark):
    cells = ["1.5", "", "missing", None, "NaN", "x", " 2 "]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(arrays.clean_number(F.col("c"))).collect()]
    assert got == [1.5, None, None, None, None, None, 2.0]


def test_countdown(spark):
    make = lambda a, b, n: one(spark, arrays.countdown(F.lit(a), F.lit(b), F.lit(n)))
    first, full = make(236, -7, 243), make(243, 0, 243)
    assert first[0] == 236 and first[-1] == -7 and len(first) == len(full) == 244
    assert full[0] == 243 and full[-1] == 0
    assert make(5, 3, 2) == [5, 4, 3]  # full three days before first
    assert make(-8, 0, -5) == []


def test_padding_and_slices(spark):
    assert one(spark, arrays.pad_zeros(lits(1.0, 2.0), F.lit(4))) == [1.0, 2.0, 0.0, 0.0]
    assert one(spark, arrays.pad_zeros(lits(1.0, 2.0), F.lit(1))) == [1.0, 2.0]
    assert one(spark, arrays.prefix(lits(1, 2, 3), F.lit(0))) == []
    assert one(spark, arrays.prefix(lits(1, 2, 3), F.lit(2))) == [1, 2]
    assert one(spark, arrays.all_but_last(lits(1, 2, 3))) == [1, 2]
    assert one(spark, arrays.last_item(lits(1, 2, 3))) == 3
    assert one(spark, arrays.last_item(F.array().cast("array<int>"))) is None


def test_item_at(spark):
    assert one(spark, arrays.item_at(lits(5, 6), F.lit(1))) == 6
    assert one(spark, arrays.item_at(lits(5, 6), F.lit(2), strict=False)) is None
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        one(spark, arrays.item_at(lits(5, 6), F.lit(2)))


def test_lengths(spark):
    assert one(spark, arrays.array_length(lits(1, 2))) == 2
    assert one(spark, arrays.array_length(F.lit(None).cast("array<int>"))) == 0
    sizes = spark.range(1, 400).select("id", *[arrays.cutoff_length(F.col("id"), f) for f in (0.5, 0.7, 0.825, 0.99)])
    for n, *cuts in sizes.collect():
        assert cuts == [int(n * f) for f in (0.5, 0.7, 0.825, 0.99)]


def test_mean_abs_error(spark):
    assert one(spark, arrays.mean_abs_error(lits(1.0, 5.0), lits(2.0, 3.0))) == 1.5
    empty = F.array().cast("array<double>")
    assert one(spark, arrays.mean_abs_error(empty, empty)) is None


def test_fourier_terms(spark):
    got = [r[0] for r in spark.range(5).select(arrays.fourier_terms(F.col("id"), 100, [1.0, 0.5, 0.25])).collect()]
    want = [sum(a * math.sin(2 * math.pi * k * x / 100) for k, a in ((1, 1.0), (2, 0.5), (3, 0.25))) for x in range(5)]
    assert got == pytest.approx(want)
