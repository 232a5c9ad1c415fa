import pytest

from phenoline.operators.windows import lag_windows


def test_history_windows_across_blocks(spark):
    rows = [(k, i, float(100 * k + i)) for k, n in ((1, 25), (2, 4), (3, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(5)
    for block in (3, 7, 4096):
        got = {(r.k, r.i): r.past_v for r in lag_windows(df, ["k"], "i", ["v"], n_in=3, block=block).collect()}
        assert got == {(k, i): [v - 3, v - 2, v - 1] for k, i, v in rows if i >= 3}


def test_nulls_are_kept_and_arguments_checked(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, 6.0)], "k int, i int, v double")
    assert lag_windows(df, ["k"], "i", ["v"], n_in=2).first().past_v == [None, 5.0]
    for n_in, block in ((0, 5), (6, 5)):
        with pytest.raises(ValueError):
            lag_windows(df, ["k"], "i", ["v"], n_in=n_in, block=block)
