import datetime as dt

import pytest

from phenoline.operators import overlap
from phenoline.operators.calendar import latest_day_of_year


def sets(spark, **lists):
    return {n: spark.createDataFrame([(v,) for v in vs], "k string") for n, vs in lists.items()}


def test_counts_and_overlaps(spark):
    data = sets(spark, z=["a", "b", "b", None], y=["b", "c", None], x=["q"], w=[])
    counts = {r.dataset: r.n_keys for r in overlap.key_counts(data).collect()}
    assert counts == {"z": 3, "y": 3, "x": 1, "w": 0}
    plain = {r.dataset: r.n_keys for r in overlap.key_counts(data, count_null=False).collect()}
    assert plain == {"z": 2, "y": 2, "x": 1, "w": 0}
    pairs = {(r.dataset_1, r.dataset_2): r.overlap_count for r in overlap.key_overlap(data).collect()}
    assert pairs == {("y", "z"): 2, ("x", "y"): 0, ("x", "z"): 0, ("w", "x"): 0, ("w", "y"): 0, ("w", "z"): 0}
    assert {r.overlap_count for r in overlap.key_overlap(data, count_null=False).collect()} == {0, 1}


def test_overlap_of_random_sets(spark):
    import random

    rng = random.Random(4)
    raw = {n: [str(rng.randint(0, 60)) for _ in range(rng.randint(5, 80))] for n in "abcdef"}
    got = overlap.key_overlap(sets(spark, **raw)).collect()
    assert len(got) == 15
    for r in got:
        assert r.overlap_count == len(set(raw[r.dataset_1]) & set(raw[r.dataset_2]))


def test_empty_datasets_and_intersect(spark):
    empty = sets(spark, a=[], b=[])
    assert [tuple(r) for r in overlap.key_overlap(empty).collect()] == [("a", "b", 0)]
    data = sets(spark, a=["x", "x", "y"], b=["x"])
    assert [r.k for r in overlap.shared_keys(data["a"], data["b"]).collect()] == ["x"]
    with pytest.raises(ValueError):
        overlap.key_overlap(sets(spark, a=["x"]))


def wide(spark, *rows):
    return spark.createDataFrame(list(rows), "`Site Name` string, n int, `2000` string, `2001` string, Notes string")


def test_latest_day(spark):
    df = wide(
        spark,
        ("A", 1, "2000-05-01", "2001-05-02", "2000-12-31"),  # days 122 and 122
        ("B", 2, "2000-04-30", "bad", None),
        ("C", 3, "2000-05-01", None, None),
    )
    assert tuple(latest_day_of_year(df, "n").first()) == (dt.date(2000, 5, 1), 122)
    late = wide(spark, ("A", 1, None, "2001-01-05", None), ("B", 2, "2000-06-01", None, None))
    assert tuple(latest_day_of_year(late, "n").first()) == (dt.date(2001, 1, 5), 5)
    assert tuple(latest_day_of_year(late, "n", on_null_first="keep").first()) == (dt.date(2000, 6, 1), 153)
    assert tuple(latest_day_of_year(late.drop("n")).first()) == (dt.date(2001, 1, 5), 5)
    none = wide(spark, ("A", 1, None, "soon", None))
    assert tuple(latest_day_of_year(none, "n").first()) == (None, 0)
    with pytest.raises(ValueError):
        latest_day_of_year(none, on_null_first="drop")


def test_ties_go_to_the_first_row(spark):
    df = wide(spark, ("A", 2, "2000-05-01", None, None), ("B", 1, "1996-05-01", None, None))
    assert latest_day_of_year(df, "n").first().latest_date == dt.date(1996, 5, 1)


def test_more_datasets_than_bits(spark):
    rows = spark.range(130).selectExpr("cast(id AS string) AS k")
    data = {f"d{i:03}": rows.filter(f"k >= 0 AND cast(k AS int) % 130 < {i}") for i in range(66)}
    got = {(r.dataset_1, r.dataset_2): r.overlap_count for r in overlap.key_overlap(data).collect()}
    assert len(got) == 66 * 65 // 2 and all(n == min(int(a[1:]), int(b[1:])) for (a, b), n in got.items())
    assert {r.dataset: r.n_keys for r in overlap.key_counts(data).collect()} == {f"d{i:03}": i for i in range(66)}


def test_latest_day_with_far_row_numbers(spark):
    rows = [("A", "2000-04-02", 0), ("B", "2000-04-30", 30 << 54)]
    df = spark.createDataFrame(rows, "`Site Name` string, `2000` string, row long")
    assert tuple(latest_day_of_year(df, "row").first()) == (dt.date(2000, 4, 30), 121)


def test_rows_of_files_are_read_in_the_order_of_names(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.csv").write_text("Site Name,2000\nA,2000-04-02\n")
    (folder / "b.csv").write_text("Site Name,2000\nB,\n" + "".join(f"S{i},2000-03-01\n" for i in range(500)))
    df = spark.read.csv(str(folder), header=True)
    assert tuple(latest_day_of_year(df).first()) == (dt.date(2000, 4, 2), 93)
