import datetime as dt
import random

import pytest

from phenoline.operators import scoring

START = dt.date(1999, 8, 1)
FRACTIONS = (0.9, 0.5, 0.55, 0.7)


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(8)
    out = {}
    for key, n in (("A", 11), ("B", 4), ("C", 60), ("D", 2)):
        true = [(float(n - 3 - t), float(n - 1 - t)) for t in range(n)]
        pred = [(a + rng.randint(-8, 8) / 4, b + rng.randint(-8, 8) / 4) for a, b in true]
        out[key] = (true, pred)
    return out


@pytest.fixture(scope="module")
def steps(spark, sequences):
    rows = [
        (k, START, len(true), t, *true[t], *pred[t]) for k, (true, pred) in sequences.items() for t in range(len(true))
    ]
    schema = (
        "k string, data_start_date date, full_length int, step int, true_first double, true_full double, "
        "pred_first double, pred_full double"
    )
    return spark.createDataFrame(rows, schema).repartition(5)


def shown(sequences, k, fraction):
    true, pred = sequences[k]
    return true, pred, int(len(true) * fraction)


def moment(cutoff, prediction):
    return dt.datetime(1999, 8, 1) + dt.timedelta(days=cutoff) + dt.timedelta(days=prediction)


def test_sequence_form(steps, sequences):
    rows = scoring.score_at_cutoffs(steps, ["k"], FRACTIONS).collect()
    assert len(rows) == len(sequences) * len(FRACTIONS)
    for r in rows:
        true, pred, cut = shown(sequences, r.k, r.fraction)
        assert r.cutoff == cut
        for i, got in ((0, r.mae_first), (1, r.mae_full)):
            assert got == sum(abs(pred[t][i] - true[t][i]) for t in range(cut)) / cut
        assert r.pred_first_bloom_date == moment(cut, pred[cut - 1][0])
        assert r.cutoff_date == START + dt.timedelta(days=cut)


def test_point_form_and_exact_alignment(steps, sequences):
    for align, shift in (("reference", 0), ("exact", 1)):
        for r in scoring.score_at_cutoffs(steps, ["k"], FRACTIONS, "point", align).collect():
            true, pred, cut = shown(sequences, r.k, r.fraction)
            assert r.mae_full == abs(pred[cut - 1][1] - true[cut - shift][1])
            assert r.pred_full_bloom_date == moment(cut - shift, pred[cut - 1][1])


def test_a_perfect_prediction_lands_on_the_day_with_exact_dates(spark):
    rows = [(1, START, 10, t, 9.0 - t, 9.0 - t, 9.0 - t, 9.0 - t) for t in range(10)]
    schema = (
        "k int, data_start_date date, full_length int, step int, true_first double, true_full double, "
        "pred_first double, pred_full double"
    )
    df = spark.createDataFrame(rows, schema)
    for align, days in (("exact", 9), ("reference", 10)):
        got = scoring.score_at_cutoffs(df, ["k"], [0.5], align=align).first()
        assert got.pred_full_bloom_date == moment(days, 0)


def test_point_form_past_the_end_fails(steps):
    with pytest.raises(Exception, match="past the end"):
        scoring.score_at_cutoffs(steps, ["k"], [1.0], "point").collect()
    assert scoring.score_at_cutoffs(steps, ["k"], [1.0]).count() == 4


def test_nothing_shown_gives_nulls(steps):
    row = scoring.score_at_cutoffs(steps.filter("k = 'D'"), ["k"], [0.1]).first()
    assert row.cutoff == 0 and row.mae_first is None and row.pred_first_bloom_date is None


def test_array_form_agrees(spark, steps, sequences):
    rows = [
        (k, 2000, START, START, START, *[[x[i] for x in s] for s in (true, pred) for i in (0, 1)])
        for k, (true, pred) in sequences.items()
    ]
    schema = (
        "site_name string, year int, start_date date, date_first date, date_full date, true_first array<double>, "
        "true_full array<double>, pred_first array<double>, pred_full array<double>"
    )
    nested = spark.createDataFrame(rows, schema)
    long = {(r.k, r.fraction): r for r in scoring.score_at_cutoffs(steps, ["k"], FRACTIONS).collect()}
    for r in scoring.score_sequences(nested, FRACTIONS).collect():
        other = long[r.site_name, r.fraction]
        assert (r.cutoff, r.mae_first, r.mae_full) == (other.cutoff, other.mae_first, other.mae_full)
        assert r.pred_full_bloom_date == other.pred_full_bloom_date
        assert r.pred_first_sequence == [p[0] for p in sequences[r.site_name][1]][: r.cutoff]
    at = {(r.site_name, r.fraction): r.true_full_at for r in scoring.true_at_cutoff(nested, FRACTIONS).collect()}
    for (k, f), value in at.items():
        true, _, cut = shown(sequences, k, f)
        assert value == true[cut][1]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        scoring.true_at_cutoff(nested, [1.0]).collect()


def test_step_errors(steps, sequences):
    total, n = 0.0, 0
    for true, pred in sequences.values():
        for (a, b), (c, d) in zip(true, pred):
            total, n = total + ((c - a) ** 2 + (d - b) ** 2) / 2, n + 1
    assert scoring.step_mse(steps).first().mse == pytest.approx(total / n)
    assert scoring.step_errors(steps, floor=0.5).agg({"mse": "min"}).first()[0] >= 0.5


def test_user_models(steps):
    def per_sequence(frame):
        return frame.assign(pred_first=frame.true_first.mean(), pred_full=frame.true_full)

    schema = steps.schema
    got = scoring.predict_sequences(steps, ["k"], per_sequence, schema)
    assert scoring.score_at_cutoffs(got, ["k"], [0.5]).filter("mae_full = 0").count() == 4

    def per_row(batches):
        for batch in batches:
            yield batch.assign(pred_full=batch.true_full + 2)

    rows = scoring.predict_rows(steps, per_row, schema)
    assert {r.mae_full for r in scoring.score_at_cutoffs(rows, ["k"], FRACTIONS).collect()} == {2.0}


def test_sequences_are_whole_whatever_the_batches(spark):
    rows = spark.range(600).selectExpr("id % 41 AS k", "CAST(id AS double) AS v", "date_add(DATE'2001-01-01', CAST(id AS int)) AS day", "if(id % 5 = 0, NULL, DATE'1600-02-29') AS old")

    def per_sequence(frame):
        assert str(frame.day.dtype).startswith("datetime64")
        return frame.assign(v=float(frame.v.sum()) + len(frame))

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.k, r.day): (r.v, r.old) for r in scoring.predict_sequences(rows, ["k"], per_sequence, rows.schema).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    whole = {k: sum(i for i in range(600) if i % 41 == k) + sum(1 for i in range(600) if i % 41 == k) for k in range(41)}
    assert got == {(r.k, r.day): (whole[r.k], r.old) for r in rows.collect()} and len(got) == 600


def test_cutoffs_between_and_ahead_of_the_steps_that_there_are(spark):
    """Steps 4 and 7 of 10: nothing is shown at 3, the first at 5 and 6, both at 8 and beyond."""
    rows = [("a", s, 10, dt.date(2001, 1, 1), float(s), float(s), s + 1.0, s + 2.0) for s in (4, 7)]
    steps = spark.createDataFrame(rows, "k string, step int, full_length int, data_start_date date, true_first double, true_full double, pred_first double, pred_full double")
    got = scoring.score_at_cutoffs(steps, ["k"], [0.3, 0.5, 0.6, 0.8, 0.9]).orderBy("fraction").collect()
    assert [(r.cutoff, r.pred_first, r.mae_first, r.mae_full) for r in got] == [(3, None, None, None), (5, 5.0, 1.0, 2.0), (6, 5.0, 1.0, 2.0), (8, 8.0, 1.0, 2.0), (9, 8.0, 1.0, 2.0)]
    ahead = scoring.score_at_cutoffs(steps, ["k"], [0.3, 0.5], form="point").orderBy("fraction").collect()
    assert [(r.true_first, r.pred_first) for r in ahead] == [(4.0, None), (7.0, 5.0)]


def test_arguments(steps):
    for options in ({"form": "line"}, {"align": "late"}):
        with pytest.raises(ValueError):
            scoring.score_at_cutoffs(steps, ["k"], FRACTIONS, **options)


def test_errors_of_sequences_are_added_up_once(spark):
    """Means at cutoffs in any order, one ahead of the first item, equal sums of each prefix; the plan adds no prefix anew."""
    pred, true = [1.5, 2.0, 0.1, 7.3, 4.4], [1.0, 2.5, 0.4, 3.0, 4.0]
    start = dt.date(2000, 1, 1)
    rows = [("a", 2001, start, start, start, true, true, pred, true), ("b", 2001, start, start, start, [1.0], [1.0], [3.0], [1.0])]
    names = "site_name string, year int, start_date date, date_first date, date_full date, " + ", ".join(
        f"{n} array<double>" for n in ("true_first", "true_full", "pred_first", "pred_full")
    )
    made = scoring.score_sequences(spark.createDataFrame(rows, names), [0.9, 0.1, 0.4, 0.6])
    found = {(r["site_name"], r["cutoff"], r["fraction"]): (r["mae_first"], r["mae_full"]) for r in made.collect()}
    for n, share in ((4, 0.9), (0, 0.1), (2, 0.4), (3, 0.6)):
        total = 0.0
        for p, t in zip(pred[:n], true[:n]):
            total += abs(p - t)
        assert found["a", n, share] == ((total / n, 0.0) if n else (None, None))
    assert found["b", 0, 0.9] == (None, None)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.split("Generate")[0]
