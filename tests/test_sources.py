import json
import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from phenoline.operators.scaling import Scaler
from phenoline.sources import commits, paths, runs, sheets, store, wide


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_sheets(spark, tmp_path):
    write(tmp_path / "s", "Tokyo.csv", "Humidity\nsource,x\nYear,Jan,Feb\n1954,1,2\n1955,3,\n2000,\"4,5\",6\nmean,7,8\n")
    write(tmp_path / "s", "New +Town.csv", "The Year is below,\r\n1999,9\r\n")
    write(tmp_path / "s", "Kyoto.csv", "Year,Mar,Jan\n2001,30,10\n")
    with pytest.raises(ValueError, match="no column named"):
        sheets.read_sheets(spark, str(tmp_path / "s" / "New +Town.csv"))
    (tmp_path / "s" / "New +Town.csv").write_text("x\r\nYear,Feb\r\n1999,9\r\n")
    df = sheets.read_sheets(spark, str(tmp_path / "s"))
    assert df.columns == ["Year", "Feb", "Jan", "Mar", "City"]
    rows = {(r.City, r.Year): (r.Jan, r.Feb, r.Mar) for r in df.collect()}
    assert rows == {
        ("Tokyo", 1955): ("3", None, None),
        ("Tokyo", 2000): ("4,5", "6", None),
        ("New +Town", 1999): (None, "9", None),
        ("Kyoto", 2001): ("10", None, "30"),
    }


def test_quoted_header_cells(spark, tmp_path):
    write(tmp_path / "s", "a.csv", 'Year,"a,b", c \n2000,1,2\n')
    row = sheets.read_sheets(spark, str(tmp_path / "s")).first()
    assert row.asDict() == {"Year": 2000, "a,b": "1", "c": "2", "City": "a"}


def test_sheets_of_several_headers(spark, tmp_path):
    """Different headers, one that is broken and very wide, and one sheet that is larger than a task's share."""
    write(tmp_path / "s", "a.csv", "Year,x,y\n2000,1,2\n")
    write(tmp_path / "s", "b.csv", "top\nYear,x,y\n2001,3,4\n1900,9,9\n")
    write(tmp_path / "s", "c.csv", "y,Year of\nYear,z, x ,x\n2002,5,6,7\n")
    write(tmp_path / "s", "broken.csv", "Year,y" + "," * 30_000 + "\n2003,8" + "," * 30_000 + "\n")
    write(tmp_path / "s", "empty.csv", "note\nYear,only\n")
    write(tmp_path / "s", "huge.csv", "Year,x,y\n" + "".join(f"{1960 + i % 60},{i},\"{i},{i}\"\n" for i in range(30_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = sheets.read_sheets(spark, str(tmp_path / "s"))
        assert df.columns == ["Year", "only", "x", "y", "z", "City"]
        rest = sorted(tuple(r) for r in df.filter("City <> 'huge'").select("City", "Year", "x", "y", "z").collect())
        assert rest == [("a", 2000, "1", "2", None), ("b", 2001, "3", "4", None), ("broken", 2003, None, "8", None), ("c", 2002, "6", None, "5")]
        huge = sorted((int(r.x), r.Year, r.y) for r in df.filter("City = 'huge'").collect())
        assert huge == [(i, 1960 + i % 60, f"{i},{i}") for i in range(30_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sheet_without_header(spark, tmp_path):
    write(tmp_path / "s", "a.csv", "Year,x\n2000,1\n")
    write(tmp_path / "s", "b.csv", "no,header\n2000,1\n")
    with pytest.raises(ValueError, match="1 sheet"):
        sheets.read_sheets(spark, str(tmp_path / "s"))


def test_a_sheet_split_between_tasks_keeps_its_order(spark, tmp_path):
    body = "".join(f"{1900 + i % 100},{i}\n" for i in range(4000))
    write(tmp_path / "s", "a.csv", "1990,above\n" * 300 + "Year,v\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = sheets.read_sheets(spark, str(tmp_path / "s"))
        assert df.filter("v = 'above'").count() == 0
        assert df.count() == sum(1900 + i % 100 >= 1955 for i in range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def predictions(spark):
    rows = [(s, f, float(s) * f) for s in (1, 2, 12) for f in (0.5, 0.825)]
    return spark.createDataFrame(rows, "sim_id int, fraction double, x double")


def test_runs_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs.write_runs(predictions(spark), path)
    back = runs.read_runs(spark, path)
    assert sorted(map(tuple, back.select("sim_id", "fraction", "x").collect())) == sorted(
        map(tuple, predictions(spark).collect())
    )
    plan = back.filter("sim_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sim_id" in plan


def test_run_folders(spark, tmp_path):
    stem = tmp_path / "size_2000"
    for s, f, x in predictions(spark).collect():
        one = spark.createDataFrame([(x,)], "x double")
        one.write.parquet(str(stem / f"sim_id_{s}" / f"test_cutoff_{f}" / "predictions.parquet"))
    back = runs.read_run_folders(spark, str(stem))
    assert sorted((r.sim_id, r.fraction, r.x) for r in back.collect()) == sorted(map(tuple, predictions(spark).collect()))
    some = runs.read_run_folders(spark, str(stem), [2, 7])
    assert {r.sim_id for r in some.collect()} == {2}


def test_finished_runs(spark, tmp_path):
    """Sequence and point runs are matched by name; a run that stopped isn't listed, and names that are taken are left alone."""
    stem = str(tmp_path / "runs")
    assert runs.finished_runs(spark, stem) == []
    with pytest.raises(FileNotFoundError):
        runs.read_finished_runs(spark, stem)
    points = spark.createDataFrame([(f, f * 2) for f in (0.5, 0.825, 0.99)], "fraction double, pred_full double")
    sequences = spark.createDataFrame([(0.5, [1.0, 2.0]), (0.75, [])], "fraction double, pred_full_sequence array<double>")
    runs.write_run(points, stem, 1, {"tau": 0.1, "name": None})
    runs.write_run(sequences.withColumn("sim_id", F.lit(9)), stem, 12)
    broken = points.withColumn("pred_full", F.expr("pred_full + CAST(assert_true(fraction < 0.9) AS double)"))
    with pytest.raises(Exception):
        runs.write_run(broken, stem, 3)
    points.write.parquet(f"{stem}/sim_id_4/test_cutoff_0.5/predictions.parquet")
    with pytest.raises(FileExistsError):
        runs.write_run(points, stem, 4)
    assert [e["sim_id"] for e in runs.finished_runs(spark, stem)] == [1, 12]
    rows = runs.read_finished_runs(spark, stem)
    got = sorted((r.sim_id, r.fraction, r.pred_full, r.pred_full_sequence) for r in rows.collect())
    assert got == [(1, 0.5, 1.0, None), (1, 0.825, 1.65, None), (1, 0.99, 1.98, None), (12, 0.5, None, [1.0, 2.0]), (12, 0.75, None, [])]
    assert {r.sim_id for r in runs.read_finished_runs(spark, stem, [12, 4]).collect()} == {12}
    assert sorted(map(tuple, runs.parameters_table(spark, stem).collect()), key=str) == [(1, "name", None), (1, "tau", "0.1")]
    # The folders are those that readers without a catalogue know.
    assert runs.read_run_folders(spark, stem, [1]).count() == 3


def test_csv_and_json_sinks(spark, tmp_path):
    summary = spark.createDataFrame(
        [(1, 0.5, 2.0, 0.5, 3.0, 0.25)],
        "sim_id int, cutoff double, mean_first double, std_first double, mean_full double, std_full double",
    )
    runs.write_summary_csv(summary, str(tmp_path / "csv"))
    first = spark.read.option("header", True).csv(str(tmp_path / "csv" / "sim_id=1" / "event=mae_first"))
    assert sorted(map(tuple, first.collect())) == [("mean_0.5", "2.0"), ("std_0.5", "0.5")]
    metrics = spark.createDataFrame([(1, 0.5, 2.0, 3.0)], "sim_id int, fraction double, mae_first double, mae_full double")
    runs.write_metrics_json(metrics, str(tmp_path / "json"))
    part = next((tmp_path / "json" / "sim_id=1" / "fraction=0.5").glob("*.json"))
    assert json.loads(part.read_text()) == {"mae_first": 2.0, "mae_full": 3.0}
    runs.write_parameters_json(spark, {1: {"alpha": 1.0}, 2: {"alpha": 2.0, "tau": 10}}, str(tmp_path / "p"))
    got = {r.sim_id: (r.alpha, r.tau) for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got == {1: (1.0, None), 2: (2.0, 10)}


def test_wide_csv(spark, tmp_path):
    write(tmp_path, "w.csv", "Site Name,2000,Notes\nA,2000-03-01,\nB,,\"x,y\"\n")
    rows = wide.read_wide_csv(spark, str(tmp_path / "w.csv"))
    assert rows.dtypes == [("Site Name", "string"), ("2000", "string"), ("Notes", "string")]
    assert [tuple(r) for r in rows.collect()] == [("A", "2000-03-01", None), ("B", None, "x,y")]
    write(tmp_path, "c.csv", "city,lat,country,city_ascii,lng\nŌsaka,34.7,Japan,Osaka,135.5\nX,bad,Peru,X,1\n")
    cities = wide.read_cities(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in cities.collect()] == [("Japan", "Osaka", 34.7, 135.5), ("Peru", "X", None, 1.0)]


def test_cache_is_created_once_and_only_when_complete(spark, tmp_path):
    path, calls = str(tmp_path / "deep" / "seasons"), []

    def create():
        calls.append(1)
        return spark.range(3), {"a": Scaler("a", "minmax", 1.0, 2.0, -1.0)}

    with pytest.raises(FileNotFoundError):
        store.read_seasons(spark, path)
    for _ in range(2):
        rows, scalers = store.load_or_create(spark, path, create)
        assert rows.count() == 3 and scalers["a"].scale == 2.0
    assert len(calls) == 1
    store.load_or_create(spark, path, create, "other inputs")
    store.load_or_create(spark, path, create, "other inputs")
    assert len(calls) == 2
    (tmp_path / "deep" / "seasons" / "manifest.json").unlink()
    store.load_or_create(spark, path, create)
    assert len(calls) == 3


def test_a_build_that_failed_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "seasons")
    store.write_seasons(spark.range(3), {"a": Scaler("a", "minmax", 1.0, 2.0, -1.0)}, path)

    def fail():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        store.load_or_create(spark, path, fail, "new")
    bad = spark.range(5).selectExpr("assert_true(id < 3) AS x")
    with pytest.raises(Exception):
        store.write_seasons(bad, {}, path)
    rows, scalers = store.read_seasons(spark, path)
    assert rows.count() == 3 and set(scalers) == {"a"}


def test_two_builders_leave_one_whole_pair(spark, tmp_path):
    path = str(tmp_path / "seasons")

    def build(n):
        store.write_seasons(spark.range(n), {f"c{n}": Scaler(f"c{n}", "minmax", 0.0, float(n))}, path)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(build, range(1, 9)))
    rows, scalers = store.read_seasons(spark, path)
    (name,) = scalers
    assert rows.count() == scalers[name].scale == int(name[1:])


def test_cache_key_follows_files_and_options(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "x\n1\n")
    write(tmp_path / "in", "b.csv", "x\n1\n")
    one = commits.cache_key(spark, [str(tmp_path / "in")], {"a": 1})
    assert one == commits.cache_key(spark, [str(tmp_path / "in")], {"a": 1})
    assert one != commits.cache_key(spark, [str(tmp_path / "in")], {"a": 2})
    assert one != commits.cache_key(spark, [str(tmp_path / "in" / "a*")], {"a": 1})
    write(tmp_path / "in", "b.csv", "x\n1\n2\n")
    assert one != commits.cache_key(spark, [str(tmp_path / "in")], {"a": 1})
    with pytest.raises(FileNotFoundError):
        commits.cache_key(spark, [str(tmp_path / "none*")], {})


def test_melt_of_a_very_wide_table(spark, tmp_path):
    n = 20_000
    for part in (1, 2):
        head = ["Date", *[f"s{i}" if part == 1 else f"s{n - 1 - i}" for i in range(n)]]
        rows = [[f"200{part}-01-{d:02d}", *[str(i + d) if (i + d) % 7 else ("" if i % 2 else "missing") for i in range(n)]] for d in (1, 2, 3)]
        write(tmp_path / "w", f"{part}.csv", "\n".join(",".join(r) for r in [head, *rows]) + "\n")
    df = wide.read_wide_observations(spark, str(tmp_path / "w"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = df.groupBy("date").agg(F.count("*"), F.count("temp"), F.sum("temp")).orderBy("date").collect()
    sums = [sum(i + d for i in range(n) if (i + d) % 7) for d in (1, 2, 3)]
    assert [r[1] for r in got] == [n] * 6 and [r[2] for r in got] == [sum((i + d) % 7 > 0 for i in range(n)) for d in (1, 2, 3)] * 2
    assert [r[3] for r in got] == sums * 2
    # The second file has its columns the other way round.
    assert [r.temp for r in df.filter("site = 's19999'").orderBy("date").collect()] == [20000.0, 20001.0, 20002.0, 1.0, 2.0, 3.0]


def test_cells_of_lines(spark, tmp_path):
    lines = ['a,b,c', '"a,1",b,', ',,', '"say ""x""",,"', 'a', '"",""']
    made = spark.createDataFrame([(x,) for x in lines], "line string").select(wide.csv_cells(F.col("line")).alias("c"))
    assert [r.c for r in made.collect()] == [["a", "b", "c"], ["a,1", "b", ""], ["", "", ""], ['say "x"', "", '"'], ["a"], ["", ""]]
    write(tmp_path / "q", "a.csv", 'Date,"New, Town",B\r\n2000-1-2,"1.5",\r\n\r\n2000-1-3,x,2,9\r\n')
    rows = wide.read_wide_observations(spark, str(tmp_path / "q")).orderBy("date", "site").collect()
    assert [(str(r.date), r.site, r.temp) for r in rows] == [("2000-01-02", "B", None), ("2000-01-02", "New, Town", 1.5), ("2000-01-03", "B", 2.0), ("2000-01-03", "New, Town", None)]


def test_short_lines_lack_readings_and_headers_have_no_date(spark, tmp_path):
    write(tmp_path / "s", "a.csv", "Date,A,B,C\n2000-1-1,1,2,3\n2000-1-2,1\nDate,A,B,C\n")
    write(tmp_path / "s", "b.csv", "Date,A,B,C\n2000-1-3,,5\n")
    rows = wide.read_wide_observations(spark, str(tmp_path / "s"))
    found = rows.groupBy("date").agg(F.count("*").alias("n"), F.sum("temp").alias("t")).orderBy("date").collect()
    assert [(r.n, r.t) for r in found] == [(3, 6.0), (3, 1.0), (3, 5.0)]
    assert sorted(r.site for r in wide.column_keys(spark, str(tmp_path / "s")).collect()) == ["A", "B", "C"]


def test_scratch_follows_the_session(spark):
    assert paths.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert paths.stored(spark.range(5)).count() == 5


def test_parameters_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "parameters")
    runs.write_parameters_json(spark, {1: {"tau": 0.1, "dim": 2000, "on": True, "name": "a"}, 2: {"tau": 1, "dim": 5}}, path)
    rows = {r["sim_id"]: r for r in spark.read.json(path).collect()}
    assert (rows[1]["tau"], rows[1]["dim"], rows[1]["on"], rows[1]["name"]) == (0.1, 2000, True, "a")
    assert (rows[2]["tau"], rows[2]["dim"], rows[2]["on"]) == (1.0, 5, None)


def test_scratch_follows_set_checkpoint_dir():
    conf = SimpleNamespace(get=lambda name, default: default)
    context = SimpleNamespace(getCheckpointDir=lambda: "hdfs://shared/x", master="spark://cluster")
    session = SimpleNamespace(conf=conf, sparkContext=context)
    assert paths.scratch_path(session, "t").startswith("hdfs://shared/x/")
    context.getCheckpointDir = lambda: None
    with pytest.raises(RuntimeError):
        paths.scratch_path(session, "t")


def test_a_run_of_wide_rows_is_written_where_it_is(spark, tmp_path):
    """Without gathering nothing is shuffled, and the folders hold the same rows."""
    rows = spark.range(40).select(F.lit(7).alias("sim_id"), "id", (F.col("id") % 4 / 4).alias("fraction"), F.array_repeat("id", 5).alias("a"))
    rows = rows.repartition(3)
    runs.write_run(rows, f"{tmp_path}/apart", 7, gather=False)
    runs.write_run(rows, f"{tmp_path}/together", 7)
    apart, together = (runs.read_finished_runs(spark, f"{tmp_path}/{n}") for n in ("apart", "together"))
    assert sorted(apart.collect()) == sorted(together.collect())
    assert len(apart.inputFiles()) > len(together.inputFiles()) == 4


def test_cells_travel_to_their_names_in_blocks(spark, tmp_path):
    """More columns than a block holds, a short line, and names that aren't sent to the cells."""
    names = [f"s{i}" for i in range(600)]
    write(tmp_path / "b", "a.csv", ",".join(["Date", *names]) + "\n2000-1-1," + ",".join(map(str, range(600))) + "\n2000-1-2," + ",".join(map(str, range(300))) + "\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = wide.read_wide_observations(spark, str(tmp_path / "b"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted((str(r.date), int(r.site[1:]), r.temp) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(d, i, float(i) if i < n else None) for d, n in (("2000-01-01", 600), ("2000-01-02", 300)) for i in range(600)]
    # A line is cut up in its task: not shuffled to its header, and a cell isn't a row before it has its name.
    assert "posexplode" not in plan and plan.count("Exchange hashpartitioning(file") <= 2


def test_wide_rows_go_to_their_files_unsorted(spark, tmp_path):
    """Rows of a run reach the writer in the order in which they are made, whatever their number, and the setting is put back."""
    rows = spark.range(400).select("id", (F.col("id") % 8 / 8).alias("fraction"), F.array_repeat("id", 5).alias("a")).coalesce(1)
    held, plans = spark.conf.get(runs.OPEN_FILES), []
    write = type(rows.write).parquet

    def seen(self, path, *args, **options):
        plans.append(spark.conf.get(runs.OPEN_FILES))
        return write(self, path, *args, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows.write), "parquet", seen)
        runs.write_run(rows, f"{tmp_path}/r", 3, gather=False)
    assert plans == [runs.MOST_OPEN] and spark.conf.get(runs.OPEN_FILES) == held
    back = runs.read_finished_runs(spark, f"{tmp_path}/r")
    assert sorted((r.id, r.fraction, r.a) for r in back.collect()) == sorted((r.id, r.fraction, r.a) for r in rows.collect())


def test_shuffles_of_written_tables_leave_the_disk(spark):
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    paths.free_shuffles(spark)
    before = files()
    paths.stored(spark.range(1000).repartition(7, "id"))
    assert files() > before
    paths.free_shuffles(spark)
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
