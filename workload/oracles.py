"""DuckDB SQL for the queries, on the same tables."""

from __future__ import annotations

from phenoline.operators.scoring import DEFAULT_FRACTIONS

# Stand-in inputs, as in standins.py.
OBS = """
obs_raw AS (
  SELECT s_name AS site, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS temp
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
axis AS (
  SELECT site, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM obs_raw GROUP BY site),
obs AS (
  SELECT a.site, a.date, o.temp,
         year(a.date) + CASE WHEN month(a.date) >= 8 THEN 1 ELSE 0 END AS season_year
  FROM axis a LEFT JOIN obs_raw o ON a.site = o.site AND a.date = o.date)
"""

SEASONS = """
bloom AS (
  SELECT s_name AS site, CAST(year(l_shipdate) AS INTEGER) AS year,
         min(CASE WHEN month(l_shipdate) >= 3 THEN CAST(l_shipdate AS DATE) END) AS first_bloom,
         min(CASE WHEN month(l_shipdate) >= 4 THEN CAST(l_shipdate AS DATE) END) AS full_bloom
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
seasons AS (
  SELECT site, year, first_bloom, full_bloom, make_date(year - 1, 8, 1) AS data_start_date,
         CAST(first_bloom - make_date(year - 1, 8, 1) AS INTEGER) AS days_to_first,
         CAST(full_bloom - make_date(year - 1, 8, 1) AS INTEGER) AS days_to_full,
         CAST(full_bloom - first_bloom AS INTEGER) AS bloom_offset
  FROM bloom WHERE first_bloom IS NOT NULL AND full_bloom IS NOT NULL)
"""

CITIES = """
cities AS (
  SELECT n_name AS country, s_name AS city_ascii, s_acctbal AS lat, top.lng
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN (SELECT c_nationkey, max(c_acctbal) AS lng FROM customer GROUP BY 1) top ON top.c_nationkey = n_nationkey)
"""


def _near(method: str, partition: str, order: str, pos: str, value: str) -> str:
    """Neighbour columns of the nearest known points."""
    count = 3 if method == "quadratic" else 1
    known = f"CASE WHEN {value} IS NOT NULL THEN {pos} END"
    window = f"OVER (PARTITION BY {partition} ORDER BY {order})"
    parts = []
    for k in range(1, count + 1):
        for tag, lookup in (("p", "lag"), ("n", "lead")):
            parts.append(f"{lookup}({known}, {k} IGNORE NULLS) {window} AS {tag}{k}x")
            parts.append(f"{lookup}({value}, {k} IGNORE NULLS) {window} AS {tag}{k}y")
    return ", ".join(parts)


def _parabola(at: str, a: str, b: str, c: str) -> str:
    terms = []
    for p, q, r in ((a, b, c), (b, a, c), (c, a, b)):
        terms.append(f"{p}y * (({at} - {q}x) * ({at} - {r}x)) / CAST(({p}x - {q}x) * ({p}x - {r}x) AS DOUBLE)")
    return "(" + " + ".join(terms) + ")"


def _fill(method: str, at: str, value: str, last: str | None) -> str:
    """Filled value for a window that ends at position ``last``."""

    def seen(k: int) -> str:
        return f"n{k}x IS NOT NULL" + (f" AND n{k}x <= {last}" if last else "")

    line = (
        f"CASE WHEN p1x IS NULL THEN (CASE WHEN {seen(1)} THEN n1y END) WHEN NOT ({seen(1)}) THEN p1y "
        f"ELSE (n1y - p1y) / (n1x - p1x) * ({at} - p1x) + p1y END"
    )
    if method == "linear":
        return f"coalesce({value}, {line})"
    curve = (
        f"CASE WHEN p1x IS NULL THEN (CASE WHEN {seen(3)} THEN {_parabola(at, 'n1', 'n2', 'n3')} END) "
        f"WHEN NOT ({seen(1)}) THEN (CASE WHEN p3x IS NOT NULL THEN {_parabola(at, 'p1', 'p2', 'p3')} END) "
        f"WHEN p2x IS NOT NULL THEN {_parabola(at, 'p1', 'n1', 'p2')} "
        f"ELSE (CASE WHEN {seen(2)} THEN {_parabola(at, 'p1', 'n1', 'n2')} END) END"
    )
    return f"coalesce({value}, {curve}, {line})"


# A wide table has a cell for every day that any site has.
OBS_WIDE = f"""{OBS.replace("obs AS (", "own AS (")},
obs AS (
  SELECT s.site, d.date, o.temp, d.season_year FROM (SELECT DISTINCT date, season_year FROM own) d
  CROSS JOIN (SELECT DISTINCT site FROM own) s LEFT JOIN own o ON o.site = s.site AND o.date = d.date)
"""


def _steps(method: str = "linear", obs: str = OBS) -> str:
    """CTEs that end in ``steps``."""
    return f"""{obs}, {SEASONS}, {CITIES},
picked AS (
  SELECT s.*, c.lat, c.lng, o.date, o.temp,
         CAST(row_number() OVER w - 1 AS INTEGER) AS step,
         count(*) FILTER (o.date <= first_bloom) OVER a AS n_first,
         count(*) FILTER (o.date <= full_bloom) OVER a AS n_full,
         count(temp) FILTER (o.date <= first_bloom) OVER a AS known_first,
         count(temp) FILTER (o.date <= full_bloom) OVER a AS known_full
  FROM seasons s JOIN cities c ON c.city_ascii = s.site
  JOIN obs o ON o.site = s.site AND o.date BETWEEN s.data_start_date AND greatest(s.first_bloom, s.full_bloom)
  WINDOW w AS (PARTITION BY s.site, s.year ORDER BY o.date), a AS (PARTITION BY s.site, s.year)),
valid AS (
  SELECT *, {_near(method, "site, year", "step", "step", "temp")} FROM picked
  WHERE n_first = days_to_first + 1 AND n_full = days_to_full + 1 AND known_first >= 30 AND known_full >= 30),
steps AS (
  SELECT site, year, first_bloom, full_bloom, data_start_date, days_to_first, days_to_full, bloom_offset, lat, lng,
         step, date, temp,
         CASE WHEN step <= days_to_first THEN {_fill(method, "step", "temp", "days_to_first")} END AS temp_first,
         CASE WHEN step <= days_to_full THEN {_fill(method, "step", "temp", "days_to_full")} END AS temp_full,
         days_to_first - step AS countdown_first, days_to_full - step AS countdown_full
  FROM valid)"""


FRACTIONS = ", ".join(f"CAST({f} AS DOUBLE)" for f in DEFAULT_FRACTIONS)

PREDICTED = f"""{_steps()},
sims AS (SELECT unnest([1, 2, 3, 4]) AS sim_id),
numbered AS (SELECT *, CAST(substring(site, 10, 9) AS INTEGER) AS num FROM steps WHERE step <= days_to_full),
predicted AS (
  SELECT sim_id, site, year, first_bloom, full_bloom, data_start_date, step, days_to_full + 1 AS full_length,
         CAST(countdown_first AS DOUBLE) AS true_first, CAST(countdown_full AS DOUBLE) AS true_full,
         countdown_first + ((step * 7 + num * 3 + sim_id * 5) % 11 - 5) * CAST(0.75 AS DOUBLE) AS pred_first,
         countdown_full + ((step * 5 + num * 7 + sim_id * 3) % 13 - 6) * CAST(0.5 AS DOUBLE) AS pred_full
  FROM numbered, sims)"""


def _scores(form: str = "sequence", align: str = "reference", predicted: str = PREDICTED) -> str:
    """CTEs that end in ``scores``."""
    shown = "cutoff" if align == "reference" else "cutoff - 1"
    if form == "sequence":
        errors = """avg(abs(pred_first - true_first)) FILTER (step < cutoff) AS mae_first,
         avg(abs(pred_full - true_full)) FILTER (step < cutoff) AS mae_full"""
    else:
        errors = """abs(max(pred_first) FILTER (step = cutoff - 1) - max(true_first) FILTER (step = cutoff)) AS mae_first,
         abs(max(pred_full) FILTER (step = cutoff - 1) - max(true_full) FILTER (step = cutoff)) AS mae_full"""
    return f"""{predicted},
cuts AS (SELECT unnest([{FRACTIONS}]) AS fraction),
cut AS (
  SELECT p.*, fraction, CAST(trunc(full_length * fraction) AS INTEGER) AS cutoff FROM predicted p, cuts),
folded AS (
  SELECT sim_id, site, year, first_bloom AS date_first, full_bloom AS date_full, data_start_date, fraction, cutoff,
         max(pred_first) FILTER (step = cutoff - 1) AS pred_first,
         max(pred_full) FILTER (step = cutoff - 1) AS pred_full,
         {errors}
  FROM cut GROUP BY ALL),
scores AS (
  SELECT *, data_start_date + cutoff AS cutoff_date,
    epoch_us(CAST(data_start_date + ({shown}) AS TIMESTAMP)) + CAST(round(pred_first * 86400000000) AS BIGINT)
      AS first_micros,
    epoch_us(CAST(data_start_date + ({shown}) AS TIMESTAMP)) + CAST(round(pred_full * 86400000000) AS BIGINT)
      AS full_micros
  FROM folded)"""


SCORES_OUT = """
SELECT sim_id, site, year, fraction, cutoff, pred_first, pred_full,
       CAST(CAST(cutoff_date AS DATE) AS VARCHAR) AS cutoff_date, first_micros, full_micros,
       mae_first, mae_full FROM scores"""

def _date_errors(predicted: str = PREDICTED) -> str:
    """CTEs that end in ``summary``."""
    return f"""{_scores(predicted=predicted)},
errors AS (
  SELECT sim_id, fraction,
         CAST(floor((first_micros - epoch_us(CAST(date_first AS TIMESTAMP))) / 86400000000) AS INTEGER) AS e_first,
         CAST(floor((full_micros - epoch_us(CAST(date_full AS TIMESTAMP))) / 86400000000) AS INTEGER) AS e_full
  FROM scores),
summary AS (
  SELECT sim_id, fraction AS cutoff, avg(abs(e_first)) AS mean_first, stddev_samp(abs(e_first)) AS std_first,
         avg(abs(e_full)) AS mean_full, stddev_samp(e_full) AS std_full, stddev_samp(abs(e_full)) AS std_full_abs
  FROM errors GROUP BY 1, 2)"""


DATE_ERRORS = _date_errors()


def _sweep() -> str:
    """CTEs that end in ``predicted``: split, scaling, ridge weights by Gaussian elimination, predictions of the test seasons."""
    size = 7
    turns = [f"sin(2 * pi() * step / (CAST(365.25 AS DOUBLE) / {k}))" for k in (1, 2, 3)]
    inputs = ["CAST(1 AS DOUBLE)", "(lat - lat_c) / lat_s", "(lng - lng_c) / lng_s", "(temp_full - t_lo) / t_s - 1", *turns]
    steps = []
    for k in range(1, size + 1):
        e = f"e{k - 1}"
        steps.append(f"""e{k} AS MATERIALIZED (
  SELECT a.sim_id, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v / p.v * b.v END AS v
  FROM {e} a JOIN {e} p ON p.sim_id = a.sim_id AND p.i = {k} AND p.j = {k}
  JOIN {e} b ON b.sim_id = a.sim_id AND b.i = {k} AND b.j = a.j JOIN {e} c ON c.sim_id = a.sim_id AND c.i = a.i AND c.j = {k})""")
    guess = [" + ".join(f"z[{i}] * w{t}[{i}]" for i in range(1, size + 1)) for t in (1, 2)]
    half = lambda c, n: f"min({c}) AS {n}_lo, (max({c}) - min({c})) / CAST(2 AS DOUBLE) AS {n}_s"
    spread = lambda c: f"quantile_cont({c}, 0.5) AS {c}_c, quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) AS {c}_s"
    return f"""{_steps()},
used AS MATERIALIZED (SELECT * FROM steps WHERE step <= days_to_full),
places AS (
  SELECT site, year, count(*) OVER () AS n,
         row_number() OVER (ORDER BY substr(md5(site || '|' || year || '|3'), 1, 13), site, year) AS place
  FROM (SELECT DISTINCT site, year FROM used)),
ends AS (SELECT {half("temp_full", "t")}, {half("countdown_first", "a")}, {half("countdown_full", "b")} FROM used),
spots AS (SELECT {spread("lat")}, {spread("lng")} FROM used WHERE step = 0),
inputs AS MATERIALIZED (
  SELECT u.*, ends.*, place <= floor(0.8 * n) AS train,
         [{", ".join(inputs)}, (countdown_first - a_lo) / a_s - 1, (countdown_full - b_lo) / b_s - 1] AS z
  FROM used u JOIN places USING (site, year), ends, spots),
sums AS (
  SELECT i, j, sum(z[i] * z[j]) AS v FROM inputs, range(1, {size + 1}) x(i), range(1, {size + 3}) y(j) WHERE train GROUP BY 1, 2),
runs AS (SELECT unnest([1, 2, 3, 4]) AS sim_id, CAST(unnest([1, 10, 100, 1000]) AS DOUBLE) AS alpha),
e0 AS MATERIALIZED (SELECT sim_id, i, j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM sums, runs),
{", ".join(steps)},
weights AS (
  SELECT sim_id, list(v ORDER BY i) FILTER (j = {size + 1}) AS w1, list(v ORDER BY i) FILTER (j = {size + 2}) AS w2
  FROM e{size} GROUP BY 1),
predicted AS (
  SELECT sim_id, site, year, first_bloom, full_bloom, data_start_date, step, days_to_full + 1 AS full_length,
         CAST(countdown_first AS DOUBLE) AS true_first, CAST(countdown_full AS DOUBLE) AS true_full,
         ({guess[0]} + 1) * a_s + a_lo AS pred_first, ({guess[1]} + 1) * b_s + b_lo AS pred_full
  FROM inputs, weights WHERE NOT train)"""


SUMMARY_OUT = """
SELECT sim_id, cutoff, round(mean_first, 6) AS mean_first, round(std_first, 6) AS std_first,
       round(mean_full, 6) AS mean_full, round(std_full, 6) AS std_full FROM summary"""

STEPS_OUT = """
SELECT site, year, step, CAST(date AS VARCHAR) AS date, days_to_first, days_to_full,
       coalesce(temp_first, -1.0) AS temp_first, coalesce(temp_full, -1.0) AS temp_full,
       countdown_first, countdown_full, lat, lng FROM steps"""

KEY_SETS = """
keys AS (
  SELECT DISTINCT 'Events' AS dataset, CAST(user_id AS VARCHAR) AS key FROM events
  UNION ALL SELECT DISTINCT 'Customers', CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT DISTINCT 'Orders', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT DISTINCT 'Suppliers', CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT DISTINCT 'Sources', source FROM documents),
names AS (SELECT unnest(['Events', 'Customers', 'Orders', 'Suppliers', 'Sources']) AS dataset)"""


def _stats(key: str) -> str:
    columns = []
    for v in ("mae_first", "mae_full"):
        mean, std, n = f"avg({v})", f"stddev_samp({v})", f"count({v})"
        sem = f"{std} / sqrt({n})"
        columns += [
            f"round({mean}, 6) AS {v}_mean",
            f"round({std}, 6) AS {v}_std",
            f"{n} AS {v}_count",
            f"round({sem}, 6) AS {v}_sem",
            f"round(1.96 * {sem}, 6) AS {v}_ci",
            f"round({mean} - 1.96 * {sem}, 6) AS {v}_lower",
            f"round({mean} + 1.96 * {sem}, 6) AS {v}_upper",
        ]
    return f"WITH {_scores()} SELECT {key}, {', '.join(columns)} FROM scores GROUP BY {key}"


def _gap(method: str, group: str = "site, season_year") -> str:
    return f"""WITH {OBS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY date) AS pos,
         count(temp) OVER (PARTITION BY {group}) AS known FROM obs),
near AS (SELECT *, {_near(method, group, "pos", "pos", "temp")} FROM placed WHERE known >= 3)
SELECT site, CAST(date AS VARCHAR) AS date, {_fill(method, "pos", "temp", None)} AS filled FROM near"""


ORACLES: dict[str, str] = {
    "season_steps": f"WITH {_steps()} {STEPS_OUT}",
    "season_steps_quadratic": f"WITH {_steps('quadratic')} {STEPS_OUT}",
    "season_steps_repeated_dates": f"WITH {_steps()} {STEPS_OUT}",
    "seasons_with_invalid": f"""WITH {OBS}, {SEASONS}, {CITIES},
counted AS (
  SELECT s.site, s.year, s.days_to_full,
         count(o.date) FILTER (o.date <= first_bloom) AS n_first, count(o.date) FILTER (o.date <= full_bloom) AS n_full,
         count(o.temp) FILTER (o.date <= first_bloom) AS known_first,
         count(o.temp) FILTER (o.date <= full_bloom) AS known_full
  FROM seasons s JOIN cities c ON c.city_ascii = s.site
  LEFT JOIN obs o ON o.site = s.site AND o.date BETWEEN s.data_start_date AND greatest(s.first_bloom, s.full_bloom)
  GROUP BY 1, 2, 3)
SELECT site AS site_name, year, days_to_full + 1 AS n_countdown,
       CAST(CASE WHEN known_first >= 30 THEN n_first ELSE 0 END AS INTEGER) AS n_first,
       CAST(CASE WHEN known_full >= 30 THEN n_full ELSE 0 END AS INTEGER) AS n_full FROM counted""",
    "seasons_kept_with_repeats": f"""WITH {OBS}, {SEASONS}, {CITIES},
readings AS (
  SELECT site, date, temp FROM obs
  UNION ALL SELECT s_name, CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE month(l_shipdate) = 2 AND l_suppkey % 3 = 0),
placed AS (
  SELECT s.*, c.lat, c.lng, o.date, o.temp,
         CAST(row_number() OVER w - 1 AS INTEGER) AS step,
         count(*) FILTER (o.date <= first_bloom) OVER a - 1 AS last_first,
         count(*) FILTER (o.date <= full_bloom) OVER a - 1 AS last_full,
         count(temp) FILTER (o.date <= first_bloom) OVER a AS known_first,
         count(temp) FILTER (o.date <= full_bloom) OVER a AS known_full
  FROM seasons s JOIN cities c ON c.city_ascii = s.site
  JOIN readings o ON o.site = s.site AND o.date BETWEEN s.data_start_date AND greatest(s.first_bloom, s.full_bloom)
  WINDOW w AS (PARTITION BY s.site, s.year ORDER BY o.date, o.temp NULLS FIRST), a AS (PARTITION BY s.site, s.year)),
near AS (SELECT *, {_near("linear", "site, year", "step", "step", "temp")} FROM placed),
steps AS (
  SELECT *, CASE WHEN known_first >= 30 AND step <= last_first THEN {_fill("linear", "step", "temp", "last_first")} END AS temp_first,
         CASE WHEN known_full >= 30 AND step <= last_full THEN {_fill("linear", "step", "temp", "last_full")} END AS temp_full,
         days_to_first - step AS countdown_first, days_to_full - step AS countdown_full FROM near)
{STEPS_OUT}""",
    "pair_events": f"""WITH {SEASONS}
SELECT site, year, CAST(first_bloom AS VARCHAR) AS first_bloom, CAST(full_bloom AS VARCHAR) AS full_bloom,
       CAST(data_start_date AS VARCHAR) AS data_start_date, days_to_first, days_to_full, bloom_offset,
       CAST(1 AS BIGINT) AS copies FROM seasons""",
    "sites_in_country": f"WITH {CITIES} SELECT city_ascii, lat, lng FROM cities WHERE country = 'NATION_15'",
    "site_coordinates": """
SELECT n_name AS site, count(*) AS n_rows, max(s_acctbal) AS top_lat
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
    "site_coordinates_left": """
WITH names AS (SELECT n_name AS site FROM nation UNION ALL SELECT r_name FROM region),
places AS (SELECT n_name, s_acctbal AS lat, CAST(s_suppkey AS DOUBLE) AS lng FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT site, coalesce(lat, -1e9::DOUBLE) AS lat, coalesce(lng, -1.0::DOUBLE) AS lng FROM names LEFT JOIN places ON n_name = site""",
    "repeated_sites": """
SELECT n_name AS city_ascii, count(*) AS n_rows FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 HAVING count(*) > 1""",
    "kept_and_skipped_sites": """
SELECT CAST(c_custkey AS VARCHAR) AS site,
       CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'kept' ELSE 'skipped' END AS status FROM customer""",
    "densify": """
WITH days AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS site, CAST(l_shipdate AS DATE) AS d FROM lineitem GROUP BY 1, 2)
SELECT site, max(d) - min(d) + 1 AS n_days, count(*) AS n_known,
       CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM days GROUP BY site""",
    "unpivot_events": f"""WITH {SEASONS}
SELECT site, year, CAST(first_bloom AS VARCHAR) AS date FROM bloom
WHERE first_bloom IS NOT NULL AND dayofweek(first_bloom) NOT IN (0, 6)""",
    "unpivot_observations": """
WITH priced AS (
  SELECT n_name AS site, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n.n_name AS site, CAST(days.d AS VARCHAR) AS date, coalesce(v, -1.0) AS temp
FROM (SELECT DISTINCT d FROM priced) days CROSS JOIN nation n
LEFT JOIN priced p ON p.site = n.n_name AND p.d = days.d""",
    "site_keys": "SELECT n_name AS site FROM nation",
    "nest_seasons": f"""WITH {_steps()}
SELECT site AS site_name, year,
       max(days_to_full) + 1 AS n_countdown_first, max(days_to_full) + 1 AS n_countdown_full,
       max(days_to_first) - max(days_to_full) AS end_first, 0 AS end_full,
       CAST(count(temp_first) AS INTEGER) AS n_first, CAST(count(temp_full) AS INTEGER) AS n_full,
       max(temp_full) FILTER (step = 0) AS start_temp,
       max(temp_first) FILTER (step = days_to_first) AS end_temp_first,
       max(temp_full) FILTER (step = days_to_full) AS end_temp_full, site AS city_ascii
FROM steps GROUP BY site, year""",
    "nested_items": f"""WITH {_steps()}
SELECT site AS site_name, year, step, CAST(countdown_first AS DOUBLE) AS countdown_to_first, CAST(countdown_full AS DOUBLE) AS countdown_to_full,
       coalesce(temp_first, -1e9::DOUBLE) AS temps_to_first, coalesce(temp_full, -1e9::DOUBLE) AS temps_to_full FROM steps WHERE step <= days_to_full""",
    "zero_padding": """
WITH v AS (SELECT vec_id, embedding, label % 64 AS n FROM embeddings WHERE label IS NOT NULL),
i AS (SELECT vec_id, embedding, n, unnest(range(greatest(n, 40))) AS pos FROM v)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN pos < n THEN CAST(embedding[pos + 1] AS DOUBLE) ELSE 0.0 END, 6) AS value FROM i""",
    "explode_steps": f"""WITH {_steps()}
SELECT site AS site_name, year, step, lat, lng, temp_full AS temp,
       CAST(countdown_first AS DOUBLE) AS target_first, CAST(countdown_full AS DOUBLE) AS target_full
FROM steps WHERE step <= days_to_full""",
    "explode_daily": f"""WITH {_steps()}
SELECT site AS site_name, year, CAST(date AS VARCHAR) AS date, temp_full AS temperature,
       CAST(countdown_first AS DOUBLE) AS countdown_first, CAST(countdown_full AS DOUBLE) AS countdown_full
FROM steps WHERE step <= days_to_full""",
    "length_stats": f"""WITH {_steps()}
SELECT CAST(label AS VARCHAR) AS kind, CAST(min(len(embedding)) AS INTEGER) AS min_length,
       CAST(max(len(embedding)) AS INTEGER) AS max_length FROM embeddings GROUP BY 1
UNION ALL SELECT 'temps', min(days_to_full) + 1, max(days_to_full) + 1 FROM steps""",
    "scale_minmax": """
WITH items AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos
  FROM embeddings),
fit AS (SELECT min(v) AS lo, max(v) AS hi FROM items)
SELECT vec_id, pos, round((v - lo) / ((hi - lo) / 2.0) - 1.0, 6) AS value FROM items, fit""",
    "scale_standard": """
SELECT event_id, round((value - m) / s, 6) AS value
FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""",
    "scale_robust": """
SELECT c_custkey, round((c_acctbal - m) / (hi - lo), 6) AS c_acctbal
FROM customer, (SELECT quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.05) AS lo,
                       quantile_cont(c_acctbal, 0.95) AS hi FROM customer)""",
    "scale_robust_by_counting": """
SELECT 'l_extendedprice' AS "column", 'robust' AS kind, round(quantile_cont(l_extendedprice, 0.5), 6) AS center,
       round(quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05), 6) AS scale FROM lineitem""",
    "scale_maxabs": """
WITH items AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos
  FROM embeddings)
SELECT vec_id, pos, round(v / m, 6) AS value FROM items, (SELECT max(abs(v)) AS m FROM items)""",
    "scale_quantile": """
WITH q AS (SELECT quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS x FROM events),
u AS (SELECT unnest(x) AS x, unnest(range(11)) / 10 AS r FROM q),
k AS (SELECT x, min(r) AS r1, max(r) AS r2 FROM u GROUP BY x),
s AS (SELECT *, lead(x) OVER (ORDER BY x) AS nx, lead(r1) OVER (ORDER BY x) AS nr, min(x) OVER () AS low, max(x) OVER () AS high FROM k),
f AS (
  SELECT event_id, value AS v, CASE WHEN value = low THEN 0 WHEN value = high THEN 1 WHEN value = x THEN (r1 + r2) / 2
    ELSE r2 + (value - x) * (nr - r2) / (nx - x) END AS share
  FROM events JOIN s ON value >= x AND (nx IS NULL OR value < nx))
SELECT event_id, round(share, 6) AS value, round(CASE WHEN share >= 1 THEN q.x[11] ELSE
    q.x[1 + CAST(floor(share * 10) AS INT)] + (share * 10 - floor(share * 10)) * (q.x[2 + CAST(floor(share * 10) AS INT)] - q.x[1 + CAST(floor(share * 10) AS INT)])
  END, 6) AS back FROM f, q""",
    "scale_symlog": """
WITH u AS (SELECT avg(abs(c_acctbal)) AS unit FROM customer)
SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal) / unit), 6) AS c_acctbal, round(c_acctbal, 4) AS back FROM customer, u""",
    "scale_roundtrip": "SELECT event_id, round(value, 6) AS value FROM events",
    "scaler_table": """
SELECT 'l_quantity' AS "column", 'minmax' AS kind, round(min(l_quantity), 6) AS center,
       round((max(l_quantity) - min(l_quantity)) / 2, 6) AS scale, CAST(-1 AS DOUBLE) AS floor FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'standard', round(avg(l_extendedprice), 6), round(stddev_pop(l_extendedprice), 6), 0
FROM lineitem
UNION ALL SELECT 'l_discount', 'robust', round(quantile_cont(l_discount, 0.5), 6),
       round(quantile_cont(l_discount, 0.95) - quantile_cont(l_discount, 0.05), 6), 0 FROM lineitem
UNION ALL SELECT 'l_tax', 'maxabs', 0, round(max(abs(l_tax)), 6), 0 FROM lineitem""",
    "split_counts": """
WITH n AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders)
SELECT 'train' AS part, CAST(floor(0.8 * n) AS BIGINT) AS n_keys, CAST(floor(0.8 * n) AS BIGINT) AS n_rows FROM n
UNION ALL SELECT 'test', n - CAST(floor(0.8 * n) AS BIGINT), n - CAST(floor(0.8 * n) AS BIGINT) FROM n""",
    "split_members": """
WITH keys AS (SELECT DISTINCT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders),
placed AS (
  SELECT *, count(*) OVER () AS n,
         row_number() OVER (ORDER BY substr(md5(o_custkey || '|' || day || '|3'), 1, 13), o_custkey, day) AS place
  FROM keys)
SELECT o_custkey, day, CASE WHEN place <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM placed""",
    "shared_keys_of_many": """
WITH k AS (SELECT DISTINCT o_custkey AS c, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month FROM orders),
m AS (SELECT DISTINCT month FROM k),
hit AS (SELECT x.month AS a, y.month AS b, count(*) AS n FROM k x JOIN k y ON x.c = y.c AND x.month < y.month GROUP BY ALL)
SELECT x.month AS dataset_1, y.month AS dataset_2, coalesce(n, 0) AS overlap_count
FROM m x JOIN m y ON x.month < y.month LEFT JOIN hit ON a = x.month AND b = y.month""",
    "gap_linear": _gap("linear"),
    "gap_quadratic": _gap("quadratic"),
    "gap_spline": """
SELECT s_suppkey AS site, CAST(t AS INTEGER) AS t, NOT ((t * 7 + s_suppkey) % 5 > 1 AND t BETWEEN 3 AND 115) AS gap,
       round((s_acctbal / 100 + (s_nationkey - 12) * t / 10.0::DOUBLE + (s_suppkey % 7 - 3) * t * t / 50.0::DOUBLE) / pi(), 4) AS filled
FROM supplier, range(120) r(t)""",
    "gap_series": _gap("linear", "site"),
    "gap_series_quadratic": _gap("quadratic", "site"),
    "lag_window_features": f"""WITH {_steps()},
past AS (
  SELECT site, year, step, countdown_full, CAST(count(*) OVER w AS INTEGER) AS n_past,
         min(temp_full) OVER w AS low, max(temp_full) OVER w AS high,
         first_value(temp_full) OVER w AS oldest, last_value(countdown_full) OVER w AS newest_countdown
  FROM steps
  WINDOW w AS (PARTITION BY site, year ORDER BY step ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT * FROM past WHERE n_past = 30""",
    "lag_window_values": f"""WITH {_steps()},
past AS (
  SELECT site, year, step, list(temp_full) OVER w AS a, list(CAST(countdown_full AS DOUBLE)) OVER w AS b
  FROM steps WINDOW w AS (PARTITION BY site, year ORDER BY step ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT site, year, step, round(list_sum(list_transform(a, lambda v, i: v * i)) / pi(), 3) AS temp_by_place, round(list_sum(a) / pi(), 3) AS temp_sum,
       round(list_sum(list_transform(b, lambda v, i: v * i)) / pi(), 3) AS days_by_place FROM past WHERE len(a) = 30""",
    "lag_products": f"""WITH {_steps()},
past AS (
  SELECT countdown_first AS y, list(temp_full / 1000) OVER w AS a, list(CAST(countdown_full AS DOUBLE)) OVER w AS b
  FROM steps WINDOW w AS (PARTITION BY site, year ORDER BY step ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
z AS (
  SELECT row_number() OVER () AS id, list_concat([1.0::DOUBLE], list_concat(list_reverse(a), list_concat(list_reverse(b), [CAST(y AS DOUBLE)]))) AS z
  FROM past WHERE len(a) = 6),
c AS (SELECT id, unnest(z) AS v, unnest(range(14)) AS i FROM z)
SELECT CAST(p.i AS INTEGER) AS i, CAST(q.i AS INTEGER) AS j, round(sum(p.v * q.v), 1) AS value
FROM c p JOIN c q ON p.id = q.id WHERE p.i < 13 GROUP BY 1, 2""",
    "fourier_features": """
SELECT CAST(dayofyear(l_shipdate) AS INTEGER) AS doy, count(*) AS n_rows,
       round(sin(2 * pi() * dayofyear(l_shipdate) / 365) + 0.5 * sin(4 * pi() * dayofyear(l_shipdate) / 365)
             + 0.25 * sin(6 * pi() * dayofyear(l_shipdate) / 365), 6) AS signal
FROM lineitem GROUP BY dayofyear(l_shipdate)""",
    "score_sequence_errors": f"WITH {_scores()} {SCORES_OUT}",
    "score_sequence_exact_dates": f"WITH {_scores(align='exact')} {SCORES_OUT}",
    "score_point_errors": f"WITH {_scores('point')} {SCORES_OUT}",
    "score_sequence_rows": f"""WITH {_scores()}
SELECT sim_id, site AS site_name, year, fraction, cutoff,
       CAST(date_full - data_start_date AS INTEGER) + 1 AS full_length, cutoff AS n_first, cutoff AS n_full,
       pred_full AS last_full, CAST(CAST(cutoff_date AS DATE) AS VARCHAR) AS cutoff_date, first_micros,
       mae_first, mae_full FROM scores""",
    "score_point_rows": f"""WITH {_scores('point')},
shown AS (SELECT * FROM scores)
SELECT sim_id, site AS site_name, year, CAST(data_start_date AS VARCHAR) AS start_date, CAST(date_first AS VARCHAR) AS date_first,
       CAST(date_full AS VARCHAR) AS date_full, CAST(date_first - data_start_date - cutoff AS DOUBLE) AS true_first,
       CAST(date_full - data_start_date - cutoff AS DOUBLE) AS true_full, pred_first, pred_full, cutoff,
       CAST(CAST(cutoff_date AS DATE) AS VARCHAR) AS cutoff_date, first_micros AS pred_first_bloom_date,
       full_micros AS pred_full_bloom_date, mae_first, mae_full, fraction FROM shown""",
    "cutoff_values": f"""WITH {_scores()}
SELECT sim_id, site AS site_name, year, fraction, cutoff,
       CAST(date_first - data_start_date - cutoff AS DOUBLE) AS true_first_at,
       CAST(date_full - data_start_date - cutoff AS DOUBLE) AS true_full_at, cutoff - 1 AS n_history,
       CAST(date_first - data_start_date - cutoff + 1 AS DOUBLE) AS last_shown
FROM scores""",
    "step_mse": f"""WITH {PREDICTED}
SELECT sim_id, round(sum(((pred_first - true_first) ** 2 + (pred_full - true_full) ** 2) / 2) / count(*), 6) AS mse
FROM predicted GROUP BY 1""",
    "step_error_floor": f"""WITH {PREDICTED},
e AS (SELECT sim_id, step,
             greatest(1e-10, ((pred_first - true_first) ** 2 + (pred_full - true_full) ** 2) / 2) AS mse FROM predicted)
SELECT sim_id, step, min(mse) AS lowest, max(mse) AS highest, count(*) AS n_rows FROM e GROUP BY 1, 2""",
    "row_model": f"""WITH c AS (SELECT unnest([{FRACTIONS}]) AS fraction), {_steps()}
SELECT DISTINCT sim_id, fraction, CAST(1 AS DOUBLE) AS mae_first, CAST(1 AS DOUBLE) AS mae_full,
       CAST(1 AS DOUBLE) AS mae_average FROM c, steps, (SELECT unnest([1, 2, 3, 4]) AS sim_id)""",
    "sequence_model": f"""WITH {PREDICTED},
means AS (
  SELECT *, avg(true_first) OVER (PARTITION BY sim_id, site, year) AS p1, avg(true_full) OVER (PARTITION BY sim_id, site, year) AS p2
  FROM predicted),
maes AS (
  SELECT sim_id, site, year, fraction, avg(abs(p1 - true_first)) AS m1, avg(abs(p2 - true_full)) AS m2
  FROM means, (SELECT unnest([{FRACTIONS}]) AS fraction) WHERE step < trunc(full_length * fraction) GROUP BY 1, 2, 3, 4)
SELECT sim_id, fraction, round(avg(m1), 6) AS mae_first, round(avg(m2), 6) AS mae_full,
       round((avg(m1) + avg(m2)) / 2, 6) AS mae_average FROM maes GROUP BY 1, 2""",
    "errors_by_site": _stats("site"),
    "errors_by_year": _stats("year"),
    "overall_metrics": f"""WITH {_scores()}
SELECT sim_id, fraction, round(avg(mae_first), 6) AS mae_first, round(avg(mae_full), 6) AS mae_full,
       round((avg(mae_first) + avg(mae_full)) / 2, 6) AS mae_average FROM scores GROUP BY 1, 2""",
    "run_summary": f"WITH {DATE_ERRORS} {SUMMARY_OUT}",
    "run_summary_bands": f"""WITH {DATE_ERRORS}
SELECT sim_id, cutoff, round(mean_first - std_first, 6) AS low_first, round(mean_full - std_full_abs, 6) AS low_full,
       round(mean_first + std_first, 6) AS high_first, round(mean_full + std_full_abs, 6) AS high_full FROM summary""",
    "run_summary_long": f"""WITH {DATE_ERRORS}
SELECT 'full' AS event, sim_id, 'mean_' || CAST(cutoff AS VARCHAR) AS key, round(mean_full, 6) AS values FROM summary
UNION ALL SELECT 'full', sim_id, 'std_' || CAST(cutoff AS VARCHAR), round(std_full, 6) FROM summary
UNION ALL SELECT 'first', sim_id, 'mean_' || CAST(cutoff AS VARCHAR), round(mean_first, 6) FROM summary
UNION ALL SELECT 'first', sim_id, 'std_' || CAST(cutoff AS VARCHAR), round(std_first, 6) FROM summary""",
    "best_runs": f"""WITH {DATE_ERRORS},
m AS (SELECT sim_id, avg(mean_first) AS f, avg(mean_full) AS u FROM summary GROUP BY 1)
(SELECT 'first' AS event, round(f, 6) AS best_mae, sim_id AS best_sim_id FROM m ORDER BY f, sim_id LIMIT 1)
UNION ALL (SELECT 'full', round(u, 6), sim_id FROM m ORDER BY u, sim_id LIMIT 1)""",
    "seasons_and_sites": f"""WITH {SEASONS} SELECT DISTINCT 'year' AS kind, CAST(year AS VARCHAR) AS value FROM bloom WHERE first_bloom IS NOT NULL
UNION ALL SELECT DISTINCT 'site', site FROM bloom WHERE first_bloom IS NOT NULL""",
    "key_counts": f"WITH {KEY_SETS} SELECT dataset, count(*) AS n_keys FROM keys GROUP BY 1",
    "key_overlap": f"""WITH {KEY_SETS}
SELECT a.dataset AS dataset_1, b.dataset AS dataset_2,
       (SELECT count(*) FROM keys x JOIN keys y ON x.key = y.key
        WHERE x.dataset = a.dataset AND y.dataset = b.dataset) AS overlap_count
FROM names a JOIN names b ON a.dataset < b.dataset""",
    "shared_keys": "SELECT user_id AS key FROM events INTERSECT SELECT o_custkey FROM orders",
    "latest_doy": """
WITH d AS (
  SELECT o_custkey AS c, year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1, 2),
kept AS (SELECT y FROM d WHERE c = (SELECT min(c) FROM d))
SELECT CAST(d AS VARCHAR) AS latest_date, CAST(dayofyear(d) AS INTEGER) AS day_of_year
FROM d WHERE y IN (SELECT y FROM kept) ORDER BY dayofyear(d) DESC, y, c LIMIT 1""",
    "date_arithmetic": """
SELECT event_id, CAST(floor(epoch_us(ts - TIMESTAMP '2024-01-15') / 86400000000) AS INTEGER) AS floored,
       CAST(CAST(ts AS DATE) - DATE '2024-01-15' AS INTEGER) AS whole, CAST(dayofyear(ts) AS INTEGER) AS doy,
       CAST(CASE WHEN CAST(ts AS DATE) >= make_date(year(ts), 1, 15) THEN year(ts) + 1 ELSE year(ts) END AS INTEGER)
         AS season,
       CAST(CAST(ts AS DATE) + 40 AS VARCHAR) AS later,
       epoch_us(TIMESTAMP '2024-01-15') + CAST(floor(value) * 10800000000 AS BIGINT) AS shifted
FROM events""",
    "fit_lines": f"""WITH {_steps()}
SELECT site, round(regr_slope(temp_full, step), 6) AS slope, round(regr_intercept(temp_full, step), 6) AS intercept,
       count(*) AS n FROM steps GROUP BY site""",
    "fit_readout": f"""WITH {_steps()},
sums AS (
  SELECT count(*) AS n, sum(step / 100.0) AS t, sum((step / 100.0) ** 2) AS tt,
         CAST(sum(countdown_full) AS DOUBLE) AS y, sum(step / 100.0 * countdown_full) AS ty
  FROM steps WHERE step <= days_to_full),
alphas AS (SELECT CAST(unnest([1, 100]) AS DOUBLE) AS alpha)
SELECT alpha, round(((tt + alpha) * y - t * ty) / ((n + alpha) * (tt + alpha) - t * t), 6) AS w_bias,
       round(((n + alpha) * ty - t * y) / ((n + alpha) * (tt + alpha) - t * t), 6) AS w_t FROM sums, alphas""",
    "readout_sweep": f"WITH {_date_errors(_sweep())}{SUMMARY_OUT}",
    "fit_and_score": f"""WITH {_steps()},
rows AS (
  SELECT *, step / 100.0 AS t, CAST(trunc((days_to_full + 1) * fraction) AS INTEGER) AS cutoff
  FROM steps, (SELECT unnest([{FRACTIONS}]) AS fraction) WHERE step <= days_to_full),
sums AS (
  SELECT count(*) AS n, sum(step / 100.0) AS t, sum((step / 100.0) ** 2) AS tt,
         CAST(sum(countdown_first) AS DOUBLE) AS y1, sum(step / 100.0 * countdown_first) AS ty1,
         CAST(sum(countdown_full) AS DOUBLE) AS y2, sum(step / 100.0 * countdown_full) AS ty2
  FROM steps WHERE step <= days_to_full),
runs AS (SELECT 1 AS sim_id, CAST(1 AS DOUBLE) AS alpha UNION ALL SELECT 2, 1000),
weights AS (
  SELECT sim_id, ((tt + alpha) * y1 - t * ty1) / ((n + alpha) * (tt + alpha) - t * t) AS b1,
         ((n + alpha) * ty1 - t * y1) / ((n + alpha) * (tt + alpha) - t * t) AS w1,
         ((tt + alpha) * y2 - t * ty2) / ((n + alpha) * (tt + alpha) - t * t) AS b2,
         ((n + alpha) * ty2 - t * y2) / ((n + alpha) * (tt + alpha) - t * t) AS w2 FROM sums, runs),
maes AS (
  SELECT sim_id, fraction, site, year, avg(abs(b1 + w1 * t - countdown_first)) AS m1,
         avg(abs(b2 + w2 * t - countdown_full)) AS m2
  FROM rows, weights WHERE step < cutoff GROUP BY 1, 2, 3, 4)
SELECT sim_id, fraction, round(avg(m1), 6) AS mae_first, round(avg(m2), 6) AS mae_full,
       round((avg(m1) + avg(m2)) / 2, 6) AS mae_average FROM maes GROUP BY 1, 2""",
    "sheet_extract": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS "Year", count(DISTINCT n_name) AS n_sheets, max(o_totalprice) AS top
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "sheet_rows": """
WITH y AS (
  SELECT n_name, n_nationkey % 3 AS kind, CAST(year(o_orderdate) AS INTEGER) AS y, quarter(o_orderdate) AS q, o_totalprice AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name AS "City", y AS "Year",
       coalesce(max(p) FILTER (q = 1 AND kind < 2), -1.0) AS "Q1", coalesce(max(p) FILTER (q = 2 AND kind = 0), -1.0) AS "Q2",
       coalesce(max(p) FILTER (q = 3 AND kind < 2), -1.0) AS "Q3", coalesce(max(p) FILTER (q = 4 AND kind = 0), -1.0) AS "Q4",
       coalesce(max(p) FILTER (kind = 2), -1.0) AS "Top" FROM y GROUP BY n_name, kind, y""",
    "run_folders": f"WITH {DATE_ERRORS} {SUMMARY_OUT}",
    "run_folder_paths": f"WITH {DATE_ERRORS} {SUMMARY_OUT} WHERE sim_id IN (1, 3)",
    "run_catalogue": f"""WITH sequence_runs AS (WITH {_scores()} SELECT * FROM scores WHERE sim_id < 4),
point_runs AS (WITH {_scores('point')} SELECT * FROM scores WHERE sim_id = 4)
SELECT sim_id, site AS site_name, year, fraction, cutoff, CAST(date_full - data_start_date AS INTEGER) + 1 AS full_length, cutoff AS n_shown,
       pred_full AS last_full, CAST(CAST(cutoff_date AS DATE) AS VARCHAR) AS cutoff_date, first_micros, full_micros, mae_first, mae_full
FROM sequence_runs
UNION ALL SELECT sim_id, site, year, fraction, cutoff, NULL, 1, pred_full, CAST(CAST(cutoff_date AS DATE) AS VARCHAR), first_micros, full_micros,
       mae_first, mae_full FROM point_runs""",
    "run_parameters": """
WITH s AS (SELECT unnest([1, 2, 3, 4]) AS sim_id), n AS (SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customer)
SELECT sim_id, 'dim_input' AS name, '3' AS value FROM s
UNION ALL SELECT sim_id, 'dim_reservoir', CAST(500 * sim_id AS VARCHAR) FROM s
UNION ALL SELECT sim_id, 'tau', CAST(sim_id / 10 AS VARCHAR) FROM s
UNION ALL SELECT sim_id, 'device', 'cpu:' || sim_id FROM s
UNION ALL SELECT sim_id, 'noise', CASE WHEN sim_id > 2 THEN 'true' ELSE 'false' END FROM s
UNION ALL SELECT sim_id, 'orders', CAST(orders AS VARCHAR) FROM s, n
UNION ALL SELECT sim_id, 'customer', CAST(customer AS VARCHAR) FROM s, n""",
    "summary_sinks": f"""WITH {DATE_ERRORS}
SELECT sim_id, 'mae_first mean_' || CAST(cutoff AS VARCHAR) AS key, round(mean_first, 6) AS value FROM summary
UNION ALL SELECT sim_id, 'mae_first std_' || CAST(cutoff AS VARCHAR), round(std_first, 6) FROM summary
UNION ALL SELECT sim_id, 'mae_full mean_' || CAST(cutoff AS VARCHAR), round(mean_full, 6) FROM summary
UNION ALL SELECT sim_id, 'mae_full std_' || CAST(cutoff AS VARCHAR), round(std_full, 6) FROM summary
UNION ALL SELECT sim_id, 'average_' || CAST(fraction AS VARCHAR), round((avg(mae_first) + avg(mae_full)) / 2, 6)
FROM scores GROUP BY sim_id, fraction""",
    "season_cache": f"""WITH {_steps()}
SELECT site AS site_name, year, 1 AS n_built, CAST(max(days_to_full) AS DOUBLE) AS days,
       round(max(temp_full) FILTER (step = days_to_full), 6) AS end_temp FROM steps GROUP BY site, year""",
    "melt_observations": f"""WITH {OBS_WIDE}
SELECT site, CAST(date AS VARCHAR) AS date, coalesce(temp, -1.0) AS temp FROM obs""",
    "column_keys": "SELECT DISTINCT s_name AS site FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "load_seasons": f"""WITH {_steps(obs=OBS_WIDE)},
spans AS (
  SELECT min(countdown_first) AS f0, max(countdown_first) AS f1, min(countdown_full) AS u0, max(countdown_full) AS u1,
         min(temp_first) AS tf0, max(temp_first) AS tf1, min(temp_full) AS tu0, max(temp_full) AS tu1 FROM steps WHERE step <= days_to_full),
places AS (SELECT DISTINCT site, year, lat, lng FROM steps),
p AS (
  SELECT quantile_cont(lat, 0.5) AS la, quantile_cont(lat, 0.95) - quantile_cont(lat, 0.05) AS las,
         quantile_cont(lng, 0.5) AS ln, quantile_cont(lng, 0.95) - quantile_cont(lng, 0.05) AS lns FROM places)
SELECT site AS site_name, year, strftime(CAST(first_bloom AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS first_bloom, days_to_full,
       round((lat - la) / las, 6) AS lat, round((lng - ln) / lns, 6) AS lng, step,
       round((countdown_first - f0) / ((f1 - f0) / 2) - 1, 6) AS countdown_to_first,
       round((countdown_full - u0) / ((u1 - u0) / 2) - 1, 6) AS countdown_to_full,
       round((temp_first - tf0) / ((tf1 - tf0) / 2) - 1, 6) AS temps_to_first,
       round((temp_full - tu0) / ((tu1 - tu0) / 2) - 1, 6) AS temps_to_full
FROM steps, spans, p""",
    "wide_csv": f"WITH {CITIES} SELECT city_ascii, lat, lng FROM cities",
}
