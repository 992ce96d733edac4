"""SQL statements that state each query's result on the same tables."""

from __future__ import annotations

from workload.panels import PAIR, TREATED
from workload.queries import N_PERM, OUTCOMES, NATIONS, SEED, STEP

ORACLES: dict[str, str] = {}
T_QUANTILE = "tan(pi() * 0.45)"
MAX_ROUNDS = 50
SPEC = {
    "quarter": ("2000-01-01", 3),
    "month": ("1999-01-01", 1),
    "day": ("2024-01-21", None),
}


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


SOURCE = """src AS (
  SELECT o_orderpriority, n_name, o_orderdate, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

PANELS = {
    "quarter": f"""{SOURCE},
panel AS (
  SELECT o_orderpriority AS outcome, n_name AS unit, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS t,
         SUM(cents) / 1e8 AS y FROM src GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'all', n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE), SUM(cents) / 1e8 FROM src GROUP BY 2, 3)""",
    "month": f"""{SOURCE},
panel AS (
  SELECT 'all' AS outcome, n_name AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS t,
         SUM(cents) / 1e8 AS y
  FROM src GROUP BY 1, 2, 3)""",
    "day": """panel AS (
  SELECT event_type AS outcome, 'G' || (user_id % 20) AS unit, CAST(ts AS DATE) AS t,
         SUM(CAST(ROUND(value * 100) AS BIGINT)) / 1e4 AS y FROM events GROUP BY 1, 2, 3)""",
}

DENSE = """dense AS (
  SELECT u.outcome, u.unit, d.t, p.y
  FROM (SELECT DISTINCT outcome, unit FROM panel) u
  JOIN (SELECT DISTINCT outcome, t FROM panel) d ON d.outcome = u.outcome
  LEFT JOIN panel p ON p.outcome = u.outcome AND p.unit = u.unit AND p.t = d.t)"""


def studies(kind: str = "quarter", donors=None, shifts=(0,)) -> str:
    """CTEs from the panel to periods, complete donors and usable studies."""
    base, months = SPEC[kind]
    treated = TREATED if kind != "day" else ("G2", "G6")
    if kind == "day":
        pool = f"SELECT DISTINCT unit, CASE WHEN unit IN ({quoted(treated)}) THEN 'treated' ELSE 'control' END AS role FROM panel"
        back = "base_date - CAST(shift AS INTEGER)"
    else:
        keep = f" WHERE n_name IN ({quoted((*treated, *donors))})" if donors else ""
        pool = f"SELECT n_name AS unit, CASE WHEN n_name IN ({quoted(treated)}) THEN 'treated' ELSE 'control' END AS role FROM nation{keep}"
        back = f"base_date - to_months({months} * CAST(shift AS INTEGER))"
    return f"""{PANELS[kind]},
roles AS ({pool}),
study AS (
  SELECT *, CAST({back} AS DATE) AS treatment_date,
         CASE WHEN shift = 0 THEN 'FALSE' ELSE 'time_' || shift END AS placebo
  FROM (SELECT outcome, treated, shift, DATE '{base}' AS base_date
        FROM (SELECT DISTINCT outcome FROM panel) o,
             (SELECT unnest([{quoted(treated)}]) AS treated) u,
             (SELECT unnest([{", ".join(map(str, shifts))}]) AS shift) s)),
usable AS (
  SELECT s.*, p.unit, p.t, p.y, r.role FROM study s JOIN panel p ON p.outcome = s.outcome
  JOIN roles r ON r.unit = p.unit WHERE (r.role = 'control' OR p.unit = s.treated){" AND p.t <= DATE '2001-07-31'" if kind == "month" else ""}),
dated AS (
  SELECT *, t >= treatment_date AS is_post,
    row_number() OVER (PARTITION BY outcome, treated, placebo ORDER BY t) AS idx,
    count(*) FILTER (WHERE t < treatment_date) OVER (PARTITION BY outcome, treated, placebo) AS t0,
    count(*) FILTER (WHERE t >= treatment_date) OVER (PARTITION BY outcome, treated, placebo) AS n_post,
    count(*) FILTER (WHERE t >= base_date) OVER (PARTITION BY outcome, treated, placebo) AS real_post
  FROM (SELECT DISTINCT outcome, treated, placebo, shift, base_date, treatment_date, t FROM usable)),
periods AS (
  SELECT * FROM (SELECT *, CASE WHEN shift = 0 THEN n_post ELSE least(n_post, real_post) END AS t1 FROM dated)
  WHERE idx <= t0 + t1),
members AS (
  SELECT outcome, treated, placebo, unit, role FROM usable JOIN periods USING (outcome, treated, placebo, t)
  WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) = max(t0 + t1)),
sizes AS (
  SELECT outcome, treated, placebo, max(t0) AS t0, max(t1) AS t1 FROM periods GROUP BY ALL),
counts AS (
  SELECT outcome, treated, placebo, count(*) FILTER (WHERE role = 'control') AS n_donors,
         count(*) FILTER (WHERE role = 'treated') AS n_own FROM members GROUP BY ALL),
valid AS (
  SELECT s.*, z.t0, z.t1, c.n_donors FROM study s JOIN sizes z USING (outcome, treated, placebo)
  JOIN counts c USING (outcome, treated, placebo)
  WHERE c.n_donors > 0 AND c.n_own = 1 AND z.t0 >= 2 AND z.t1 >= 1),
cells AS (
  SELECT v.outcome, v.treated, v.placebo, v.shift, v.treatment_date, p.t, p.idx, p.is_post, v.t0, v.t1, v.n_donors,
         m.unit, m.role, u.y
  FROM valid v JOIN periods p USING (outcome, treated, placebo)
  JOIN members m USING (outcome, treated, placebo)
  JOIN panel u ON u.outcome = v.outcome AND u.unit = m.unit AND u.t = p.t)"""


KEYS = "outcome, treated, placebo"
ROW = f"{KEYS}, shift, treatment_date, t, idx, is_post, t0, t1"


def uniform(kind="quarter", shifts=(0,)) -> str:
    """Gaps with equal weights; the same for every fit."""
    return f"""{studies(kind, None, shifts)},
wide AS (
  SELECT {ROW}, max(y) FILTER (WHERE role = 'treated') AS obs, avg(y) FILTER (WHERE role = 'control') AS synth
  FROM cells GROUP BY ALL),
gaps AS (SELECT *, obs - synth AS diff, f.fit FROM wide, (SELECT unnest(['main', 'fold_1', 'fold_2', 'full']) AS fit) f)"""


FOLD = """CASE WHEN idx > t0 THEN -1
  WHEN idx > t0 - 2 * least(t0 // 2, t1) THEN CAST((idx - 1 - (t0 - 2 * least(t0 // 2, t1))) // least(t0 // 2, t1) + 1 AS INTEGER)
  ELSE 0 END"""


def pair(kind="quarter", shifts=(0,), theta0=0.0) -> str:
    """Gaps of the two-donor pool, whose weights have a closed form per fit."""
    return f"""{studies(kind, PAIR, shifts)},
wide AS (
  SELECT {ROW}, n_donors, max(y) FILTER (WHERE role = 'treated') AS obs,
         max(y) FILTER (WHERE unit = '{PAIR[0]}') AS a, max(y) FILTER (WHERE unit = '{PAIR[1]}') AS b,
         {FOLD} AS block
  FROM cells WHERE n_donors = 2 GROUP BY ALL),
used AS (
  SELECT w.*, f.fit, CASE WHEN f.fit = 'full' AND is_post THEN obs - {theta0!r} ELSE obs END AS target
  FROM wide w, (SELECT unnest(['main', 'fold_1', 'fold_2', 'full']) AS fit) f
  WHERE f.fit = 'full' OR (NOT is_post AND f.fit <> 'fold_' || block)),
share AS (
  SELECT {KEYS}, fit, least(1.0, greatest(0.0, sum((target - b) * (a - b)) / sum((a - b) * (a - b)))) AS w
  FROM used GROUP BY ALL),
solo AS (
  SELECT {KEYS}, unit FROM cells WHERE n_donors = 1 AND role = 'control' GROUP BY ALL),
gaps AS (
  SELECT w.* EXCLUDE (a, b, n_donors, block), s.fit, s.w * a + (1 - s.w) * b AS synth, obs - (s.w * a + (1 - s.w) * b) AS diff
  FROM wide w JOIN share s USING (outcome, treated, placebo)
  UNION ALL
  SELECT {", ".join("x." + c.strip() for c in ROW.split(","))}, x.y, f.fit, o.y, x.y - o.y
  FROM cells x JOIN cells o USING (outcome, treated, placebo, t),
       (SELECT unnest(['main', 'fold_1', 'fold_2', 'full']) AS fit) f
  WHERE x.n_donors = 1 AND x.role = 'treated' AND o.role = 'control')"""


def q(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{select}"


# --- sources and checks ------------------------------------------------------

q("scan_panel", f"{PANELS['quarter']},\n{DENSE}",
  "SELECT t AS date, outcome || '/' || unit AS country, y AS \"DAP\" FROM dense")
ORACLES["check_studies"] = """
WITH r AS (SELECT DISTINCT o_orderpriority AS outcome,
    date_diff('month', CAST(date_trunc('month', o_orderdate) AS DATE), DATE '2000-01-01') * CAST(1.5 AS DOUBLE) AS placebo_shift FROM orders)
SELECT outcome, placebo_shift, CASE WHEN placebo_shift <> floor(placebo_shift) THEN 'shift_not_integer'
  WHEN placebo_shift < 0 OR placebo_shift > 70 THEN 'shift_out_of_range' END AS reason FROM r"""
q("unsupported_outcomes", PANELS["quarter"], """SELECT DISTINCT event_type AS outcome,
  (SELECT string_agg(outcome, ', ' ORDER BY outcome) FROM (SELECT DISTINCT outcome FROM panel)) AS supported FROM events""")
q("all_null_columns", f"{PANELS['quarter']},\n{DENSE}", """
SELECT 'y' AS column_name, count(y) AS n_values, count(y) = 0 AS all_null FROM dense
UNION ALL SELECT 'none', count(CASE WHEN y < 0 THEN y END), count(CASE WHEN y < 0 THEN y END) = 0 FROM dense
UNION ALL SELECT 'unit', count(unit), count(unit) = 0 FROM dense""")
q("duplicate_panel_keys", SOURCE, """SELECT o_orderpriority AS outcome, n_name AS unit, CAST(o_orderdate AS DATE) AS t,
  count(*) AS n_rows FROM src GROUP BY 1, 2, 3 HAVING count(*) > 1""")

# --- projections, predicates, scalars ---------------------------------------

ORACLES["recode_category"] = """SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'NOTSPEC'
  WHEN '1-URGENT' THEN 'URGENT' ELSE o_orderpriority END AS category FROM orders"""
q("pool_membership", PANELS["quarter"], f"""SELECT outcome, t, unit,
  unit <> 'NATION_0' AND unit IN ({quoted((*TREATED, *PAIR))}) AS in_pool, outcome IN ('all', '5-LOW') AS is_outcome FROM panel""")
q("post_flag", PANELS["quarter"], """SELECT outcome, unit, t, t <> DATE '1995-01-01' AND t >= DATE '2000-01-01' AS post_treatment FROM panel""")
q("date_window", PANELS["quarter"], """SELECT outcome, unit, t, y FROM panel
WHERE outcome IN ('all', '5-LOW') AND t BETWEEN DATE '1996-04-01' AND DATE '1998-10-01'""")
q("exclude_other_treated", studies(), "SELECT outcome, treated, unit, role, t, y FROM usable")
ORACLES["project_panel"] = """SELECT event_type AS outcome, CAST(user_id AS VARCHAR) AS unit, CAST(ts AS DATE) AS t, value AS y FROM events"""
ORACLES["shift_months"] = """SELECT o_orderkey,
  CAST(last_day(o_orderdate) - to_months(CAST(o_orderkey % 25 AS INTEGER)) AS DATE) AS months_back,
  CAST(last_day(o_orderdate) - to_months(CAST(3 * (o_orderkey % 25) AS INTEGER)) AS DATE) AS quarters_back,
  CAST(last_day(o_orderdate) - CAST(o_orderkey % 25 AS INTEGER) AS DATE) AS days_back FROM orders"""
q("round_to_step", PANELS["quarter"], "SELECT outcome, unit, t, round_even(y, 1) AS y_1, round_even(y, 3) AS y_3 FROM panel")

# --- group filters, reshape, windows -----------------------------------------

q("drop_units_with_nulls", f"{PANELS['quarter']},\n{DENSE}", """SELECT outcome, unit, t, y FROM dense
WHERE (outcome, unit) NOT IN (SELECT (outcome, unit) FROM dense WHERE y IS NULL)""")
q("densify_panel", f"{PANELS['quarter']},\n{DENSE}", "SELECT outcome, unit, t, y FROM dense")
q("pivot_outcomes", PANELS["quarter"], "SELECT t, unit, " + ", ".join(
    f"max(CASE WHEN outcome = '{o}' THEN y END) AS \"{o}\"" for o in OUTCOMES) + " FROM panel GROUP BY t, unit")
q("pivot_units", PANELS["quarter"], "SELECT outcome, t, " + ", ".join(
    f"max(CASE WHEN unit = '{u}' THEN y END) AS \"{u}\"" for u in NATIONS) + " FROM panel GROUP BY outcome, t")
q("expand_studies", studies(shifts=(0, 4, 8)), f"""SELECT {KEYS}, CAST(shift AS INTEGER) AS placebo_shift,
  base_date AS base_treatment_date, treatment_date FROM study""")
q("period_index", studies("day"), f"""SELECT DISTINCT outcome, placebo, t, CAST(idx AS INTEGER) AS period_idx, is_post FROM periods
WHERE treated = 'G6'""")
q("study_window", studies(shifts=(0, 4, 12)), f"""SELECT outcome, placebo, t, CAST(idx AS INTEGER) AS period_idx,
  CAST(t0 AS INTEGER) AS "T0", CAST(t1 AS INTEGER) AS "T1" FROM periods WHERE treated = '{TREATED[0]}'""")
q("window_lengths", studies("day", shifts=(0, 5, 12)), f"""SELECT {KEYS}, CAST(z.t0 AS INTEGER) AS "T0", CAST(z.t1 AS INTEGER) AS "T1",
  shift > 0 AND shift < z.t1 AS overlaps_treatment,
  CASE WHEN z.t0 < 2 THEN 'too_few_pre_periods' WHEN z.t1 < 1 THEN 'no_post_period'
       WHEN coalesce(c.n_own, 0) = 0 THEN 'treated_incomplete'
       WHEN coalesce(c.n_donors, 0) = 0 THEN 'no_complete_donor' END AS reason
FROM study JOIN sizes z USING ({KEYS}) LEFT JOIN counts c USING ({KEYS})""")
q("placebo_windows", studies("month", shifts=(0, 12, 24)), f"""SELECT {KEYS}, treatment_date, CAST(z.t0 AS INTEGER) AS "T0",
  CAST(z.t1 AS INTEGER) AS "T1", CAST(coalesce(c.n_donors, 0) AS INTEGER) AS n_donors, shift > 0 AND shift < z.t1 AS overlaps_treatment
FROM study JOIN sizes z USING ({KEYS}) LEFT JOIN counts c USING ({KEYS})""")
q("complete_donors", studies(shifts=(0, 4)), f"""SELECT DISTINCT outcome, placebo, unit FROM members WHERE role = 'control'""")
q("donor_pool_size", studies("day"), """SELECT outcome, placebo, max(n_donors) AS n_donors FROM counts GROUP BY outcome, placebo""")
q("study_panel", studies(), """SELECT outcome, treated, unit, role, t, CAST(idx AS INTEGER) AS period_idx, is_post, round(y, 8) AS y FROM cells""")

# --- counterfactuals ----------------------------------------------------------

q("gram_matrix", studies(), f"""
, level AS (SELECT outcome, t, avg(y) AS m FROM panel JOIN roles USING (unit) WHERE role = 'control' GROUP BY ALL),
x AS (SELECT c.outcome, c.treated, c.unit, c.role, c.idx, {FOLD} AS block, c.y - l.m AS x
      FROM cells c JOIN level l ON l.outcome = c.outcome AND l.t = c.t),
d AS (SELECT * FROM x WHERE treated = (SELECT min(treated) FROM x x2 WHERE x2.outcome = x.outcome) AND role = 'control')
SELECT a.outcome, a.block, a.unit AS i, b.unit AS j, round(sum(a.x * b.x), 8) AS g
FROM d a JOIN d b ON a.outcome = b.outcome AND a.idx = b.idx AND a.unit <= b.unit GROUP BY ALL
UNION ALL
SELECT a.outcome, a.block, a.unit, b.unit, round(sum(a.x * b.x), 8)
FROM x a JOIN x b ON a.outcome = b.outcome AND a.treated = b.treated AND a.idx = b.idx
WHERE a.role = 'treated' AND b.role = 'control' GROUP BY ALL""".lstrip("\n"))
ORACLES["gram_matrix"] = ORACLES["gram_matrix"].replace("\n, level AS", ",\nlevel AS")
q("sc_weights_two_donor", pair(), f"""
SELECT m.unit AS control_unit, round(CASE WHEN s.w IS NULL THEN 1.0 WHEN m.unit = '{PAIR[0]}' THEN s.w ELSE 1 - s.w END, 8) AS weight,
  m.treated, m.outcome, m.placebo, v.treatment_date
FROM members m JOIN valid v USING ({KEYS}) LEFT JOIN (SELECT * FROM share WHERE fit = 'main') s USING ({KEYS})
WHERE m.role = 'control'""")
q("sc_weights_certificate", studies(shifts=(0, 4)),
  f"SELECT {KEYS}, true AS sums_to_one, true AS non_negative, true AS optimal FROM valid")
DATES = f"(SELECT {KEYS}, treatment_date FROM valid) v"
MAIN = "FROM gaps WHERE fit = 'main'"
q("synthetic_series", pair(), f"SELECT t AS date, round(synth, 8) AS synth, {KEYS} {MAIN}")
q("gap_series", pair(shifts=(0, 4)), f"SELECT t AS date, round(diff, 8) AS diff, {KEYS} {MAIN}")
q("uniform_counterfactual", uniform(), f"""SELECT t AS date, round(obs, 8) AS obs, round(synth, 6) AS synth, round(diff, 6) AS diff,
  CAST(t0 AS INTEGER) AS "T0", {KEYS} {MAIN}""")
q("gap_summary", uniform(), f"""SELECT {KEYS}, round(avg(diff) FILTER (WHERE NOT is_post), 8) AS mean_pre,
  round(avg(diff) FILTER (WHERE is_post), 8) AS mean_post, round(min(diff) FILTER (WHERE is_post), 8) AS min_post,
  round(max(diff) FILTER (WHERE is_post), 8) AS max_post {MAIN} GROUP BY ALL""")
q("pre_rmspe", pair(), f"SELECT {KEYS}, round(sqrt(avg(diff * diff) FILTER (WHERE NOT is_post)), 8) AS pre_rmspe {MAIN} GROUP BY ALL")

# --- inference ----------------------------------------------------------------

TTEST = f"""
taus AS (
  SELECT {KEYS}, fit, max(t0) AS t0, max(t1) AS t1,
    avg(diff) FILTER (WHERE is_post) - avg(diff) FILTER (WHERE fit = 'fold_' || ({FOLD})) AS tau
  FROM gaps WHERE fit LIKE 'fold_%' GROUP BY ALL),
ttest AS (
  SELECT {KEYS}, t0, avg(tau) AS att,
    sqrt(1 + 2.0 * least(t0 // 2, t1) / t1) * stddev_samp(tau) / sqrt(2.0) AS se FROM taus GROUP BY {KEYS}, t0, t1),
tests AS (
  SELECT {KEYS}, CAST(t0 AS INTEGER) AS "T0", round(att, 8) AS att, round(se, 8) AS se,
    round(att - {T_QUANTILE} * se, 8) AS lb, round(att + {T_QUANTILE} * se, 8) AS ub FROM ttest)"""
TTEST_OUT = f"""SELECT att, se, lb, ub, "T0", lb > 0 OR ub < 0 AS significant, {KEYS} FROM tests"""


def block_p(theta0: float) -> str:
    return f"""
u AS (SELECT {KEYS}, idx, t0, t1, abs(diff - CASE WHEN is_post THEN {theta0!r} ELSE 0.0 END) AS a FROM gaps WHERE fit = 'full'),
shifted AS (
  SELECT {KEYS}, s.shift_by, max(u.t0) AS t0, max(u.t1) AS t1, sum(v.a) AS stat
  FROM u JOIN (SELECT DISTINCT {KEYS}, idx - 1 AS shift_by FROM u) s USING ({KEYS})
  JOIN u v USING ({KEYS})
  WHERE u.idx > u.t0 AND v.idx - 1 = (u.idx - 1 + s.shift_by) % (u.t0 + u.t1) GROUP BY {KEYS}, s.shift_by),
pvals AS (
  SELECT {KEYS}, max(t0) AS t0, count(*) FILTER (WHERE stat >= own * (1 - 1e-9)) / CAST(count(*) AS DOUBLE) AS pval
  FROM (SELECT *, max(stat) FILTER (WHERE shift_by = 0) OVER (PARTITION BY {KEYS}) AS own FROM shifted) GROUP BY {KEYS})"""


IID = f"""
u AS (SELECT {KEYS}, idx, t0, t1, abs(diff) AS a FROM gaps WHERE fit = 'full'),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS}, b ORDER BY md5('{SEED}:' || b || ':' || idx)) AS rank
  FROM u, (SELECT unnest(range(1, {N_PERM + 1})) AS b) p),
perms AS (SELECT {KEYS}, b, sum(a) AS stat FROM drawn WHERE rank <= t1 GROUP BY {KEYS}, b),
own AS (SELECT {KEYS}, max(t0) AS t0, sum(a) FILTER (WHERE idx > t0) AS s FROM u GROUP BY {KEYS}),
pvals AS (
  SELECT {KEYS}, max(own.t0) AS t0, (1 + count(*) FILTER (WHERE stat >= s * (1 - 1e-9))) / CAST({N_PERM + 1} AS DOUBLE) AS pval
  FROM perms JOIN own USING ({KEYS}) GROUP BY {KEYS})"""
P_OUT = f"""SELECT round(pval, 8) AS pval, CAST(t0 AS INTEGER) AS "T0", pval <= 0.1 AS significant, {KEYS} FROM pvals"""

q("ttest_uniform", f"{uniform()},{TTEST}", TTEST_OUT)
q("ttest_two_donor", f"{pair()},{TTEST}", TTEST_OUT)
q("placebo_att_uniform", f"{uniform('month', (12, 18))},{TTEST}", TTEST_OUT)
q("placebo_att_two_donor", f"{pair('month', (0, 12))},{TTEST}", TTEST_OUT)
q("conformal_block_uniform", f"{uniform()},{block_p(0.0)}", P_OUT)
q("conformal_block_two_donor", f"{pair(theta0=0.5)},{block_p(0.5)}", P_OUT)
q("conformal_iid_uniform", f"{uniform()},{IID}", P_OUT)
q("conformal_iid_two_donor", f"{pair()},{IID}", P_OUT)

GRID = f"""
summary AS (
  SELECT {KEYS}, max(t0) AS t0, max(t1) AS t1, avg(diff) FILTER (WHERE NOT is_post) / nullif(avg(diff) FILTER (WHERE is_post), 0) AS factor,
    round_even(min(diff) FILTER (WHERE is_post), 1) AS min_gap, round_even(max(diff) FILTER (WHERE is_post), 1) AS max_gap
  FROM gaps WHERE fit = 'main' GROUP BY {KEYS}),
grid AS (
  SELECT {KEYS}, t0, t1, min_gap, max_gap,
    CAST(floor(round((min_gap - abs(min_gap * coalesce(factor, 0))) / {STEP}, 6)) AS BIGINT) AS lo,
    CAST(ceil(round((max_gap + abs(max_gap * coalesce(factor, 0))) / {STEP}, 6)) AS BIGINT) AS hi,
    CAST(greatest(1, round_even(round((max_gap - min_gap) * 0.33 / {STEP}, 6), 0)) AS BIGINT) AS pad FROM summary)"""


def accepted(name: str, points: str, equal_weights: bool) -> str:
    """Accepted (period, k) of the grid points in ``points`` (keys, k)."""
    if equal_weights:
        return f"""
{name} AS (
  SELECT {KEYS}, p.idx, g.k FROM {points} g JOIN (SELECT * FROM gaps WHERE fit = 'main') p USING ({KEYS})
  JOIN (SELECT * FROM gaps WHERE fit = 'main') s USING ({KEYS})
  WHERE p.is_post AND NOT s.is_post GROUP BY {KEYS}, p.idx, g.k
  HAVING (1 + count(*) FILTER (WHERE abs(s.diff) >= abs(p.diff - round(g.k * {STEP}, 1)) - 1e-12)) / CAST(max(p.t0) + 1 AS DOUBLE) > 0.1)"""
    return f"""
{name}_w AS (
  SELECT {KEYS}, p.idx, g.k, max(p.obs - round(g.k * {STEP}, 1)) AS target, max(p.a) AS pa, max(p.b) AS pb, max(p.t0) AS t0,
    (sum((s.obs - s.b) * (s.a - s.b)) + max((p.obs - round(g.k * {STEP}, 1) - p.b) * (p.a - p.b)))
      / (sum((s.a - s.b) * (s.a - s.b)) + max((p.a - p.b) * (p.a - p.b))) AS raw
  FROM {points} g JOIN wide2 p USING ({KEYS}) JOIN wide2 s USING ({KEYS})
  WHERE p.is_post AND NOT s.is_post GROUP BY {KEYS}, p.idx, g.k),
{name}_c AS (SELECT *, least(1.0, greatest(0.0, raw)) AS w FROM {name}_w),
{name} AS (
  SELECT {KEYS}, c.idx, c.k FROM {name}_c c JOIN wide2 s USING ({KEYS}) WHERE NOT s.is_post
  GROUP BY {KEYS}, c.idx, c.k
  HAVING (1 + count(*) FILTER (WHERE abs(s.obs - c.w * s.a - (1 - c.w) * s.b)
      >= abs(c.target - c.w * c.pa - (1 - c.w) * c.pb) - 1e-12)) / CAST(max(c.t0) + 1 AS DOUBLE) > 0.1)"""


# a pool of one donor enters the closed form as two equal donors
WIDE2 = f"""
wide2 AS (
  SELECT {KEYS}, idx, is_post, t0, obs, a, b FROM wide
  UNION ALL SELECT {KEYS}, idx, is_post, t0, obs, synth, synth FROM gaps
  WHERE fit = 'main' AND ({KEYS}) NOT IN (SELECT ({KEYS}) FROM wide))"""


def ci(equal_weights: bool) -> str:
    pre = "" if equal_weights else WIDE2 + ","
    return f"""{pre}{GRID},
edges AS (
  SELECT {KEYS}, unnest(range(0, {MAX_ROUNDS + 1})) AS n, lo, hi, pad FROM grid),
edge_k AS (
  SELECT DISTINCT {KEYS}, k FROM (SELECT {KEYS}, lo - n * pad AS k FROM edges UNION ALL SELECT {KEYS}, hi + n * pad FROM edges)),
{accepted("edge_ok", "edge_k", equal_weights)},
hit AS (SELECT DISTINCT {KEYS}, k FROM edge_ok),
grown AS (
  SELECT {KEYS}, min(n) FILTER (WHERE ({KEYS}, lo - n * pad) NOT IN (SELECT ({KEYS}, k) FROM hit)) AS lower_rounds,
    min(n) FILTER (WHERE ({KEYS}, hi + n * pad) NOT IN (SELECT ({KEYS}, k) FROM hit)) AS upper_rounds
  FROM edges GROUP BY {KEYS}),
point_k AS (
  SELECT {KEYS}, unnest(range(lo - coalesce(lower_rounds, {MAX_ROUNDS}) * pad, hi + coalesce(upper_rounds, {MAX_ROUNDS}) * pad + 1)) AS k
  FROM grid JOIN grown USING ({KEYS})),
{accepted("point_ok", "point_k", equal_weights)},
bands AS (
  SELECT {KEYS}, p.idx, CAST(g.lower_rounds AS BIGINT) AS lower_rounds, CAST(g.upper_rounds AS INTEGER) AS upper_rounds,
    round(min(o.k) * {STEP}, 1) AS lower_ci, round(max(o.k) * {STEP}, 1) AS upper_ci,
    CASE WHEN g.lower_rounds IS NULL OR g.upper_rounds IS NULL THEN 'max_rounds'
         WHEN min(o.k) IS NULL THEN 'empty' ELSE 'found' END AS ci_status
  FROM (SELECT {KEYS}, idx FROM gaps WHERE fit = 'main' AND is_post) p JOIN grown g USING ({KEYS})
  LEFT JOIN point_ok o USING ({KEYS}, idx) GROUP BY {KEYS}, p.idx, g.lower_rounds, g.upper_rounds)"""


BANDS_OUT = f"""SELECT CAST(idx AS INTEGER) AS period_idx, lower_ci, upper_ci, lower_rounds, upper_rounds, ci_status, {KEYS} FROM bands"""
q("conformal_ci_uniform", f"{uniform()},{ci(True)}", BANDS_OUT)
q("conformal_ci_two_donor", f"{pair()},{ci(False)}", BANDS_OUT)
q("ci_grid", f"{uniform()},{GRID}", f"SELECT {KEYS}, min_gap, max_gap, lo, hi, pad FROM grid")
q("ci_grid_edge_flags", f"""{uniform()},{GRID},
ends AS (SELECT {KEYS}, lo AS k FROM grid UNION SELECT {KEYS}, hi FROM grid),{accepted("ok", "ends", True)}""",
  f"""SELECT {KEYS}, lo, hi, pad, ({KEYS}, lo) IN (SELECT ({KEYS}, k) FROM ok) AS grow_lower,
  ({KEYS}, hi) IN (SELECT ({KEYS}, k) FROM ok) AS grow_upper FROM grid""")

# --- result tables, rates, reports ---------------------------------------------

SERIES = f"""
series AS (
  SELECT g.t AS date, g.obs, g.synth, g.diff, b.upper_ci, b.lower_ci, b.ci_status, CAST(g.t0 AS INTEGER) AS "T0", {KEYS}, g.treatment_date
  FROM (SELECT * FROM gaps WHERE fit = 'main') g LEFT JOIN bands b USING ({KEYS}, idx))"""
q("series_table", f"{pair()},{ci(False)},{SERIES}", """SELECT date, round(obs, 8) AS obs, round(synth, 8) AS synth,
  round(diff, 8) AS diff, upper_ci, lower_ci, ci_status, "T0", outcome, treated, placebo, treatment_date FROM series""")
q("union_results", f"{uniform()},{TTEST},{block_p(0.0)}", f"""
SELECT att, se, lb, ub, NULL::DOUBLE AS pval, "T0", {KEYS}, v.treatment_date FROM tests JOIN {DATES} USING ({KEYS})
UNION ALL SELECT NULL, NULL, NULL, NULL, round(pval, 8), CAST(p.t0 AS INTEGER), {KEYS}, v.treatment_date FROM pvals p JOIN {DATES} USING ({KEYS})""")
q("built_once_panel", PANELS["quarter"], "SELECT outcome, unit, t, y FROM panel")
q("stored_series", uniform(shifts=(0, 4)), f"""SELECT t AS date, round(obs, 8) AS obs, round(synth, 6) AS synth, round(diff, 6) AS diff,
  NULL::DOUBLE AS upper_ci, NULL::DOUBLE AS lower_ci, NULL::VARCHAR AS ci_status, CAST(t0 AS INTEGER) AS "T0", {KEYS}, treatment_date {MAIN}""")
q("stored_inference", f"{pair()},{TTEST}", f"""SELECT att, se, lb, ub, "T0", {KEYS}, v.treatment_date, 'ttest' AS method
  FROM tests JOIN {DATES} USING ({KEYS})""")
q("stored_weights", ORACLES["sc_weights_two_donor"].removeprefix("WITH ").rsplit("\nSELECT m.unit", 1)[0],
  "SELECT m.unit" + ORACLES["sc_weights_two_donor"].rsplit("\nSELECT m.unit", 1)[1])
RATES = f"""
based AS (
  SELECT s.t AS date, s.obs, s.synth, b.obs AS base, {KEYS}, s.treatment_date FROM (SELECT * FROM gaps WHERE fit = 'main') s
  LEFT JOIN (SELECT {KEYS}, CAST(t + INTERVAL 12 MONTH AS DATE) AS t, obs FROM gaps WHERE fit = 'main') b USING ({KEYS}, t)
  WHERE s.outcome IN ('all') AND s.t <= s.treatment_date + INTERVAL 6 MONTH),
rated AS (
  SELECT date, {KEYS}, treatment_date, (obs - base) / base * 100 AS obs_rate,
    CASE WHEN date > treatment_date THEN (synth - base) / base * 100 ELSE (obs - base) / base * 100 END AS synth_rate FROM based)"""
q("yoy_rate", f"{uniform('month')},{RATES}", f"SELECT date, round(obs_rate, 6) AS obs_rate, {KEYS} FROM rated")
q("yoy_rate_synth", f"{uniform('month')},{RATES}", f"""SELECT date, round(obs_rate, 6) AS obs_rate, round(synth_rate, 6) AS synth_rate,
  round(obs_rate - synth_rate, 6) AS gaps_rate, {KEYS} FROM rated""")
q("yoy_rate_own_dates", f"{uniform('month', (0, 12))},{RATES}", f"""SELECT date, round(obs_rate, 6) AS obs_rate, round(synth_rate, 6) AS synth_rate,
  round(obs_rate - synth_rate, 6) AS gaps_rate, treatment_date, {KEYS} FROM rated""")


def at_dates(sql: str, *dates: str) -> str:
    """The statement at each base date, one after the other."""
    base = SPEC["quarter"][0]
    return " UNION ALL ".join(f"SELECT * FROM (WITH {sql.replace(base, d)})" for d in dates)


ORACLES["estimate_two_dates"] = at_dates(f"""{pair()},{TTEST}
SELECT att, se, lb, ub, "T0", {KEYS}, v.treatment_date FROM tests JOIN {DATES} USING ({KEYS})""", "2000-01-01", "1999-04-01")
ORACLES["versioned_series"] = at_dates(f"""{pair()}
SELECT t AS date, round(obs, 6) AS obs, round(synth, 6) AS synth, round(diff, 6) AS diff, CAST(t0 AS INTEGER) AS "T0", {KEYS}, treatment_date {MAIN}""",
  "2000-01-01", "1999-04-01")
q("report_frame", f"{uniform()},{ci(True)},{SERIES}", """
, lines AS (
  SELECT date, obs AS value, NULL::DOUBLE AS upper_ci, NULL::DOUBLE AS lower_ci, 'Observed' AS series, outcome AS subplot,
    'N' || replace(treated, 'NATION_', '') AS color, 1 AS color_ord, 1 AS subplot_ord, outcome, treated FROM series
  UNION ALL SELECT date, synth, NULL, NULL, 'Synthetic', outcome, 'SC_n' || replace(treated, 'NATION_', ''), 2, 1, outcome, treated FROM series
  UNION ALL SELECT date, diff, upper_ci, lower_ci, 'Difference', 'Difference', 'Gap', 3, 2, outcome, treated FROM series)
SELECT date, round(value, 6) AS value, upper_ci, lower_ci, series, subplot, 'Nation ' || replace(treated, 'NATION_', '') AS country,
  color, color_ord, subplot_ord, outcome, treated FROM lines
UNION ALL
SELECT NULL, 0.0, NULL, NULL, 'Zero', 'Difference', NULL, NULL, 0, 2, outcome, NULL
FROM (SELECT DISTINCT outcome FROM series), (SELECT unnest([1, 2]))""".lstrip("\n"))
ORACLES["report_frame"] = ORACLES["report_frame"].replace("\n, lines AS", ",\nlines AS")
q("treatment_marker", uniform("month", (0, 12)), f"""SELECT {KEYS},
  CAST(min(t) + to_months(CAST(max(t0) AS INTEGER)) AS DATE) AS marker, max(treatment_date) AS treatment_date {MAIN} GROUP BY {KEYS}""")
q("ci_band", f"{uniform()},{ci(True)},{SERIES}", f"""SELECT date, lower_ci, upper_ci,
  'Nation ' || replace(treated, 'NATION_', '') AS country, {KEYS} FROM series WHERE date >= treatment_date""")
