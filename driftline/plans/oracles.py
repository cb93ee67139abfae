"""Plain SQL over the shared test tables with the meaning of each registered query.

Where another route to the same numbers exists it is taken: pairwise comparison instead of prefix
sums, ``ASOF JOIN`` instead of interval joins, run-by-run pair counts for the bootstrap.
"""

from __future__ import annotations

GATED = "range(42, 47)"
ALL = "range(42, 62)"
FAULT_RUNS = "(19, 20, 23, 24, 25, 26, 27, 28)"


def h(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")"
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


READINGS = """
  floor(value)::DOUBLE AS pkts_toserver, (event_id % 50)::DOUBLE AS pkts_toclient,
  floor(value)::DOUBLE * 60 AS bytes_toserver, (event_id % 50)::DOUBLE * 60 AS bytes_toclient,
  CASE WHEN event_id % 17 <> 0 THEN ['established', 'new', 'closed'][event_id % 3 + 1] END AS flow_state,
  CASE WHEN event_type = 'flow' THEN NULL WHEN label = 'attack' THEN 6.0::DOUBLE ELSE 3.0::DOUBLE END AS modbus_function,
  CASE WHEN event_type = 'flow' THEN NULL WHEN label = 'attack' THEN 'WRITE' ELSE 'READ' END AS modbus_access,
  CASE WHEN event_id % 2 = 0 THEN value / 8 - 5 END AS rudder_angle
"""

SRC = f"""
src0 AS (SELECT event_id, epoch_us(ts) AS t_us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp, event_type AS type_in,
  value, (event_id % 26 + 3)::INTEGER AS run_id,
  CASE WHEN event_id % 11 = 0 THEN 'alert' WHEN event_id % 5 = 0 THEN 'flow' ELSE 'modbus' END AS event_type FROM events),
src1 AS (SELECT *, CASE WHEN run_id IN {FAULT_RUNS} AND type_in = 'error' THEN 'fault'
  WHEN run_id NOT IN {FAULT_RUNS} AND type_in = 'purchase' THEN 'attack' ELSE 'normal' END AS label FROM src0),
src AS (SELECT event_id, t_us, stamp, run_id, event_type, label,
  CASE WHEN label = 'fault' THEN ['fault_comm_dropout', 'fault_plc_restart', 'fault_poll_storm'][floor(value)::BIGINT % 3 + 1]
    ELSE 'baseline' END AS scenario, {READINGS}, ((event_id % 130) * 10)::DOUBLE AS rpm_command FROM src1),
acc AS (SELECT * FROM src WHERE event_type IN ('flow', 'modbus')),
main AS (SELECT * FROM acc WHERE label IN ('normal', 'attack')
  AND run_id NOT IN (SELECT run_id FROM acc WHERE label = 'fault')),
stress AS (SELECT * FROM acc WHERE label = 'fault')
"""

TGT = f"""
tgt0 AS (SELECT event_id, epoch_us(ts) AS t_us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp, value,
  CASE event_type WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'manipulation' WHEN 'signup' THEN 'recon' ELSE 'normal' END AS family,
  CASE WHEN event_id % 5 = 0 THEN 'flow' ELSE 'modbus' END AS event_type FROM events),
tgt1 AS (SELECT *, CASE WHEN t_us < 1704088800000000 THEN 'pre-phase'
  WHEN family = 'normal' OR t_us < 1704672000000000 THEN 'baseline' ELSE 'act' END AS phase FROM tgt0),
tgt2 AS (SELECT *, CASE WHEN phase <> 'act' THEN 'normal' WHEN family = 'fault' THEN 'fault' ELSE 'attack' END AS label FROM tgt1),
tgt AS (SELECT event_id, t_us, stamp, family, event_type, phase, label, (label = 'attack')::INTEGER AS y,
  'dom_' || family AS scenario, family || '-r0' || (event_id % 3 + 1) AS run_id, {READINGS},
  CASE WHEN event_id % 4 = 1 THEN (event_id % 130) / 100.0::DOUBLE END AS throttle_command_left,
  CASE WHEN event_id % 4 = 3 THEN (event_id % 130) / 100.0::DOUBLE END AS throttle_command_right,
  CASE WHEN event_id % 5 = 2 THEN ((event_id % 400) * 10)::DOUBLE END AS hydraulic_pump_rpm_left,
  CASE WHEN event_id % 5 = 3 THEN ((event_id % 300) * 10)::DOUBLE END AS hydraulic_pump_rpm_right,
  CASE WHEN event_type = 'flow' THEN t_us - (event_id % 7200) * 1000000 END AS flow_start_us FROM tgt2),
runs12 AS (SELECT DISTINCT run_id, family FROM tgt),
timeline AS (SELECT run_id, 1704088800000000 AS t_us, 'baseline' AS name FROM runs12
  UNION ALL SELECT run_id, 1704672000000000, 'act' FROM runs12 WHERE family <> 'normal')
"""


def scores(seeds: str, table: str = "tgt", name: str = "sc") -> str:
    return f"""
{name}_seeds AS (SELECT unnest({seeds}) AS seed),
{name} AS (SELECT s.seed, t.*, ({h('s.seed', 't.event_id')} % 141 + CASE WHEN t.label = 'attack' THEN 40 ELSE 0 END) / 200.0::DOUBLE AS score
  FROM {table} t CROSS JOIN {name}_seeds s)"""


def splits(seeds: str, table: str = "main", name: str = "sp") -> str:
    return f"""
{name}_runs AS (SELECT s.seed, r.run_id, row_number() OVER (PARTITION BY s.seed ORDER BY {h('s.seed', 'r.run_id')}, r.run_id) - 1 AS pos,
  count(*) OVER (PARTITION BY s.seed) AS n FROM (SELECT DISTINCT run_id FROM {table}) r CROSS JOIN (SELECT unnest({seeds}) AS seed) s),
{name} AS (SELECT seed, run_id, CASE WHEN pos < greatest(1, least(n - 1, floor(n * 0.7::DOUBLE))) THEN 'train' ELSE 'validation' END AS side
  FROM {name}_runs)"""


def validation(seeds: str) -> str:
    return f"""{splits(seeds)},
va AS (SELECT sp.seed, m.*, (m.label = 'attack')::INTEGER AS y,
  ({h('sp.seed', 'm.event_id')} % 141 + CASE WHEN m.label = 'attack' THEN 40 ELSE 0 END) / 200.0::DOUBLE AS score
  FROM main m JOIN sp USING (run_id) WHERE sp.side = 'validation')"""


def threshold(rows: str, budget: str, name: str) -> str:
    """Each negative score against all negatives of its seed, by comparison instead of prefix sums."""
    return f"""
{name}_neg AS (SELECT seed, score, count(*) AS c FROM {rows} WHERE y = 0 GROUP BY ALL),
{name}_rate AS (SELECT a.seed, a.score, sum(CASE WHEN b.score >= a.score THEN b.c ELSE 0 END)::DOUBLE / sum(b.c) AS fpr,
    sum(CASE WHEN b.score >= a.score THEN b.c ELSE 0 END) AS at_or_above
  FROM {name}_neg a JOIN {name}_neg b USING (seed) GROUP BY ALL),
{name} AS (SELECT s.seed, coalesce(min(score) FILTER (fpr <= {budget}), nextafter(max(score), 'infinity'::DOUBLE), 0.5) AS threshold
  FROM (SELECT DISTINCT seed FROM {rows}) s LEFT JOIN {name}_rate USING (seed) GROUP BY s.seed)"""


def predicted(seeds: str) -> str:
    return f"""{SRC}, {TGT}, {validation(seeds)}, {threshold('va', '0.01', 'thr')}, {scores(seeds)},
pr AS (SELECT sc.*, threshold, (score >= threshold)::INTEGER AS pred FROM sc JOIN thr USING (seed))"""


RATE = "avg(pred) FILTER (family = '{f}' AND y = {y})"
THRESHOLD_METRICS = f"""
  round({RATE.format(f='normal', y=0)}, 6) AS normal_fpr, round({RATE.format(f='fault', y=0)}, 6) AS fault_fpr,
  round({RATE.format(f='manipulation', y=1)}, 6) AS manipulation_recall, round({RATE.format(f='recon', y=1)}, 6) AS recon_recall"""


def auc(rows: str, key: str) -> str:
    """Every positive score against every negative score."""
    return f"""SELECT p.{key}, round(sum(p.c * n.c * CASE WHEN n.score < p.score THEN 2 WHEN n.score = p.score THEN 1 ELSE 0 END)::DOUBLE
  / (2.0 * sum(p.c * n.c)), 6) AS auc
FROM (SELECT {key}, score, count(*) AS c FROM {rows} WHERE y = 1 GROUP BY ALL) p
JOIN (SELECT {key}, score, count(*) AS c FROM {rows} WHERE y = 0 GROUP BY ALL) n USING ({key}) GROUP BY p.{key}"""


def primary(rows: str, key: str) -> str:
    """CTEs ending in ``prim``: the four metrics per key from pair counts by family."""
    return f"""
pf AS (SELECT {key}, family, score, y, count(*) AS c FROM {rows} GROUP BY ALL),
fam_n AS (SELECT {key}, family, sum(c) AS n, sum(c) FILTER (y = 1) AS np, sum(c) FILTER (y = 0) AS nn FROM pf GROUP BY ALL),
cc AS (SELECT p.{key}, p.family AS fp, n.family AS fn,
  sum(p.c * n.c * CASE WHEN n.score < p.score THEN 2 WHEN n.score = p.score THEN 1 ELSE 0 END)::DOUBLE AS twice
  FROM (SELECT * FROM pf WHERE y = 1) p JOIN (SELECT * FROM pf WHERE y = 0) n USING ({key}) GROUP BY ALL),
tot AS (SELECT {key}, sum(np)::DOUBLE AS p, sum(nn)::DOUBLE AS n, sum(np / n::DOUBLE) AS wp, sum(nn / n::DOUBLE) AS wn,
  coalesce(sum(np) FILTER (family = 'normal'), 0) AS p_normal, sum(nn) FILTER (family = 'normal') AS n_normal,
  sum(np) FILTER (family = 'manipulation') AS p_manipulation, sum(np) FILTER (family = 'recon') AS p_recon FROM fam_n GROUP BY {key}),
prim AS (SELECT cc.{key}, sum(twice) / any_value(2 * p * tot.n) AS event_weighted_auc,
  sum(twice / (a.n * b.n)) / any_value(2 * wp * wn) AS scenario_balanced_auc,
  sum(twice) FILTER (fn = 'normal' AND fp IN ('normal', 'manipulation')) / any_value(2.0 * (p_manipulation + p_normal) * n_normal) AS manipulation_vs_normal_auc,
  sum(twice) FILTER (fn = 'normal' AND fp IN ('normal', 'recon')) / any_value(2.0 * (p_recon + p_normal) * n_normal) AS recon_vs_normal_auc
  FROM cc JOIN tot USING ({key}) JOIN fam_n a ON a.{key} = cc.{key} AND a.family = fp
  JOIN fam_n b ON b.{key} = cc.{key} AND b.family = fn GROUP BY cc.{key})"""


def multiplicity(replicates: int, rows: str = "tgt") -> str:
    return f"""
ranked AS (SELECT family, run_id, row_number() OVER (PARTITION BY family ORDER BY {h('run_id')}, run_id) - 1 AS rank,
  count(*) OVER (PARTITION BY family) AS n FROM (SELECT DISTINCT family, run_id FROM {rows})),
draws AS (SELECT f.family, b.replicate, {h('20260817', 'b.replicate', 'f.family', 'j.draw')} % f.n AS rank
  FROM (SELECT family, max(n) AS n FROM ranked GROUP BY family) f
  CROSS JOIN (SELECT unnest(range({replicates})) AS replicate) b
  JOIN (SELECT unnest(range(10000)) AS draw) j ON j.draw < f.n),
mult AS (SELECT replicate, run_id, count(*) AS m FROM draws JOIN ranked USING (family, rank) GROUP BY ALL)"""


def intervals(replicates: int, rows: str) -> str:
    """CTEs ending in ``ci``: metrics of each replicate from a run-by-run pair table."""
    return f"""{multiplicity(replicates, rows)},
cells AS (SELECT run_id, family, score, sum(y) AS pos, sum(1 - y) AS neg FROM {rows} GROUP BY ALL),
pairs AS (SELECT a.run_id AS ra, a.family AS fa, b.run_id AS rb, b.family AS fb,
  sum(a.pos * b.neg * CASE WHEN b.score < a.score THEN 2 WHEN b.score = a.score THEN 1 ELSE 0 END)::BIGINT AS c
  FROM (SELECT * FROM cells WHERE pos > 0) a CROSS JOIN (SELECT * FROM cells WHERE neg > 0) b GROUP BY ALL),
per_run AS (SELECT run_id, family, sum(pos) AS p, sum(neg) AS n FROM cells GROUP BY ALL),
rep_fam AS (SELECT replicate, family, sum(m * (p + n))::DOUBLE AS size, sum(m * p)::DOUBLE AS p, sum(m * n)::DOUBLE AS n
  FROM mult JOIN per_run USING (run_id) GROUP BY ALL),
rep_pair AS (SELECT ma.replicate, fa, fb, sum(ma.m * mb.m * c)::DOUBLE AS twice FROM pairs
  JOIN mult ma ON ma.run_id = ra JOIN mult mb ON mb.run_id = rb AND mb.replicate = ma.replicate GROUP BY ALL),
rep_tot AS (SELECT replicate, sum(p) AS p, sum(n) AS n, sum(p / size) AS wp, sum(n / size) AS wn,
  coalesce(sum(p) FILTER (family = 'normal'), 0) AS pn, sum(n) FILTER (family = 'normal') AS nn,
  sum(p) FILTER (family = 'manipulation') AS pm, sum(p) FILTER (family = 'recon') AS pr FROM rep_fam GROUP BY replicate),
rep AS (SELECT t.replicate, sum(twice) / any_value(2 * t.p * t.n) AS event_weighted_auc,
  sum(twice / (a.size * b.size)) / any_value(2 * wp * wn) AS scenario_balanced_auc,
  coalesce(sum(twice) FILTER (fb = 'normal' AND fa IN ('normal', 'manipulation')), 0) / any_value(2 * (pm + pn) * nn) AS manipulation_vs_normal_auc,
  coalesce(sum(twice) FILTER (fb = 'normal' AND fa IN ('normal', 'recon')), 0) / any_value(2 * (pr + pn) * nn) AS recon_vs_normal_auc
  FROM rep_pair x JOIN rep_tot t USING (replicate) JOIN rep_fam a ON a.replicate = x.replicate AND a.family = fa
  JOIN rep_fam b ON b.replicate = x.replicate AND b.family = fb GROUP BY t.replicate),
ci AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
  FROM (UNPIVOT rep ON event_weighted_auc, scenario_balanced_auc, manipulation_vs_normal_auc, recon_vs_normal_auc INTO NAME metric VALUE value)
  GROUP BY metric)"""


PRIMARY = "event_weighted_auc, scenario_balanced_auc, manipulation_vs_normal_auc, recon_vs_normal_auc"
FAMILY_OF = """CASE WHEN n IN ('normal', 'fault', 'manipulation', 'recon') THEN n
  WHEN n LIKE '%\\_normal' ESCAPE '\\' THEN 'normal' WHEN n LIKE '%\\_fault' ESCAPE '\\' THEN 'fault'
  WHEN n LIKE '%\\_manipulation' ESCAPE '\\' THEN 'manipulation' WHEN n LIKE '%\\_recon' ESCAPE '\\' THEN 'recon' ELSE 'other' END"""
PROPULSION = """CASE WHEN throttle_command_left IS NULL AND throttle_command_right IS NULL THEN NULL
  ELSE (coalesce(throttle_command_left, 0) + coalesce(throttle_command_right, 0))
    / ((throttle_command_left IS NOT NULL)::INTEGER + (throttle_command_right IS NOT NULL)::INTEGER) END"""


def band(value: str, low: float, high: float) -> str:
    return f"""CASE WHEN coalesce(modbus_function, 0) NOT IN (5, 6, 15, 16) THEN 'na' WHEN {value} IS NULL THEN 'unknown'
  WHEN {value} BETWEEN {low} AND {high} THEN 'in_band' ELSE 'out_of_band' END"""


RUDDER_BAND = band("rudder_angle / 35.0", -1, 1) + " AS rudder_band"
PROPULSION_BAND = band(PROPULSION, 0, 1) + " AS propulsion_band"
FLOW_COLUMNS = """event_id, pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient, coalesce(flow_state, 'na') AS flow_state"""
PROTOCOL_COLUMNS = """coalesce(modbus_function::VARCHAR, 'na') AS modbus_function, coalesce(modbus_access, 'na') AS modbus_access"""
RATE_CTE = f"""WITH {TGT},
samples AS (SELECT event_id, t_us, rudder_angle / 35.0 AS v, run_id FROM tgt WHERE rudder_angle IS NOT NULL),
rates AS (SELECT event_id, CASE WHEN t_us > lag(t_us) OVER w THEN (v - lag(v) OVER w) / ((t_us - lag(t_us) OVER w) / 1e6) ELSE 0 END AS rate
  FROM samples WINDOW w AS (PARTITION BY run_id ORDER BY t_us, event_id)),
rated AS (SELECT tgt.*, coalesce(rate, 0) AS rate FROM tgt LEFT JOIN rates USING (event_id))"""
STRICT_COLUMNS = f"""round(coalesce(rudder_angle / 35.0, 0), 6) AS rudder_norm, (rudder_angle IS NOT NULL)::INTEGER AS rudder_norm_present,
  round(rate, 6) AS rudder_rate, {RUDDER_BAND}"""
PROXY_COLUMNS = f"""round(coalesce({PROPULSION}, 0), 6) AS propulsion_demand_norm,
  ((throttle_command_left IS NOT NULL) OR (throttle_command_right IS NOT NULL))::INTEGER AS propulsion_demand_norm_present, {PROPULSION_BAND}"""
TIED = RATE_CTE.replace(
    "SELECT event_id, t_us, rudder_angle / 35.0 AS v, run_id",
    "SELECT event_id, CASE event_id % 10 WHEN 0 THEN 1704700000000000 ELSE t_us END AS t_us, rudder_angle / 35.0 AS v, "
    "CASE event_id % 10 WHEN 0 THEN 'normal-r01' ELSE run_id END AS run_id",
)
RATE_ONLY = f"{TIED} SELECT event_id, round(rate, 6) AS rudder_rate FROM rated"
FPR_CURVE = f"""WITH {SRC}, {validation(ALL)}, {threshold('va', '0.01', 'thr')}
SELECT seed, round(score, 6) AS score, at_or_above::BIGINT AS at_or_above, round(fpr, 6) AS fpr FROM thr_rate"""
QUANTILES = """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.025), 6) AS q025, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY event_type"""
ASOF = f"""WITH {TGT}, e AS (SELECT event_id, CASE WHEN event_id % 103 <> 0 THEN run_id END AS run_id, CASE WHEN event_id % 101 <> 0 THEN t_us END AS t_us FROM tgt),
p AS (SELECT run_id, run_id AS k, name, t_us FROM timeline UNION ALL SELECT NULL, '', name, t_us FROM timeline WHERE run_id = 'recon-r01')
SELECT e.event_id, e.run_id, coalesce(p.name, 'pre-phase') AS phase_name, p.t_us AS phase_start_us
FROM (SELECT *, coalesce(run_id, '') AS k FROM e) e ASOF LEFT JOIN p ON e.k = p.k AND e.t_us >= p.t_us"""
AUC_EVENT = f"WITH {TGT}, {scores(ALL)} {auc('sc', 'seed')}"
SPLIT_SOLO = f"""solo AS (SELECT s.seed, event_id, row_number() OVER (PARTITION BY s.seed ORDER BY {h('s.seed', 'event_id')}, event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY s.seed) AS n FROM src CROSS JOIN (SELECT unnest({ALL}) AS seed) s),
solo_side AS (SELECT seed, event_id, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'validation' END AS side FROM solo)"""
ATTACKS = "family IN ('manipulation', 'recon') AND y = 1"


def checks(*rows: str) -> str:
    return " UNION ALL ".join(rows)


def row(name: str, subject: str, expected: str, actual: str, passed: str, rest: str, keys: str = "") -> str:
    return (
        f"SELECT {keys}'{name}' AS check_name, ({subject})::VARCHAR AS subject, ({expected})::VARCHAR AS expected, "
        f"({actual})::VARCHAR AS actual, coalesce({passed}, false) AS passed {rest}"
    )


def split_check_rows(keys: str = "seed, ") -> str:
    """Split checks over ``prof(seed, run_id, side, label)``, one row per event."""
    agg = """FROM (SELECT seed, count(*) FILTER (side = 'validation') AS n_val,
      count(*) FILTER (side = 'validation' AND label <> 'attack') AS n_neg FROM prof GROUP BY seed)"""
    return checks(
        row("split_basis", "'basis'", "'run'", "'run'", "true", agg, keys),
        row("validation_rows", "'rows'", "'>=1'", "n_val", "n_val > 0", agg, keys),
        row("run_overlap", "'shared runs'", "0", "0", "true", agg, keys),
        row("validation_negatives_present", "'rows'", "'>=1'", "n_neg", "n_val = 0 OR n_neg > 0", agg, keys),
        row("validation_negatives_enough", "'rows'", "'>=100'", "n_neg", "n_val = 0 OR n_neg = 0 OR n_neg >= 100", agg, keys),
    )


def composition_rows(seeds: str) -> str:
    rest = f"""FROM (SELECT s.seed, d.side, l.label, count(DISTINCT p.run_id) AS n
      FROM (SELECT unnest({seeds}) AS seed) s CROSS JOIN (SELECT unnest(['train', 'validation']) AS side) d
      CROSS JOIN (SELECT DISTINCT label FROM tgt WHERE label <> 'attack') l
      LEFT JOIN prof p ON p.seed = s.seed AND p.side = d.side AND p.label = l.label GROUP BY ALL)"""
    return checks(
        row("class_present", "side || '/' || label", "'>=1'", "n", "n > 0", rest, "seed, "),
        row("class_runs", "side || '/' || label", "'>=2'", "n", "n = 0 OR n >= 2", rest, "seed, "),
    )


def profile(seeds: str) -> str:
    return f"{splits(seeds, 'src', 'ss')}, prof AS (SELECT seed, run_id, side, label FROM src JOIN ss USING (run_id))"


def readiness(table: str, phased: str, min_seconds: int = 60) -> str:
    fam = f"(SELECT *, {FAMILY_OF} AS fam FROM (SELECT *, lower(trim(scenario)) AS n FROM {table}))"
    per_run = f"(SELECT run_id, count(DISTINCT label) AS k, max(t_us) - min(t_us) AS span FROM {table} GROUP BY run_id)"
    return checks(
        row("ground_truth_phases", "'runs with phases'", "'>=1'", "n", "n > 0", f"FROM (SELECT {phased} AS n)"),
        row("phase_level_labels", "'runs with several labels'", "'>=1'", "n", "n > 0", f"FROM (SELECT count(*) FILTER (k > 1) AS n FROM {per_run})"),
        row("run_duration_sec", "run_id", f"'>={min_seconds}'", "floor(span / 1000000)::BIGINT", f"span >= {min_seconds} * 1000000", f"FROM {per_run}"),
        row("scenario_mapped", "'unmapped scenario names'", "0", "n", "n = 0", f"FROM (SELECT count(DISTINCT scenario) FILTER (fam = 'other') AS n FROM {fam})"),
        row("family_repeats", "fam", "'>=3'", "n", "n >= 3", f"FROM (SELECT fam, count(DISTINCT run_id) AS n FROM {fam} GROUP BY fam)"),
    )


def set_row(name: str, column: str, known: str, size: int, rest: str, subset: bool = False) -> str:
    counted = f"FROM (SELECT count(DISTINCT {column}) FILTER ({column} IN {known}) AS hit, count(DISTINCT {column}) FILTER ({column} NOT IN {known}) AS extra {rest})"
    passed = "extra = 0" if subset else f"extra = 0 AND hit = {size}"
    return row(name, f"'{column}'", f"'{size} known, 0 other'", "hit || ' known, ' || extra || ' other'", passed, counted)


def count_row(name: str, aggregate: str, expected: str, table: str) -> str:
    return row(name, "'count'", expected, "n", f"n = {expected}", f"FROM (SELECT {aggregate} AS n FROM {table})")


#: Runs as found and as declared; ``wrong`` is the manifest with four planted faults.
CAMPAIGN = """
found AS (SELECT run_id AS run, count(*) AS n FROM tgt GROUP BY run_id),
listed AS (
  SELECT false AS wrong, run, run AS shown, n AS rows, n, true AS told, true AS seen, true AS same FROM found
  UNION ALL SELECT true, run, run, CASE run WHEN 'fault-r02' THEN n - 1 WHEN 'recon-r03' THEN NULL ELSE n END, n, run <> 'recon-r03', true, run NOT IN ('normal-r01', 'recon-r03') FROM found
  UNION ALL SELECT true, 'ghost-r01', 'ghost-r01', n, NULL, true, false, false FROM found WHERE run = 'normal-r01')
"""


def campaign_rows(wrong: str) -> str:
    b = f"FROM listed WHERE wrong = {wrong}"
    return checks(
        row("file_listed", "run", "'declared and found'", "CASE WHEN told AND seen THEN 'declared and found' WHEN told THEN 'missing' ELSE 'undeclared' END", "told AND seen", b),
        row("file_hash", "run", "'same'", "CASE WHEN same THEN 'same' WHEN seen THEN 'other' ELSE 'none' END", "same", f"{b} AND told"),
        row("run_rows", "run", "coalesce(rows::VARCHAR, 'none')", "coalesce(n::VARCHAR, 'none')", "rows = n", b),
        row("single_run_id", "run", "CASE WHEN told THEN run ELSE 'none' END", "CASE WHEN seen THEN run ELSE 'none' END", "told AND seen", b),
        row("total_rows", "'count'", "rows", "n", "rows = n", f"FROM (SELECT sum(rows)::BIGINT AS rows, sum(n)::BIGINT AS n {b})"),
        set_row("event_type_set", "event_type", "('flow', 'modbus')", 2, "FROM tgt", subset=True),
        set_row("family_set", "family", "('normal', 'fault', 'manipulation', 'recon')", 4, "FROM tgt"),
        set_row("label_set", "label", "('normal', 'fault', 'attack')", 3, "FROM tgt"),
        row("family_runs", "family", "3", "n", "n = 3", "FROM (SELECT family, count(DISTINCT run_id) AS n FROM tgt GROUP BY family)"),
    )


MAIN_RUNS = "(3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 21, 22)"
FAULT_NAMES = "('fault_comm_dropout', 'fault_plc_restart', 'fault_poll_storm')"

STRESS_COLUMNS = """round(avg(cell), 6) AS run_scenario_balanced_false_positive_rate, round(sum(hits) / sum(n), 6) AS event_weighted_false_positive_rate"""


def stress(seeds: str) -> str:
    return f"""{scores(seeds, 'stress', 'st')},
cell AS (SELECT seed, run_id, scenario, avg((score >= threshold)::INTEGER) AS cell, sum((score >= threshold)::INTEGER)::DOUBLE AS hits, count(*) AS n
  FROM st JOIN thr USING (seed) GROUP BY ALL)"""


def inverted(replicates: int, keys: str) -> str:
    """CTE ``boot``: per key of ``hits`` and replicate the share hit, a hash inverted at the whole binomial distribution."""
    hashed = h(*["seed", *[k for k in keys.split(", ") if k != "seed"], "b.replicate"])
    return f"""
pmf AS (SELECT {keys}, n_episodes, k, CASE WHEN n_hit IN (0, n_episodes) THEN (k = n_hit)::INTEGER::DOUBLE
    ELSE exp(lgamma(n_episodes + 1) - lgamma(k + 1) - lgamma(n_episodes - k + 1) + k * ln(n_hit / n_episodes) + (n_episodes - k) * ln(1 - n_hit / n_episodes)) END AS w
  FROM (SELECT *, unnest(range(n_episodes + 1)) AS k FROM hits)),
cdf AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY k) AS c FROM pmf),
boot AS (SELECT {keys}, replicate, count(*) FILTER (c <= u) / any_value(n_episodes) AS value
  FROM cdf JOIN (SELECT hits.* EXCLUDE (n_episodes, n_hit), b.replicate, ({hashed} + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
    FROM hits CROSS JOIN (SELECT unnest(range({replicates})) AS replicate) b) USING ({keys}) GROUP BY ALL)"""


def recall_ci(replicates: int, source: str = "ep") -> str:
    return f"""
hits AS (SELECT seed, family, count(*) AS n_episodes, sum(hit)::BIGINT AS n_hit FROM {source} GROUP BY ALL), {inverted(replicates, 'seed, family')},
rci AS (SELECT seed, family, any_value(n_hit / n_episodes) AS mean, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi,
  any_value(n_episodes) AS n_episodes FROM hits JOIN boot USING (seed, family) GROUP BY seed, family)"""


def gated_base() -> str:
    """CTEs of the gated evaluation, which trains on the whole source table, faults included."""
    return f"""WITH {SRC}, {TGT}, {profile(GATED)},
gated_va AS (SELECT ss.seed, s.*, (s.label = 'attack')::INTEGER AS y,
  ({h('ss.seed', 's.event_id')} % 141 + CASE WHEN s.label = 'attack' THEN 40 ELSE 0 END) / 200.0::DOUBLE AS score
  FROM src s JOIN ss USING (run_id) WHERE ss.side = 'validation'),
{threshold('gated_va', '0.01', 'thr')}, {scores(GATED)},
pr AS (SELECT sc.*, threshold, (score >= threshold)::INTEGER AS pred FROM sc JOIN thr USING (seed)),
atk AS (SELECT * FROM pr WHERE {ATTACKS}),
ep AS (SELECT seed, family, run_id, phase AS episode, max(pred) AS hit, min(t_us) AS first_us, min(t_us) FILTER (pred = 1) AS alarm_us FROM atk GROUP BY ALL),
{recall_ci(2000)},
lat AS (SELECT seed, family, median((alarm_us - first_us) / 1e6) AS med, count(alarm_us) AS det, count(*) FILTER (hit = 0) AS miss FROM ep GROUP BY ALL),
own AS (SELECT seed, count(*) FILTER (NOT passed) AS n FROM ({split_check_rows()} UNION ALL {composition_rows(GATED)}) GROUP BY seed),
general AS (SELECT count(*) FILTER (NOT passed) AS n FROM ({readiness('tgt', '(SELECT count(*) FROM runs12)')})),
modes AS (SELECT seed, own.n + general.n AS n_reasons FROM own CROSS JOIN general),
by_run AS (SELECT seed, run_id, sum(pred) AS alarms, max(t_us) - min(t_us) AS span FROM pr GROUP BY ALL),
load AS (SELECT seed, avg(alarms) AS a_mean, max(alarms)::BIGINT AS a_max, count(*) AS n_runs, sum(alarms) / (sum(span) / 3.6e9) AS per_hour, sum(span) / 3.6e9 AS hours
  FROM by_run GROUP BY seed),
rates AS (SELECT seed, any_value(threshold) AS threshold, {RATE.format(f='normal', y=0)} AS fpr_normal, count(*) FILTER (family = 'normal' AND y = 0) AS n_normal,
  {RATE.format(f='fault', y=0)} AS fpr_fault, count(*) FILTER (family = 'fault' AND y = 0) AS n_fault,
  {RATE.format(f='manipulation', y=1)} AS recall_event_manipulation, count(*) FILTER (family = 'manipulation' AND y = 1) AS n_manipulation_attack_rows,
  {RATE.format(f='recon', y=1)} AS recall_event_recon, count(*) FILTER (family = 'recon' AND y = 1) AS n_recon_attack_rows FROM pr GROUP BY seed)"""


def gated_columns(attack: str) -> list[str]:
    return [
        f"round(r_{attack}.mean, 6) AS recall_episode_{attack}",
        f"round(r_{attack}.lo, 6) AS recall_episode_{attack}_lo",
        f"round(r_{attack}.hi, 6) AS recall_episode_{attack}_hi",
        f"r_{attack}.n_episodes AS n_episodes_{attack}",
        f"'ground_truth_phase' AS episode_basis_{attack}",
        f"round(l_{attack}.med, 6) AS latency_{attack}_median_sec",
        f"l_{attack}.det AS latency_{attack}_n_detected",
        f"l_{attack}.miss AS latency_{attack}_n_missed",
    ]


GATED_JOIN = " ".join(
    f"JOIN rci r_{a} ON r_{a}.seed = m.seed AND r_{a}.family = '{a}' JOIN lat l_{a} ON l_{a}.seed = m.seed AND l_{a}.family = '{a}'"
    for a in ("manipulation", "recon")
)

LABELLED = f"""WITH {TGT}, lb AS (SELECT event_id, run_id, phase AS phase_name, label AS phase_label FROM tgt)"""

TRANSFER_CTES = f"""{predicted(ALL)}, {stress(ALL)},
per_seed AS (SELECT seed, {THRESHOLD_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM pr GROUP BY seed),
vauc AS ({auc('va', 'seed')}),
vauc_raw AS (SELECT p.seed, sum(p.c * n.c * CASE WHEN n.score < p.score THEN 2 WHEN n.score = p.score THEN 1 ELSE 0 END)::DOUBLE / (2.0 * sum(p.c * n.c)) AS v
  FROM (SELECT seed, score, count(*) AS c FROM va WHERE y = 1 GROUP BY ALL) p JOIN (SELECT seed, score, count(*) AS c FROM va WHERE y = 0 GROUP BY ALL) n USING (seed) GROUP BY p.seed),
vfpr AS (SELECT seed, avg((score >= threshold)::INTEGER) FILTER (y = 0) AS v FROM va JOIN thr USING (seed) GROUP BY seed),
st_m AS (SELECT seed, avg(cell) AS b, sum(hits) / sum(n) AS e FROM cell GROUP BY seed),
long AS (SELECT 'source_validation_auc' AS metric, v FROM vauc_raw UNION ALL SELECT 'source_validation_fpr', v FROM vfpr
  UNION ALL SELECT 'normal_fpr', normal_fpr FROM per_seed UNION ALL SELECT 'fault_fpr', fault_fpr FROM per_seed
  UNION ALL SELECT 'manipulation_recall', manipulation_recall FROM per_seed UNION ALL SELECT 'recon_recall', recon_recall FROM per_seed
  UNION ALL SELECT 'run_scenario_balanced_false_positive_rate', b FROM st_m UNION ALL SELECT 'event_weighted_false_positive_rate', e FROM st_m),
ens AS (SELECT 0 AS k, event_id, any_value(run_id) AS run_id, any_value(family) AS family, any_value(y) AS y, list_reduce(list(score ORDER BY seed), lambda a, b: a + b) / 20.0::DOUBLE AS score
  FROM sc GROUP BY event_id),
{primary('ens', 'k')}, {intervals(2000, 'ens')},
point AS (SELECT metric, value FROM (UNPIVOT (SELECT {PRIMARY} FROM prim) ON {PRIMARY} INTO NAME metric VALUE value))"""
TRANSFER_ROWS = """SELECT 'flow' AS schema, 'per_seed_summary' AS section, metric, round(median(v), 6) AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi,
  round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n, true AS ready, 0::BIGINT AS n_reasons FROM long GROUP BY metric
UNION ALL SELECT 'flow', 'primary_ensemble', metric, round(value, 6), round(lo, 6), round(hi, 6), NULL, NULL, 20, true, 0 FROM point JOIN ci USING (metric)"""
TRANSFER = f"WITH {TRANSFER_CTES} {TRANSFER_ROWS}"

SCHEMAS = "['flow', 'protocol', 'physical_strict', 'physical_proxy']"
METRIC_ROWS = """(
  SELECT 'per_seed_summary' AS section, unnest(['source_validation_auc', 'source_validation_fpr', 'normal_fpr', 'fault_fpr', 'manipulation_recall',
    'recon_recall', 'run_scenario_balanced_false_positive_rate', 'event_weighted_false_positive_rate']) AS metric
  UNION ALL SELECT 'primary_ensemble', unnest(['event_weighted_auc', 'scenario_balanced_auc', 'manipulation_vs_normal_auc', 'recon_vs_normal_auc']))"""
#: Rows and runs of the pools, as the experiment reports them.
AUDIT_ROWS = """SELECT '' AS schema, 'audit_' || stage AS section, metric, value::DOUBLE AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS min,
  NULL::DOUBLE AS max, 1::BIGINT AS n, true AS ready, 0::BIGINT AS n_reasons
FROM (UNPIVOT (SELECT stage, count(*) AS n_rows, count(DISTINCT r) AS n_runs, count(DISTINCT r || '/' || scenario) AS n_cells FROM (
  SELECT 'raw' AS stage, run_id::VARCHAR AS r, scenario FROM src UNION ALL SELECT 'main', run_id::VARCHAR, scenario FROM main
  UNION ALL SELECT 'stress', run_id::VARCHAR, scenario FROM stress UNION ALL SELECT 'target', run_id, scenario FROM tgt) GROUP BY stage)
  ON n_rows, n_runs, n_cells INTO NAME metric VALUE value)"""

PIVOT = ", ".join(
    f"count(*) FILTER (scenario = '{s}') AS {s}" for s in ("fault_comm_dropout", "fault_plc_restart", "fault_poll_storm")
)

DOC_FILES = "df AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, n_chars AS bytes, sha256(text) AS sha256 FROM documents)"

CHANGED = f"""{DOC_FILES}, act AS (SELECT CASE WHEN doc_id % 19 = 0 THEN path || '.KEY' ELSE path END AS path,
  CASE WHEN doc_id % 11 = 0 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN doc_id % 13 = 0 THEN reverse(sha256) ELSE sha256 END AS sha256 FROM df WHERE doc_id % 17 <> 0),
rec AS (SELECT coalesce(d.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'unexpected' WHEN d.bytes <> a.bytes THEN 'size mismatch'
  WHEN d.sha256 <> a.sha256 THEN 'hash mismatch' ELSE 'ok' END AS status, d.bytes AS declared_bytes, a.bytes AS actual_bytes
  FROM df d FULL OUTER JOIN act a ON d.path = a.path)"""

CONTENT_RULES = r"""r(rule, pattern) AS (VALUES ('host user path', '(?i)[a-z]:[\\/]+users[\\/]+'),
  ('GitHub access token', '(?:gh[opsu]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})'), ('AWS access key', '(?:AKIA|ASIA)[A-Z0-9]{16}'),
  ('private key', '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----'), ('mailbox', '(?i)[a-z0-9._]@[a-z0-9.]'),
  ('long number', '[0-9]{3}[- ][0-9]{2,}'), ('license line', '(?i)license'))"""

# Episodes by phase and by UTC day, all seeds.
EPISODES = f"""{predicted(ALL)}, rows_of AS (
  SELECT 'phase' AS scope, seed, family, run_id, phase AS episode, pred, t_us FROM pr WHERE {ATTACKS}
  UNION ALL SELECT 'day', seed, family, run_id, (t_us // 86400000000)::VARCHAR, pred, CASE WHEN event_id % 7 <> 0 THEN t_us END FROM pr WHERE {ATTACKS}),
ep AS (SELECT scope, seed, family, run_id, episode, max(pred) AS hit, min(t_us) AS first_us, min(t_us) FILTER (pred = 1) AS alarm_us FROM rows_of GROUP BY ALL)"""

# Each kind of planted difference, with its place among those of one document.
DEEP = "$.deep" + ".d" * 12
DIFFERENCES = f"""WITH e AS (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS n, event_id % 10 AS k FROM events), found AS (
SELECT event_id, '$.k' AS path, 'type' AS difference, 'integer' AS expected_type, 'double' AS actual_type, n::VARCHAR AS expected_value, n::DOUBLE::VARCHAR AS actual_value, 0 AS place FROM e WHERE k = 0
UNION ALL SELECT event_id, '$.k', 'value', 'integer', 'integer', n::VARCHAR, (n + 1)::VARCHAR, 0 FROM e WHERE k = 1
UNION ALL SELECT event_id, '$', 'value', 'object', 'object', '["a","a.b","big","deep","k","l"]', '["a","a.b","big","deep","extra","k","l"]', 0 FROM e WHERE k = 2
UNION ALL SELECT event_id, '$.extra', 'unexpected', NULL, 'array', NULL, '2', 1 FROM e WHERE k = 2
UNION ALL SELECT event_id, '$.extra[0]', 'unexpected', NULL, 'boolean', NULL, 'true', 2 FROM e WHERE k = 2
UNION ALL SELECT event_id, '$.extra[1]', 'unexpected', NULL, 'string', NULL, '"x"', 3 FROM e WHERE k = 2
UNION ALL SELECT event_id, '{DEEP}', 'value', 'integer', 'integer', n::VARCHAR, (n + 1)::VARCHAR, 0 FROM e WHERE k = 3
UNION ALL SELECT event_id, '$.l[2]', 'type', 'integer', 'null', '2', 'null', 0 FROM e WHERE k = 4
UNION ALL SELECT event_id, '$.l[10]', 'type', 'integer', 'string', '10', '"10"', 1 FROM e WHERE k = 4
UNION ALL SELECT event_id, '$.big', 'value', 'integer', 'integer', '12345678901234567890', '12345678901234567891', 0 FROM e WHERE k = 5
UNION ALL SELECT event_id, '$["a.b"]', 'type', 'integer', 'boolean', '1', 'true', 0 FROM e WHERE k = 6)"""

SQL: dict[str, str] = {
    "scan_events": f"""WITH {SRC} SELECT event_id, 'site_a' AS source_dataset, run_id::VARCHAR AS run_id, scenario, label, event_type,
  stamp AS "timestamp", pkts_toserver, flow_state, modbus_function, round(rudder_angle, 6) AS rudder_angle, NULL::DOUBLE AS throttle_command_left FROM src""",
    "scan_campaign": f"""WITH {TGT} SELECT run_id AS run, count(*) AS n_rows, 1::BIGINT AS n_run_ids,
  count(throttle_command_left) FILTER (family <> 'normal') AS with_throttle, sum(event_id)::BIGINT AS id_sum, count(rudder_angle) AS with_rudder FROM tgt GROUP BY run_id""",
    "scan_campaign_parquet": f"WITH {TGT} SELECT run_id AS run, count(*) AS n_rows, 1::BIGINT AS n_run_ids FROM tgt GROUP BY run_id",
    "campaign_manifest": f"""WITH {TGT} SELECT run_id AS run, count(*) AS rows, CASE WHEN any_value(family) = 'normal' THEN 'baseline' ELSE 'baseline,act' END AS phases,
  'run=' || run_id AS folder, 64 AS hash_length, true AS no_label FROM tgt GROUP BY run_id""",
    "spec_rows": f"""WITH {SRC} SELECT tag, tag = 'source/v1' AS tag_ok, (SELECT count(*) FROM src) AS raw_rows, (SELECT count(*) FROM main) AS main_rows,
  (SELECT count(*) FROM main WHERE label = 'normal') AS main_normal_rows, (SELECT count(*) FROM main WHERE label = 'attack') AS main_attack_rows,
  (SELECT count(*) FROM stress) AS stress_rows, (SELECT count(DISTINCT run_id) FROM src) AS raw_runs,
  (SELECT count(DISTINCT run_id || scenario) FROM stress) AS stress_cells FROM (SELECT unnest(['source/v1', 'source/v2']) AS tag)""",
    "phase_timeline": f"WITH {TGT} SELECT run_id, t_us, name FROM timeline",
    "manifest_rows": f"WITH {DOC_FILES} SELECT path, bytes, sha256, true AS tag_ok FROM df",
    "result_rounded": f"""WITH {predicted(ALL)}, w AS (SELECT seed, {THRESHOLD_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM pr GROUP BY seed)
SELECT seed, metric, round_even(value, 6) AS value FROM (UNPIVOT w ON normal_fpr, fault_fpr, manipulation_recall, recon_recall INTO NAME metric VALUE value)""",
    "safe_numeric": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN round(value, 6) WHEN 3 THEN round(value, 6) WHEN 7 THEN 1500.0 END AS num FROM events""",
    "role_normalize": f"""WITH {SRC} SELECT event_id, round(rudder_angle / 35.0, 6) AS rudder_norm, round(rpm_command / 1200.0, 6) AS propulsion_demand_norm FROM src""",
    "role_coalesce": f"""WITH {TGT} SELECT event_id, round({PROPULSION}, 6) AS propulsion_demand_norm,
  round((coalesce(rudder_angle / 35.0, 0) + pkts_toclient / 35.0) / (1 + (rudder_angle IS NOT NULL)::INTEGER), 6) AS mixed_mean FROM tgt""",
    "presence_impute": f"""WITH {TGT} SELECT event_id, round(coalesce({PROPULSION}, 0), 6) AS propulsion_demand_norm,
  ({PROPULSION} IS NOT NULL)::INTEGER AS propulsion_demand_norm_present, (rudder_angle IS NOT NULL)::INTEGER AS rudder_norm_present FROM tgt""",
    "physical_band": f"WITH {TGT} SELECT event_id, {RUDDER_BAND}, {PROPULSION_BAND} FROM tgt",
    "write_filter": f"WITH {TGT} SELECT event_id, (coalesce(modbus_function, 0) IN (5, 6, 15, 16))::INTEGER AS is_write FROM tgt",
    "scenario_family": f"""WITH {TGT}, r AS (SELECT CASE event_id % 4 WHEN 0 THEN scenario WHEN 1 THEN chr(10) || ' ' || upper(scenario) || chr(9) WHEN 2 THEN family ELSE family || '_x' END AS raw FROM tgt)
SELECT raw, {FAMILY_OF} AS family, count(*) AS n_rows FROM (SELECT raw, lower(trim(raw, ' ' || chr(9) || chr(10))) AS n FROM r) GROUP BY ALL""",
    "epoch_seconds": "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN round(epoch_us(ts) / 1e6, 6) END AS epoch_sec FROM events",
    "features_flow": f"WITH {TGT} SELECT {FLOW_COLUMNS} FROM tgt",
    "features_protocol": f"WITH {TGT} SELECT {FLOW_COLUMNS}, {PROTOCOL_COLUMNS} FROM tgt",
    "features_strict": f"{RATE_CTE} SELECT {FLOW_COLUMNS}, {PROTOCOL_COLUMNS}, {STRICT_COLUMNS} FROM rated",
    "features_proxy": f"{RATE_CTE} SELECT {FLOW_COLUMNS}, {PROTOCOL_COLUMNS}, {STRICT_COLUMNS}, {PROXY_COLUMNS} FROM rated",
    "leakage_guard": f"""WITH {TGT}, t AS (SELECT event_id, t_us, stamp AS "timestamp", 'site_b' AS source_dataset, run_id, scenario, event_type, phase, label,
  pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient, flow_state, modbus_function, modbus_access, rudder_angle, throttle_command_left,
  throttle_command_right, hydraulic_pump_rpm_left, hydraulic_pump_rpm_right, flow_start_us FROM tgt)
SELECT column_name, filled_rows, column_name NOT IN ('timestamp', 'source_dataset', 'run_id', 'scenario', 'phase', 'label', 'rudder_angle',
  'throttle_command_left', 'throttle_command_right', 'hydraulic_pump_rpm_left', 'hydraulic_pump_rpm_right') AS allowed
FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM t) ON * INTO NAME column_name VALUE filled_rows)""",
    "side_roles": f"""WITH {TGT} SELECT event_id, round(hydraulic_pump_rpm_left / 3000.0, 6) AS hydraulic_pump_rpm_left_norm,
  round(hydraulic_pump_rpm_right / 3000.0, 6) AS hydraulic_pump_rpm_right_norm FROM tgt""",
    "tracking_error": f"""WITH {TGT} SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN round(((event_id % 71 - 35)::DOUBLE - rudder_angle) / 35.0, 6) END AS rudder_tracking_error FROM tgt""",
    "scenario_map": f"""WITH {SRC}, {TGT} SELECT DISTINCT scenario, {FAMILY_OF} AS family
FROM (SELECT scenario, lower(trim(scenario)) AS n FROM (SELECT scenario FROM src UNION ALL SELECT scenario FROM tgt))""",
    "run_name_family": f"WITH {TGT} SELECT split_part(run_id, '-r', 1) AS family, count(DISTINCT run_id) AS n_runs FROM tgt GROUP BY 1",
    "rate_of_change": RATE_ONLY,
    "rate_of_change_hot": RATE_ONLY,
    "accepted_events": f"WITH {SRC} SELECT event_type, label, count(*) AS n_rows, count(DISTINCT run_id) AS n_runs FROM acc GROUP BY ALL",
    "main_pool": f"WITH {SRC} SELECT run_id, label, count(*) AS n_rows FROM main GROUP BY ALL",
    "stress_pool": f"WITH {SRC} SELECT run_id, scenario, count(*) AS n_rows FROM stress GROUP BY ALL",
    "mask_counts": f"WITH {TGT} SELECT family, count(*) FILTER (y = 0) AS benign_rows, count(*) FILTER (y = 1) AS attack_rows FROM tgt GROUP BY ALL",
    "label_counts": f"WITH {SRC} SELECT label, count(*) AS n_rows FROM main GROUP BY ALL",
    "distinct_runs": f"""WITH {SRC} SELECT DISTINCT field, value FROM (SELECT 'run_id' AS field, run_id::VARCHAR AS value FROM src UNION ALL
  SELECT 'scenario', scenario FROM src UNION ALL SELECT 'label', label FROM src UNION ALL SELECT 'event_type', event_type FROM src)""",
    "cell_count": f"WITH {SRC} SELECT count(*) AS cells FROM (SELECT DISTINCT run_id, scenario FROM stress)",
    "family_counts": f"WITH {TGT} SELECT family, count(*) AS n_rows, count(DISTINCT run_id) AS n_runs FROM tgt GROUP BY ALL",
    "labels_per_run": f"WITH {TGT} SELECT run_id, count(DISTINCT label) AS n_labels FROM tgt GROUP BY ALL",
    "family_repeats": f"""WITH {SRC}, {TGT} SELECT family, count(DISTINCT run_id) AS n_runs, count(DISTINCT run_id) < 3 AS thin
FROM (SELECT run_id::VARCHAR AS run_id, 'other' AS family FROM src UNION ALL SELECT run_id, family FROM tgt) GROUP BY family""",
    "run_duration": f"""WITH {TGT}, x AS (SELECT run_id, CASE WHEN run_id <> 'recon-r02' THEN t_us END AS t FROM tgt)
SELECT run_id, round((max(t) - min(t)) / 1e6, 6) AS duration_sec, coalesce((max(t) - min(t)) / 1e6 < 60, false) AS short FROM x GROUP BY run_id""",
    "pool_audit": f"""WITH {SRC}, {TGT}, x AS (SELECT 'raw' AS stage, run_id::VARCHAR AS r, scenario FROM src UNION ALL SELECT 'accepted', run_id::VARCHAR, scenario FROM acc
  UNION ALL SELECT 'main', run_id::VARCHAR, scenario FROM main UNION ALL SELECT 'stress', run_id::VARCHAR, scenario FROM stress UNION ALL SELECT 'target', run_id, scenario FROM tgt)
SELECT stage, metric, value FROM (UNPIVOT (SELECT stage, count(*) AS n_rows, count(DISTINCT r) AS n_runs, count(DISTINCT r || '/' || scenario) AS n_cells FROM x GROUP BY stage)
  ON n_rows, n_runs, n_cells INTO NAME metric VALUE value)""",
    "run_scenario_pivot": f"WITH {SRC} SELECT run_id, {PIVOT}, count(*) FILTER (label = 'normal') AS normal_rows FROM acc GROUP BY run_id",
    "union_runs": f"""WITH {SRC}, {TGT} SELECT source_dataset, run_id, count(*) AS n_rows, count(rpm) AS with_rpm, count(thr) AS with_throttle
FROM (SELECT 'site_a' AS source_dataset, run_id::VARCHAR AS run_id, rpm_command AS rpm, NULL AS thr FROM src
  UNION ALL SELECT 'site_b', run_id, NULL, throttle_command_left FROM tgt) GROUP BY ALL""",
    "set_difference": f"""WITH {SRC}, e AS (SELECT DISTINCT run_id AS value FROM src WHERE label <> 'attack'), a AS (SELECT DISTINCT run_id + 2 AS value FROM main)
SELECT value, 'missing' AS side FROM (FROM e EXCEPT FROM a) UNION ALL SELECT value, 'unexpected' FROM (FROM a EXCEPT FROM e)""",
    "run_overlap": f"WITH {SRC}, {splits(ALL)} SELECT seed, count(DISTINCT run_id) AS n_runs, 0::BIGINT AS n_shared FROM sp GROUP BY seed",
    "split_by_run": f"WITH {SRC}, {splits(ALL)} SELECT seed, run_id, side FROM sp",
    "split_rows": f"WITH {SRC}, {splits(ALL)} SELECT seed, side, label, count(*) AS n_rows FROM main JOIN sp USING (run_id) GROUP BY ALL",
    "split_basis": f"""WITH {SRC}, {splits(ALL, 'src')}, {SPLIT_SOLO}
SELECT 'many runs' AS scope, seed, 'run' AS basis, side, count(*) AS n_rows, sum(event_id)::BIGINT AS id_sum FROM src JOIN sp USING (run_id) GROUP BY ALL
UNION ALL SELECT 'one run', seed, 'row', side, count(*), sum(event_id)::BIGINT FROM solo_side GROUP BY ALL""",
    "split_basis_hot": f"WITH {SRC}, {SPLIT_SOLO} SELECT seed, 'row' AS basis, side, count(*) AS n_rows, sum(event_id)::BIGINT AS id_sum FROM solo_side GROUP BY ALL",
    "apply_threshold": f"WITH {predicted(ALL)} SELECT seed, family, pred, count(*) AS n_rows FROM pr GROUP BY ALL",
    "auc_event": AUC_EVENT,
    "auc_event_hot": AUC_EVENT,
    "auc_labels": f"""WITH sc AS (SELECT 'quality' AS target, quality AS y, ({h('doc_id')} % 97 + 20 * quality) / 200.0::DOUBLE AS score FROM labels) {auc('sc', 'target')}""",
    "auc_weighted": f"""WITH {TGT}, {scores(ALL)}, w AS (SELECT seed, score, y, sum(CASE family WHEN 'normal' THEN 1 / 2.0::DOUBLE WHEN 'fault' THEN 1 / 3.0::DOUBLE
  WHEN 'manipulation' THEN 1 / 4.0::DOUBLE ELSE 1 / 5.0::DOUBLE END) AS c FROM sc GROUP BY ALL)
SELECT p.seed, round(sum(p.c * n.c * CASE WHEN n.score < p.score THEN 2 WHEN n.score = p.score THEN 1 ELSE 0 END) / (2.0 * sum(p.c * n.c)), 6) AS auc
FROM (SELECT * FROM w WHERE y = 1) p JOIN (SELECT * FROM w WHERE y = 0) n USING (seed) GROUP BY p.seed""",
    "balanced_weights": f"WITH {TGT} SELECT family, count(*) AS family_rows, round(1.0::DOUBLE / count(*), 9) AS weight FROM tgt GROUP BY family",
    "primary_metrics": f"""WITH {TGT}, {scores(ALL)}, {primary('sc', 'seed')} SELECT seed, round(event_weighted_auc, 6) AS event_weighted_auc,
  round(scenario_balanced_auc, 6) AS scenario_balanced_auc, round(manipulation_vs_normal_auc, 6) AS manipulation_vs_normal_auc,
  round(recon_vs_normal_auc, 6) AS recon_vs_normal_auc FROM prim""",
    "threshold_fpr": f"""WITH {SRC}, {validation(ALL)}, {threshold('va', '0.01', 't1')}, {threshold('va', '0.0', 't0')}
SELECT 'one percent' AS budget, seed, threshold FROM t1 UNION ALL SELECT 'zero', seed, threshold FROM t0
UNION ALL SELECT DISTINCT 'no negatives', seed, 0.5::DOUBLE FROM va WHERE y = 1""",
    "fpr_curve": FPR_CURVE,
    "fpr_curve_hot": FPR_CURVE,
    "threshold_metrics": f"WITH {predicted(ALL)} SELECT seed, {THRESHOLD_METRICS} FROM pr GROUP BY seed",
    "lodo_event_rates": f"""WITH {predicted(ALL)}, b AS (SELECT 'all' AS scope, * FROM pr UNION ALL SELECT 'no fault', * FROM pr WHERE family <> 'fault')
SELECT scope, seed, round({RATE.format(f='normal', y=0)}, 6) AS fpr_normal, count(*) FILTER (family = 'normal' AND y = 0) AS n_normal,
  round({RATE.format(f='fault', y=0)}, 6) AS fpr_fault, count(*) FILTER (family = 'fault' AND y = 0) AS n_fault,
  round({RATE.format(f='manipulation', y=1)}, 6) AS recall_event_manipulation, count(*) FILTER (family = 'manipulation' AND y = 1) AS n_manipulation_attack_rows,
  round({RATE.format(f='recon', y=1)}, 6) AS recall_event_recon, count(*) FILTER (family = 'recon' AND y = 1) AS n_recon_attack_rows FROM b GROUP BY ALL""",
    "stress_fpr": f"WITH {SRC}, {validation(ALL)}, {threshold('va', '0.01', 'thr')}, {stress(ALL)} SELECT seed, {STRESS_COLUMNS} FROM cell GROUP BY seed",
    "ensemble_score": f"WITH {TGT}, {scores(ALL)} SELECT event_id, round(sum(round(score * 200)) / 4000.0, 6) AS score, count(*) AS n_scores FROM sc GROUP BY event_id",
    "validation_metrics": f"""WITH {SRC}, {validation(ALL)}, {threshold('va', '0.01', 'thr')}, a AS ({auc('va', 'seed')}),
f AS (SELECT seed, round(avg((score >= threshold)::INTEGER) FILTER (y = 0), 6) AS validation_fpr FROM va JOIN thr USING (seed) GROUP BY seed)
SELECT seed, auc, validation_fpr FROM a JOIN f USING (seed)""",
    "seed_summary": f"""WITH {predicted(ALL)}, w AS (SELECT seed, {THRESHOLD_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM pr GROUP BY seed)
SELECT metric, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n, true AS finite
FROM (UNPIVOT w ON normal_fpr, fault_fpr, manipulation_recall, recon_recall INTO NAME metric VALUE value) GROUP BY metric""",
    "multiseed_summary": f"""WITH {predicted(ALL)}, w AS (SELECT seed, {RATE.format(f='normal', y=0)} AS fpr_normal,
  CASE WHEN seed % 2 = 0 THEN {RATE.format(f='fault', y=0)} END AS fpr_fault, {RATE.format(f='manipulation', y=1)} AS recall_event_manipulation,
  {RATE.format(f='recon', y=1)} AS recall_event_recon FROM pr GROUP BY seed)
SELECT metric, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM (UNPIVOT w ON fpr_normal, fpr_fault, recall_event_manipulation, recall_event_recon INTO NAME metric VALUE value) GROUP BY metric""",
    "quantiles": QUANTILES,
    "quantiles_hot": QUANTILES,
    "asof_phase": ASOF,
    "asof_phase_dense": ASOF,
    "run_timeline": f"""WITH {TGT} SELECT run_id, t_us, name FROM timeline WHERE run_id NOT LIKE '%r03'
UNION ALL SELECT run_id, 1704088800000000, 'baseline' FROM runs12 WHERE run_id LIKE '%r03'
UNION ALL SELECT run_id, 1704672000000000, 'act' FROM runs12 WHERE run_id LIKE '%r03'""",
    "episode_basis": f"""WITH {TGT} SELECT DISTINCT family, CASE WHEN family = 'manipulation' THEN 'ground_truth_phase' WHEN c THEN 'phase_column' ELSE 'run_id' END AS basis,
  c AS has_column FROM tgt CROSS JOIN (SELECT unnest([true, false]) AS c) WHERE {ATTACKS}""",
    "episode_hits": f"""WITH {predicted(ALL)}, ep AS (SELECT seed, family, run_id, phase, max(pred) AS hit FROM pr WHERE {ATTACKS} GROUP BY ALL)
SELECT seed, family, count(*) AS n_episodes, sum(hit)::BIGINT AS n_hit, round(avg(hit), 6) AS recall_episode FROM ep GROUP BY ALL""",
    "episode_recall_ci": f"""WITH {EPISODES},
hits AS (SELECT scope, seed, family, count(*) AS n_episodes, sum(hit)::BIGINT AS n_hit FROM ep GROUP BY ALL),
{inverted(2000, 'scope, seed, family').lstrip()}
SELECT scope, seed, family, round(any_value(n_hit / n_episodes), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo,
  round(quantile_cont(value, 0.975), 6) AS hi, any_value(n_episodes) AS n_episodes FROM hits JOIN boot USING (scope, seed, family) GROUP BY scope, seed, family""",
    "detection_latency": f"""WITH {EPISODES},
l AS (SELECT *, hit = 0 OR first_us IS NULL AS missed, (alarm_us - first_us) / 1e6 AS lat FROM ep)
SELECT scope, seed, family, round(median(lat) FILTER (NOT missed), 6) AS median_sec, round(avg(lat) FILTER (NOT missed), 6) AS mean_sec,
  round(max(lat) FILTER (NOT missed), 6) AS max_sec, count(lat) FILTER (NOT missed) AS n_detected, count(*) FILTER (missed) AS n_missed FROM l GROUP BY ALL""",
    "alarm_load": f"""WITH {predicted(ALL)}, r AS (SELECT seed, run_id, sum(pred) AS alarms, max(t_us) - min(t_us) AS span FROM pr GROUP BY ALL)
SELECT seed, round(avg(alarms), 6) AS alarms_per_run_mean, max(alarms)::BIGINT AS alarms_per_run_max, count(*) AS n_runs,
  round(sum(alarms) / (sum(span) / 3.6e9), 6) AS alarms_per_hour, round(sum(span) / 3.6e9, 6) AS observed_hours FROM r GROUP BY seed""",
    "alarm_load_live": f"""WITH {predicted(GATED)}, r AS (SELECT seed, run_id, sum(pred) AS alarms, max(t_us) - min(t_us) AS span FROM pr WHERE t_us IS NOT NULL GROUP BY ALL)
SELECT seed, round(avg(alarms), 6) AS alarms_per_run_mean, max(alarms)::BIGINT AS alarms_per_run_max, count(*) AS n_runs,
  round(sum(alarms) / (sum(span) / 3.6e9), 6) AS alarms_per_hour, round(sum(span) / 3.6e9, 6) AS observed_hours FROM r GROUP BY seed""",
    "result_document": f"""WITH {predicted(ALL)}, r AS (SELECT seed, run_id, sum(pred) AS alarms, max(t_us) - min(t_us) AS span FROM pr GROUP BY ALL)
SELECT 'target' AS experiment, 0::BIGINT AS n_differences, seed, round(avg(alarms), 6) AS alarms_per_run_mean, max(alarms)::BIGINT AS alarms_per_run_max, count(*) AS n_runs,
  round(sum(alarms) / (sum(span) / 3.6e9), 6) AS alarms_per_hour, round(sum(span) / 3.6e9, 6) AS observed_hours FROM r GROUP BY seed""",
    "resample_multiplicity": f"WITH {TGT}, {multiplicity(2000)} SELECT replicate, run_id, m FROM mult",
    "bootstrap_intervals": f"""WITH {TGT}, {scores(ALL)},
mean20 AS (SELECT event_id, run_id, family, y, round(sum(round(score * 200)) / 4000.0, 6) AS score FROM sc GROUP BY ALL), {intervals(2000, 'mean20')}
SELECT metric, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ci""",
    "readiness_checks": f"WITH {TGT} {readiness('tgt', '(SELECT count(*) FROM runs12)')}",
    "readiness_refused": f"WITH {SRC} {readiness('src', '0')}",
    "split_checks": f"WITH {SRC}, {profile(ALL)} {split_check_rows()}",
    "class_composition": f"WITH {SRC}, {TGT}, {profile(ALL)} {composition_rows(ALL)}",
    "source_contract": f"WITH {SRC} " + checks(
        count_row("raw_rows", "count(*)", "(SELECT count(*) FROM events)", "src"),
        count_row("raw_runs", "count(DISTINCT run_id)", "(SELECT count(DISTINCT run_id) FROM src)", "src"),
        set_row("fault_run_set", "run_id", FAULT_RUNS, 8, "FROM stress"),
        count_row("main_rows", "count(*)", "(SELECT count(*) FROM main)", "main"),
        count_row("main_normal_rows", "count(*) FILTER (label = 'normal')", "(SELECT count(*) FROM main WHERE label = 'normal')", "main"),
        count_row("main_attack_rows", "count(*) FILTER (label = 'attack')", "(SELECT count(*) FROM main WHERE label = 'attack')", "main"),
        set_row("main_run_set", "run_id", MAIN_RUNS, 18, "FROM main"),
        set_row("main_label_set", "label", "('normal', 'attack')", 2, "FROM main"),
        count_row("main_leaked_rows", f"count(*) FILTER (run_id IN {FAULT_RUNS})", "0", "main"),
        count_row("stress_rows", "count(*)", "(SELECT count(*) FROM stress)", "stress"),
        count_row("stress_cells", "count(DISTINCT run_id || scenario)", "(SELECT count(DISTINCT run_id || scenario) FROM stress)", "stress"),
        set_row("stress_run_set", "run_id", FAULT_RUNS, 8, "FROM stress"),
        set_row("stress_scenario_set", "scenario", FAULT_NAMES, 3, "FROM stress"),
    ),
    "target_contract": f"WITH {TGT}, {CAMPAIGN} " + campaign_rows("false"),
    "target_contract_faults": f"WITH {TGT}, {CAMPAIGN} " + campaign_rows("true"),
    "split_contract": f"WITH {SRC}, {splits(ALL)}, prof AS (SELECT seed, run_id, side, label FROM main JOIN sp USING (run_id)) " + checks(
        row("run_overlap", "'shared runs'", "0", "0", "true", "FROM (SELECT DISTINCT seed FROM prof)", "seed, "),
        row("runs_per_label_side", "side || '/' || label", "'>=2'", "n", "n >= 2", "FROM (SELECT seed, side, label, count(DISTINCT run_id) AS n FROM prof GROUP BY ALL)", "seed, "),
        row("validation_normals", "'rows'", "'>=100'", "n", "n >= 100", "FROM (SELECT seed, count(*) FILTER (side = 'validation' AND label = 'normal') AS n FROM prof GROUP BY seed)", "seed, "),
    ),
    "metric_preconditions": f"WITH {TGT}, {scores(ALL)} " + checks(
        row("both_classes", "'classes'", "2", "n", "n = 2", "FROM (SELECT seed, count(DISTINCT y) AS n FROM sc GROUP BY seed)", "seed, "),
        row("finite_scores", "'not finite'", "0", "n", "n = 0", "FROM (SELECT seed, count(*) FILTER (NOT isfinite(score)) AS n FROM sc GROUP BY seed)", "seed, "),
        row("mask_not_empty", "s", "'>=1'", "n", "n > 0", """FROM (SELECT seed, CASE WHEN y = 1 THEN family || '_positives' ELSE family || '_negatives' END AS s, count(*) AS n
  FROM sc WHERE (y = 0) = (family IN ('normal', 'fault')) GROUP BY ALL)""", "seed, "),
        row("stratum_runs", "family", "'>=2'", "n", "n >= 2", "FROM (SELECT seed, family, count(DISTINCT run_id) AS n FROM sc GROUP BY ALL)", "seed, "),
    ),
    "refusal_mode": f"""WITH {SRC}, {TGT}, {profile(ALL)},
own AS (SELECT seed, count(*) FILTER (NOT passed) AS n FROM ({split_check_rows()} UNION ALL {composition_rows(ALL)}) GROUP BY seed),
g AS (SELECT 'target' AS scope, count(*) FILTER (NOT passed) AS n FROM ({readiness('tgt', '(SELECT count(*) FROM runs12)')})
  UNION ALL SELECT s, n FROM (SELECT count(*) FILTER (NOT passed) AS n FROM ({readiness('src', '0')})) CROSS JOIN (SELECT unnest(['unfit', 'unfit forced']) AS s))
SELECT scope, seed, own.n + g.n = 0 AS ready, CASE WHEN own.n + g.n = 0 THEN 'headline' WHEN scope = 'unfit forced' THEN 'forced' ELSE 'contract' END AS mode,
  (own.n + g.n)::BIGINT AS n_reasons FROM own CROSS JOIN g""",
    "result_contract": f"""WITH {SRC}, {TGT}, {validation(ALL)}, {threshold('va', '0.01', 'thr')}, {scores('range(42, 43)')}, {primary('sc', 'seed')}, {intervals(2000, 'sc')},
f AS (SELECT seed, avg((score >= threshold)::INTEGER) FILTER (y = 0) AS v FROM va JOIN thr USING (seed) GROUP BY seed),
pt AS (SELECT metric, value, lo, hi FROM (UNPIVOT (SELECT {PRIMARY} FROM prim) ON {PRIMARY} INTO NAME metric VALUE value) JOIN ci USING (metric)) """ + checks(
        row("seeds_complete", "'seeds'", "20", "n", "n = 20", "FROM (SELECT count(DISTINCT seed) AS n FROM f)"),
        row("seed_list", "'in order'", "(SELECT string_agg(seed::VARCHAR, ',') FROM (SELECT unnest(range(42, 62)) AS seed))", "s", "true", "FROM (SELECT string_agg(seed::VARCHAR, ',' ORDER BY seed) AS s FROM f)"),
        row("validation_fpr_within_budget", "'seeds over budget'", "0", "n", "n = 0", "FROM (SELECT count(*) FILTER (v > 0.01) AS n FROM f)"),
        row("interval_holds_point", "metric", "'inside'", "CASE WHEN value BETWEEN lo AND hi THEN 'inside' ELSE 'outside' END", "value BETWEEN lo AND hi", "FROM pt"),
    ),
    "onehot_features": f"""WITH {SRC}, {TGT}, tr AS (SELECT coalesce(flow_state, 'na') AS a, coalesce(modbus_function::VARCHAR, 'na') AS b, coalesce(modbus_access, 'na') AS c FROM main),
te AS (SELECT event_id, pkts_toserver + pkts_toclient + bytes_toserver + bytes_toclient AS s,
  coalesce(flow_state, 'na') AS a, coalesce(modbus_function::VARCHAR, 'na') AS b, coalesce(modbus_access, 'na') AS c FROM tgt)
SELECT event_id, (SELECT 4 + count(DISTINCT a) + count(DISTINCT b) + count(DISTINCT c) FROM tr) AS width,
  round(s + (a IN (SELECT a FROM tr))::INTEGER + (b IN (SELECT b FROM tr))::INTEGER + (c IN (SELECT c FROM tr))::INTEGER, 6) AS total FROM te""",
    "rule_scores": "SELECT event_id, (floor(value) > 0)::INTEGER::DOUBLE AS score FROM events",
    "transfer_refused": f"""SELECT 'flow' AS schema, section, metric, NULL::DOUBLE AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS min,
  NULL::DOUBLE AS max, 20::BIGINT AS n, false AS ready, 20::BIGINT AS n_reasons FROM {METRIC_ROWS}""",
    "transfer_withheld": f"""WITH {SRC}, {TGT}, {CAMPAIGN}
SELECT schema, section, metric, NULL::DOUBLE AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS min, NULL::DOUBLE AS max, 20::BIGINT AS n,
  false AS ready, (SELECT count(*) FILTER (NOT passed) FROM ({campaign_rows('true')})) AS n_reasons FROM {METRIC_ROWS} CROSS JOIN (SELECT unnest({SCHEMAS}) AS schema)
UNION ALL {AUDIT_ROWS}""",
    "forest_scores": "SELECT seed, n AS n_rows, n AS n_events, true AS in_range, true AS repeatable FROM (SELECT count(*) AS n FROM events) CROSS JOIN (SELECT unnest([42, 43]) AS seed)",
    "transfer_experiment": f"""WITH {TRANSFER_CTES}, one AS ({TRANSFER_ROWS})
SELECT s.schema, one.* EXCLUDE (schema) FROM one CROSS JOIN (SELECT unnest({SCHEMAS}) AS schema) s UNION ALL {AUDIT_ROWS}""",
    "file_inventory": """WITH b AS (SELECT *, (sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT // 131072 AS bucket FROM documents)
SELECT 'source=' || source || '/bucket=' || bucket AS folder, sum(strlen(text) + 1)::BIGINT AS bytes, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256
FROM b GROUP BY source, bucket""",
    "transfer_schema": TRANSFER,
    "lodo_eval": f"""{gated_base()}
SELECT schema, m.seed, m.n_reasons = 0 AS ready, CASE WHEN m.n_reasons = 0 THEN 'headline' ELSE 'contract' END AS mode, m.n_reasons::BIGINT AS n_reasons,
  {{shown}} FROM modes m JOIN rates USING (seed) JOIN load USING (seed) {GATED_JOIN} CROSS JOIN (SELECT unnest({SCHEMAS}) AS schema)""",  # metrics are filled in below
    "lodo_multiseed": f"""{gated_base()},
v AS (SELECT rates.seed, round(fpr_normal, 4) AS fpr_normal, round(fpr_fault, 4) AS fpr_fault, round(recall_event_manipulation, 4) AS recall_event_manipulation,
  round(recall_event_recon, 4) AS recall_event_recon, round(a.mean, 3) AS recall_episode_manipulation, round(b.mean, 3) AS recall_episode_recon
  FROM rates JOIN rci a ON a.seed = rates.seed AND a.family = 'manipulation' JOIN rci b ON b.seed = rates.seed AND b.family = 'recon')
SELECT schema, metric, CASE WHEN metric LIKE 'recall_episode%' THEN round(avg(value), 3) ELSE round(avg(value), 4) END AS mean, min(value) AS min, max(value) AS max
FROM (UNPIVOT v ON fpr_normal, fpr_fault, recall_event_manipulation, recall_event_recon, recall_episode_manipulation, recall_episode_recon INTO NAME metric VALUE value)
CROSS JOIN (SELECT unnest({SCHEMAS}) AS schema) GROUP BY schema, metric""",
    "manifest_build": f"WITH {DOC_FILES} SELECT count(*) AS file_count, sum(bytes)::BIGINT AS total_bytes, true AS release_eligible FROM df",
    "manifest_reconcile": f"WITH {CHANGED} SELECT path, status, declared_bytes, actual_bytes FROM rec",
    "artifact_verify": f"""WITH {CHANGED}, {CONTENT_RULES}
SELECT path, status AS finding FROM rec WHERE status <> 'ok'
UNION ALL SELECT path, 'forbidden prefix' FROM act WHERE starts_with(path, 'web/1')
UNION ALL SELECT path, 'forbidden exact path' FROM act WHERE path IN ('web/20.txt', 'books/21.txt')
UNION ALL SELECT path, 'forbidden extension' FROM act WHERE lower(path) LIKE '%.key'
UNION ALL SELECT source || '/' || doc_id || '.txt', 'forbidden ' || rule FROM documents JOIN r ON regexp_matches(text, pattern)
UNION ALL SELECT '', unnest(['file_count mismatch', 'total_bytes mismatch'])""",
    "path_rules": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, 'prefix' AS rule FROM p WHERE starts_with(path, 'fr/') OR starts_with(path, 'es/1')
UNION ALL SELECT page_id, path, 'exact path' FROM p WHERE path IN ('en/519', 'de/49', 'de/612')
UNION ALL SELECT page_id, path, 'extension' FROM p WHERE lower(path) LIKE '%.html'""",
    "sensitive_scan": f"WITH {CONTENT_RULES} SELECT doc_id, rule FROM documents JOIN r ON regexp_matches(text, pattern)",
    "result_diff": f"{DIFFERENCES} SELECT * EXCLUDE (place) FROM found",
    "first_difference": f"{DIFFERENCES} SELECT * EXCLUDE (place) FROM found QUALIFY place = min(place) OVER (PARTITION BY event_id)",
    "phase_labels": f"{LABELLED} SELECT event_id, phase_name, phase_label FROM lb",
    "phase_row_counts": f"{LABELLED} SELECT run_id, phase_name, phase_label, count(*) AS n_rows FROM lb GROUP BY ALL",
    "run_label": f"{LABELLED} SELECT run_id, coalesce(max(phase_label) FILTER (phase_label <> 'normal'), 'normal') AS run_label, count(DISTINCT phase_label) > 1 AS label_is_phase_level FROM lb GROUP BY run_id",
    "phase_backdate": f"""WITH {TGT}, late AS (SELECT run_id, name, t_us + CASE WHEN name = 'act' THEN 172800000000 ELSE 0 END AS marker_us FROM timeline),
m AS (SELECT *, lag(marker_us) OVER (PARTITION BY run_id ORDER BY marker_us) AS prev, CASE name WHEN 'act' THEN 0.21::DOUBLE ELSE 0.73::DOUBLE END AS setpoint FROM late),
w AS (SELECT m.run_id, m.name, m.marker_us, min(t.t_us) AS write_us FROM m LEFT JOIN tgt t ON t.run_id = m.run_id AND t.modbus_function IN (5, 6, 15, 16)
  AND t.throttle_command_left = m.setpoint AND t.t_us <= m.marker_us AND (m.prev IS NULL OR t.t_us > m.prev) GROUP BY ALL)
SELECT run_id, name, marker_us, coalesce(write_us, marker_us) AS start_us, CASE WHEN write_us IS NULL THEN 'marker' ELSE 'setpoint' END AS anchor,
  coalesce(write_us < marker_us, false) AS backdated FROM w""",
    "flow_boundary_span": f"""WITH {TGT}, f AS (SELECT t.event_id, t.run_id, max((p.t_us > t.flow_start_us AND p.t_us <= t.t_us)::INTEGER) AS spans
  FROM tgt t JOIN timeline p USING (run_id) WHERE t.event_type = 'flow' GROUP BY ALL)
SELECT run_id, count(*) AS flow_rows, sum(spans)::BIGINT AS flow_rows_spanning_boundary FROM f GROUP BY run_id""",
}

SHOWN = (
    ["round(threshold, 6) AS threshold"]
    + [f"round({c}, 6) AS {c}" for c in ("fpr_normal", "fpr_fault", "recall_event_manipulation", "recall_event_recon")]
    + [f"{c} AS {c}" for c in ("n_normal", "n_fault", "n_manipulation_attack_rows", "n_recon_attack_rows")]
    + ["round(a_mean, 6) AS alarms_per_run_mean", "a_max AS alarms_per_run_max", "n_runs AS n_runs",
       "round(per_hour, 6) AS alarms_per_hour", "round(hours, 6) AS observed_hours"]
    + gated_columns("manipulation") + gated_columns("recon")
)
# A refused seed keeps its row and loses its numbers.
SQL["lodo_eval"] = SQL["lodo_eval"].replace(
    "{shown}", ", ".join("CASE WHEN m.n_reasons = 0 THEN {} END AS {}".format(*c.rsplit(" AS ", 1)) for c in SHOWN)
)
