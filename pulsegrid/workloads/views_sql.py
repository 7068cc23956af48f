"""The adapter views as SQL text for the comparison engine.

Each view is a common table expression; :func:`sql` puts the ones a query needs in front of it."""

from __future__ import annotations

import re

from pulsegrid import fixed
from pulsegrid.functions.text import status_column
from pulsegrid.workloads.adapter import NUMERIC, STATUS_OF, VARIABLE_OF

BIN_US = 6 * 3600 * 1_000_000


def _case(column: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _flags(source: str, word: str) -> str:
    return ", ".join(
        f"coalesce({source} = {s} AND (({word} >> {b}) & 1) = 1, false) AS {status_column(n)}"
        for s, b, n in fixed.STATUS_BITS
    )


STATUS = list(fixed.STATUS_FEATURES)
IDS = list(VARIABLE_OF.values())
_START = f"make_timestamp(bin * {BIN_US})"

CTES: dict[str, str] = {
    "ev": "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events",
    "telemetry": f"""
SELECT event_id, ts AS timestamp, lpad(CAST(user_id AS VARCHAR), 15, '0') AS device_serial,
  {_case('event_type', VARIABLE_OF)} AS variable_id,
  CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
       ELSE value END AS value,
  {_flags(f"({_case('event_type', STATUS_OF)})", 'k')}
FROM ev""",
    "registry": """
SELECT lpad(right(regexp_replace(s_name, '[^0-9]', '', 'g'), 7), 15, '0') AS device_serial,
  CAST(s_suppkey AS INTEGER) AS cmms_reg, s_name AS cmms_serial FROM supplier""",
    "failures": """
SELECT event_id, lpad(CAST(user_id AS VARCHAR), 15, '0') AS device_serial,
  CAST(user_id AS INTEGER) AS cmms_reg, CAST(ts AS DATE) AS event_date,
  'error ' || props AS description
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
      FROM events WHERE event_type = 'error') WHERE r = 1""",
    "services": """
SELECT event_id, lpad(CAST(user_id AS VARCHAR), 15, '0') AS device_serial,
  CAST(user_id AS INTEGER) AS cmms_reg, CAST(ts AS DATE) AS event_date
FROM events WHERE event_type = 'signup'""",
    "scores": f"""
SELECT device_serial, make_timestamp(bin * {BIN_US}) AS window_start,
  make_timestamp((bin + 1) * {BIN_US}) AS window_end,
  make_timestamp((bin + 1) * {BIN_US}) AS timestamp, anomaly_score
FROM (SELECT device_serial, epoch_us(timestamp) // {BIN_US} AS bin,
        round(avg(value) + 1e-10, 6) + 0.0 AS anomaly_score
      FROM telemetry WHERE variable_id <> 1889 GROUP BY 1, 2)""",
    "ranked": """
SELECT s.*, (rank() OVER (PARTITION BY timestamp ORDER BY anomaly_score)
   + (count(*) OVER (PARTITION BY timestamp, anomaly_score) - 1) / 2.0)
   / count(*) OVER (PARTITION BY timestamp) AS fleet_percentile
FROM scores s""",
    "alert_history": """
SELECT o_orderkey AS id, lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS device_serial,
  o_orderdate AS timestamp,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning'
    ELSE 'normal' END AS alert_level,
  o_totalprice / 100000 AS anomaly_score, least(o_totalprice / 500000, 1.0) AS fleet_percentile,
  o_orderstatus = 'F' AS notified,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 6 HOUR END AS notified_at
FROM orders""",
    "labels_table": """
SELECT o_orderkey AS id, lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS device_serial,
  CAST(o_orderdate AS DATE) AS date,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed_fault' WHEN 'P' THEN 'scheduled_pv'
    ELSE 'unrelated' END AS event_type,
  'WO' || o_orderkey AS work_order_id,
  CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderkey END AS matched_alert_id,
  o_orderpriority AS notes, o_orderdate AS created_at, 'manual' AS source
FROM orders""",
    "raw_work_orders": """
SELECT l_orderkey || '-' || l_linenumber AS work_order_id,
  CASE l_returnflag WHEN 'R' THEN 'corrective' WHEN 'A' THEN 'preventive'
    ELSE 'kalibrering' END AS work_order_type,
  CAST(l_shipdate AS DATE) AS registered_date,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS completed_date,
  'quantity ' || CAST(l_quantity AS INTEGER) AS fault_description,
  CASE WHEN l_discount > 0.05 THEN 'discounted' ELSE '' END AS technical_description,
  CAST(l_suppkey AS INTEGER) AS device_reg, 'SN' || l_partkey AS serial_number
FROM lineitem WHERE l_tax > 0""",
    "work_orders": """
SELECT 'WO' || l_orderkey AS work_order_id,
  CASE l_returnflag WHEN 'R' THEN 'corrective' WHEN 'A' THEN 'preventive'
    ELSE 'kalibrering' END AS work_order_type,
  CAST(l_shipdate AS DATE) AS registered_date,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS completed_date,
  'quantity ' || CAST(l_quantity AS INTEGER) AS fault_description,
  '' AS technical_description, CAST(l_suppkey AS INTEGER) AS device_reg,
  'SN' || l_suppkey AS serial_number, 'export.csv' AS import_filename,
  l_shipdate AS imported_at, l_linestatus = 'F' AS matched
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate,
        l_suppkey, l_returnflag, l_linestatus, l_quantity) AS r FROM lineitem) WHERE r = 1""",
    "health": """
SELECT event_id AS id, ts AS timestamp,
  CASE event_type WHEN 'click' THEN 'daily_inference' WHEN 'view' THEN 'health_check'
    ELSE 'label_matcher' END AS job_name,
  CASE WHEN value > 60 THEN 'failure' ELSE 'success' END AS status,
  CAST(round(value * 1000) AS BIGINT) AS duration_ms, CAST(k AS BIGINT) AS rows_processed,
  CASE WHEN value > 60 THEN props END AS error_message
FROM ev""",
    "models": """
SELECT p_partkey AS version_id, TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey AS INTEGER)) AS trained_at,
  p_size AS label_count, p_size // 3 AS confirmed_count, p_name AS model_path,
  p_type AS performance_snapshot, p_partkey = (SELECT max(p_partkey) FROM part) AS active
FROM part""",
    "attribution_cache": """
SELECT event_id AS id, lpad(CAST(user_id AS VARCHAR), 15, '0') AS device_serial,
  ts AS computed_at, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS window_end, props AS result_json
FROM events""",
    "msg": f"""
SELECT *, strftime(ts, '%Y%m%d%H%M%S') AS stamp,
  CASE WHEN k = 13 THEN strftime(ts, '%Y%m%d') WHEN k = 14 THEN '20241399' || strftime(ts, '%H%M%S')
    ELSE strftime(ts, '%Y%m%d%H%M%S') END AS seen,
  CASE event_type WHEN 'click' THEN '19' WHEN 'view' THEN '42' ELSE '' END AS unit,
  CASE WHEN k < 30 THEN 'p' WHEN k < 60 THEN 'vv' ELSE '??' END AS mode,
  CASE WHEN k = 15 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS word,
  CAST({_case('event_type', VARIABLE_OF)} AS VARCHAR) AS number,
  CAST({_case('event_type', STATUS_OF, '801')} AS VARCHAR) AS status_id
FROM ev""",
    "messages": r"""
SELECT 'gw-' || event_type AS src, event_id AS pos, ts AS timestamp,
  concat_ws(chr(13),
    'MSH|^~\&|DEV|SITE|RCV|SVC|' || stamp || '||ORU^R01|' || event_id || '|P|2.3',
    'PID|1||X',
    'OBR|1|R|F|999^' || CASE WHEN value >= 10 THEN 'Elisa 800' ELSE 'Elisa 500' END || '^L',
    'OBX|1|NM|' || number || '^x^L|1|' || CAST(value AS VARCHAR) || '|' || unit || '|||||F|||' || seen,
    'OBX|2|NM|' || status_id || '^x^L|1|' || word || '||||||F|||' || seen,
    'OBX|3|CWE|584^x^L|1|' || mode || '||||||F|||' || seen,
    'OBX|4|NM|2046^x^L|1|' || CASE WHEN k < 50 THEN '0' ELSE '1' END || '||||||F|||' || seen,
    CASE WHEN k < 60 THEN 'OBX|5|CWE|1913^x^L|1|' || lpad(CAST(user_id AS VARCHAR), 15, '0')
      || '||||||F|||' || seen END) AS message
FROM msg""",
    "parsed": r"""
SELECT src, pos, message, segs, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY src
    ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS device_serial
FROM (SELECT *, string_split(message, chr(13)) AS segs,
        string_split(list_filter(string_split(message, chr(13)),
          lambda s: s LIKE 'OBX|%|1913^%')[-1], '|')[6] AS own FROM messages)""",
    "obx": r"""
SELECT src, pos, device_serial, CAST(obx - 1 AS INTEGER) AS obx, split_part(f[4], '^', 1) AS variable_id,
  f[6] AS value, nullif(f[7], '') AS unit, coalesce(f[15], '') AS timestamp
FROM (SELECT src, pos, device_serial, generate_subscripts(o, 1) AS obx, string_split(unnest(o), '|') AS f
      FROM (SELECT *, list_filter(segs, lambda s: s LIKE 'OBX%') AS o FROM parsed
            WHERE len(list_filter(segs, lambda s: s LIKE 'OBR%^Elisa 800%')) > 0))""",
    "catalog": "SELECT * FROM (VALUES "
    + ", ".join(f"('{i}', '{l}', '{u}')" for i, l, u in fixed.LABELS)
    + ") t(variable_id, label, cat_unit)",
    "codes": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{v}', '{c}', '{t}')" for v, m in fixed.CODED_VALUES.items() for c, t in m.items()
    )
    + ") t(variable_id, value, text)",
    "units": "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{u}')" for c, u in fixed.UNIT_CODES.items())
    + ") t(unit, unit_short)",
    "enriched": """
SELECT src, pos, obx, device_serial, x.variable_id, x.value, x.timestamp, x.label, x.unit,
  coalesce(u.unit_short, '') AS unit_short,
  CASE WHEN x.variable_id IN (SELECT variable_id FROM codes) THEN coalesce(c.text, x.value)
    WHEN regexp_matches(lower(x.label), 'alarm|failure|error') THEN
      CASE x.value WHEN '0' THEN 'Alarm OFF' WHEN '1' THEN 'Alarm ON' ELSE x.value END
    ELSE x.value END AS value_description
FROM (SELECT o.* EXCLUDE (unit), coalesce(g.label, o.variable_id) AS label,
        coalesce(o.unit, g.cat_unit, '') AS unit
      FROM obx o LEFT JOIN catalog g USING (variable_id)) x
  LEFT JOIN codes c ON c.variable_id = x.variable_id AND c.value = x.value
  LEFT JOIN units u ON u.unit = x.unit""",
    "binned": f"""
SELECT device_serial, variable_id, epoch_us(timestamp) // {BIN_US} AS bin, avg(value) AS value
FROM telemetry GROUP BY 1, 2, 3""",
    "grid": """
SELECT device_serial, variable_id, unnest(generate_series(lo, hi)) AS bin
FROM (SELECT device_serial, variable_id, min(bin) AS lo, max(bin) AS hi FROM binned GROUP BY 1, 2)""",
    "dense": """
SELECT g.device_serial, g.variable_id, g.bin, b.value
FROM grid g LEFT JOIN binned b USING (device_serial, variable_id, bin)""",
    "filled": """
SELECT device_serial, variable_id, bin, last_value(value IGNORE NULLS) OVER (
  PARTITION BY device_serial, variable_id ORDER BY bin ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS value
FROM dense""",
    "wide": "SELECT device_serial, bin, "
    + ", ".join(f"max(CASE WHEN variable_id = {i} THEN value END) AS var_{i}" for i in IDS)
    + " FROM filled GROUP BY 1, 2",
    "bits": f"SELECT device_serial, epoch_us(timestamp) // {BIN_US} AS bin, "
    + ", ".join(f"max(CAST({c} AS INTEGER)) AS {c}" for c in STATUS)
    + " FROM telemetry GROUP BY 1, 2",
    "bits_filled": "SELECT device_serial, bin, "
    + ", ".join(
        f"CAST(last_value({c} IGNORE NULLS) OVER (PARTITION BY device_serial ORDER BY bin "
        f"ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS {c}"
        for c in STATUS
    )
    + """ FROM (SELECT device_serial, unnest(generate_series(min(bin), max(bin))) AS bin
                FROM bits GROUP BY 1) LEFT JOIN bits USING (device_serial, bin)""",
    "wide_bits": "SELECT w.*, "
    + ", ".join(f"b.{c}" for c in STATUS)
    + " FROM wide w LEFT JOIN bits_filled b USING (device_serial, bin)",
    "derived": """
SELECT *, var_635 - var_2782 AS fio2_deviation,
  var_2098 / nullif(var_2097, 0) AS o2_air_pressure_ratio FROM wide_bits""",
    "active": "SELECT * FROM derived WHERE var_1889 IS DISTINCT FROM 1",
    "gaps": """
SELECT device_serial, (bin - lag(bin) OVER (PARTITION BY device_serial ORDER BY bin)) * 21600.0 AS gap
FROM active""",
    "cadence": """
SELECT device_serial, quantile_cont(gap, 0.5) AS cadence_s FROM gaps WHERE gap IS NOT NULL GROUP BY 1""",
    "sizes": """
SELECT device_serial,
  CAST(greatest(1, round_even(129600 / greatest(cadence_s, 21600), 0)) AS BIGINT) AS win,
  CAST(greatest(1, round_even(21600 / greatest(cadence_s, 21600), 0)) AS BIGINT) AS stride
FROM cadence""",
    "numbered": """
SELECT a.*, s.win, s.stride, row_number() OVER (PARTITION BY device_serial ORDER BY bin) - 1 AS rn,
  count(*) OVER (PARTITION BY device_serial) AS n
FROM active a JOIN sizes s USING (device_serial)""",
    "starts": """
SELECT device_serial, win, stride, unnest(generate_series(0, (n - win) // stride)) AS window_idx
FROM (SELECT DISTINCT device_serial, win, stride, n FROM numbered) WHERE win >= 2 AND n >= win""",
    "members": f"""
SELECT w.window_idx, r.rn - w.window_idx * w.stride AS pos, r.*, make_timestamp(r.bin * {BIN_US}) AS timestamp
FROM starts w JOIN numbered r ON r.device_serial = w.device_serial
  AND r.rn BETWEEN w.window_idx * w.stride AND w.window_idx * w.stride + w.win - 1""",
    "linked": """
SELECT work_order_id, device_serial, registered_date AS date,
  CASE WHEN hit.id IS NULL THEN 'unrelated' WHEN work_order_type = 'corrective' THEN 'confirmed_fault'
    WHEN work_order_type = 'preventive' THEN 'scheduled_pv' ELSE 'unrelated' END AS event_type,
  hit.id AS matched_alert_id, hit.id IS NOT NULL AS matched_alert
FROM (SELECT w.work_order_id, g.device_serial, w.registered_date, w.work_order_type,
        max({'t': a.timestamp, 'id': a.id}) FILTER (a.id IS NOT NULL) AS hit
      FROM work_orders w JOIN registry g ON g.cmms_reg = w.device_reg
        LEFT JOIN alert_history a ON a.device_serial = g.device_serial
          AND a.alert_level IN ('warning', 'critical')
          AND a.timestamp >= w.registered_date - INTERVAL 7 DAY
          AND a.timestamp < w.registered_date + INTERVAL 8 DAY
      WHERE NOT w.matched GROUP BY ALL)""",
    "near": """
SELECT f.event_id, f.cmms_reg, f.event_date, f.description, s.*,
  (epoch_us(s.timestamp) - epoch_us(CAST(f.event_date AS TIMESTAMP))) / 86400e6 AS days_to_event
FROM failures f JOIN ranked s ON s.device_serial = f.device_serial
  AND s.timestamp >= f.event_date - INTERVAL 14 DAY AND s.timestamp <= f.event_date + INTERVAL 2 DAY""",
    "pre_runs": """
SELECT event_id, event_date, island, min(timestamp) AS t0, count(*) AS n FROM (
  SELECT *, rn - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY timestamp) AS island
  FROM (SELECT *, fleet_percentile >= 0.7 AS hit,
          row_number() OVER (PARTITION BY event_id ORDER BY timestamp) AS rn
        FROM near WHERE timestamp < event_date)) WHERE hit GROUP BY 1, 2, 3""",
    "lead": """
SELECT event_id, (epoch_us(CAST(event_date AS TIMESTAMP)) - epoch_us(min(t0))) / 86400e6 AS lead_time_days
FROM pre_runs WHERE n >= 3 GROUP BY event_id, event_date""",
    "evaluated": """
SELECT 'mean-reading' AS model, f.event_id, f.cmms_reg, f.event_date, f.description,
  l.lead_time_days IS NOT NULL AS detected, l.lead_time_days, m.max_percentile_pre,
  coalesce(m.n, 0) AS n_score_points
FROM failures f LEFT JOIN (SELECT event_id, max(CASE WHEN timestamp < event_date THEN fleet_percentile END)
    AS max_percentile_pre, count(*) AS n FROM near GROUP BY 1) m USING (event_id)
  LEFT JOIN lead l USING (event_id)""",
    "run_rows": """
SELECT *, CASE WHEN hit THEN rn - sum(CASE WHEN hit THEN 1 ELSE 0 END)
    OVER (PARTITION BY device_serial ORDER BY window_end) END AS island
FROM (SELECT *, fleet_percentile >= 0.7 AS hit,
        row_number() OVER (PARTITION BY device_serial ORDER BY window_end) - 1 AS rn FROM ranked)""",
    "run_groups": """
SELECT device_serial, island AS run_id, min(window_start) AS run_start, max(window_end) AS run_end,
  count(*) AS n_windows, max(anomaly_score) AS max_score, max(fleet_percentile) AS max_percentile
FROM run_rows WHERE hit GROUP BY 1, 2""",
    "alert_rows": """
SELECT device_serial, cmms_reg, alert_level, round(anomaly_score, 4) AS anomaly_score,
  round(fleet_percentile, 4) AS fleet_percentile, top_contributing_features,
  CASE alert_level WHEN 'critical' THEN '"""
    + fixed.ADVICE["critical"]
    + """' WHEN 'warning' THEN '"""
    + fixed.ADVICE["warning"]
    + """' ELSE 'No action required' END AS recommended_action,
  alert_start, alert_end, n_anomalous_windows
FROM (SELECT device_serial, CASE WHEN max_percentile >= 0.95 THEN 'critical' ELSE 'warning' END AS alert_level,
        max_score AS anomaly_score, max_percentile AS fleet_percentile,
        'fio2_measured (var_635), fio2_setting (var_2782), o2_supply_pressure (var_2098)'
          AS top_contributing_features,
        run_start AS alert_start, run_end AS alert_end, CAST(n_windows AS INTEGER) AS n_anomalous_windows
      FROM run_groups WHERE n_windows >= 3
      UNION ALL
      SELECT device_serial, 'normal', max(anomaly_score), max(fleet_percentile), '', NULL, NULL, 0
      FROM ranked WHERE device_serial NOT IN (SELECT device_serial FROM run_groups WHERE n_windows >= 3)
      GROUP BY 1) LEFT JOIN registry USING (device_serial)""",
    "summary": """
SELECT p.device_serial, coalesce(a.alert_level, 'normal') AS alert_level, p.anomaly_score, p.fleet_percentile
FROM (SELECT device_serial, max(anomaly_score) AS anomaly_score, max(fleet_percentile) AS fleet_percentile
      FROM ranked GROUP BY 1) p
  LEFT JOIN (SELECT device_serial, arg_min(alert_level, coalesce(alert_start, TIMESTAMP '1970-01-01'))
    AS alert_level FROM alert_rows GROUP BY 1) a USING (device_serial)""",
    "attribution": f"""
SELECT n.event_id, n.cmms_reg, n.window_start, b.feature_name,
  {_case('b.feature_name', {f'var_{v[0]}': f"'{v[1]}'" for v in fixed.VARIABLES}, 'b.feature_name')} AS human_name,
  b.attribution_value, n.anomaly_score,
  (epoch_us(CAST(n.event_date AS TIMESTAMP)) - epoch_us(n.window_start)) / 86400e6 AS days_to_failure
FROM near n JOIN (SELECT device_serial, make_timestamp(bin * {BIN_US}) AS window_start,
    'var_' || variable_id AS feature_name, abs(value - 50) AS attribution_value FROM binned) b
  USING (device_serial, window_start)
WHERE n.event_id IN (SELECT event_id FROM near GROUP BY 1 HAVING count(*) >= 2)""",
    "attr_mean": """
SELECT event_id, feature_name, avg(attribution_value) AS mean_attribution FROM attribution GROUP BY 1, 2""",
    "attr_ranked": """
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY mean_attribution DESC, feature_name) AS rank
FROM attr_mean""",
    "timeline": """
SELECT event_id, window_start, min(anomaly_score) AS anomaly_score FROM attribution GROUP BY 1, 2""",
}

def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with every view it reads, directly or not, each after the ones it reads itself."""
    views = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        unquoted = re.sub(r"'(?:[^']|'')*'", "", text)
        read = re.findall(r"(?:FROM|JOIN|,)\s+([A-Za-z_0-9]+)", unquoted)
        for name in read:
            if name in views and name not in ordered:
                visit(views[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{n} AS ({views[n].strip()})" for n in ordered)
    return f"WITH {head}\n{body.strip()}"


def r6(*columns: str) -> str:
    """Rounded doubles, spelled like the adapter's ``tidy``."""
    return ", ".join(f"round({c} + 1e-10, 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def stats_sql(features: list[str]) -> dict[str, str]:
    """Window summaries, imputation, scaling and the linear score over ``features``."""
    stat = []
    for f in features:
        stat += [
            f"avg({f}) AS {f}__mean", f"stddev_pop({f}) AS {f}__std", f"min({f}) AS {f}__min",
            f"max({f}) AS {f}__max",
            f"coalesce(max(CASE WHEN pos = win - 1 THEN {f} END) - max(CASE WHEN pos = 0 THEN {f} END), 0.0)"
            f" AS {f}__delta",
        ]
    columns = [f"{f}__{s}" for s in fixed.STATISTICS for f in features]
    med = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in columns)
    fill = ", ".join(f"coalesce(s.{c}, m.{c}) AS {c}" for c in columns)
    mean = ", ".join(f"avg({c}) AS m_{i}, stddev_pop({c}) AS s_{i}" for i, c in enumerate(columns))
    scale = ", ".join(
        f"(i.{c} - p.m_{n}) / CASE WHEN p.s_{n} = 0 THEN 1 ELSE p.s_{n} END AS {c}"
        for n, c in enumerate(columns)
    )
    key = "device_serial, window_idx, window_start, window_end, n_samples"
    ikey = "i.device_serial, i.window_idx, i.window_start, i.window_end, i.n_samples"
    return {
        "stats": f"SELECT device_serial, window_idx, min(timestamp) AS window_start, "
        f"max(timestamp) AS window_end, CAST(count(*) AS INTEGER) AS n_samples, {', '.join(stat)} "
        "FROM members GROUP BY 1, 2",
        "med": f"SELECT {med} FROM stats",
        "imputed": f"SELECT {key.replace('device', 's.device').replace(', w', ', s.w').replace(', n', ', s.n')}, {fill} FROM stats s, med m",
        "params": f"SELECT {mean} FROM imputed",
        "scaled": f"SELECT {ikey}, {scale} FROM imputed i, params p",
    }


__all__ = ["NUMERIC", "sql", "r6", "stats_sql", "STATUS", "IDS", "BIN_US", "CTES"]
