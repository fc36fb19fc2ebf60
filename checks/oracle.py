"""DuckDB SQL for every query, composed from the same role definitions."""

from __future__ import annotations

from checks.roles import BATCH, EXPERIMENTS, PROBE_EVENTS, STATE_EVENTS


def rnd(expr: str, digits: int) -> str:
    """Half away from zero, on the decimal digits that a double is written with. Never -0.0."""
    return f"(CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE) + 0::DOUBLE)"


def mean(expr: str) -> str:
    """Mean of times over an exact sum."""
    return f"(CAST(sum(CAST({expr} AS DECIMAL(28, 9))) AS DOUBLE) / nullif(count({expr}), 0))"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _mode_label(code: str) -> str:
    return (f"CASE {code} WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'DISCONNECTED' WHEN 2 THEN 'NO SERVICE' "
            f"WHEN 3 THEN '2G' WHEN 4 THEN '3G' WHEN 5 THEN 'LTE' ELSE '?' END")


QUALITY = ("CASE WHEN (dev_mode = 5 AND lte_rsrq >= -7 AND lte_rsrp >= -102) "
           "OR (dev_mode IN (3, 4) AND rssi >= -69) THEN 'GOOD' "
           "WHEN (dev_mode = 5 AND lte_rsrq >= -11 AND lte_rsrp >= -111) "
           "OR (dev_mode IN (3, 4) AND rssi >= -94) THEN 'FAIR' ELSE 'POOR' END")

_CLASSIFIED = f"*, {_mode_label('dev_mode')} AS device_mode, {QUALITY} AS signal_quality"

COUNTS = (("op0", "if_name = 'op0'"), ("op1", "if_name = 'op1'"), ("lte", "device_mode = 'LTE'"),
          ("3g", "device_mode = '3G'"), ("2g", "device_mode = '2G'"),
          ("good", "signal_quality = 'GOOD'"), ("fair", "signal_quality = 'FAIR'"),
          ("poor", "signal_quality = 'POOR'"))
ARMS = (("", "run_tool NOT LIKE 't-%'"), ("_t", "run_tool LIKE 't-%'"))


def _summary(view: str, kind: str) -> str:
    cols = ["sched_id", "min(exp_id) AS exp_id", "min(node_id) AS node_id", "count(*) AS cnt_all"]
    for s, arm in ARMS:
        if kind == "ping":
            echo = f"{arm} AND ping_type = 'ECHO'"
            cols += [f"sum(CASE WHEN {echo} THEN 1 END) AS cnt_rtt{s}",
                     f"{mean(f'CASE WHEN {echo} THEN rtt END')} AS rtt{s}"]
        else:
            cols += [f"sum(CASE WHEN {arm} THEN 1 END) AS cnt_dwnl{s}",
                     f"sum(CASE WHEN {arm} THEN dwnl_size END) AS dwnl_size{s}",
                     f"sum(CASE WHEN {arm} THEN total_time - init_time END) AS dwnl_time{s}"]
        first = f"{arm} AND iter_nr = 1"
        cols.append(f"sum(CASE WHEN {first} THEN 1 END) AS cnt{s}")
        cols += [f"sum(CASE WHEN {first} AND {test} THEN 1 ELSE 0 END) AS cnt_{name}{s}"
                 for name, test in COUNTS]
        start = "rtt" if kind == "ping" else "init_time"
        cols.append(f"{mean(f'CASE WHEN {first} THEN {start} END')} AS init_time{s}")
    return f"SELECT {', '.join(cols)} FROM {view} GROUP BY sched_id"


PING_SUMMARY = ("SELECT *, cnt_rtt_t::DOUBLE / nullif(cnt_rtt, 0) - 1 AS cnt_gain, "
                "rtt_t / nullif(rtt, 0) - 1 AS rtt_gain FROM ({})")
DOWNLOAD_SUMMARY = (
    "SELECT *, cnt_dwnl_t::DOUBLE / nullif(cnt_dwnl, 0) - 1 AS cnt_gain, "
    "dwnl_size_t::DOUBLE / nullif(dwnl_size, 0) - 1 AS size_gain, "
    "dwnl_speed_t / nullif(dwnl_speed, 0) - 1 AS speed_gain FROM (SELECT *, "
    "dwnl_size::DOUBLE / nullif(dwnl_time, 0) AS dwnl_speed, "
    "dwnl_size_t::DOUBLE / nullif(dwnl_time_t, 0) AS dwnl_speed_t FROM ({}))")


def _merged(p: str, d: str) -> str:
    cols = [f"{p}.exp_id", f"{p}.sched_id", f"{p}.node_id"]
    for s, _ in ARMS:
        cols += [f"{p}.{c}{s} + {d}.{c}{s} AS {c}{s}" for c in ["cnt", *[f"cnt_{n}" for n, _ in COUNTS]]]
        cols.append(f"({p}.cnt{s} * {p}.init_time{s} + {d}.cnt{s} * {d}.init_time{s}) "
                    f"/ nullif({p}.cnt{s} + {d}.cnt{s}, 0) AS init_time{s}")
    return f"SELECT {', '.join(cols)} FROM {p} LEFT JOIN {d} ON {p}.sched_id = {d}.sched_id"


TOOL_COUNTS = [f"{c}{s}" for s, _ in ARMS for c in ["cnt", *[f"cnt_{n}" for n, _ in COUNTS]]]

_EXPERIMENT_ROWS = ", ".join(
    f"({i}, '{name}', TIMESTAMP '{dtm}:00', '{batch}', '{name} ({dtm}:00)')"
    for i, name, dtm, batch in EXPERIMENTS)

CTES = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "exps": f"SELECT * FROM (VALUES {_EXPERIMENT_ROWS}) AS t(exp_id, exp_name, exp_dtm, batch, label)",
    "probes": f"""SELECT event_id, user_id % 15 AS exp_id, user_id AS sched_id, user_id % 7 AS node_id,
        CASE WHEN event_id % 2 = 0 THEN 't-tcp-ping' ELSE 'tcp-ping' END AS run_tool, ts AS run_dtm,
        1 + (event_id // 2) % 5 AS iter_nr, 'op' || (k % 3) AS if_name, 24000 + k % 4 AS oper,
        CASE WHEN (event_id // 2) % 5 = 0 THEN 'CONN' ELSE 'ECHO' END AS ping_type,
        value / 1000 AS rtt, k FROM ev WHERE event_type IN ({_quoted(PROBE_EVENTS)})""",
    "states": f"""SELECT event_id, user_id % 15 AS exp_id, user_id AS sched_id, user_id % 7 AS node_id,
        event_id AS seq_no, ts, 'op' || (k % 3) AS iif_name, k % 6 AS dev_mode, -(40 + k) AS rssi,
        -(k % 15) AS lte_rsrq, -(80 + k % 50) AS lte_rsrp, k
        FROM ev WHERE event_type IN ({_quoted(STATE_EVENTS)})""",
    "pings": """SELECT p.*, s.ts AS m_ts, s.dev_mode, s.rssi, s.lte_rsrq, s.lte_rsrp FROM probes p
        ASOF LEFT JOIN states s ON p.sched_id = s.sched_id AND p.if_name = s.iif_name
        AND p.run_dtm >= s.ts""",
    "vping": f"SELECT {_CLASSIFIED} FROM pings",
    "dping": """SELECT *, CASE WHEN sched_id % 3 = 0 THEN 5 ELSE k % 6 END AS dev_mode,
        NULL::INTEGER AS rssi, NULL::INTEGER AS lte_rsrq, NULL::INTEGER AS lte_rsrp FROM probes""",
    "vdping": f"SELECT {_CLASSIFIED} FROM dping",
    "dl": """SELECT l_suppkey % 15 AS exp_id, l_suppkey AS sched_id, l_suppkey % 7 AS node_id,
        CASE WHEN l_linestatus = 'O' THEN 't-dwnl-test' ELSE 'dwnl-test' END AS run_tool,
        l_linenumber AS iter_nr, 'op' || (l_partkey % 2) AS if_name, 24000 + l_partkey % 4 AS oper,
        CAST(l_quantity * 1000000 AS BIGINT) AS dwnl_size, l_discount AS init_time,
        l_discount + l_extendedprice / 10000 AS total_time, l_partkey % 6 AS dev_mode,
        -(40 + l_partkey % 100) AS rssi, -(l_partkey % 15) AS lte_rsrq,
        -(80 + l_partkey % 50) AS lte_rsrp, l_orderkey FROM lineitem""",
    "vdl": f"SELECT {_CLASSIFIED} FROM dl",
    "spans": f"""SELECT {_CLASSIFIED}, coalesce(epoch_us(lead(ts) OVER (PARTITION BY sched_id, iif_name
        ORDER BY ts, seq_no)) - epoch_us(ts), 0) / 1000000.0::DOUBLE AS span FROM states""",
    "ps": PING_SUMMARY.format(_summary("vping", "ping")),
    "ds": DOWNLOAD_SUMMARY.format(_summary("vdl", "download")),
    "tool": _merged("ps", "ds"),
    "dps": PING_SUMMARY.format(_summary("vdping", "ping")),
    "dtool": _merged("dps", "ds"),
    "samples": """SELECT event_id, user_id AS recording, ts, value AS cpu, 8589934592 AS total,
        (k + 1) * 1048576 AS avail,
        CASE event_type WHEN 'click' THEN 'tcp-ping' WHEN 'view' THEN 't-tcp-ping'
            WHEN 'purchase' THEN 'dwnl-test' WHEN 'error' THEN '(no-app)' END AS app_name,
        CASE WHEN event_type IN ('click', 'view', 'purchase') AND k % 10 <> 0 THEN value END AS app_cpu,
        CASE WHEN event_type IN ('click', 'view', 'purchase') THEN k * 1048576 END AS app_pss,
        CASE WHEN k % 2 = 0 THEN 'exporter' END AS exporter_name,
        CASE WHEN k % 2 = 0 THEN value / 2 END AS exporter_cpu,
        CASE WHEN k % 2 = 0 THEN k * 1024 END AS exporter_pss,
        CASE WHEN k % 3 = 0 THEN 'policyd' END AS policyd_name,
        CASE WHEN k % 3 = 0 THEN value / 4 END AS policyd_cpu,
        CASE WHEN k % 3 = 0 THEN k * 2048 END AS policyd_pss,
        CASE WHEN k % 5 = 0 THEN 'proxy' END AS proxy_name,
        CASE WHEN k % 5 = 0 THEN value / 8 END AS proxy_cpu,
        CASE WHEN k % 5 = 0 THEN k * 4096 END AS proxy_pss FROM ev""",
    "inner_samples": """SELECT * FROM (SELECT *,
        row_number() OVER (PARTITION BY recording ORDER BY ts, event_id) AS rn,
        count(*) OVER (PARTITION BY recording) AS n FROM samples) WHERE rn > 1 AND rn < n""",
    "processes": """SELECT DISTINCT user_id AS recording, date_trunc('hour', ts) AS seen_at,
        CASE event_type WHEN 'click' THEN 'tcp-ping' WHEN 'view' THEN 't-tcp-ping'
            WHEN 'purchase' THEN 'dwnl-test' WHEN 'error' THEN 't-dwnl-test' ELSE 'exporter' END AS process
        FROM ev""",
    "reads": """SELECT event_id, user_id AS flow_id, ts, CAST(round(value * 100) AS BIGINT) * 10 AS bytes,
        k % 5 AS protocol, event_id * 1000 + k AS bytes_total FROM ev""",
    "sizes": "SELECT DISTINCT p_size AS s FROM part",
    "rules": """SELECT DISTINCT 'rule-' || s AS uid, role, name, lo::DOUBLE AS lo, hi::DOUBLE AS hi, score::DOUBLE AS score FROM (
        SELECT s, 'match' AS role, 'device_mode' AS name, unnest([3, 4, s % 6]) AS lo, unnest([3, 4, s % 6]) AS hi, NULL AS score
          FROM sizes WHERE s % 3 = 0
        UNION ALL SELECT s, 'property', 'device_mode', unnest([3, 4]), unnest([3, 4]), unnest([0, s % 20]) FROM sizes WHERE s % 3 = 0
        UNION ALL SELECT s, 'match', 'device_mode', 4, 4, NULL FROM sizes WHERE s % 3 = 1
        UNION ALL SELECT s, 'match', 'rssi', -128, -s - 40, NULL FROM sizes WHERE s % 3 = 1
        UNION ALL SELECT s, 'property', 'rssi', -100, -s - 50, 15 FROM sizes WHERE s % 3 = 1
        UNION ALL SELECT s, 'property', 'lte_rsrq', -11, -(s % 12), 5 FROM sizes WHERE s % 3 = 1
        UNION ALL SELECT s, 'property', 'dlb_quality', 0, s % 4, 2 FROM sizes WHERE s % 3 = 2
        UNION ALL SELECT s, 'property', 'lte_rsrp', -128, -s - 80, 7 FROM sizes WHERE s % 3 = 2)""",
    "candidates": """SELECT event_id, sched_id, ts, iif_name AS if_name, dev_mode AS device_mode, rssi,
        lte_rsrp, lte_rsrq, k % 4 AS dlb_quality FROM states""",
}


def _prelude() -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in CTES.items())


def q(body: str, ints: str = "", doubles: str = "", texts: str = "") -> str:
    """Query text with uniform types: BIGINT, six-decimal DOUBLE, or as it is."""
    cols = [f"CAST({c} AS BIGINT) AS {_id(c)}" for c in map(_id, ints.split())]
    cols += [f"{rnd(f'CAST({c} AS DOUBLE)', 6)} AS {c}" for c in map(_id, doubles.split())]
    cols += [_id(c) for c in texts.split()]
    return f"SELECT {', '.join(cols)} FROM ({body}) AS result_rows"


def _id(name: str) -> str:
    return f'"{name}"' if not name.startswith('"') else name


def _batch(source: str, alias: str = "t") -> str:
    return f"{source} {alias} JOIN exps e ON {alias}.exp_id = e.exp_id WHERE e.batch = '{BATCH}'"


def _both(select: str, source: str, where: str = "", alias: str = "t") -> str:
    tail = f"FROM {_batch(source, alias)}{where}"
    return (f"SELECT e.label AS exp_name, {select} {tail} GROUP BY e.label, {alias}.exp_id "
            f"UNION ALL SELECT 'TOTAL', {select} {tail}")


def _wmean(w: str, x: str) -> str:
    return f"(sum({w} * {x}) / nullif(sum({w}), 0))"


def _rtt_gain(source: str = "ps", tool: str = "tool", segment: str = "") -> str:
    cols = []
    for s, _ in ARMS:
        cols += [f"sum(t.cnt_rtt{s}) AS cnt{s}",
                 f"{rnd(_wmean(f't.cnt_rtt{s}', f't.rtt{s}') + ' * 1000', 1)} AS rtt_ms{s}",
                 f"{rnd(_wmean(f't.cnt{s}', f't.init_time{s}') + ' * 1000', 1)} AS init_ms{s}"]
    gain = f"({_wmean('t.cnt_rtt_t', 't.rtt_t')} / nullif({_wmean('t.cnt_rtt', 't.rtt')}, 0) * 100 - 100)"
    cols += [f"{rnd(gain, 2)} AS rtt_gain_pct",
             f"{rnd('(100 * avg(CASE WHEN t.rtt_t < t.rtt THEN 1 ELSE 0 END))', 2)} AS win_cnt_pct"]
    where = f" AND t.sched_id IN (SELECT sched_id FROM {tool} WHERE {segment})" if segment else ""
    return q(_both(", ".join(cols), source, where), "cnt cnt_t",
             "rtt_ms init_ms rtt_ms_t init_ms_t rtt_gain_pct win_cnt_pct", "exp_name")


def _download_gain(tool: str = "tool", segment: str = "") -> str:
    def speed(s):
        return f"(sum(t.dwnl_size{s})::DOUBLE / nullif(sum(t.dwnl_time{s}), 0))"

    cols = []
    for s, _ in ARMS:
        cols += [f"sum(t.cnt_dwnl{s}) AS cnt{s}",
                 f"{rnd(f'(sum(t.dwnl_size{s})::DOUBLE / 1048576)', 0)} AS size_mb{s}",
                 f"{rnd(f'({speed(s)} / 1048576)', 2)} AS speed_mbs{s}",
                 f"{rnd(_wmean(f't.cnt{s}', f't.init_time{s}') + ' * 1000', 1)} AS init_ms{s}"]
    size_gain = "(sum(t.dwnl_size_t)::DOUBLE / nullif(sum(t.dwnl_size), 0) * 100 - 100)"
    cols += [f"{rnd(size_gain, 2)} AS size_gain_pct",
             f"{rnd(f'({speed('_t')} / nullif({speed('')}, 0) * 100 - 100)', 2)} AS speed_gain_pct",
             f"{rnd('(100 * avg(CASE WHEN t.dwnl_speed_t > t.dwnl_speed THEN 1 ELSE 0 END))', 2)} "
             "AS win_cnt_pct"]
    where = f" AND t.sched_id IN (SELECT sched_id FROM {tool} WHERE {segment})" if segment else ""
    return q(_both(", ".join(cols), "ds", where), "cnt cnt_t",
             "size_mb speed_mbs init_ms size_mb_t speed_mbs_t init_ms_t size_gain_pct speed_gain_pct "
             "win_cnt_pct", "exp_name")


SHARE = "(CASE WHEN cnt_op0 = cnt THEN cnt_op1_t ELSE cnt_op0_t END::DOUBLE / nullif(cnt_t, 0))"
NON_LTE = "(cnt_lte <> cnt OR cnt_lte_t <> cnt_t)"
BUCKETS = (("no_diff_pct", 0.0, 0.0001), ("to_20_pct", 0.0001, 0.2), ("to_40_pct", 0.2001, 0.4),
           ("to_60_pct", 0.4001, 0.6), ("to_80_pct", 0.6001, 0.8), ("above_80_pct", 0.8001, 1.0))


def _bucket_columns(share: str) -> str:
    return ", ".join(
        rnd(f"(100 * sum(CASE WHEN {rnd(share, 4)} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN 1 ELSE 0 "
            f"END)::DOUBLE / count(*))", 2) + f" AS {name}" for name, lo, hi in BUCKETS)


def _span_share(column: str, categories) -> str:
    return ", ".join(
        rnd(f"(100 * sum(CASE WHEN {column} = '{value}' THEN span ELSE 0 END) / nullif(sum(span), 0))", 2)
        + f' AS "{name}_pct"' for name, value in categories)


MODE_CATEGORIES = (("lte", "LTE"), ("3g", "3G"), ("2g", "2G"), ("no_service", "NO SERVICE"),
                   ("disconnected", "DISCONNECTED"), ("unknown", "UNKNOWN"))
QUALITY_CATEGORIES = (("good", "GOOD"), ("fair", "FAIR"), ("poor", "POOR"))


def _pcts(names, suffixes=("",)) -> str:
    return " ".join(f"{n}_pct{s}" for s in suffixes for n in names)


def _selection(names) -> str:
    cols = []
    for s, _ in ARMS:
        cols.append(f"sum(t.cnt{s}) AS cnt{s}")
        cols += [rnd(f"(100 * sum(t.cnt_{n}{s})::DOUBLE / nullif(sum(t.cnt{s}), 0))", 2)
                 + f' AS "{n}_pct{s}"' for n in names]
    return q(_both(", ".join(cols), "tool"), "cnt cnt_t", _pcts(names, ("", "_t")), "exp_name")


def _schedule_shares(names) -> str:
    cols = ["t.exp_id", "t.sched_id", "t.node_id"]
    for s, _ in ARMS:
        cols.append(f"t.cnt{s}")
        cols += [rnd(f"(100 * t.cnt_{n}{s}::DOUBLE / nullif(t.cnt{s}, 0))", 2) + f' AS "{n}_pct{s}"'
                 for n in names]
    return q(f"SELECT {', '.join(cols)} FROM {_batch('tool')}", "exp_id sched_id node_id cnt cnt_t",
             _pcts(names, ("", "_t")))


def _rtt_by(*keys: str) -> str:
    names = ", ".join(f"t.{k}" for k in keys)
    ints, texts = ("cnt oper", "") if keys == ("oper",) else ("cnt", " ".join(keys))
    return q(f"SELECT {names}, count(*) AS cnt, {rnd(f"({mean('t.rtt')} * 1000)", 1)} AS rtt_ms "
             f"FROM {_batch('vping')} AND t.ping_type = 'ECHO' GROUP BY {names}", ints, "rtt_ms", texts)


def _speed_by(*keys: str) -> str:
    names = ", ".join(f"t.{k}" for k in keys)
    speed = "(sum(t.dwnl_size)::DOUBLE / nullif(sum(t.total_time - t.init_time), 0) / 1048576)"
    ints, texts = ("cnt oper", "") if keys == ("oper",) else ("cnt", " ".join(keys))
    return q(f"SELECT {names}, count(*) AS cnt, {rnd(speed, 2)} AS speed_mbs FROM {_batch('vdl')} "
             f"GROUP BY {names}", ints, "speed_mbs", texts)


def _overhead() -> str:
    def mem(slot):
        return f"{slot}_pss / 1048576.0::DOUBLE"

    category = """CASE WHEN app_name = '(no-app)' AND exporter_name IS NULL AND policyd_name IS NULL
        AND proxy_name IS NULL THEN 'idle' WHEN app_name = 't-tcp-ping' THEN 'treatment'
        WHEN app_name IN ('tcp-ping', 'dwnl-test') THEN
        CASE WHEN proxy_name IS NULL THEN 'baseline' ELSE 'proxy' END END"""
    parts = [("'cpu'", "cpu", "TRUE"), ("'mem'", "(total - avail) / 1048576.0::DOUBLE", "TRUE"),
             ("app_name || '-cpu'", "app_cpu / 4", "category <> 'idle'"),
             ("app_name || '-mem'", mem("app"), "category <> 'idle'")]
    for slot, where in (("exporter", "category IN ('treatment', 'proxy')"),
                        ("policyd", "category IN ('treatment', 'proxy')"), ("proxy", "category = 'proxy'")):
        parts += [(f"'{slot}-cpu'", f"{slot}_cpu / 4", where), (f"'{slot}-mem'", mem(slot), where)]
    rows = " UNION ALL ".join(f"SELECT category, {key} AS key, {value} AS v FROM c WHERE {where}"
                              for key, value, where in parts)
    return (f"SELECT category, key, count(v) AS cnt, avg(v) AS avr FROM (WITH c AS (SELECT *, {category} "
            f"AS category FROM inner_samples) SELECT * FROM (SELECT * FROM ({rows}) "
            "WHERE category IS NOT NULL) WHERE v IS NOT NULL) GROUP BY category, key")


def _summary_names(kind: str) -> tuple[str, str]:
    ints = ["sched_id", "exp_id", "node_id", "cnt_all"]
    doubles = ["cnt_gain"] + (["rtt_gain"] if kind == "ping" else ["size_gain", "speed_gain"])
    for s, _ in ARMS:
        ints += [f"cnt{s}", *[f"cnt_{n}{s}" for n, _ in COUNTS]]
        doubles.append(f"init_time{s}")
        if kind == "ping":
            ints.append(f"cnt_rtt{s}"), doubles.append(f"rtt{s}")
        else:
            ints += [f"cnt_dwnl{s}", f"dwnl_size{s}"]
            doubles += [f"dwnl_time{s}", f"dwnl_speed{s}"]
    return " ".join(ints), " ".join(doubles)


def _human(x: str) -> str:
    units = ("B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
    cases, scaled = [], x
    for i, unit in enumerate(units):
        cases.append(f"WHEN {scaled} <= 1000 THEN printf('%.{i}f {unit}', {scaled})")
        scaled = f"({scaled} / 1000)"
    return f"CASE {' '.join(cases)} END"


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


RULE_SCORES = """SELECT event_id, uid, sum(CASE WHEN role = 'property' THEN score ELSE 0 END) AS score
    FROM (SELECT event_id, unnest(['', 'device_mode', 'rssi', 'lte_rsrp', 'lte_rsrq', 'dlb_quality']) AS name,
          unnest([0, device_mode, rssi, lte_rsrp, lte_rsrq, dlb_quality]) AS reading FROM candidates) c
    JOIN (SELECT * FROM rules UNION ALL SELECT uid, 'always', '', 0, 0, NULL FROM rules GROUP BY uid
          HAVING count(*) FILTER (WHERE role = 'match') = 0) r
      ON c.name = r.name AND c.reading BETWEEN r.lo AND r.hi
    GROUP BY event_id, uid HAVING count(DISTINCT CASE WHEN role = 'match' THEN r.name END) =
        (SELECT count(DISTINCT n.name) FROM rules n WHERE n.role = 'match' AND n.uid = r.uid)"""


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["o_s1"] = q("SELECT DISTINCT exp_id, sched_id, node_id FROM probes", "exp_id sched_id node_id")
    out["o_s2"] = q("SELECT event_id, user_id AS sched_id, epoch_us(date_trunc('second', ts)) AS run_dtm "
                    "FROM ev WHERE event_type IN ('click', 'view')", "event_id sched_id run_dtm")
    out["o_s3"] = q("SELECT event_id, user_id AS sched_id, '10.0.' || (user_id % 250) || '.' || (k % 3) "
                    "AS local_ip, 'op' || (k % 3) AS if_name FROM ev WHERE event_id % 4 NOT IN (0, 1)",
                    "event_id sched_id", "", "local_ip if_name")
    out["o_s4"] = q("SELECT seq_no, epoch_us(ts) AS ts, iif_name, dev_mode, "
                    "CASE WHEN k % 10 <> 0 THEN rssi END AS rssi, lte_rsrq, lte_rsrp, "
                    "CASE WHEN k % 7 <> 0 THEN 24000 + k % 3 END AS imsimccmnc, "
                    "CASE WHEN k % 4 <> 0 THEN 'net ' || k END AS op_name FROM states",
                    "seq_no ts dev_mode rssi lte_rsrq lte_rsrp imsimccmnc", "", "iif_name op_name")
    out["o_s5"] = q("SELECT run_tool, iter_nr, '10.0.0.' || (k % 5) AS local_ip, event_id AS remote_port, "
                    "ping_type, rtt FROM probes", "iter_nr remote_port", "rtt",
                    "run_tool local_ip ping_type")
    out["o_s6"] = q("SELECT run_tool, iter_nr, if_name AS local_ip, '/f/' || l_orderkey AS dwnl_path, "
                    "dwnl_size, init_time, total_time FROM dl", "iter_nr dwnl_size",
                    "init_time total_time", "run_tool local_ip dwnl_path")
    sample_ints = "total avail app_pss exporter_pss policyd_pss proxy_pss"
    out["o_s7"] = q("SELECT * FROM samples", "event_id " + sample_ints,
                    "cpu app_cpu exporter_cpu policyd_cpu proxy_cpu",
                    "app_name exporter_name policyd_name proxy_name")
    out["o_s8"] = q("SELECT e.label, e.batch, count(*) AS cnt FROM probes p JOIN exps e "
                    "ON p.exp_id = e.exp_id GROUP BY e.label, e.batch, e.exp_id", "cnt", "", "label batch")
    out["o_s9"] = q("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS corrupt,
        CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS run_count,
        CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 100 END AS ping_count,
        CASE WHEN p_partkey % 10 <> 0 THEN 2 END AS commands,
        CASE WHEN p_partkey % 10 <> 0 THEN 'tcp-ping' END AS first_command FROM part""",
                    "p_partkey corrupt run_count ping_count commands", "", "first_command")
    out["o_s10"] = q("""
        SELECT r.*, p_size AS priority, CASE WHEN p_partkey % 2 = 0 THEN 'yes' END AS replaces FROM (
        SELECT 'rule-' || p_partkey AS uid, 'policy' AS policy_type, 'match' AS role, 0 AS group_no,
            'device_mode' AS name, m AS lo, m AS hi, NULL AS text_value, NULL AS precedence, NULL AS score
            FROM part, unnest([3, 4, p_size]) AS u(m) WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'rule-' || p_partkey, 'policy', 'property', 0, 'device_mode', m, m, NULL, 2, s
            FROM (SELECT p_partkey, unnest([3, p_size]) AS m, unnest([0, p_partkey % 20]) AS s
                  FROM part WHERE p_partkey % 3 = 0)
        UNION ALL SELECT 'rule-' || p_partkey, 'policy', 'match', 0, 'device_mode', 4, 4, NULL, NULL, NULL
            FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT 'rule-' || p_partkey, 'policy', 'match', 0, 'rssi', -128, -p_size, NULL, NULL, NULL
            FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT 'rule-' || p_partkey, 'policy', 'property', 0, 'rssi', -128, -p_size, NULL, 2, 15
            FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT 'rule-' || p_partkey, 'profile', 'property', 0, 'interface', NULL, NULL, i, 2, NULL
            FROM part, unnest(['op0', 'op' || p_size]) AS u(i) WHERE p_partkey % 3 = 2) r
        JOIN part ON r.uid = 'rule-' || p_partkey""",
                     "group_no precedence priority", "lo hi score", "uid policy_type role name text_value replaces")
    out["o_s11"] = q("""SELECT event_id,
        CASE event_type WHEN 'view' THEN 'no space' WHEN 'purchase' THEN 'bad json' ELSE 'ok' END AS status,
        CASE WHEN event_type <> 'view' THEN 'META.MODEM' END AS header,
        CASE WHEN event_type IN ('error', 'signup') THEN k % 6 END AS dev_mode
        FROM ev WHERE event_type <> 'click'""", "event_id dev_mode", "", "status header")
    latest = """SELECT sched_id, iif_name, epoch_us(ts) AS ts, seq_no, dev_mode FROM (SELECT *,
        row_number() OVER (PARTITION BY sched_id, iif_name ORDER BY ts DESC, seq_no DESC) AS rn FROM states)
        WHERE rn = 1"""
    out["o_k5"] = out["o_t2"] = q(latest, "sched_id ts seq_no dev_mode", "", "iif_name")
    out["o_k1"] = q("""SELECT p.exp_id, count(*) AS cnt, count(p.m_ts) AS with_state,
        sum(CAST(round(rtt * 100000) AS BIGINT)) AS rtt_sum, sum(epoch(run)::BIGINT - floor(epoch(p.m_ts))::BIGINT) AS state_age,
        sum(CASE WHEN known THEN 24000 + right(if_name, 1)::INTEGER END) AS oper_sum, min(n) AS states
        FROM (SELECT f.exp_id, f.rtt, f.if_name, f.run, max(s.ts) AS m_ts, bool_or(s.ts IS NOT NULL OR k.sched_id IS NOT NULL) AS known
              FROM (SELECT *, CASE WHEN day(run_dtm) < 16 THEN TIMESTAMP '2024-01-08 12:00:00'
                                   ELSE TIMESTAMP '2024-01-22 12:00:00' END AS run FROM probes) f
              LEFT JOIN states s ON s.sched_id = f.sched_id AND s.iif_name = f.if_name AND s.ts <= f.run
              LEFT JOIN (SELECT DISTINCT sched_id, iif_name FROM states) k
                ON k.sched_id = f.sched_id AND k.iif_name = f.if_name
              GROUP BY f.event_id, f.exp_id, f.rtt, f.if_name, f.run) p
        JOIN (SELECT exp_id, count(*) AS n FROM states GROUP BY exp_id) c USING (exp_id)
        GROUP BY p.exp_id""", "exp_id cnt with_state rtt_sum state_age oper_sum states")
    ping_ints, ping_doubles = _summary_names("ping")
    dl_ints, dl_doubles = _summary_names("download")
    out["o_k2"] = out["o_a6"] = q("SELECT * FROM ps", ping_ints, ping_doubles)
    out["o_a7"] = q("SELECT * FROM ds", dl_ints, dl_doubles)
    out["o_k3"] = q("SELECT device_mode, signal_quality, count(*) AS cnt FROM vping "
                    "GROUP BY device_mode, signal_quality", "cnt", "", "device_mode signal_quality")
    out["o_k4"] = q("SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem "
                    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", "l_orderkey l_linenumber cnt")

    radio = """SELECT seq_no, iif_name AS if_name, dev_mode AS mode,
        CASE WHEN dev_mode = 5 THEN ((rssi + 128) & 255) - 128 END AS lte_rssi,
        CASE WHEN dev_mode = 5 THEN lte_rsrp END AS lte_rsrp,
        CASE WHEN dev_mode <> 5 THEN ((rssi + 128) & 255) - 128 END AS rssi"""
    out["o_p14"] = q(f"{radio} FROM states", "seq_no mode lte_rssi lte_rsrp rssi", "", "if_name")
    out["o_t1"] = out["o_k6"] = q(f"{radio}, iif_name || '_metadata_exporter' AS uid, "
                                  "(SELECT count(*) FROM probes WHERE k % 10 = 0) AS rejects FROM states",
                                  "seq_no mode lte_rssi lte_rsrp rssi rejects", "", "if_name uid")
    out["o_p13"] = q("""SELECT seq_no, iif_name || '_metadata_exporter' AS uid, 4 AS priority, 'true' AS link,
        iif_name AS matched, 'false' AS wired, 2 AS precedence, 24000 + k % 3 AS oper FROM states""",
                     "seq_no priority precedence oper", "", "uid link matched wired")
    out["o_j7"] = q("""SELECT seq_no, iif_name AS if_name, s.s_nationkey AS conn,
        s.s_suppkey % 3 AS quality FROM states t LEFT JOIN supplier s
        ON t.sched_id = s.s_suppkey""", "seq_no conn quality", "", "if_name")
    out["o_t3"] = q("""SELECT seq_no, s.s_nationkey AS conn, (s.s_suppkey + seq_no % 2) % 3 AS quality
        FROM states t LEFT JOIN supplier s ON t.sched_id = s.s_suppkey""", "seq_no conn quality")
    out["o_p11"] = q("""SELECT seq_no, CASE WHEN k % 10 <> 0 THEN rssi END AS rssi_loaded,
        CASE WHEN k % 10 = 0 THEN 0 ELSE ((rssi + 128) & 255) - 128 END AS rssi_streamed,
        CASE WHEN k % 4 <> 0 THEN 'net ' || k END AS op_loaded,
        CASE WHEN k % 4 <> 0 THEN 'net ' || k ELSE '' END AS op_streamed FROM states""",
                     "seq_no rssi_loaded rssi_streamed", "", "op_loaded op_streamed")
    out["o_p12"] = q("""SELECT event_id, ((x + 128) & 255) - 128 AS wrapped8, x & 255 AS wrapped_u8,
        CASE WHEN x BETWEEN -128 AND 127 THEN x END AS fitted8, ((y + 32768) & 65535) - 32768 AS wrapped16
        FROM (SELECT event_id, k * 7 - 300 AS x, k * 1000 - 50000 AS y FROM ev)""",
                     "event_id wrapped8 wrapped_u8 fitted8 wrapped16")
    out["o_k7"] = q(f"""SELECT category || chr(9) || key || chr(9) || cnt || chr(9) ||
        {_fixed(rnd('avr', 6), 6)} AS value FROM ({_overhead()})""", "", "", "value")

    odd_mode = "CASE WHEN k % 11 <> 0 THEN k % 8 END"
    out["o_p1"] = q(f"SELECT event_id, {_mode_label(odd_mode)} AS device_mode FROM ev", "event_id", "",
                    "device_mode")
    out["o_p2"] = q("SELECT event_id, signal_quality FROM spans", "event_id", "", "signal_quality")
    out["o_p3"] = q("SELECT event_id, CASE WHEN ping_type = 'ECHO' THEN rtt END AS echo_rtt, "
                    "CASE WHEN iter_nr = 1 THEN 1 ELSE 0 END AS is_first FROM probes",
                    "event_id is_first", "echo_rtt")
    out["o_p4"] = q("SELECT event_id, value * 1000 AS ms, k * 1000000 / 1048576.0::DOUBLE AS mib, "
                    "k / 7.0::DOUBLE * 100 AS pct FROM ev", "event_id", "ms mib pct")
    out["o_p5"] = q(f"SELECT event_id, {rnd('(value / 3)', 1)} AS one, {rnd('(-value / 3)', 2)} AS two, "
                    f"{rnd('value', 0)} AS none FROM ev", "event_id", "one two none")
    out["o_p6"] = q("SELECT event_id, e.label FROM probes p JOIN exps e ON p.exp_id = e.exp_id",
                    "event_id", "", "label")
    out["o_p7"] = q("SELECT event_id, value / nullif(k % 5, 0) AS share FROM ev", "event_id", "share")
    out["o_p8"] = q("SELECT sched_id, cnt_gain, rtt_gain, rtt_t / nullif(rtt, 0) * 100 - 100 AS rtt_gain_pct "
                    "FROM ps", "sched_id", "cnt_gain rtt_gain rtt_gain_pct")
    out["o_p9"] = q("SELECT event_id, epoch(strptime(strftime(ts, '%Y%m%d-%H%M%S'), '%Y%m%d-%H%M%S')) "
                    "AS epoch FROM ev", "event_id epoch")
    out["o_p10"] = q("SELECT event_id, epoch_us(ts) AS ts FROM ev", "event_id ts")
    out["o_p15"] = q("""SELECT event_id, (total - avail) / 1048576.0::DOUBLE AS mem, app_cpu / 4 AS app_cpu,
        app_pss / 1048576.0::DOUBLE AS app_mem, proxy_cpu / 4 AS proxy_cpu,
        proxy_pss / 1048576.0::DOUBLE AS proxy_mem FROM samples""",
                     "event_id", "mem app_cpu app_mem proxy_cpu proxy_mem")
    protocol = "CASE {} WHEN 1 THEN 'TCP' WHEN 2 THEN 'SCTP' WHEN 3 THEN 'SCTP/UDP' ELSE 'OTHER' END"
    out["o_p16"] = q(f"SELECT event_id, {protocol.format('protocol')} AS protocol FROM reads", "event_id", "",
                     "protocol")
    out["o_p17"] = q(f"SELECT event_id, {_human('amount')} AS size FROM (SELECT event_id, "
                     "value * [1.0::DOUBLE, 1e3, 1e6, 1e9, 1e12, 1e15, 1e18, 1e21, 1e24, 1e27][k % 10 + 1] "
                     "AS amount FROM ev)", "event_id", "", "size")
    out["o_p18"] = q("SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000.0::DOUBLE "
                     "AS elapsed FROM ev", "event_id", "elapsed")
    out["o_p19"] = q("""SELECT event_id, CASE WHEN k % 10 = 0 THEN 'none' WHEN run_tool LIKE 't-%'
        THEN 'treatment' ELSE 'baseline' END AS arm FROM probes""", "event_id", "", "arm")
    out["o_p20"] = q(f"SELECT sched_id, {SHARE} AS share FROM tool", "sched_id", "share")

    out["o_f1"] = q(f"SELECT t.exp_id, count(*) AS cnt FROM {_batch('probes')} GROUP BY t.exp_id",
                    "exp_id cnt")
    out["o_j1"] = q(f"SELECT event_id, e.label, rtt FROM {_batch('probes')}", "event_id", "rtt", "label")
    out["o_f2"] = q("""SELECT sched_id, sum(CASE WHEN run_tool LIKE 't-%' THEN 1 ELSE 0 END) AS treatment,
        sum(CASE WHEN run_tool NOT LIKE 't-%' THEN 1 ELSE 0 END) AS baseline FROM probes GROUP BY sched_id""",
                    "sched_id treatment baseline")
    out["o_f3"] = q("SELECT event_id FROM vping WHERE (ping_type = 'ECHO' AND if_name = 'op1' AND "
                    "device_mode = 'LTE') OR (iter_nr = 1 AND signal_quality = 'FAIR')", "event_id")
    out["o_f4"] = q(f"SELECT sched_id, CASE WHEN {SHARE} > 0.2::DOUBLE THEN 'often' ELSE 'never' END "
                    f"AS segment FROM tool WHERE {SHARE} > 0.2::DOUBLE OR {SHARE} = 0", "sched_id", "",
                    "segment")
    out["o_f5"] = q(f"SELECT sched_id FROM dtool WHERE {NON_LTE}", "sched_id")
    out["o_f6"] = q("SELECT event_id FROM ev WHERE k BETWEEN 20 AND 40", "event_id")
    out["o_f7"] = q("SELECT event_id FROM states WHERE dev_mode IN (3, 4)", "event_id")
    out["o_f8"] = q(r"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id,
        unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE starts_with(line, 'S') OR regexp_matches(line, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')
        GROUP BY doc_id""", "doc_id lines")
    out["o_f9"] = q("SELECT event_id FROM inner_samples", "event_id")
    out["o_w3"] = q("SELECT recording, count(*) AS cnt, sum(cpu) AS cpu FROM inner_samples GROUP BY recording",
                    "recording cnt", "cpu")
    out["o_f10"] = q("""SELECT event_id FROM (SELECT *, max(CASE WHEN late THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past
        FROM (SELECT event_id, user_id, ts, day, epoch(date_trunc('second', ts)) -
              epoch(date_trunc('second', min(ts) OVER (PARTITION BY user_id, day))) > 21600 AS late
              FROM (SELECT *, date_trunc('day', ts) AS day FROM ev))) WHERE coalesce(past, 0) = 0""", "event_id")

    out["o_j2"] = out["o_j5"] = q("SELECT event_id, epoch_us(m_ts) AS m_ts, dev_mode, rssi FROM pings",
                                  "event_id m_ts dev_mode rssi")
    out["o_w2"] = q("SELECT event_id, epoch_us(m_ts) AS m_ts FROM pings", "event_id m_ts")
    out["o_j3"] = q("SELECT ps.sched_id, ps.cnt_rtt, ds.cnt_dwnl, ds.dwnl_size FROM ps LEFT JOIN ds "
                    "ON ps.sched_id = ds.sched_id", "sched_id cnt_rtt cnt_dwnl dwnl_size")
    out["o_j6"] = q("""SELECT p.event_id, a.if_name, o.oper FROM probes p
        LEFT JOIN (SELECT DISTINCT sched_id, k % 3 AS host, iif_name AS if_name FROM states) a
            ON p.sched_id = a.sched_id AND p.k % 5 = a.host
        LEFT JOIN (SELECT DISTINCT sched_id, iif_name AS if_name, 24000 + k % 3 AS oper FROM states) o
            ON p.sched_id = o.sched_id AND a.if_name = o.if_name""", "event_id oper", "", "if_name")
    out["o_j8"] = q("SELECT t.sched_id, e.label, t.cnt_rtt, v.cnt_t FROM ps t LEFT JOIN exps e "
                    "ON t.exp_id = e.exp_id LEFT JOIN tool v ON t.sched_id = v.sched_id",
                    "sched_id cnt_rtt cnt_t", "", "label")
    out["o_j9"] = q(RULE_SCORES, "event_id", "score", "uid")
    out["o_o4"] = q(f"""SELECT sched_id, epoch_us(day) AS day, if_name, score FROM (SELECT *, row_number() OVER (
        PARTITION BY sched_id, day ORDER BY score DESC, if_name DESC) AS rn FROM (SELECT c.sched_id,
        date_trunc('day', c.ts) AS day, c.if_name, s.score FROM candidates c JOIN (SELECT event_id,
        sum(score) AS score FROM ({RULE_SCORES}) GROUP BY event_id) s ON c.event_id = s.event_id)) WHERE rn = 1""",
                    "sched_id day", "score", "if_name")

    out["o_a1"] = q("SELECT sched_id, count(*) AS cnt FROM probes GROUP BY sched_id", "sched_id cnt")
    out["o_a2"] = q("SELECT sched_id, sum(CASE WHEN signal_quality = 'GOOD' THEN 1 END) AS good FROM vping "
                    "GROUP BY sched_id", "sched_id good")
    out["o_a3"] = q("SELECT sched_id, sum(CASE WHEN signal_quality = 'GOOD' THEN 1 ELSE 0 END) AS good "
                    "FROM vping GROUP BY sched_id", "sched_id good")
    out["o_a4"] = q("SELECT sched_id, avg(CASE WHEN ping_type = 'ECHO' THEN rtt END) AS rtt, "
                    "sum(CASE WHEN ping_type = 'CONN' THEN rtt END) AS conn FROM probes GROUP BY sched_id",
                    "sched_id", "rtt conn")
    out["o_a5"] = q("SELECT sched_id, min(exp_id) AS exp_id, min(node_id) AS node_id FROM probes "
                    "GROUP BY sched_id", "sched_id exp_id node_id")
    out["o_a8"] = q(f"SELECT exp_id, {_wmean('cnt_rtt', 'rtt')} AS rtt, {_wmean('cnt', 'init_time')} AS init "
                    "FROM ps GROUP BY exp_id", "exp_id", "rtt init")
    out["o_a9"] = q("SELECT exp_id, sum(dwnl_size)::DOUBLE / nullif(sum(dwnl_time), 0) / 1048576 AS speed "
                    "FROM ds GROUP BY exp_id", "exp_id", "speed")
    out["o_a10"] = q("SELECT exp_id, 100 * avg(CASE WHEN rtt_t < rtt THEN 1 ELSE 0 END) AS wins FROM ps "
                     "GROUP BY exp_id", "exp_id", "wins")
    totals = _both("count(*) AS cnt, sum(t.rtt) AS rtt", "probes")
    out["o_a11"] = out["o_u1"] = q(totals, "cnt", "rtt", "exp_name")
    out["o_a12"] = q("SELECT count(*) AS cnt, avg(rtt) AS rtt, min(rtt) AS low, max(rtt) AS high FROM probes",
                     "cnt", "rtt low high")
    out["o_a13"] = q(f"SELECT exp_id, {_span_share('device_mode', MODE_CATEGORIES)} FROM spans GROUP BY exp_id",
                     "exp_id", _pcts([n for n, _ in MODE_CATEGORIES]))
    shares = ", ".join(f"100 * sum(cnt_{n})::DOUBLE / nullif(sum(cnt), 0) AS {n}_pct" for n in
                       ("good", "fair", "poor"))
    out["o_a14"] = q(f"SELECT exp_id, {shares} FROM tool GROUP BY exp_id", "exp_id",
                     "good_pct fair_pct poor_pct")
    out["o_a15"] = q(f"SELECT exp_id, count(*) AS cnt, {_bucket_columns(SHARE)} FROM tool GROUP BY exp_id",
                     "exp_id cnt", " ".join(n for n, _, _ in BUCKETS))
    out["o_a16"] = q(f"SELECT if_name, device_mode, count(*) AS cnt, {rnd(f"({mean('rtt')} * 1000)", 1)} AS rtt_ms "
                     "FROM vping GROUP BY if_name, device_mode", "cnt", "rtt_ms", "if_name device_mode")
    tool_ints = "exp_id sched_id node_id " + " ".join(TOOL_COUNTS)
    out["o_a17"] = q("SELECT * FROM tool", tool_ints, "init_time init_time_t")
    cols = ", ".join(["exp_id", "sched_id", "node_id", *[f'"{c}"' for c in TOOL_COUNTS], "init_time",
                      "init_time_t"])
    out["o_u2"] = q(f"SELECT {cols} FROM ps UNION ALL SELECT {cols} FROM ds", tool_ints,
                    "init_time init_time_t")
    out["o_a18"] = q("""SELECT sched_id, local_ip, CASE WHEN low = high THEN 'unique' ELSE 'conflict' END
        AS status, low AS if_name, high AS other FROM (SELECT sched_id, '10.0.0.' || (k % 7) AS local_ip,
        min(if_name) AS low, max(if_name) AS high FROM probes GROUP BY ALL)""",
                     "sched_id", "", "local_ip status if_name other")
    out["o_a19"] = q("SELECT app_name, count(app_cpu) AS cnt, avg(app_cpu) AS avr FROM samples "
                     "WHERE app_cpu IS NOT NULL GROUP BY app_name", "cnt", "avr", "app_name")
    out["o_a20"] = out["r1"] = q(_overhead(), "cnt", "avr", "category key")
    out["o_a21"] = q(f"""SELECT flow_id, bytes, reads, duration, bandwidth, {protocol.format('p')} AS protocol,
        {_human('bytes::DOUBLE')} AS size_text, {_human('bandwidth')} || 'it/s' AS bandwidth_text FROM (
        SELECT *, bytes * 8 / nullif(duration, 0) AS bandwidth FROM (SELECT flow_id, sum(bytes)::BIGINT AS bytes,
        count(*) AS reads, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration,
        arg_max(protocol, ts) AS p FROM reads GROUP BY flow_id))""", "flow_id bytes reads",
                     "duration bandwidth", "protocol size_text bandwidth_text")
    out["o_w1"] = q("SELECT seq_no, span FROM spans", "seq_no", "span")
    behind = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM states WHERE {})"
    too_late = f"(seq_no % 50 = 0 AND ts < {behind.format('seq_no % 50 <> 0')})"
    out["o_t4"] = q(f"""SELECT seq_no, (epoch_us(following) - epoch_us(ts)) / 1000000.0::DOUBLE AS span, 0 AS late
        FROM (SELECT seq_no, ts, lead(ts) OVER (PARTITION BY sched_id, iif_name ORDER BY ts, seq_no) AS following
              FROM states WHERE NOT {too_late}) WHERE following < {behind.format('true')}
        UNION ALL SELECT seq_no, NULL, 1 FROM states WHERE {too_late}""", "seq_no late", "span")
    out["o_w4"] = q("""SELECT event_id, grown AS interval_bytes, passed AS interval_seconds,
        grown * 8 / nullif(passed, 0) AS rate_bps FROM (SELECT event_id,
        bytes_total - lag(bytes_total) OVER w AS grown,
        (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0::DOUBLE AS passed FROM reads
        WINDOW w AS (PARTITION BY flow_id ORDER BY ts, event_id))""", "event_id interval_bytes",
                    "interval_seconds rate_bps")
    out["o_w5"] = q("""SELECT recording, epoch_us(seen_at) AS seen_at, process FROM (SELECT p.*, n,
        lag(n) OVER (PARTITION BY p.recording, process ORDER BY n) AS before FROM processes p JOIN (
        SELECT recording, seen_at, row_number() OVER (PARTITION BY recording ORDER BY seen_at) AS n
        FROM (SELECT DISTINCT recording, seen_at FROM processes)) i ON p.recording = i.recording AND p.seen_at = i.seen_at)
        WHERE n - before = 1""", "recording seen_at", "", "process")
    out["o_w6"] = q("""SELECT event_id, n, CASE WHEN n = 1 THEN 'CONN' ELSE 'ECHO' END AS kind FROM (
        SELECT event_id, row_number() OVER (PARTITION BY sched_id, run_tool ORDER BY run_dtm, event_id) AS n
        FROM probes)""", "event_id n", "", "kind")
    out["o_o3"] = q("""SELECT recording, epoch_us(seen_at) AS seen_at, CASE min(CASE process WHEN 'tcp-ping' THEN 0
        WHEN 't-tcp-ping' THEN 1 WHEN 'dwnl-test' THEN 2 WHEN 't-dwnl-test' THEN 3 END) WHEN 0 THEN 'tcp-ping'
        WHEN 1 THEN 't-tcp-ping' WHEN 2 THEN 'dwnl-test' WHEN 3 THEN 't-dwnl-test' ELSE '(no-app)' END AS app_name
        FROM processes GROUP BY recording, seen_at""", "recording seen_at", "", "app_name")
    out["o_o1"] = q(f"""SELECT oper, cnt, rtt_ms, row_number() OVER (ORDER BY rtt_ms ASC NULLS FIRST, oper) AS place
        FROM (SELECT oper, count(*) AS cnt, {rnd(f"({mean('rtt')} * 1000)", 1)} AS rtt_ms FROM probes
        WHERE ping_type = 'ECHO' GROUP BY oper)""", "oper cnt place", "rtt_ms")
    speed = "(sum(dwnl_size)::DOUBLE / nullif(sum(total_time - init_time), 0) / 1048576)"
    out["o_o2"] = q(f"""SELECT oper, cnt, speed_mbs, row_number() OVER (ORDER BY speed_mbs DESC NULLS LAST, oper)
        AS place FROM (SELECT oper, count(*) AS cnt, {rnd(speed, 2)} AS speed_mbs FROM dl GROUP BY oper)""",
                    "oper cnt place", "speed_mbs")
    mark = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM samples WHERE {})"
    out["o_t5"] = q(f"""SELECT epoch_us(w) AS window_start, app_name, count(cpu) AS cpu_cnt, avg(cpu) AS cpu_avr,
        CASE WHEN w + INTERVAL 1 HOUR > {mark.format('true')} THEN 'open'
             WHEN bool_or(held) AND w + INTERVAL 1 HOUR <= {mark.format('epoch_us(ts) % 40 <> 0')} THEN 'corrected'
             ELSE 'written' END AS origin
        FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS w, app_name, cpu, epoch_us(ts) % 40 = 0 AS held FROM samples)
        GROUP BY w, app_name""", "window_start cpu_cnt", "cpu_avr", "app_name origin")

    often, never = f"{SHARE} > 0.2::DOUBLE", f"{SHARE} = 0"
    out["q1"], out["q2"] = _rtt_gain(), _download_gain()
    out["q3"] = q(_both(f"count(*) AS cnt, {_bucket_columns(SHARE)}", "tool"), "cnt",
                  " ".join(n for n, _, _ in BUCKETS), "exp_name")
    out["q4"], out["q5"] = _rtt_gain(segment=often), _download_gain(segment=often)
    out["q6"], out["q7"] = _rtt_gain(segment=never), _download_gain(segment=never)
    out["q8"] = q(_both(_span_share("device_mode", MODE_CATEGORIES), "spans"), "",
                  _pcts([n for n, _ in MODE_CATEGORIES]), "exp_name")
    out["q9"] = _selection(("lte", "3g", "2g"))
    out["q10"] = _rtt_gain("dps", "dtool", NON_LTE)
    out["q11"] = _download_gain("dtool", NON_LTE)
    out["q12"] = q(_both(_span_share("signal_quality", QUALITY_CATEGORIES), "spans"), "",
                   _pcts([n for n, _ in QUALITY_CATEGORIES]), "exp_name")
    out["q13"] = _selection(("good", "fair", "poor"))
    out["q14"], out["q15"], out["q16"] = _rtt_by("oper"), _rtt_by("device_mode"), _rtt_by("signal_quality")
    out["q17"] = _rtt_by("device_mode", "signal_quality")
    out["q18"], out["q19"] = _speed_by("oper"), _speed_by("device_mode")
    out["q20"], out["q21"] = _speed_by("signal_quality"), _speed_by("device_mode", "signal_quality")
    per_rtt = ["t.exp_id", "t.sched_id", "t.node_id"]
    per_dl = list(per_rtt)
    for s, _ in ARMS:
        per_rtt += [f"t.cnt_rtt{s} AS cnt{s}", f"{rnd(f'(t.rtt{s} * 1000)', 1)} AS rtt_ms{s}",
                    f"{rnd(f'(t.init_time{s} * 1000)', 1)} AS init_ms{s}"]
        per_dl += [f"t.cnt_dwnl{s} AS cnt{s}", f"{rnd(f'(t.dwnl_size{s}::DOUBLE / 1048576)', 1)} AS size_mb{s}",
                   f"{rnd(f'(t.dwnl_speed{s} / 1048576)', 2)} AS speed_mbs{s}",
                   f"{rnd(f'(t.init_time{s} * 1000)', 1)} AS init_ms{s}"]
    per_rtt.append(f"{rnd('(t.rtt_gain * 100)', 2)} AS rtt_gain_pct")
    per_dl += [f"{rnd(f'(t.{g}_gain * 100)', 2)} AS {g}_gain_pct" for g in ("size", "speed")]
    out["n1"] = q(f"SELECT {', '.join(per_rtt)} FROM {_batch('ps')}", "exp_id sched_id node_id cnt cnt_t",
                  "rtt_ms init_ms rtt_ms_t init_ms_t rtt_gain_pct")
    out["n2"] = q(f"SELECT {', '.join(per_dl)} FROM {_batch('ds')}", "exp_id sched_id node_id cnt cnt_t",
                  "size_mb speed_mbs init_ms size_mb_t speed_mbs_t init_ms_t size_gain_pct speed_gain_pct")
    out["n3"] = _schedule_shares(("op0", "op1"))
    out["n4"] = _schedule_shares(("lte", "3g", "2g"))
    out["n5"] = _schedule_shares(("good", "fair", "poor"))
    prelude = _prelude()
    return {key: f"{prelude} {text}" for key, text in out.items()}
