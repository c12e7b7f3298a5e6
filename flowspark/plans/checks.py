"""The same results in plain SQL over the same tables, written independently of the operators: no list is shared."""

from __future__ import annotations

import math

from flowspark.plans.queries import LOG_THRESHOLD, WINDOW
from flowspark.sources import driver_tables as tables

# Fixed values, written out here so that a slip in the operators' lists shows.
_FEATURES = (
    "icmp_ratio", "tcp_ratio", "udp_ratio", "s0_ratio", "sf_ratio", "failed_conn_ratio", "time_span", "flow_rate",
    "avg_orig_bytes", "avg_resp_bytes", "total_orig_bytes", "total_resp_bytes", "byte_ratio", "avg_orig_pkts",
    "avg_resp_pkts", "total_orig_pkts", "total_resp_pkts", "pkt_ratio", "unique_src_ips", "unique_dst_ips",
    "src_ip_diversity", "dst_ip_diversity", "unique_src_ports", "unique_dst_ports", "avg_src_port", "avg_dst_port",
    "avg_duration", "max_duration", "min_duration", "total_flows",
)
_TAXONOMY_GROUPS = {
    "Unknown": "unk empty",
    "Other": "ttl_error hostout netout icmp_error",
    "HTTP": "alphflHTTP ptmpHTTP mptpHTTP ptmplaHTTP mptplaHTTP",
    "MultiPoints": "ptmp mptp mptmp",
    "AlphaFlow": "alphfl malphfl salphfl point_to_point heavy_hitter",
    "IPv6Tunneling": "ipv4gretun ipv46tun",
    "PortScan": "posca ptpposca",
    "NetworkScanICMP": "ntscIC dntscIC",
    "NetworkScanUDP": "ntscUDP ptpposcaUDP",
    "NetworkScanTCP": "ntscACK ntscSYN sntscSYN ntscTCP ntscnull ntscXmas ntscFIN dntscSYN",
    "DoS": "DoS distributed_dos ptpDoS sptpDoS DDoS rflat",
}
_NORMAL_PHRASES = (
    "sh flag", "sh flags", " sh f ", "sf flag", "sf flags", "rstr", "rsto", "reset received", "oth flag", "oth flags",
    "showing oth", "rej flag",
)
_DENIAL_PHRASES = (
    "do not treat as", "not a syn flood", "no syn flood", "inconsistent with", "not icmp ping traffic",
    "cannot be classified as a ping flood", "this cannot be confirmed as a ping flood",
)
_ATTACK_STATE_PHRASES = (
    "s0 flag", "s0 state", "flag s0", "s0)", "(s0", "showing s0", "with s0", "state s0",
)
_CONFIRMATION_PHRASES = (
    "tcp syn flood detected", "syn flood attack confirmed", "classic indicators of a syn flood",
)
_QUOTED_ROW = r"tcp\s+[-\w]+\s+[-\w]+\s+[-\w]+\s+[-\w]+\s+(\w+)\s+F\s+F"
_NO_ANOMALIES = "No anomaly data found."
_NO_HEURISTICS = "No heuristic context available."
_PROMPT = (
    "Decide whether the log below shows a %s attack. Use only the evidence given.\n"
    "Name the alert, the anomaly records and heuristics that justify it, and one action.\n"
    "\n"
    "Alerts:\n"
    "%s\n"
    "\n"
    "Anomaly records:\n"
    "%s\n"
    "\n"
    "Heuristics and taxonomy:\n"
    "%s\n"
)

_ALL_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:\\.[\\p{{L}}\\p{{M}}\\p{{N}}_]+)*')"

_SOURCES = {
    "flows": tables.flows_sql("duckdb"),
    "anomalies": tables.anomalies_sql("duckdb"),
    "rules": tables.rules_sql("duckdb"),
    "reports": tables.reports_sql("duckdb"),
}


def _with(body: str, *names: str, **ctes: str) -> str:
    """`body` behind the named source tables and further CTEs."""
    parts = [f"{n} AS ({_SOURCES[n]})" for n in names] + [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _time(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S')"


_ECHO_TYPE = "proto = 'icmp' AND dst_port = 8"
_ECHO_PAIR = "((src_port = 8 AND dst_port = 0) OR (src_port = 0 AND dst_port = 8))"
_HALF_OPEN = "proto = 'tcp' AND conn_state IN ('S0', 'S1', 'REJ', 'RSTO', 'RSTOS0')"
_ID = "line_no, log_name, ts_us, src_ip, dst_ip"
_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_FINE = "concat_ws('_', log_name, dst_ip)"


def _category(code: str) -> str:
    return (
        f"CASE WHEN {code} < 500 THEN 'Suspicious traffic: abnormal TCP flags or well-known malware ports.' "
        f"WHEN {code} < 900 THEN 'Normal protocol traffic seen on well-known ports.' "
        "ELSE 'Traffic anomaly observed on unknown or uncommon ports.' END"
    )


_IP_SET = """
SELECT DISTINCT ip FROM (SELECT srcIP AS ip FROM anomalies WHERE heuristic = 20
                         UNION ALL SELECT dstIP FROM anomalies WHERE heuristic = 20) u WHERE ip IS NOT NULL"""

_HEURISTIC_TEXTS = """
SELECT p_partkey AS text_id,
       concat('Heuristics', chr(10), '* ', CAST(p_partkey % 1000 AS VARCHAR), ': ', p_name, ' ', chr(10), '*bad line', chr(10),
              '* ', CAST(p_size * 20 AS VARCHAR), ':', p_type, chr(10), 'Anomaly taxonomy', chr(10), '* 999: not a heuristic') AS text
FROM part"""

_HEURISTIC_LINES = r"""
SELECT text_id, regexp_extract(entry, '\* (\d+):(.+)', 1) AS code, trim(regexp_extract(entry, '\* (\d+):(.+)', 2)) AS label
FROM (SELECT text_id, unnest(regexp_extract_all(split_part(text, 'Anomaly taxonomy', 1), '\* (\d+):(.+)')) AS entry FROM texts) e"""


def _trailing_floods(keys: str, hub: str, peer: str, threshold: int, window: int) -> str:
    """First trailing window per hub with enough rows and at least three peers."""
    by = f"{keys}, {hub}" if keys else hub
    return f"""
SELECT {by}, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(peers) AS x) d) AS unique_{peer}s,
       n_peers AS {peer}_count, n AS packet_count, start_us, ts_us AS end_us
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts_us, line_no) AS hit
      FROM (SELECT a.ts_us, a.line_no, {', '.join('a.' + c.strip() for c in by.split(','))}, count(*) AS n,
                   count(DISTINCT b.{peer}) AS n_peers, list(b.{peer}) AS peers, min(b.ts_us) AS start_us
            FROM echoes a JOIN echoes b
              ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in by.split(','))}
             AND b.ts_us >= a.ts_us - {window}
             AND (b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.line_no <= a.line_no))
            GROUP BY ALL) w
      WHERE n >= {threshold} AND n_peers >= 3) h
WHERE hit = 1"""


_ECHOES = f"SELECT * FROM flows WHERE proto = 'icmp' AND {_ECHO_PAIR}"

_BURSTS = f"""
SELECT dst_ip, start_us, end_us, CAST(5 AS BIGINT) AS count
FROM (SELECT dst_ip, start_us, ts_us AS end_us, row_number() OVER (PARTITION BY dst_ip ORDER BY ts_us, line_no) AS hit
      FROM (SELECT dst_ip, ts_us, line_no, lag(ts_us, 4) OVER (PARTITION BY dst_ip ORDER BY ts_us, line_no) AS start_us
            FROM flows WHERE {_ECHO_TYPE}) l
      WHERE ts_us - start_us <= {WINDOW}) h
WHERE hit = 1"""

_STARTS = f"""
SELECT dst_ip, min(ts_us) AS from_us
FROM (SELECT a.dst_ip, a.ts_us, a.line_no FROM half_open a JOIN half_open b
        ON a.dst_ip = b.dst_ip AND b.ts_us BETWEEN a.ts_us AND a.ts_us + {WINDOW}
      GROUP BY ALL HAVING count(*) >= 10) s
GROUP BY dst_ip"""


def _described(source: str, hub: str, peer: str, prefix: str) -> str:
    return f"""
SELECT {hub}, min_by(dst_port, (ts_us, line_no)) AS first_port,
       (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(list_sort(list_distinct(list({peer})))[1:10]) AS x) d) AS {prefix}_ips,
       count(DISTINCT {peer}) AS {prefix}_count, count(*) AS syn_count,
       array_to_string(list_sort(list_distinct(list(conn_state))), ',') AS conn_states,
       min(ts_us) AS start_us, max(ts_us) AS end_us, round((max(ts_us) - min(ts_us)) / 1000000.0, 6) AS duration_seconds
FROM {source} GROUP BY {hub}"""


_FLOODS = f"""
SELECT *, CASE WHEN source_count >= 3 THEN 'Distributed SYN Flood (DDoS)' ELSE 'Concentrated SYN Flood' END AS attack_type
FROM ({_described('(SELECT h.* FROM half_open h JOIN starts s ON h.dst_ip = s.dst_ip AND h.ts_us BETWEEN s.from_us AND s.from_us + '
                  + str(WINDOW) + ') w', 'dst_ip', 'src_ip', 'source')}) d"""
_SCANS = f"""
SELECT *, 'SYN Scanning' AS attack_type FROM ({_described('half_open', 'src_ip', 'dst_ip', 'target')}) d
WHERE syn_count >= 10 AND target_count >= 3"""
_SYN = {"half_open": f"SELECT * FROM flows WHERE {_HALF_OPEN}", "starts": _STARTS, "floods": _FLOODS, "scans": _SCANS}

_PING_DOCS = f"""
SELECT 'ping_flood_' || CAST(row_number() OVER (ORDER BY substr(md5(b.dst_ip), 1, 3), b.dst_ip) - 1 AS VARCHAR) AS doc_id,
       'Ping flood detected targeting destination IP ' || b.dst_ip || '. ' || CAST(t.n AS VARCHAR)
       || ' ICMP Echo Requests received between ' || {_time('start_us')} || ' and ' || {_time('end_us')} || '.' AS text,
       CAST(t.n AS VARCHAR) AS total
FROM bursts b JOIN (SELECT dst_ip, count(*) AS n FROM flows WHERE {_ECHO_TYPE} GROUP BY dst_ip) t ON b.dst_ip = t.dst_ip"""


def _spaced(column: str) -> str:
    return f"replace({column}, ',', ', ')"


def _five(column: str) -> str:
    return f"array_to_string(string_split({column}, ',')[1:5], ', ')"


_SYN_DOCS = f"""
SELECT 'syn_flood_' || CAST(row_number() OVER (ORDER BY substr(md5(subject), 1, 3), subject) AS VARCHAR) AS doc_id, text, type
FROM (SELECT 'many_to_one ' || dst_ip AS subject, 'many_to_one' AS type,
             attack_type || ': ' || CAST(syn_count AS VARCHAR) || ' SYN attempts detected to ' || dst_ip || ':'
             || CAST(first_port AS VARCHAR) || ' from ' || CAST(source_count AS VARCHAR) || ' source(s) between '
             || {_time('start_us')} || ' and ' || {_time('end_us')} || '. Connection states: ' || {_spaced('conn_states')}
             || '. Source IPs include: ' || {_five('source_ips')} || '...' AS text
      FROM floods
      UNION ALL
      SELECT 'one_to_many ' || src_ip, 'one_to_many',
             attack_type || ': ' || CAST(syn_count AS VARCHAR) || ' SYN attempts from ' || src_ip || ' targeting '
             || CAST(target_count AS VARCHAR) || ' different IPs between ' || {_time('start_us')} || ' and '
             || {_time('end_us')} || '. Connection states: ' || {_spaced('conn_states')} || '. Targets include: '
             || {_five('target_ips')} || '...'
      FROM scans) a"""


def _unknown(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'unknown')"


_ANOMALY_DOCS = f"""
SELECT 'anomaly_' || CAST(row_no AS VARCHAR) AS doc_id,
       'Anomaly ID anomaly_' || CAST(row_no AS VARCHAR) || ': A ' || {_unknown('label')}
       || ' connection was detected from source IP ' || {_unknown('srcIP')} || ' on port ' || {_unknown('srcPort')}
       || ' to destination IP ' || {_unknown('dstIP')} || ' on port ' || {_unknown('dstPort')}
       || '. This anomaly is categorized as ''' || {_unknown('taxonomy')} || ''' based on heuristic '
       || {_unknown('heuristic')} || '.' AS text,
       {_unknown('dstPort')} AS dst_port, srcIP, dstIP, taxonomy, CAST(heuristic AS VARCHAR) AS heuristic, label
FROM anomalies"""


_META = " || ';' || ".join(
    f"'{c}=' || coalesce(CAST({c} AS VARCHAR), 'unknown')" for c in ("dstIP", "dst_port", "heuristic", "label", "srcIP", "srcPort", "taxonomy")
).replace("'dst_port='", "'dstPort='")


def _features() -> str:
    mean = {f"avg_{c}": f"sum(coalesce({c}, 0)) / CAST(count(*) AS DOUBLE)" for c in
            ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "src_port", "dst_port")}
    exprs = {
        **{f"{p}_ratio": f"sum(CASE WHEN proto = '{p}' THEN 1.0 ELSE 0.0 END) / count(*)" for p in ("icmp", "tcp", "udp")},
        "s0_ratio": "sum(CASE WHEN conn_state = 'S0' THEN 1.0 ELSE 0.0 END) / count(*)",
        "sf_ratio": "sum(CASE WHEN conn_state = 'SF' THEN 1.0 ELSE 0.0 END) / count(*)",
        "failed_conn_ratio": "sum(CASE WHEN conn_state = 'S0' THEN 1.0 ELSE 0.0 END) / count(*)",
        "time_span": "(max(ts_us) - min(ts_us)) / 1000000.0",
        "flow_rate": "count(*) / greatest((max(ts_us) - min(ts_us)) / 1000000.0, 1.0)",
        **mean,
        **{f"total_{c}": f"sum({c})" for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")},
        "byte_ratio": "CAST(sum(orig_bytes) AS DOUBLE) / greatest(sum(resp_bytes), 1)",
        "pkt_ratio": "CAST(sum(orig_pkts) AS DOUBLE) / greatest(sum(resp_pkts), 1)",
        **{f"unique_{c}s": f"count(DISTINCT {c})" for c in ("src_ip", "dst_ip", "src_port", "dst_port")},
        "src_ip_diversity": "count(DISTINCT src_ip) / CAST(count(*) AS DOUBLE)",
        "dst_ip_diversity": "count(DISTINCT dst_ip) / CAST(count(*) AS DOUBLE)",
        "avg_duration": "avg(duration)",
        "max_duration": "max(duration)",
        "min_duration": "min(duration)",
        "total_flows": "count(*)",
    }
    columns = ", ".join(f"CAST({exprs[c]} AS DOUBLE) AS {c}" for c in _FEATURES)
    return f"SELECT log_name, {columns} FROM flows GROUP BY log_name"


def _rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_STATE_LABEL = "SELECT log_name, min_by(conn_state, line_no) = 'S0' AS label FROM flows GROUP BY log_name"
# Lines against time, and without line numbers in every third log.
_RECORDS = """
SELECT log_name, conn_state, row_number() OVER (
         PARTITION BY log_name ORDER BY CASE WHEN (line_no // 108) % 3 <> 0 THEN -line_no END NULLS LAST, ts_us, 'C' || CAST(line_no AS VARCHAR)) AS place
FROM flows"""
_EXPERT = "SELECT concat('conn_log_part_', CAST(doc_id AS VARCHAR)) AS log_name, quality = 1 AS label FROM labels"

_FLOOD_PARTS = {
    "echoes": _ECHOES,
    "ipset": _IP_SET,
    "many": _trailing_floods("log_name", "dst_ip", "src_ip", LOG_THRESHOLD, WINDOW),
    "scan": _trailing_floods("log_name", "src_ip", "dst_ip", LOG_THRESHOLD, WINDOW),
    "matches": f"""
SELECT log_name, CAST(count(*) AS BIGINT) AS matching_anomaly_rows FROM flows
WHERE {_ECHO_PAIR} AND (src_ip IN (SELECT ip FROM ipset) OR dst_ip IN (SELECT ip FROM ipset)) GROUP BY log_name""",
    "flood_labels": """
SELECT log_name, m + a + b > 0 AS ping_flood_detected, a + b AS num_floods, a AS many_to_one, b AS one_to_many,
       n AS matching_anomaly_rows,
       concat_ws('; ', CASE WHEN n >= 5 THEN '≥5 rows have both ICMP echo and heuristic 20 IP (' || CAST(n AS VARCHAR) || ' match)' END,
                 CASE WHEN a > 0 THEN 'many-to-one ICMP ping flood detected (' || CAST(a AS VARCHAR) || ' events)' END,
                 CASE WHEN b > 0 THEN 'one-to-many ICMP ping flood detected (' || CAST(b AS VARCHAR) || ' events)' END) AS detection_reason
FROM (SELECT l.log_name, coalesce(x.matching_anomaly_rows, 0) AS n, CASE WHEN coalesce(x.matching_anomaly_rows, 0) >= 5 THEN 1 ELSE 0 END AS m,
             (SELECT count(*) FROM many q WHERE q.log_name = l.log_name) AS a,
             (SELECT count(*) FROM scan q WHERE q.log_name = l.log_name) AS b
      FROM (SELECT DISTINCT log_name FROM flows) l LEFT JOIN matches x ON l.log_name = x.log_name) c""",
}

_CASE_IPS = "SELECT DISTINCT log_name, unnest([src_ip, dst_ip]) AS ip FROM flows"
_EVIDENCE = """
SELECT DISTINCT c.log_name, i.doc_id
FROM case_ips c JOIN (SELECT DISTINCT unnest([srcIP, dstIP]) AS ip, doc_id FROM adocs) i ON c.ip = i.ip"""
_HEURISTICS = f"""
SELECT code, 'Heuristic ID: ' || code || chr(10) || 'Label: ' || label || chr(10) || 'Category: ' || {_category('CAST(code AS INT)')} AS text
FROM (SELECT CAST(p_partkey % 1000 AS VARCHAR) AS code, min(p_name) AS label FROM part GROUP BY 1) p"""
_PREFIXES = "SELECT * FROM (VALUES {}) v(taxonomy, category)".format(
    ", ".join(f"('{p}', '{c}')" for c, prefixes in _TAXONOMY_GROUPS.items() for p in prefixes.split())
)
_TAXONOMY = """
SELECT DISTINCT e.log_name, a.taxonomy, p.category, 'Category: ' || p.category || chr(10) || 'Prefix: ' || a.taxonomy AS entry
FROM evidence e JOIN adocs a ON e.doc_id = a.doc_id JOIN prefixes p ON a.taxonomy = p.taxonomy"""
_BY_CODE = """
SELECT DISTINCT e.log_name, h.code, h.text AS heuristic_text
FROM evidence e JOIN adocs a ON e.doc_id = a.doc_id JOIN heuristics h ON a.heuristic = h.code"""
_EVIDENCE_PARTS = {
    "adocs": _ANOMALY_DOCS, "case_ips": _CASE_IPS, "evidence": _EVIDENCE, "heuristics": _HEURISTICS, "prefixes": _PREFIXES,
}

# One log line of 22 fields from the flow columns.
_RAW = (
    "concat_ws(chr(9), CAST(ts_us // 1000000 AS VARCHAR) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0'), '-', src_ip, "
    "CAST(src_port AS VARCHAR), dst_ip, CAST(dst_port AS VARCHAR), proto, '-', CAST(duration AS VARCHAR), CAST(orig_bytes AS VARCHAR), "
    "CAST(resp_bytes AS VARCHAR), conn_state, '-', '-', '-', '-', CAST(orig_pkts AS VARCHAR), '-', CAST(resp_pkts AS VARCHAR), '-', '-', '-')"
)
_ALERTS = f"""
SELECT log_name, string_agg(raw, chr(10) ORDER BY line_no) AS alerts
FROM (SELECT log_name, line_no, raw, sum(length(raw) + 1) OVER (PARTITION BY log_name ORDER BY line_no) AS upto,
             sum(length(raw) + 1) OVER (PARTITION BY log_name) - 1 AS whole
      FROM (SELECT log_name, line_no, {_RAW} AS raw, proto = 'tcp' AS wanted,
                   max(CASE WHEN proto = 'tcp' THEN 1 ELSE 0 END) OVER (PARTITION BY log_name) AS any_tcp FROM flows) f
      WHERE wanted OR any_tcp = 0) r
WHERE upto <= 2500 OR whole <= 2500 GROUP BY log_name"""


_WHOLE_LOGS = f"SELECT log_name, string_agg(raw, chr(10)) AS whole FROM (SELECT log_name, {_RAW} AS raw FROM flows) r GROUP BY log_name"


def _words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+(?:\\.[\\p{{L}}\\p{{M}}\\p{{N}}_]+)*'))"


def _ranked(docs: str, pairs: str, k: int) -> str:
    """Pairs (log_name, doc_id) ranked by the summed inverse document frequency of shared words."""
    return f"""
SELECT * FROM (
  SELECT log_name, doc_id, score, row_number() OVER (PARTITION BY log_name ORDER BY score DESC, doc_id) AS place
  FROM (SELECT p.log_name, p.doc_id, round(coalesce(sum(CASE WHEN list_contains(q.words, w.word) THEN i.weight END), 0), 9) AS score
        FROM {pairs} p JOIN (SELECT log_name, {_words('whole')} AS words FROM whole_logs) q ON p.log_name = q.log_name
        JOIN (SELECT doc_id, unnest({_words('text')}) AS word FROM {docs}) w ON p.doc_id = w.doc_id
        JOIN (SELECT word, ln(((SELECT count(*) FROM {docs}) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS weight
              FROM (SELECT unnest({_words('text')}) AS word FROM {docs}) x GROUP BY word) i ON w.word = i.word
        GROUP BY p.log_name, p.doc_id) s) r
WHERE place <= {k}"""


def _prompt_sql() -> str:
    head, *rest = _PROMPT.split("%s")
    literal = [f"'{part}'" for part in (head + "SYN flood" + rest[0], *rest[1:])]
    return (
        f"SELECT a.log_name, {literal[0]} || a.alerts || {literal[1]} || coalesce(x.t, '{_NO_ANOMALIES}') || {literal[2]} "
        f"|| coalesce(h.t, '{_NO_HEURISTICS}') || {literal[3]} AS prompt FROM alerts a "
        "LEFT JOIN (SELECT log_name, string_agg(DISTINCT text, chr(10) ORDER BY text) AS t FROM found b JOIN adocs d ON b.doc_id = d.doc_id GROUP BY log_name) x "
        "ON a.log_name = x.log_name "
        "LEFT JOIN (SELECT log_name, string_agg(DISTINCT doc_id, chr(10) ORDER BY doc_id) AS t FROM context_pairs GROUP BY log_name) h "
        "ON a.log_name = h.log_name"
    )


_COSINE = """
SELECT a.vec_id AS qid, b.vec_id AS did, b.label,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS s
FROM embeddings a, embeddings b"""


def _nearest(k: int, where: str = "true") -> str:
    return f"""
SELECT CAST(qid AS VARCHAR) AS query_id, CAST(did AS VARCHAR) AS doc_id, s AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, CAST(did AS VARCHAR)) AS place FROM cosine WHERE {where}) r
WHERE place <= {k}"""


def _shown_nearest(k: int, where: str = "true") -> str:
    return f"SELECT query_id, doc_id, round(similarity, 6) AS similarity FROM ({_nearest(k, where)}) n"


def _diverse(k: int) -> str:
    """Greedy picks one after the other: each CTE adds the best candidate given the earlier ones."""
    ctes = {"cosine": _COSINE, "candidates": _nearest(3 * k), "pick1": """
SELECT query_id, doc_id, similarity, 1 AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS r FROM candidates) x WHERE r = 1"""}
    for i in range(2, k + 1):
        ctes[f"pick{i}"] = f"""
SELECT * FROM pick{i - 1} UNION ALL
SELECT query_id, doc_id, similarity, {i} AS position FROM (
  SELECT c.query_id, c.doc_id, c.similarity,
         row_number() OVER (PARTITION BY c.query_id
                            ORDER BY round(0.5 * c.similarity - 0.5 * max(m.s), 12) DESC, c.similarity DESC, c.doc_id) AS r
  FROM candidates c JOIN pick{i - 1} p ON c.query_id = p.query_id
  JOIN cosine m ON CAST(m.qid AS VARCHAR) = p.doc_id AND CAST(m.did AS VARCHAR) = c.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM pick{i - 1} t WHERE t.query_id = c.query_id AND t.doc_id = c.doc_id)
  GROUP BY c.query_id, c.doc_id, c.similarity) x WHERE r = 1"""
    return _with(f"SELECT query_id, doc_id, round(similarity, 6) AS similarity, position FROM pick{k}", **ctes)


def _contains_any(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_STRIPPED = r"regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')"


def _first_sentence() -> str:
    return (
        f"CASE WHEN {_STRIPPED} = '' THEN NULL ELSE "
        f"NOT contains(lower(split_part(replace({_STRIPPED}, 'conn.log', 'conn_log'), '.', 1)), 'no') END"
    )


_STATES = """
SELECT log_name, min_by(conn_state, line_no) AS state FROM flows
WHERE conn_state IN ('S0', 'SH', 'SF', 'RSTR', 'RSTO', 'OTH', 'REJ', 'RSTOS0', 'RSTRH') GROUP BY log_name"""


def _cascade(state: str) -> str:
    low = f"lower({_STRIPPED})"
    quoted = f"upper(regexp_extract(text, '{_QUOTED_ROW}', 1))"
    return f"""
CASE WHEN {_STRIPPED} = '' THEN NULL WHEN {state} = 'S0' THEN true WHEN {state} IS NOT NULL THEN false
     WHEN {quoted} = 'S0' THEN true WHEN {quoted} IN ('SH', 'SF', 'RSTR', 'RSTO', 'OTH', 'REJ') THEN false
     WHEN {_contains_any(low, _NORMAL_PHRASES)} THEN false
     WHEN {_contains_any(low, _DENIAL_PHRASES)} THEN false
     WHEN {_contains_any(low, _ATTACK_STATE_PHRASES)} THEN true
     WHEN {_contains_any(low, _CONFIRMATION_PHRASES)} THEN true ELSE false END AS verdict"""


_OUTCOMES = f"""
SELECT l.log_name, l.label, r.verdict,
       CASE WHEN r.log_name IS NULL THEN 'missing' WHEN r.verdict IS NULL THEN 'undecided' WHEN l.label AND r.verdict THEN 'TP'
            WHEN l.label THEN 'FN' WHEN r.verdict THEN 'FP' ELSE 'TN' END AS outcome
FROM state_labels l LEFT JOIN (SELECT log_name, {_first_sentence()} AS verdict FROM reports) r ON l.log_name = r.log_name"""


def _quality(source: str, key: str = "") -> str:
    """Counts and zero-safe quality of (label, prediction) rows."""
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    return f"""
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score
FROM (SELECT *, tp + tn + fp + fn AS total,
             CASE WHEN tp + tn + fp + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) ELSE 0 END AS accuracy,
             CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall
      FROM (SELECT {lead}count(*) FILTER (label AND prediction = 1) AS tp, count(*) FILTER (NOT label AND prediction = 0) AS tn,
                   count(*) FILTER (NOT label AND prediction = 1) AS fp, count(*) FILTER (label AND prediction = 0) AS fn
            FROM {source} s {group}) c) q"""


def _area(source: str, key: str) -> str:
    """AUC as the share of (attack, normal) pairs in the right order, ties counting half."""
    return f"""
SELECT {key}, sum(p) AS positives, sum(n) AS negatives,
       CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (above + p / 2.0)) / (sum(p) * sum(n)) ELSE 0 END AS auc
FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
      FROM (SELECT {key}, score, CAST(count(*) FILTER (label) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS n
            FROM {source} s GROUP BY {key}, score) g) w
GROUP BY {key}"""


_RULE_PING = """
SELECT log_name, icmp_count, icmp_ratio, time_span, total_flows,
       (CASE WHEN icmp_count >= 5 THEN 1 ELSE 0 END) + (CASE WHEN icmp_ratio >= 0.3 THEN 1 ELSE 0 END)
       + (CASE WHEN time_span > 0 AND time_span <= {window} THEN 1 ELSE 0 END) AS rules_matched
FROM (SELECT log_name, count(*) FILTER (proto = 'icmp') AS icmp_count, count(*) FILTER (proto = 'icmp') / CAST(count(*) AS DOUBLE) AS icmp_ratio,
             (max(ts_us) - min(ts_us)) / CAST(1000000 AS DOUBLE) AS time_span, count(*) AS total_flows FROM flows GROUP BY log_name) f"""
_RULE_SYN = """
SELECT *, (CASE WHEN s0_count >= 5 THEN 1 ELSE 0 END) + (CASE WHEN s0_ratio >= {ratio} THEN 1 ELSE 0 END)
       + (CASE WHEN syn_rate >= 10 THEN 1 ELSE 0 END) AS rules_matched
FROM (SELECT log_name, s0_count, CASE WHEN tcp_count > 0 THEN CAST(s0_count AS DOUBLE) / tcp_count ELSE 0 END AS s0_ratio, tcp_count,
             tcp_count / greatest(time_span, CAST(1 AS DOUBLE)) AS syn_rate, time_span
      FROM (SELECT log_name, count(*) FILTER (proto = 'tcp' AND conn_state = 'S0') AS s0_count, count(*) FILTER (proto = 'tcp') AS tcp_count,
                   (max(ts_us) - min(ts_us)) / CAST(1000000 AS DOUBLE) AS time_span FROM flows GROUP BY log_name) g) f"""


def _rule_rows(labels: str, rule: str) -> str:
    return (
        f"SELECT l.log_name, l.label, CASE WHEN coalesce(r.rules_matched, 0) >= 2 THEN 1 ELSE 0 END AS prediction, "
        f"coalesce(r.rules_matched, 0) / CAST(3 AS DOUBLE) AS score FROM ({labels}) l LEFT JOIN ({rule}) r ON l.log_name = r.log_name"
    )


_PING_DEFAULT, _SYN_DEFAULT = _RULE_PING.format(window=60), _RULE_SYN.format(ratio=0.5)
_DETECTED = "rules_matched >= 2 AS detected, round(rules_matched / CAST(3 AS DOUBLE), 6) AS confidence, rules_matched"
_MODEL_ROWS = f"""
SELECT 'rule_ping' AS model, label, prediction, score FROM ({_rule_rows('SELECT * FROM state_labels', _PING_DEFAULT)}) a
UNION ALL SELECT 'rule_syn', label, prediction, score FROM ({_rule_rows('SELECT * FROM state_labels', _SYN_DEFAULT)}) b
UNION ALL SELECT 'report', label, CAST(verdict AS INT), CAST(CAST(verdict AS INT) AS DOUBLE) FROM outcomes WHERE verdict IS NOT NULL"""


def _scenario_rows() -> str:
    parts = []
    for attack, labels, rule in (
        ("ping", "SELECT log_name, ping_flood_detected AS label FROM flood_labels", _PING_DEFAULT),
        ("syn", "SELECT * FROM state_labels", _SYN_DEFAULT),
    ):
        for source, chosen in (("automatic", labels), ("expert", _EXPERT)):
            parts.append(
                f"SELECT '{attack}' AS attack, '{source}' AS label_source, label, prediction FROM ({_rule_rows(chosen, rule)}) x"
            )
    return " UNION ALL ".join(parts)


_PERCENT = ", ".join(
    f"round(max(CASE WHEN label_source = '{s}' THEN {m} END) * 100.0, 2) AS {s}_{m}_pct"
    for s in ("automatic", "expert")
    for m in ("accuracy", "precision", "recall", "f1_score")
)


def _profile(key: str) -> str:
    lead = f"{key}, " if key else ""
    shares = ", ".join(f"round({c} * 100.0 / total, 6) AS {c}_pct" for c in ("tcp", "icmp", "udp", "other"))
    return f"""
SELECT *, {shares}, round(flood_state * 100.0 / nullif(tcp, 0), 6) AS flood_state_pct
FROM (SELECT {lead}count(*) AS total, count(*) FILTER (proto = 'tcp') AS tcp, count(*) FILTER (proto = 'icmp') AS icmp,
             count(*) FILTER (proto = 'udp') AS udp, count(*) FILTER (proto NOT IN ('tcp', 'icmp', 'udp')) AS other,
             count(*) FILTER ({_HALF_OPEN}) AS flood_state FROM flows {'GROUP BY ' + key if key else ''}) p"""


_CLASS = (
    "CASE WHEN proto <> 'tcp' THEN CASE WHEN proto IN ('icmp', 'udp') THEN proto ELSE 'other' END "
    "WHEN conn_state IN ('S0', 'S1', 'REJ', 'RSTO', 'RSTOS0') THEN 'tcp_flood' "
    "WHEN conn_state IN ('SF', 'S2', 'S3', 'OTH', 'RSTR') THEN 'tcp_normal' ELSE 'tcp_other' END"
)

_REPORT_FIELDS = r"""
SELECT log_name,
       nullif(trim(regexp_extract(text, '(?i)flood alert:[ \t]*([^\n]*)', 1)), '') AS alert,
       nullif(trim(regexp_extract(text, '(?i)justified by anomaly:[ \t]*([^\n]*)', 1)), '') AS justification,
       nullif(trim(regexp_extract(text, '(?i)action:[ \t]*([^\n]*)', 1)), '') AS action,
       contains(text, 'UNDECIDABLE') AS abstained,
       array_to_string(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), ',') AS ips,
       CAST(nullif(regexp_extract(text, '(?i)\bport\s+(\d+)', 1), '') AS INT) AS port,
       nullif(regexp_extract(text, '\b(S0|S1|SF|REJ|S2|S3|RSTO|RSTR|RSTOS0|RSTRH|SH|SHR|OTH)\b', 1), '') AS state
FROM reports"""


def _query_filters(text: str) -> dict[str, str]:
    low = f"lower({text})"
    words = ("DoS", "DDoS", "PortScan", "HTTP", "NetworkScan", "AlphaFlow", "MultiPoints")
    cases = " ".join(f"WHEN contains({low}, '{w.lower()}') THEN '{w}'" for w in words)
    return {
        "dstPort": f"nullif(regexp_extract({text}, '(?i)\\bport\\s+(\\d+)', 1), '')",
        "taxonomy": f"CASE {cases} END",
        "label": f"CASE WHEN contains({low}, 'suspicious') THEN 'suspicious' WHEN contains({low}, 'anomalous') THEN 'anomalous' END",
    }


_QUERY_TEXT = (
    "(CASE conn_state WHEN 'S0' THEN 'DDoS alert on Port ' WHEN 'SF' THEN 'Anomalous HTTP flood, port  ' "
    "WHEN 'REJ' THEN 'Suspicious portscan, anomalous port ' WHEN 'RSTO' THEN 'NetworkScan of report ' "
    "ELSE 'tcp traffic to ' END || CAST(dst_port AS VARCHAR) || ' from ' || src_ip)"
)

_GATE = f"""
WITH cosine AS ({_COSINE}), hits AS ({_nearest(18)}),
docs AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, regexp_extract_all(text, '{_IPV4}') AS ips,
                {', '.join(f'{e} AS {n}' for n, e in _query_filters('text').items())} FROM documents),
best AS (SELECT h.query_id AS case_id, max(h.similarity) AS best,
                count(*) FILTER (h.similarity >= 0.3 AND list_has_any(q.ips, d.ips)) AS kept
         FROM hits h JOIN docs q ON h.query_id = q.case_id JOIN docs d ON h.doc_id = d.case_id
         WHERE h.query_id <> h.doc_id GROUP BY h.query_id),
gated AS (SELECT d.*, CASE WHEN len(ips) > 0 THEN greatest(coalesce(best, 0), 0) ELSE 0 END AS max_similarity,
                 CASE WHEN len(ips) > 0 THEN coalesce(kept, 0) ELSE 0 END AS kept_docs
          FROM docs d LEFT JOIN best b ON d.case_id = b.case_id)
SELECT case_id, CAST(max_similarity AS DOUBLE) AS max_similarity, kept_docs, max_similarity < 0.3 AND kept_docs = 0 AS abstain,
       CASE WHEN max_similarity < 0.3 AND kept_docs = 0 THEN
         '⚠️ **UNDECIDABLE** - Insufficient evidence to provide reliable analysis.' || chr(10) || chr(10)
         || '**Reason:** Maximum similarity score (' || printf('%.2f', CAST(max_similarity AS DOUBLE)) || ') is below threshold (0.3).' || chr(10)
         || '**Missing context:** ' || CASE WHEN len(ips) = 0 THEN 'no specific IP addresses identified'
              ELSE 'no anomaly records found for IPs: ' || array_to_string(ips, ', ') END
         || CASE WHEN coalesce(dstPort, taxonomy, label) IS NULL THEN '' ELSE '; with filters: {{' || concat_ws(', ',
              '''dstPort'': ''' || dstPort || '''', '''taxonomy'': ''' || taxonomy || '''', '''label'': ''' || label || '''') || '}}' END
         || '.' || chr(10) || chr(10) || '**Recommendation:** Please provide:' || chr(10) || '  - More specific IP addresses or timestamps' || chr(10)
         || '  - Additional context about the suspicious activity' || chr(10) || '  - Relevant log entries or anomaly records' || chr(10)
       END AS message
FROM gated"""

_WILDCARD = f"""
SELECT {_ID}, src_port, dst_port FROM flows f
WHERE EXISTS (SELECT 1 FROM rules r WHERE (r.srcIP IS NULL OR r.srcIP = f.src_ip) AND (r.dstIP IS NULL OR r.dstIP = f.dst_ip)
              AND (r.srcPort IS NULL OR r.srcPort = CAST(f.src_port AS VARCHAR)) AND (r.dstPort IS NULL OR r.dstPort = CAST(f.dst_port AS VARCHAR)))"""

_UNIQUE_IDS = """
WITH existing AS (
  SELECT CASE WHEN c_nationkey < 8 THEN 'anomaly_' || CAST(c_custkey AS VARCHAR)
              WHEN c_nationkey < 16 THEN 'anomaly_' || CAST(c_custkey AS VARCHAR) || '_2'
              ELSE 'anomaly_' || CAST(c_custkey AS VARCHAR) || '_1' END AS doc_id FROM customer
  UNION ALL SELECT 'anomaly_' || CAST(c_custkey AS VARCHAR) || '_1' FROM customer WHERE c_acctbal < 2000),
fresh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS place
          FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'anomaly_hot' WHEN 1 THEN 'anomaly_hot_' || CAST(o_custkey * 2 AS VARCHAR)
                       ELSE 'anomaly_' || CAST(o_custkey AS VARCHAR) END AS doc_id, o_orderkey AS row_no FROM orders) o),
given AS (SELECT doc_id FROM existing UNION SELECT doc_id FROM fresh),
forms AS (SELECT regexp_extract(doc_id, '^(.*)_([1-9][0-9]*)$', 1) AS base, count(*) AS t FROM given GROUP BY 1),
bases AS (SELECT f.base, n, coalesce(t, 0) AS t FROM (SELECT doc_id AS base, count(*) AS n FROM fresh GROUP BY doc_id) f LEFT JOIN forms g ON f.base = g.base),
free AS (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY i) AS place
         FROM (SELECT base, i, CASE WHEN i = 0 THEN base ELSE base || '_' || CAST(i AS VARCHAR) END AS name
               FROM (SELECT base, unnest(range(0, n + t + 2)) AS i FROM bases) g) c
         WHERE name NOT IN (SELECT doc_id FROM existing) AND (i = 0 OR name NOT IN (SELECT doc_id FROM fresh)))
SELECT f.doc_id, f.row_no, x.name AS unique_id FROM fresh f JOIN free x ON f.doc_id = x.base AND f.place = x.place"""

_CAPPED = """
SELECT d.doc_id, length(t) AS n_chars, md5(t) AS digest
FROM (SELECT doc_id, CASE WHEN length(text) <= 2500 THEN text
                          ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY i)
                                         FROM (SELECT line, i, sum(length(line) + 1) OVER (ORDER BY i) AS upto
                                               FROM (SELECT unnest(string_split(text, chr(10))) AS line,
                                                            generate_subscripts(string_split(text, chr(10)), 1) AS i) l) u
                                         WHERE upto <= 2500), '') END AS t FROM documents) d"""

_METRICS = ("accuracy", "precision", "recall", "f1_score")
_INTERVAL_COLUMNS = ", ".join(f"{c}_{end}" for c in _METRICS for end in ("low", "high"))
# Poisson draws of mean 1 from 32 bits: one for each value of the distribution function that is not above the draw.
_POISSON = " + ".join(
    f"CAST(u >= {int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32)} AS INT)" for k in range(12)
)

CHECKS: dict[str, str] = {
    "conn_log_parse": _with("SELECT * FROM flows", "flows"),
    "lenient_scan": _with(
        "SELECT line_no, log_name, ts_us, src_ip, dst_ip, proto, duration, orig_bytes, resp_bytes, conn_state FROM flows WHERE line_no % 5 <> 0", "flows"
    ),
    "anomaly_file_scan": _with("SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, * EXCLUDE (row_no) FROM anomalies", "anomalies"),
    "rule_file_scan": _with("SELECT srcIP, srcPort, dstIP, dstPort, count(*) AS n FROM rules GROUP BY ALL", "rules"),
    "report_file_scan": _with("SELECT log_name, text FROM reports", "flows", "reports"),
    "report_sink": _with("SELECT log_name, text FROM reports", "flows", "reports"),
    "metric_files": _with(
        f"SELECT form, proto, tp, tn, fp, fn, total, {_rounded(*_METRICS)} FROM q, (VALUES ('csv'), ('json')) f(form)", "flows",
        said="SELECT proto, conn_state = 'S0' AS label, CAST(dst_port = 80 AS INT) AS prediction FROM flows", q=_quality("said", "proto"),
    ),
    "result_file_scan": _with(
        "SELECT 'rule_based' AS model_type, proto AS attack_type, round(count(*) FILTER (conn_state = 'S0') / CAST(count(*) AS DOUBLE), 6) AS accuracy, "
        "count(*) FILTER (conn_state = 'S0') AS tp, count(*) FILTER (conn_state <> 'S0') AS tn, CAST(0 AS BIGINT) AS fp, CAST(1 AS BIGINT) AS fn, "
        "count(*) AS total_samples FROM flows GROUP BY proto", "flows",
    ),
    "filtered_flow_file": _with(_WILDCARD, "flows", "rules"),
    "kb_collection_read": _with(
        "SELECT 'heuristic_info_txt4' AS collection, 'heuristic_' || code AS doc_id, count(*) AS n FROM (SELECT DISTINCT code, label FROM lines) d GROUP BY ALL",
        texts=_HEURISTIC_TEXTS, lines=_HEURISTIC_LINES,
    ),
    "distance_similarity": "SELECT e.vec_id, round(1 - list_sum(list_transform(generate_series(1, len(e.embedding)), "
    "lambda i: (e.embedding[i]::DOUBLE - f.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - f.embedding[i]::DOUBLE))) / 2, 5) AS similarity "
    "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) f",
    "rule_override": _with(
        "SELECT 'ping' AS rules, log_name, m >= 2 AS detected, m AS rules_matched FROM (SELECT log_name, CAST(icmp >= 30 AS INT) + CAST(icmp >= 0.2 * n AS INT) "
        "+ CAST(span > 0 AND span <= 43200 AS INT) AS m FROM logs) p UNION ALL "
        "SELECT 'syn', log_name, m >= 2, m FROM (SELECT log_name, CAST(s0 >= 12 AS INT) + CAST(tcp > 0 AND s0 >= 0.15 * tcp AS INT) "
        "+ CAST(tcp / greatest(span, 1) >= 0.001 AS INT) AS m FROM logs) s", "flows",
        logs="SELECT log_name, count(*) AS n, count(*) FILTER (proto = 'icmp') AS icmp, count(*) FILTER (proto = 'tcp') AS tcp, "
        "count(*) FILTER (proto = 'tcp' AND conn_state = 'S0') AS s0, (max(ts_us) - min(ts_us)) / 1000000.0 AS span FROM flows GROUP BY log_name",
    ),
    "ml_saved_model": _with("SELECT DISTINCT log_name, true AS same FROM flows", "flows"),
    "anomaly_ip_set": _with(_IP_SET, "anomalies"),
    "heuristic_parse": _with(f"SELECT *, {_category('CAST(code AS INT)')} AS category FROM lines", texts=_HEURISTIC_TEXTS, lines=_HEURISTIC_LINES),
    "heuristic_docs": _with(
        f"SELECT 'heuristic_' || code AS doc_id, 'Heuristic ID: ' || code || chr(10) || 'Label: ' || label || chr(10) || 'Category: ' "
        f"|| {_category('CAST(code AS INT)')} AS text, count(*) AS n FROM lines GROUP BY ALL",
        texts=_HEURISTIC_TEXTS, lines=_HEURISTIC_LINES,
    ),
    "label_line_parse": "SELECT concat('conn_log_part_', CAST(doc_id AS VARCHAR)) AS log_name, quality = 1 AS label FROM labels WHERE toxic <> 1",
    "label_map_parse": """
SELECT concat('conn_log_part_', CAST(doc_id AS VARCHAR)) AS log_name, quality = 1 AS label, CAST(NULL AS VARCHAR) AS error FROM labels
UNION ALL SELECT concat('broken_', CAST(doc_id AS VARCHAR)), false, 'unreadable' FROM labels""",
    "label_object_split": "SELECT concat('conn_log_part_', CAST(doc_id AS VARCHAR)) AS log_name, quality = 1 AS label, 'a \"}{\" b' AS type, "
    "CAST(toxic AS INTEGER) AS packet_count FROM labels",
    "split_log_parts": _with(
        "SELECT log_name, part, 'conn_log_part_' || CAST(part AS VARCHAR) AS part_name, count(*) AS n, min(ts_us) AS min_ts_us, "
        "max(ts_us) AS max_ts_us FROM (SELECT log_name, ts_us, (row_number() OVER (PARTITION BY log_name ORDER BY line_no) - 1) // 108 + 1 AS part "
        "FROM (SELECT 'capture_' || CAST((line_no // 1000) % 3 AS VARCHAR) AS log_name, line_no, ts_us FROM flows) l) r "
        "GROUP BY log_name, part", "flows",
    ),
    "kb_upsert": _with(
        "SELECT 'anomaly_csv_logsc01' AS collection, doc_id, text, meta FROM adocs WHERE doc_id NOT IN (SELECT doc_id FROM fresh) "
        "UNION ALL SELECT 'anomaly_csv_logsc01', doc_id, text, meta FROM fresh", "anomalies",
        adocs=f"SELECT a.*, {_META} AS meta FROM ({_ANOMALY_DOCS.replace('dst_port,', 'dst_port, srcPort,')}) a",
        fresh="SELECT 'anomaly_' || CAST(s_suppkey - s_suppkey % 3 AS VARCHAR) AS doc_id, max_by(s_name, s_suppkey) AS text, "
        "'no=' || CAST(max(s_suppkey) AS VARCHAR) AS meta FROM supplier GROUP BY 1",
    ),
    "kb_snapshots": _with(
        "SELECT 'anomaly_csv_logsc01' AS collection, doc_id, text, meta FROM adocs WHERE doc_id NOT IN (SELECT doc_id FROM fresh) "
        "UNION ALL SELECT 'anomaly_csv_logsc01', doc_id, text, meta FROM fresh", "anomalies",
        adocs=f"SELECT a.*, {_META} AS meta FROM ({_ANOMALY_DOCS.replace('dst_port,', 'dst_port, srcPort,')}) a",
        fresh="SELECT 'anomaly_' || CAST(s_suppkey - s_suppkey % 3 AS VARCHAR) AS doc_id, max_by(s_name, s_suppkey) AS text, "
        "'no=' || CAST(max(s_suppkey) AS VARCHAR) AS meta FROM supplier GROUP BY 1",
    ),
    "header_scan": _with(
        "SELECT line_no, src_ip AS orig_h, dst_ip AS resp_h, CASE WHEN (line_no // 108) % 2 = 0 THEN proto END AS proto FROM flows", "flows"
    ),
    "label_file_round_trip": _with(
        "SELECT f.log_name, NOT broken AND ping_flood_detected AS label, CASE WHEN NOT broken THEN CAST(num_floods AS INT) END AS num_floods, "
        "CASE WHEN NOT broken THEN CAST(many_to_one AS INT) END AS n_many, CASE WHEN NOT broken THEN CAST(one_to_many AS INT) END AS n_scans, "
        "CASE WHEN NOT broken THEN CAST(matching_anomaly_rows AS INT) END AS matching_anomaly_rows, "
        "CASE WHEN NOT broken THEN detection_reason END AS detection_reason, CASE WHEN broken THEN 'unreadable' END AS error "
        "FROM (SELECT *, CAST(regexp_extract(log_name, '([0-9]+)$', 1) AS INT) % 7 = 0 AS broken FROM flood_labels) f",
        "flows", "anomalies", **_FLOOD_PARTS,
    ),
    "icmp_echo_v1": _with(f"SELECT {_ID} FROM flows WHERE {_ECHO_TYPE}", "flows"),
    "icmp_echo_v2": _with(f"SELECT {_ID} FROM flows WHERE proto = 'icmp' AND {_ECHO_PAIR}", "flows"),
    "syn_state_filter": _with(f"SELECT {_ID}, conn_state FROM flows WHERE {_HALF_OPEN}", "flows"),
    "case_lines_with_fallback": _with(
        "SELECT log_name, line_no, proto FROM cases c WHERE proto = 'icmp' OR NOT EXISTS "
        "(SELECT 1 FROM cases x WHERE x.log_name = c.log_name AND x.proto = 'icmp')",
        "flows", cases=f"SELECT {_FINE} AS log_name, line_no, proto FROM flows",
    ),
    "kb_metadata_filter": _with("SELECT doc_id, text FROM adocs WHERE taxonomy = 'ptpDoS' AND label = 'anomalous'", "anomalies", adocs=_ANOMALY_DOCS),
    "heuristic_category": f"SELECT o_orderkey, o_orderkey % 1000 AS code, {_category('(o_orderkey % 1000)')} AS category FROM orders",
    "query_filter_parse": _with(
        "SELECT line_no, " + ", ".join(f"{e} AS {n}" for n, e in _query_filters(_QUERY_TEXT).items()) + " FROM flows", "flows"
    ),
    "echo_validation_band": _with(
        "SELECT 'capture' AS log_name, src_ip, n AS echo_count, known AS corroborated, "
        "CASE WHEN n >= 10 THEN 'flood' WHEN n >= 5 AND known THEN 'review' ELSE 'none' END AS band FROM "
        "(SELECT src_ip, count(*) AS n, src_ip IN (SELECT ip FROM ipset) AS known FROM echoes GROUP BY src_ip) e",
        "flows", "anomalies", ipset=_IP_SET, echoes=_ECHOES,
    ),
    "ping_burst": _with(_BURSTS, "flows"),
    "stream_ping_burst": _with(_BURSTS, "flows"),
    "stream_intake": _with("SELECT * EXCLUDE (log_name, line_no) FROM flows", "flows"),
    "syn_many_to_one": _with("SELECT * FROM floods", "flows", **_SYN),
    # A scan has many ports; only floods report the port of their first row.
    "syn_one_to_many": _with("SELECT * EXCLUDE (first_port) FROM scans", "flows", **_SYN),
    "ping_many_to_one": _with(_trailing_floods("", "dst_ip", "src_ip", 10, WINDOW), "flows", echoes=_ECHOES),
    "ping_one_to_many": _with(_trailing_floods("", "src_ip", "dst_ip", LOG_THRESHOLD, 20 * WINDOW), "flows", echoes=_ECHOES),
    "protocol_profile": _with(_profile("log_name"), "flows"),
    "protocol_profile_total": _with(_profile(""), "flows"),
    "tcp_state_census": _with(
        "SELECT class, CAST(NULL AS VARCHAR) AS state, count(*) AS n FROM c GROUP BY class UNION ALL SELECT 'total', NULL, count(*) FROM c "
        "UNION ALL SELECT class, conn_state, count(*) FROM c WHERE class = 'tcp_other' GROUP BY class, conn_state",
        "flows", c=f"SELECT {_CLASS} AS class, conn_state FROM flows",
    ),
    "echo_count_by_dst": _with(f"SELECT dst_ip, count(*) AS echo_requests FROM flows WHERE {_ECHO_TYPE} GROUP BY dst_ip", "flows"),
    "flow_features": _with(f"SELECT log_name, {_rounded(*_FEATURES)} FROM features", "flows", features=_features()),
    "flow_features_from_state": _with(
        "SELECT log_name, " + ", ".join(f"true AS {x}" if x.startswith("unique") or x.endswith("diversity") else f"round({x}, 6) AS {x}" for x in _FEATURES)
        + " FROM features", "flows", features=_features(),
    ),
    "flow_features_default": _with(
        "SELECT c.log_name, " + ", ".join(f"round(coalesce({x}, 0), 6) AS {x}" for x in _FEATURES)
        + " FROM (SELECT concat('conn_log_part_', CAST(doc_id AS VARCHAR)) AS log_name FROM documents) c LEFT JOIN features f ON c.log_name = f.log_name",
        "flows", features=_features(),
    ),
    "feature_dataset": _with(
        f"SELECT f.log_name, CAST(l.label AS INT) AS label, {_rounded(*_FEATURES)} "
        "FROM features f JOIN state_labels l ON f.log_name = l.log_name", "flows", features=_features(), state_labels=_STATE_LABEL,
    ),
    "label_counts": _with(
        "SELECT ping_flood_detected AS detected, count(*) AS n FROM flood_labels GROUP BY 1", "flows", "anomalies", **_FLOOD_PARTS
    ),
    "wildcard_rule_filter": _with(_WILDCARD, "flows", "rules"),
    "anomaly_ip_match_count": _with("SELECT * FROM matches", "flows", "anomalies", ipset=_IP_SET, matches=_FLOOD_PARTS["matches"]),
    "ping_flood_labels": _with("SELECT * FROM flood_labels", "flows", "anomalies", **_FLOOD_PARTS),
    "flood_details": _with(
        f"SELECT log_name, 'many_to_one' AS type, dst_ip, unique_src_ips, CAST(src_ip_count AS INT) AS src_ip_count, "
        f"CAST(packet_count AS INT) AS packet_count, {_time('start_us')} AS start_time, {_time('end_us')} AS end_time, "
        f"CAST(NULL AS VARCHAR) AS src_ip, CAST(NULL AS VARCHAR) AS unique_dst_ips, CAST(NULL AS INT) AS dst_ip_count FROM many "
        f"UNION ALL SELECT log_name, 'one_to_many', NULL, NULL, NULL, CAST(packet_count AS INT), {_time('start_us')}, {_time('end_us')}, "
        f"src_ip, unique_dst_ips, CAST(dst_ip_count AS INT) FROM scan", "flows", "anomalies", **_FLOOD_PARTS,
    ),
    "state_label": _with(_STATE_LABEL, "flows"),
    "state_label_record_order": _with(
        "SELECT log_name, arg_min(conn_state, place) = 'S0' AS label FROM records GROUP BY log_name", "flows", records=_RECORDS
    ),
    "decisive_state_record_order": _with(
        "SELECT log_name, arg_min(conn_state, place) AS decisive_state FROM records "
        "WHERE conn_state IN ('S0', 'SH', 'SF', 'RSTR', 'RSTO', 'OTH', 'REJ', 'RSTOS0', 'RSTRH') GROUP BY log_name", "flows", records=_RECORDS,
    ),
    "eval_join_report": _with(_OUTCOMES, "flows", "reports", state_labels=_STATE_LABEL),
    "eval_join_baseline": _with(f"SELECT log_name, label, prediction, round(score, 6) AS score FROM ({_rule_rows(_EXPERT, _PING_DEFAULT)}) r", "flows"),
    "pending_cases": _with("SELECT DISTINCT log_name FROM flows WHERE log_name NOT IN (SELECT log_name FROM reports)", "flows", "reports"),
    "case_batches": _with(
        "SELECT log_name, (row_number() OVER (ORDER BY substr(md5(log_name), 1, 3), log_name) - 1) // 500 + 1 AS batch "
        f"FROM (SELECT DISTINCT {_FINE} AS log_name FROM flows) c", "flows",
    ),
    "extract_ips": f"SELECT doc_id, len(ips) AS n_ips, array_to_string(ips, ',') AS ips FROM (SELECT doc_id, regexp_extract_all(text, '{_IPV4}') AS ips FROM documents) d",
    "ping_alert_docs": _with(_PING_DOCS, "flows", bursts=_BURSTS),
    "syn_alert_docs": _with(_SYN_DOCS, "flows", **_SYN),
    "anomaly_docs": _with("SELECT doc_id, text, dst_port FROM adocs", "anomalies", adocs=_ANOMALY_DOCS),
    "unique_doc_ids": _UNIQUE_IDS,
    "cap_lines": _CAPPED,
    "alert_sections": _with(_ALERTS, "flows"),
    "ip_evidence_join": _with("SELECT * FROM evidence", "flows", "anomalies", **_EVIDENCE_PARTS),
    "heuristic_evidence_join": _with(_BY_CODE, "flows", "anomalies", **_EVIDENCE_PARTS),
    "heuristic_token_join": _with(
        "SELECT DISTINCT e.log_name, h.code, h.text AS heuristic_text FROM evidence e JOIN codes c ON e.doc_id = c.doc_id "
        "JOIN heuristics h ON c.code = h.code", "flows", "anomalies", **_EVIDENCE_PARTS,
        codes=r"SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{3,4}\b')) AS code FROM adocs",
    ),
    "taxonomy_category_join": _with(_TAXONOMY, "flows", "anomalies", **_EVIDENCE_PARTS),
    "vector_topk": _with(_shown_nearest(6), cosine=_COSINE),
    "vector_topk_indexed": "SELECT count(*) AS n_queries, 6 * count(*) AS n_rows, 6 * count(*) AS wanted, true AS recall_reached FROM embeddings",
    "vector_topk_filtered": _with(_shown_nearest(6, "label = 3"), cosine=_COSINE),
    "vector_topk_query_filter": _with(_shown_nearest(6, "qid % 2 = 1 OR label = qid % 5"), cosine=_COSINE),
    "vector_mmr": _diverse(4),
    "evidence_gate": _GATE,
    "lexical_rerank": _with(
        "SELECT log_name, doc_id, round(score, 6) AS score FROM best", "flows", "anomalies", **_EVIDENCE_PARTS, whole_logs=_WHOLE_LOGS, best=_ranked("adocs", "evidence", 6)
    ),
    "bm25_topk": _with(
        "SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM scored) s WHERE rn <= 10",
        tf=f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_ALL_WORDS.format('text')}) AS token FROM documents) t GROUP BY ALL",
        lengths="SELECT doc_id, sum(tf)::DOUBLE AS length FROM tf GROUP BY doc_id",
        one="SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, sum(length) AS w FROM lengths",
        df="SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY token",
        impact="SELECT tf.doc_id, tf.token, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE "
        "/ (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + length * 0.75::DOUBLE * n / w)) * 10000)::BIGINT AS impact "
        "FROM tf JOIN lengths USING (doc_id) JOIN df USING (token), one",
        asked=f"SELECT DISTINCT item_id AS query_id, unnest({_ALL_WORDS.format('text')}) AS token FROM benchmark",
        scored="SELECT query_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impact USING (token) GROUP BY ALL",
    ),
    "evidence_within_budget": _with(
        "SELECT log_name, text, score FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY log_name ORDER BY score DESC, text) AS upto FROM texts) t WHERE upto - 1 <= 300",
        "flows", "anomalies", **_EVIDENCE_PARTS,
        texts="SELECT e.log_name, a.text, max(CAST(h.heuristic AS DOUBLE)) AS score FROM evidence e JOIN adocs a ON a.doc_id = e.doc_id "
        "JOIN anomalies h ON a.doc_id = 'anomaly_' || CAST(h.row_no AS VARCHAR) GROUP BY ALL",
    ),
    "tfidf_vectors": _with(
        "SELECT doc_id, count(*) AS n_terms, round(max(w / nullif(length, 0)), 6) AS max_weight, round(sum(w / nullif(length, 0)), 4) AS sum_weight "
        "FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS length FROM weighted) l GROUP BY doc_id",
        tf="SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), "
        "'[\\p{L}\\p{M}\\p{N}_]+(?:\\.[\\p{L}\\p{M}\\p{N}_]+)*')) AS token FROM documents) t GROUP BY ALL",
        df="SELECT token, ln(((SELECT count(*) FROM documents) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS idf FROM tf GROUP BY token",
        weighted="SELECT tf.doc_id, tf.tf * df.idf AS w FROM tf JOIN df ON tf.token = df.token",
    ),
    "case_prompts": _with(
        _prompt_sql(), "flows", "anomalies",
        **_EVIDENCE_PARTS, alerts=_ALERTS, tcp_ips="SELECT DISTINCT log_name, unnest([src_ip, dst_ip]) AS ip FROM flows WHERE proto = 'tcp' "
        "OR log_name NOT IN (SELECT log_name FROM flows WHERE proto = 'tcp')",
        found=_EVIDENCE.replace("case_ips", "tcp_ips"),
        context_pairs=f"SELECT log_name, heuristic_text AS doc_id FROM ({_BY_CODE.replace('evidence e', 'found e')}) a "
        f"UNION ALL SELECT log_name, entry FROM ({_TAXONOMY.replace('evidence e', 'found e')}) b",
    ),
    "kb_alert_rows": _with(
        "SELECT 'ping_flood_alerts2' AS collection, doc_id, text, CAST(5 AS BIGINT) AS n_meta FROM pings "
        "UNION ALL SELECT 'syn_flood_alerts', doc_id, text, CASE type WHEN 'many_to_one' THEN 8 ELSE 7 END FROM syns",
        "flows", bursts=_BURSTS, **_SYN, pings=_PING_DOCS, syns=_SYN_DOCS,
    ),
    "report_fields": _with(_REPORT_FIELDS, "reports"),
    "verdict_first_sentence": f"SELECT doc_id, {_first_sentence()} AS verdict FROM documents",
    "verdict_syn_cascade": _with(
        f"SELECT log_name, {_cascade('state')} FROM (SELECT r.*, s.state FROM reports r LEFT JOIN states s ON r.log_name = s.log_name) j",
        "flows", "reports", states=_STATES,
    ),
    "verdict_syn_text_only": _with(f"SELECT log_name, {_cascade('CAST(NULL AS VARCHAR)')} FROM reports", "reports"),
    "verdict_strict": _with(
        f"SELECT log_name, CASE WHEN contains(text, 'UNDECIDABLE') THEN NULL ELSE {_first_sentence()} END AS verdict FROM reports", "reports"
    ),
    "confusion_metrics": _with(
        f"SELECT tp, tn, fp, fn, total, {_rounded('accuracy', 'precision', 'recall', 'f1_score')} FROM q", "flows", "reports",
        state_labels=_STATE_LABEL, outcomes=_OUTCOMES, said="SELECT label, CAST(verdict AS INT) AS prediction FROM outcomes", q=_quality("said"),
    ),
    "metric_intervals": _with(
        f"SELECT q.tp, q.tn, q.fp, q.fn, q.total, {", ".join(f"round(q.{c}, 6) AS {c}" for c in _METRICS)}, {_INTERVAL_COLUMNS} FROM q, spread", "flows", "reports",
        state_labels=_STATE_LABEL, outcomes=_OUTCOMES, said="SELECT log_name, label, CAST(verdict AS INT) AS prediction FROM outcomes", q=_quality("said"),
        drawn="SELECT said.*, r, CAST('0x' || substr(md5(log_name || ':' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT) AS u FROM said, range(1, 51) t(r) WHERE prediction IS NOT NULL",
        weighted=f"SELECT r, label, prediction, {_POISSON} AS w FROM drawn",
        # As many copies of a row as its weight.
        copies="SELECT r, label, prediction FROM weighted, range(1, 13) k(n) WHERE n <= w",
        by_replicate=_quality("copies", "r"),
        spread="SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{end}" for c in _METRICS for end, q in (("low", 0.025), ("high", 0.975))) + " FROM by_replicate",
    ),
    "roc_auc_binary": _with(
        "SELECT CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, round(auc, 6) AS auc FROM a", "flows", "reports",
        state_labels=_STATE_LABEL, outcomes=_OUTCOMES,
        said="SELECT 1 AS k, label, CAST(verdict AS INT) AS score FROM outcomes WHERE verdict IS NOT NULL", a=_area("said", "k"),
    ),
    "roc_curve": _with(
        "SELECT proto, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / CAST(sum(p) OVER (PARTITION BY proto) AS DOUBLE), 6) AS tpr, "
        "round(fp / CAST(sum(n) OVER (PARTITION BY proto) AS DOUBLE), 6) AS fpr FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g "
        "WINDOW w AS (PARTITION BY proto ORDER BY score DESC)) c", "flows",
        g="SELECT proto, duration AS score, count(*) FILTER (conn_state = 'S0') AS p, count(*) FILTER (conn_state <> 'S0') AS n FROM flows GROUP BY ALL",
    ),
    "roc_auc_scores": _with(
        "SELECT proto, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, round(auc, 6) AS auc FROM a", "flows",
        scored="SELECT proto, conn_state = 'S0' AS label, duration AS score FROM flows", a=_area("scored", "proto"),
    ),
    "model_comparison": _with(
        "SELECT metric, model, round(value, 4) AS value, value = max(value) OVER (PARTITION BY metric) AS is_best FROM long", "flows", "reports",
        state_labels=_STATE_LABEL, outcomes=_OUTCOMES, models=_MODEL_ROWS, q=_quality("models", "model"), a=_area("models", "model"),
        long=" UNION ALL ".join(
            f"SELECT q.model, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM q JOIN a ON q.model = a.model"
            for m in ("accuracy", "precision", "recall", "f1_score", "auc")
        ),
    ),
    "scenario_matrix": _with(
        f"SELECT attack, {_PERCENT} FROM q GROUP BY attack", "flows", "anomalies", **_FLOOD_PARTS, state_labels=_STATE_LABEL,
        cases=_scenario_rows(), q=_quality("cases", "attack, label_source"),
    ),
    "rule_ping_score": _with(
        f"SELECT log_name, {_DETECTED}, icmp_count, {_rounded('icmp_ratio', 'time_span')}, total_flows FROM ({_RULE_PING.format(window=86400)}) r", "flows"
    ),
    "rule_syn_score": _with(
        f"SELECT log_name, {_DETECTED}, s0_count, {_rounded('s0_ratio')}, tcp_count, {_rounded('syn_rate', 'time_span')} FROM ({_RULE_SYN.format(ratio=0.2)}) r",
        "flows",
    ),
    "scaled_features": _with(
        "SELECT log_name, " + ", ".join(
            f"round(CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0 END, 4) AS {c}"
            for c in _FEATURES
        ) + " FROM features", "flows", features=_features(),
    ),
    "ml_held_out": _with(
        "SELECT model, count(*) AS n, CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS n_attacks, min(log_name) AS first_log, true AS valid "
        "FROM state_labels, (VALUES ('svm'), ('random_forest'), ('mlp')) m(model) "
        "WHERE CAST('0x' || substr(md5(log_name), 1, 4) AS BIGINT) % 10 >= 8 GROUP BY model", "flows", state_labels=_STATE_LABEL,
    ),
    "ml_quality": _with(
        "SELECT model, n_train, n_test, true AS as_good_as_majority FROM (VALUES ('svm'), ('random_forest'), ('mlp'), ('svm_rbf')) m(model), "
        "(SELECT count(*) FILTER (b < 8) AS n_train, count(*) FILTER (b >= 8) AS n_test FROM "
        "(SELECT CAST('0x' || substr(md5(name), 1, 4) AS BIGINT) % 10 AS b FROM (SELECT DISTINCT log_name || '_' || dst_ip AS name FROM flows) c) x) n", "flows",
    ),
    "ml_svm_rbf": "SELECT count(*) AS n_test, true AS beats_linear, true AS nine_in_ten FROM embeddings "
    "WHERE CAST('0x' || substr(md5('p' || CAST(vec_id AS VARCHAR)), 1, 4) AS BIGINT) % 10 >= 8",
    "flood_window_counts": _with(
        "SELECT dst_ip, start_us, start_us + 43200000000 AS end_us, count(*) AS n FROM "
        "(SELECT dst_ip, (ts_us // 10800000000 - unnest(range(0, 4))) * 10800000000 AS start_us "
        f"FROM flows WHERE {_ECHO_TYPE}) w GROUP BY ALL HAVING count(*) >= 5", "flows",
    ),
}
