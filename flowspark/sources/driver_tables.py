"""Binding of the shared analytics tables to the flow model.

None of the shared tables is a connection log, so flows, anomalies and rules
are projected from them row for row. The same text serves Spark and the SQL
check; only type names and the microsecond function differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.session import configure

_DIALECTS = {
    "spark": {"text": "STRING", "micros": "unix_micros(CAST(ts AS TIMESTAMP))"},
    "duckdb": {"text": "VARCHAR", "micros": "epoch_us(ts)"},
}

_FLOWS = """
SELECT event_id AS line_no,
       concat('conn_log_part_', CAST(CAST(floor(event_id / 108) AS BIGINT) + 1 AS {text})) AS log_name,
       {micros} AS ts_us,
       concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS {text}), '.', CAST(user_id % 256 AS {text})) AS src_ip,
       CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 8 ELSE 0 END
                       ELSE CAST(1024 + event_id % 50000 AS INT) END AS src_port,
       concat('192.0.2.', CAST(CAST(floor(event_id / 2) AS BIGINT) % 8 AS {text})) AS dst_ip,
       CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 0 ELSE 8 END
                       WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 53 ELSE 22 END AS dst_port,
       CASE event_type WHEN 'error' THEN 'icmp' WHEN 'purchase' THEN 'udp' ELSE 'tcp' END AS proto,
       value AS duration,
       CAST(floor(value) AS BIGINT) AS orig_bytes,
       CAST(floor(value / 2) AS BIGINT) AS resp_bytes,
       CASE CAST(floor(value) AS BIGINT) % 6 WHEN 0 THEN 'S0' WHEN 1 THEN 'SF' WHEN 2 THEN 'REJ'
            WHEN 3 THEN 'RSTO' WHEN 4 THEN 'SH' ELSE 'OTH' END AS conn_state,
       CAST(1 + event_id % 7 AS BIGINT) AS orig_pkts,
       CAST(event_id % 5 AS BIGINT) AS resp_pkts
FROM events
"""

# Anomaly records: one per customer; addresses of both ends overlap those of the
# flows, and some addresses have many records.
_ANOMALIES = """
SELECT c_custkey AS row_no,
       CASE WHEN c_custkey % 11 = 3 THEN NULL
            WHEN c_custkey % 5 = 1 THEN concat('10.0.0.', CAST(c_custkey % 7 AS {text}))
            ELSE concat('10.0.', CAST(CAST(floor(c_custkey / 256) AS BIGINT) AS {text}), '.',
                        CAST(c_custkey % 256 AS {text})) END AS srcIP,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1024 + c_custkey % 50000 AS INT) END AS srcPort,
       CASE WHEN c_custkey % 7 = 2 THEN NULL
            WHEN c_custkey % 13 = 5 THEN concat('192.0.2.', CAST(c_custkey % 64 AS {text})) ELSE concat('198.51.100.', CAST(c_custkey % 200 AS {text})) END AS dstIP,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 443 WHEN 'MACHINERY' THEN 80 WHEN 'BUILDING' THEN 22
            WHEN 'AUTOMOBILE' THEN 53 ELSE NULL END AS dstPort,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'ntscSYN' WHEN 'MACHINERY' THEN 'alphflHTTP' WHEN 'BUILDING' THEN 'ptpDoS'
            WHEN 'AUTOMOBILE' THEN 'ntscIC' ELSE NULL END AS taxonomy,
       CASE c_nationkey % 6 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN 499 WHEN 3 THEN 500 WHEN 4 THEN 899 ELSE 900 END AS heuristic,
       CASE WHEN c_acctbal < 0 THEN 'anomalous' ELSE 'suspicious' END AS label
FROM customer
"""

# Wildcard rules: one per supplier; fifteen of the sixteen NULL patterns occur.
_RULES = """
SELECT s_suppkey AS rule_no,
       CASE WHEN (s_suppkey % 15 + 1) % 2 = 1
            THEN concat('10.0.', CAST(CAST(floor(s_suppkey / 256) AS BIGINT) AS {text}), '.', CAST(s_suppkey % 256 AS {text}))
            END AS srcIP,
       CASE WHEN CAST(floor((s_suppkey % 15 + 1) / 2) AS BIGINT) % 2 = 1
            THEN CAST(CASE WHEN s_nationkey % 2 = 0 THEN 8 ELSE 1024 + s_suppkey % 50000 END AS {text}) END AS srcPort,
       CASE WHEN CAST(floor((s_suppkey % 15 + 1) / 4) AS BIGINT) % 2 = 1
            THEN concat('192.0.2.', CAST(s_suppkey % 64 AS {text})) END AS dstIP,
       CASE WHEN CAST(floor((s_suppkey % 15 + 1) / 8) AS BIGINT) % 2 = 1
            THEN CAST(CASE s_nationkey % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 8 ELSE 9999 END AS {text}) END AS dstPort
FROM supplier
"""

# Written verdicts, in the shapes the verdict rules tell apart: one per log, but
# none for a log that opens with UDP, so that missing reports occur too.
_REPORTS = """
SELECT log_name,
       CASE n % 8
         WHEN 0 THEN concat('- SYN flood alert: TCP SYN flood attempt from ', src_ip, ' to ', dst_ip, ' on port ',
                            CAST(dst_port AS {text}), ' showing ', conn_state, ' flag.', chr(10),
                            '  Justified by anomaly: Matched anomaly ID anomaly_', CAST(n AS {text}), ', heuristic 10.', chr(10),
                            '  → Action: Block ', src_ip, ' and rate-limit port ', CAST(dst_port AS {text}), '.')
         WHEN 1 THEN concat('Ping flood alert: Burst seen in conn.log against ', dst_ip, '. It may not be an attack.', chr(10),
                            'Justified by anomaly: none given.', chr(10), '→ Action: Watch ', dst_ip, '.')
         WHEN 2 THEN concat('⚠️ **UNDECIDABLE** - Insufficient evidence for ', src_ip, '.', chr(10),
                            '**Reason:** Maximum similarity score (0.29) is below threshold (0.3).')
         WHEN 3 THEN concat('There is no SYN flood from ', src_ip, ' to ', dst_ip, '. Normal traffic.')
         WHEN 4 THEN concat('- SYN flood alert: raw row ', dst_ip, ' tcp - - 0 0 ', conn_state, ' F F seen.', chr(10),
                            '  Justified by anomaly: anomaly_', CAST(n AS {text}), '.', chr(10), '  → Action: Drop.')
         WHEN 5 THEN concat('TCP SYN flood detected against ', dst_ip, ' on port ', CAST(dst_port AS {text}), '. State unclear.')
         WHEN 6 THEN concat('Traffic to ', dst_ip, ' ended with reset received. Attack ruled out.')
         ELSE '' END AS text
FROM (SELECT log_name, min(CAST(floor(line_no / 108) AS BIGINT)) AS n, min_by(src_ip, line_no) AS src_ip,
             min_by(dst_ip, line_no) AS dst_ip, min_by(dst_port, line_no) AS dst_port,
             min_by(conn_state, line_no) AS conn_state, min_by(proto, line_no) AS proto
      FROM ({flows}) f
      GROUP BY log_name) g
WHERE proto <> 'udp'
"""

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def flows_sql(dialect: str) -> str:
    return _FLOWS.format(**_DIALECTS[dialect])


def anomalies_sql(dialect: str) -> str:
    return _ANOMALIES.format(**_DIALECTS[dialect])


def rules_sql(dialect: str) -> str:
    return _RULES.format(**_DIALECTS[dialect])


def reports_sql(dialect: str) -> str:
    return _REPORTS.format(flows=flows_sql(dialect), **_DIALECTS[dialect])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {name}\n", "FROM {source}\n"), source=table(spark, sf_dir, name))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "events", flows_sql("spark"))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "customer", anomalies_sql("spark"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "supplier", rules_sql("spark"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "events", reports_sql("spark"))
