"""The registered queries of this folder, and their SQL where there is one."""

from __future__ import annotations

import importlib

_MODULES = {
    "op5_quality_lines": ("quality_lines", "OP5_SQL"),
    "op1_secrets": ("secret_scan", "OP1_SQL"),
    "op2_near_copies": ("near_copies", "OP2_SQL"),
    "op3_mixing": ("mixing", "OP3_SQL"),
    "op4_html": ("html_blocks", None),
    "op6_token_files": ("token_files", None),
    "op7_url_filter": ("url_filter", None),
    "op8_warc": ("warc", "OP8_SQL"),
    "op9_decontaminate": ("decontaminate", "OP9_SQL"),
    "op10_pii": ("pii", None),
    "op11_source_audit": ("source_audit", "OP11_SQL"),
    "op12_centroids": ("centroids", "OP12_SQL"),
    "op13_simhash": ("simhash", None),
}

QUERIES, CHECKS = {}, {}
for _name, (_module, _sql) in _MODULES.items():
    _loaded = importlib.import_module(f"flowspark.llm.{_module}")
    QUERIES[_name] = getattr(_loaded, _name)
    if _sql:
        CHECKS[_name] = getattr(_loaded, _sql)
