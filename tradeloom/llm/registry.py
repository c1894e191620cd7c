"""All queries of the subpackage."""

from . import chat_format, decontaminate, html_text, license_scan, line_dedup, near_dedup, packing, periodic_runs, phrases, quality_rules, suffix_dedup, token_files, toxicity

_MODULES = (quality_rules, line_dedup, packing, near_dedup, chat_format, suffix_dedup, html_text, toxicity, decontaminate, license_scan, periodic_runs, phrases, token_files)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
