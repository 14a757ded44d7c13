"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import byte_bpe, decontamination, exact_dedup, filter_audit, html_text, language_id, licenses, mixing, phrases, sharding, simhash, substring_dedup, warc

MODULES = (mixing, language_id, exact_dedup, html_text, sharding, substring_dedup, decontamination, warc, simhash, licenses, phrases, byte_bpe, filter_audit)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
