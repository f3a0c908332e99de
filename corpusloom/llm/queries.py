"""The queries of this subpackage by name, with their oracle SQL."""

from __future__ import annotations

from . import conversation_repair, embedding_dedup, exact_dedup, language_id, license_scan, nbest_pieces, packing, pii, simhash_dedup, source_divergence, suffix_dedup, toxicity, url_filter

MODULES = (exact_dedup, simhash_dedup, language_id, packing, nbest_pieces, toxicity, suffix_dedup, url_filter, embedding_dedup, license_scan, pii, source_divergence, conversation_repair)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
